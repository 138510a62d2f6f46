"""Identifiers that are no numbers give the same groups and removals as numbers do."""

import random

from tessera.llm.ngram_join import drop_similar, ngram_join
from tessera.llm.repeats import remove_repeats


def test_string_identifiers(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(120)] for _ in range(8)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:60], word(), *b[60:]]) for b in base[:4]] + [None, "", "one two"]
    names = [f"doc-{i:02}" for i in range(len(texts))]
    numbers = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    strings = spark.createDataFrame([*zip(names, texts, strict=True), (None, texts[0])], "doc_id string, text string")
    want = {names[r.doc_id]: (r.n_shingles, names[r.component_id]) for r in ngram_join(numbers).collect()}
    got = ngram_join(strings).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want and len(got) == len(texts) + 1
    assert len({c for _, c in want.values()}) == len(texts) - 4
    kept = drop_similar(strings, 3, 9, 10)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {c for _, c in want.values()} | {None}
    plain = {names[r.doc_id]: (r.n_bytes, bytes(r.kept)) for r in remove_repeats(numbers, length=40, gram=16, block=8).collect()}
    own = remove_repeats(strings.where("doc_id IS NOT NULL"), length=40, gram=16, block=8)
    assert {r.doc_id: (r.n_bytes, bytes(r.kept)) for r in own.collect()} == plain and any(len(k) < n for n, k in plain.values())
