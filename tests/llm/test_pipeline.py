"""The pipeline against a plain version of every stage, each on its own input."""

import hashlib
import math
from collections import Counter

import corpus_pipeline
from tessera.llm import langid, mixing
from tessera.llm.common import stored, table
from test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF), name)
        seen.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]))
        if name != "bpe":
            assert out.columns == columns
        docs = out
    by = {name: (a, b) for name, a, b in seen}

    a, b = by["language_id"]
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a if langid.has_letter(r["text"] or "")}

    a, b = by["exact_dedup"]
    best = {}
    for r in a:
        best[low(r["text"])] = max(best.get(low(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in b) == sorted(best.values())

    a, b = by["ngram_join"]
    classes = brute([(r["doc_id"], r["text"]) for r in a], 5, 4, 5)
    assert sorted(r["doc_id"] for r in b) == sorted(i for i, _, c in classes if i == c)

    a, b = by["mixing"]
    sizes = Counter()
    pool = lambda r: r["source"] if r["source"] in mixing.WEIGHTS else None
    for r in a:
        sizes[pool(r)] += len((r["text"] or "").encode())
    used = {s: w for s, w in [*mixing.WEIGHTS.items(), (None, mixing.REST)] if sizes[s]}
    want = Counter()
    for r in a:
        rate = mixing.SCALE * (used[pool(r)] / sum(used.values())) * sum(sizes.values()) / sizes[pool(r)]
        u = int(hashlib.sha256(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2**mixing.BITS
        count, term = 0, math.exp(-rate)
        total = term
        while total <= u:
            count += 1
            term *= rate / count
            total += term
        want[r["doc_id"]] = count
    assert Counter(r["doc_id"] for r in b) == +want

    a, b = by["bpe"]
    texts = {r["doc_id"]: r["text"] or "" for r in a}
    assert Counter(r["doc_id"] for r in b) == Counter(r["doc_id"] for r in a)
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in b)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None
