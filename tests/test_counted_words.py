"""Embeddings of hashed words: words are counted where they are read."""

import contextlib
import hashlib
import io
import math

from tessera.operators.retrieval import hash_embedding


def test_words_are_not_shuffled(spark):
    texts = [(1, "Ab  ab\tcd\nÉté\x0b\x0cx"), (2, None), (3, " \n "), (4, ""), (1, "ab zz"), (None, "y"), (5, "a b a b"), (6, "w " * 3000)]
    got = hash_embedding(spark.createDataFrame(texts, "id long, text string"), 16)
    want = {}
    for i, t in texts:
        for w in (t or "").lower().replace(" ", "\0").split():
            w = w.replace("\0", " ")
            v = want.setdefault(i, [0] * 16)
            v[int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 16] += 1
    want = {i: [n / math.sqrt(sum(m * m for m in v)) for n in v] for i, v in want.items()}
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        got.explain()
    assert {r.id: r.vector for r in got.collect()} == want
    assert "Generate" not in plan.getvalue() and plan.getvalue().count("Exchange") == 1
