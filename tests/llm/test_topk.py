import numpy as np

from tessera.llm.topk import Lists, Reads, exact_top_k


def brute(rows, k, every):
    out = []
    ok = {i: np.floor(1024.0 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q, a in ok.items():
        if q % every:
            continue
        s = sorted(((-int(a @ b), i) for i, b in ok.items() if i != q))[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(700)]
    rows += [(i, [0.5] * 8) for i in range(700, 900)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (1000, [float("inf")] * 8), (None, [1.0] * 8), (1100, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, b int")
    want = brute(rows, 10, 100)
    for block, queries in ((4096, 512), (100, 3)):
        got = sorted(tuple(r) for r in exact_top_k(df, block=block, query_block=queries).collect())
        assert got == want


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(df).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert exact_top_k(df.limit(0)).count() == 0


def test_reading_stops_early():
    rng = np.random.default_rng(2)
    ids, size = np.arange(3000), rng.permutation(3000)
    q = rng.integers(1, 9, 16)
    # vectors that are large or small as a whole: few can qualify, and they stand near the heads of all lists
    vectors = size[:, None] + rng.integers(0, 40, (3000, 16))
    lists, reads = Lists(ids, vectors), Reads()
    assert not hasattr(lists, "vectors")
    at, scores = lists.top(q, 3, 10, reads)
    assert reads.left == 10 and reads.depth < 1500 and reads.entries <= 16 * 1500
    assert list(zip((-scores).tolist(), lists.ids[at].tolist(), strict=True)) == sorted((-int(v @ q), i) for i, v in enumerate(vectors) if i != 3)[:10]
    # directions without a preferred end: outsiders are out only when the lists have been read to the end, and every read counts
    vectors = rng.integers(-9, 9, (3000, 16))
    vectors[:20] *= 100
    lists, reads = Lists(ids, vectors), Reads()
    at, scores = lists.top(vectors[3], 3, 10, reads)
    want = sorted((-int(v @ vectors[3]), i) for i, v in enumerate(vectors) if i != 3)[:10]
    assert list(zip((-scores).tolist(), lists.ids[at].tolist(), strict=True)) == want
    assert reads.left < 3000 and reads.entries == 3000 * np.count_nonzero(vectors[3])


def test_scores_are_sums_of_reads():
    rng = np.random.default_rng(4)
    for n, d, k in ((5, 3, 10), (40, 1, 3), (200, 7, 10), (1000, 5, 1)):
        vectors = rng.integers(-50, 50, (n, d))
        for q in (*vectors[:3], np.zeros(d, dtype=np.int64), np.abs(vectors[0])):
            at, scores = Lists(np.arange(n), vectors).top(q, 1, k)
            want = sorted((-int(v @ q), i) for i, v in enumerate(vectors) if i != 1)[:k]
            assert list(zip((-scores).tolist(), at.tolist(), strict=True)) == want
