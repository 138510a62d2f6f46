"""Whitening and its eigenpairs against numpy's own solver."""

import numpy as np
import pytest

from tessera.llm.tridiagonal import below, householder, leading
from tessera.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>, component string, n string, v string, id string"


def plain(rows, k=32):
    kept = [(i, [0.0 if x is None else float(np.float32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] + [1_000_000] * (d - len(v)) for _, v in kept], dtype=object)
    n, s = len(kept), x.sum(axis=0)
    dev = ((n * x - s) ** 2).sum(axis=1)
    y = ((n * x - s).astype(np.float64)) / n
    e, w = np.linalg.eigh(y.T @ y / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return [i for i, _ in kept], n, dev, (y @ w) / np.sqrt(e), e / np.trace(y.T @ y / n)


@pytest.mark.parametrize("kind", ["random", "clustered", "identity", "split", "zero", "low rank", "tiny", "pairs"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(3)
    for d in (1, 2, 3, 20, 70):
        q = np.linalg.qr(rng.standard_normal((d, d)))[0]
        e = {"random": rng.random(d), "clustered": 1 + 1e-9 * rng.random(d), "identity": np.ones(d), "split": rng.random(d), "zero": np.zeros(d), "low rank": (np.arange(d) < 3) * 2.0, "tiny": 1e-200 * rng.random(d), "pairs": np.repeat(np.arange(d), 2)[:d] + 1.0}[kind]
        a = np.diag(e) if kind in ("split", "identity") else (q * e) @ q.T
        a = (a + a.T) / 2
        values, rows = leading(a, 32)
        k, scale = min(32, d), max(np.abs(a).max(), 1e-300)
        assert values.shape == (k,) and np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * d * scale
        assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12 and np.abs(rows @ a - values[:, None] * rows).max() <= 1e-13 * d * scale


def test_counts_of_the_sturm_sequence():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    diagonal, off, _ = householder(a)
    at = np.linspace(-20, 20, 101)
    assert (below(diagonal, off, at) == (np.linalg.eigvalsh(a)[None, :] < at[:, None]).sum(axis=1)).all()


def test_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((500, 40)) @ rng.standard_normal((40, 40)) * 0.3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(900, None), (901, [None] + [0.5] * 39), (902, [float("nan")] * 40), (903, [float("inf")] * 40), (904, [0.25] * 7), (905, []), (None, [float(x) for x in base[0]]), (3, [float(x) for x in base[3]])]
    rows += [(1000 + i, [0.125] * 40) for i in range(200)]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    ids, n, dev, z, explained = plain(rows)
    for parts in (1, 7):
        got = whiten(df.repartition(parts)).collect()
        assert len(got) == len(ids) * 32 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9
        sign = {}
        want = {}
        for i, x, row in zip(ids, dev, z, strict=True):
            want.setdefault(i, (int(x), row))
        for r in got:
            x, row = want[r.vec_id]
            assert r.deviation == x and abs(r.explained / explained[r.component - 1] - 1) < 1e-9
            if abs(row[r.component - 1]) > 0.1:
                sign.setdefault(r.component, np.sign(row[r.component - 1]) * np.sign(r.whitened))
            assert abs(sign.get(r.component, 1) * r.whitened - row[r.component - 1]) < 1e-7 or r.component not in sign
        assert len(sign) == 32


def test_defined_results_at_the_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert whiten(empty).count() == 0 and whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whiten(spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<double>")).count() == 0
    one = whiten(spark.createDataFrame([("x", [1.0, 2.0])], "vec_id string, embedding array<double>")).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [("x", 1, 1, 0, None, None, None), ("x", 2, 1, 0, None, None, None)]
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and line[0].identity_error < 1e-12 and len(line) == 27
    big = whiten(spark.createDataFrame([(1, [1e15]), (2, [-1e15]), (3, [1e300])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.deviation) for r in big} == {(1, None), (2, None)} and {round(abs(r.whitened), 9) for r in big} == {1.0}
    fine = whiten(spark.createDataFrame([(1, [1e9]), (2, [-1e6])], "vec_id long, embedding array<double>")).collect()
    wanted = (64 * 10**9 + 64 * 10**6) ** 2
    assert all(r.deviation == (wanted if wanted < 1 << 63 else None) for r in fine)
    with pytest.raises(Exception, match="at most 2048"):
        whiten(spark.createDataFrame([(1, [0.0] * 3000)], "vec_id long, embedding array<double>")).collect()
