"""Traces of many origins that go on from the same vertices."""

import random

from tessera.functions import paths as P
from tessera.operators import graph as G
from tessera.plans import graph_queries as Q


def search(edges, origin, start, depth, kinds):
    out, front = {start: 0}, {start}
    for d in range(1, depth + 1):
        front = {b for a, b, t, _ in edges if a is not None and a in front and t in kinds} - set(out)
        out |= dict.fromkeys(front, d)
    return {(origin, x, d) for x, d in out.items()}


def test_trace_equals_a_search(spark, monkeypatch):
    monkeypatch.setattr(G, "MANY", 1)  # bits of identifiers, several cells and lists of few
    monkeypatch.setattr(G, "PAIRS", 7)
    monkeypatch.setattr(G, "LISTED", 2)
    for seed in range(3):
        rng = random.Random(seed)
        name = lambda: f"v{int(rng.random() ** 2 * 16)}"
        edges = [(name(), name(), rng.choice(["CALLS", "IMPORTS", "OTHER"]), i) for i in range(40)] + [("v1", None, "CALLS", 40), (None, "v2", "CALLS", 41), ("v3", "v3", "CALLS", 42), ("v3", "v4", "CALLS", 43), ("v3", "v4", "CALLS", 44)]
        start = [(f"v{i}", f"v{i}") for i in range(20)] * 2
        e, s = spark.createDataFrame(edges, "src string, dst string, type string, ord long"), spark.createDataFrame(start, "origin string, id string")
        for depth in (1, 2, 3, 4):
            got = sorted((r.origin, r.id or "", r.depth) for r in G.trace(e, s, ["CALLS", "IMPORTS"], depth).collect())
            assert got == sorted((o, x or "", d) for o, i in set(start) for o, x, d in search(edges, o, i, depth, ["CALLS", "IMPORTS"])), (seed, depth)


def test_trace_of_nothing(spark):
    e = spark.createDataFrame([], "src string, dst string, type string, ord long")
    s = spark.createDataFrame([("a", "a")], "origin string, id string")
    assert G.trace(e, s, ["CALLS"], 3).collect() == [("a", "a", 0)] and G.trace(e, s.where("false"), ["CALLS"], 3).collect() == []


def test_call_trace_writes_no_pairs_of_origins(spark, monkeypatch):
    """What is written grows with what lies behind the vertices in the middle, not with that times the origins before them."""
    written, plain = [], G.stored
    monkeypatch.setattr(G, "stored", lambda df, name: written.append(plain(df, name)) or written[-1])
    edges = [(f"o:{i}", "p:0", P.DEPENDENCY[i % 3], i) for i in range(300)] + [("p:0", f"s:{i}", "IMPLEMENTS", 1000 + i) for i in range(20)] + [(f"s:{i}", "n:0", "INHERITS", 2000 + i) for i in range(20)]
    monkeypatch.setattr(Q.I, "edges", lambda *_: spark.createDataFrame(edges, "src string, dst string, type string, ord long"))
    monkeypatch.setattr(Q.I, "vertices", lambda *_: None)
    monkeypatch.setattr(Q.I, "table", lambda *_: spark.range(300).withColumnRenamed("id", "o_orderkey"))
    assert Q.call_trace(spark, "").count() == 300 * 23
    assert sum(df.count() for df in written) < 300
