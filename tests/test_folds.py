"""Folds that go over from one partition to the next, against a plain loop."""

import random

from tessera.operators import retrieval as R
from tessera.operators import state as ST
from tessera.operators.folds import sorted_fold


def mixed_rows(n=3000, seed=2):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None, "warm", "warm"]
    return [(rng.choice(keys), i, rng.randint(0, 9)) for i in range(n)]


def plain(rows):
    """Every number that is larger than what is kept is kept and told; a nine starts anew."""
    out, last = [], {}
    for key, i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        kept = last.get(key, 0)
        if x > kept:
            out.append((key, i, x))
        last[key] = 0 if x == 9 else max(kept, x)
    return out, last


def fold(df, partitions):
    def step(state, row):
        x = row["x"]
        found = [(row["key"], row["i"], x)] if x > state["kept"] else []
        state["kept"] = 0 if x == 9 else max(state["kept"], x)
        return found

    return sorted_fold(df, ["key"], ["i"], lambda key: {"kept": 0}, step, lambda key, state: [(*key, -1, state["kept"])], "key string, i long, x long", partitions)


def test_a_hot_key_goes_over_all_partitions(spark):
    rows = mixed_rows()
    told, last = plain(rows)
    df = spark.createDataFrame(rows, "key string, i long, x long")
    for partitions in (1, 9):
        got = [tuple(r) for r in fold(df, partitions).collect()]
        assert sorted(map(str, got)) == sorted(map(str, told + [(k, -1, x) for k, x in last.items()]))
    assert fold(df.limit(0), 3).count() == 0
    one = [("only", i, i % 10) for i in range(500)]
    assert len([r for r in fold(spark.createDataFrame(one, "key string, i long, x long"), 9).collect() if r.i < 0]) == 1


def test_greedy_packing_with_a_hot_query(spark):
    rng = random.Random(5)
    rows = [(q, k, "kind", "v" * rng.randint(0, 60), "s") for q, n in (("hot", 2000), ("b", 40), ("c", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "query_id string, rank int, kind string, value string, source string")
    got = {r.query_id: (r.used, list(r.picked)) for r in R.pack_greedy(df, 900, 14, partitions=7).collect()}
    for q in ("hot", "b", "c"):
        used, picked = 0, []
        for _, rank, kind, value, source in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            cost = len(kind) + len(value) + len(source) + 16
            if not picked or (used + cost <= 900 and len(picked) < 14):
                used, picked = used + cost, [*picked, rank]
        assert got[q] == (used, picked)


def test_semantic_state_with_ties_in_time(spark):
    rng = random.Random(7)
    rows = [("p", "s" if i % 3 else f"s{i % 5}", "k", f"v{i}", rng.randint(1, 4), i, rng.randint(0, 3), rng.random()) for i in range(1500)]
    df = spark.createDataFrame(rows, "project string, scope string, kind string, text string, ts long, seq long, session long, confidence double")
    state = {}
    for r in sorted(rows, key=lambda r: r[5]):
        old = state.get(r[1])
        if old is None or r[4] > old[4] or (r[4] == old[4] and (r[6] == old[6] or r[7] >= old[7])):
            state[r[1]] = r
    got = {r.scope: (r.value, r.confidence, r.seen) for r in ST.semantic_state(df, partitions=6).collect()}
    assert got == {s: (r[3], r[7], sum(x[1] == s for x in rows)) for s, r in state.items()}
