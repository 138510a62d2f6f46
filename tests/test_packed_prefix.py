"""Facts are reduced before they meet intents, and groups whose first items fit need no fold."""

import pytest

from tessera.operators import answers as A
from tessera.operators import retrieval as R


def items(spark):
    rows = [("a", i, "k", "v" * (i % 7), "s") for i in range(40)] + [("b", 0, "k", "v" * 500, "s")]
    return spark.createDataFrame(rows, "query_id string, rank int, kind string, value string, source string")


def test_groups_whose_first_items_fit_need_no_fold(spark, monkeypatch):
    monkeypatch.setattr(R, "sorted_fold", lambda *a: pytest.fail("folded"))
    got = {r.query_id: (r.used, list(r.picked)) for r in R.pack_greedy(items(spark), 300, 5).collect()}
    assert got == {"a": (5 * 18 + 10, [0, 1, 2, 3, 4]), "b": (518, [0])}


def test_groups_that_skip_items_are_folded(spark):
    rows = [("a", 0, "k", "v" * 10, "s"), ("a", 1, "k", "v" * 100, "s"), ("a", 2, "k", "v" * 10, "s"), (None, 0, "k", "v" * 99, "s"), (None, 1, "k", "v" * 99, "s"), ("c", 0, "k", "", "s")]
    got = {r.query_id: (r.used, list(r.picked)) for r in R.pack_greedy(spark.createDataFrame(rows, "query_id string, rank int, kind string, value string, source string"), 60, 2).collect()}
    assert got == {"a": (56, [0, 2]), None: (117, [0]), "c": (18, [0])}


def test_facts_are_reduced_before_they_meet_intents(spark, monkeypatch):
    """Of 400 equal facts one is looked at, whatever the number of intents; of equal ones at one place the same is shown each time."""
    seen = []
    facts = [("p", "task", f"Say{' ' * (i % 3 + 1)}it", "checkpoint", i // 3) for i in range(400)] + [("p", "task", "say it", "handoff", None)]
    asked = spark.createDataFrame([("p", i) for i in ("current_task", "status", "summary")], "project string, intent string")
    data = spark.createDataFrame(facts, "project string, kind string, value string, source string, place long")
    monkeypatch.setattr(A, "stored", lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or df)
    got = A.ranked_facts(asked, data).collect()
    assert sorted((r.intent, r.value, r.source) for r in got) == [(i, "Say   it", "checkpoint") for i in ("current_task", "status", "summary")]
    plan = dict(seen)["ranks"]
    assert plan.index("Join") < plan.rindex("Aggregate [project")
