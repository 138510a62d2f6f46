"""Answers from facts, and procedures from files where there are no steps."""

from tessera.operators.answers import local_answers
from tessera.operators.skills import skills

FACTS = "project string, kind string, value string, source string, place long"


def ask(spark, facts, *questions, **how):
    q = spark.createDataFrame([(str(i), "p", x) for i, x in enumerate(questions)], "ask string, project string, question string")
    got = {int(r.ask): (r.intent, r.answer, r.source) for r in local_answers(q, spark.createDataFrame(facts, FACTS), **how).collect()}
    return [got[i] for i in range(len(questions))]


def test_bounds_by_kind_and_order_of_the_intent(spark):
    facts = [("p", "todo", f"t{i}", "work-state", i) for i in range(5)] + [("p", "task", "one", "work-state", 9), ("p", "task", "two", "session-origin", 0), ("p", "blocker", "B", "work-state", 1), ("p", "blocker", " b ", "checkpoint", 50), ("q", "task", "other", "handoff", 0)]
    got = ask(spark, facts, "todo list", "blocker?", "đã quyết định gì", "current task")
    assert got[0] == ("summary", "TODO: t0\nTODO: t1\nTODO: t2\nTask hiện tại: two", "session-origin")
    assert got[1] == ("blocker", "Blocker:  b ", "checkpoint")
    assert got[2] == ("decision", None, "none")
    assert got[3] == ("current_task", "Task hiện tại: two", "session-origin")


def test_what_was_handed_over_is_canonical(spark):
    facts = [("p", "task", "stale", "work-state", 0), ("p", "file", "old.ts", "session-origin", 0), ("p", "task", "now", "handoff", 3), ("p", "rule", "no force", "checkpoint", 4), ("p", "decision", "gone", "checkpoint", 0)]
    assert ask(spark, facts, "what?") == [("summary", "Task hiện tại: now\nQuy tắc: no force", "handoff")]
    small = [("p", "task", "x" * 50, "work-state", 0), ("p", "file", "y" * 50, "work-state", 0), ("p", "todo", "z", "work-state", 0)]
    assert ask(spark, small, "what?", budget=120) == [("summary", "Task hiện tại: " + "x" * 50 + "\nTODO: z", "work-state")]


def test_files_stand_for_steps(spark):
    events = [("p", 1, k, "note", f'{{"path":"src/{k}.ts"}}') for k in range(10)] + [("p", 2, 0, "note", "{}")]
    tasks = [(1, "do it", 0, True), (2, "do that", 0, True)]
    got = skills(spark.createDataFrame(events, "project string, session long, seq long, type string, data string"), spark.createDataFrame(tasks, "session long, task string, place long, completed boolean")).collect()
    assert [(r.task, list(r.steps)) for r in got] == [("do it", [f"Update src/{k}.ts" for k in range(8)])]
