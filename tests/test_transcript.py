"""Transcripts, learnt memories, tool signals and handed-over state on small cases."""

import json

from pyspark.sql import functions as F

from tessera.functions import transcript as R
from tessera.operators import handoff as H
from tessera.operators import learned as L
from tessera.operators import session as E
from tessera.operators import tools as O


def column(spark, values, expr):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, t string")
    return [r[0] for r in rows.select("i", expr(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_lines_of_a_transcript(spark):
    noise = ["", "  ", "<SYSTEM MESSAGE> x", "<ephemeral>", "Task 12 status: ok", "thought for 3 tokens", "npm warn old", "added 3 packages", "77% done", "[============]", "processing...", "bash-5.1$ ls", "$ ls", "up to date, must not stay"]
    kept = ["We added 3 packages", "npm install", "[===]", "the $ sign", "Task one status:"]
    assert column(spark, noise + kept, R.is_noise) == [True] * len(noise) + [False] * len(kept)
    assert column(spark, ["we decided it", "a BUG", "npm notice error", "plain words"], R.is_durable) == [True, True, False, False]
    assert column(spark, ["API-key: abc d", "token==x", "Bearer  q", "Authorization: Bearer q", "no"], R.masked) == ["API-key: [REDACTED] d", "token: [REDACTED]", "Bearer: [REDACTED]", "Authorization: [REDACTED] [REDACTED]", "no"]
    texts = spark.createDataFrame([(1, "a\nA\n$ x\n a\nb"), (2, None), (3, "$ ls")], "id long, text string")
    assert {r.id: r.text for r in E.kept_transcripts(texts, 2).collect()} == {1: "a\nA\nb", 2: "", 3: ""}
    assert column(spark, ["ok\nmy token\nPASS=1\nend"], R.without_sensitive_lines) == ["ok\nend"]


def test_data_of_events(spark):
    data = json.dumps({"a": "npm notice", "b": [" token=x ", "$ ls", {"c": "up to date", "d": None}], "n": 3, "thinking": "x", "r": {"type": "Reasoning", "t": 1}})
    assert json.loads(column(spark, [data], R.kept_data)[0]) == {"b": ["token: [REDACTED]", {"d": None}], "n": 3, "thinking": "x", "r": {"type": "Reasoning", "t": 1}}
    assert json.loads(column(spark, [data], R.without_reasoning)[0]) == {"a": "npm notice", "b": [" token=x ", "$ ls", {"c": "up to date", "d": None}], "n": 3, "r": {"type": "Reasoning", "omitted": "[private reasoning omitted]"}}
    assert column(spark, [None, "{"], R.kept_data) == [None, "{"]


def test_kinds_of_memories(spark):
    cases = {
        ("You must not do that", "user", "x"): ("rule", 0.98), ("always do that", "user", "x"): ("rule", 0.92), ("always do that", "assistant", "x"): None, ("We decided on the schema", "user", "x"): ("architecture", 0.93),
        ("we will use it", "assistant", "x"): ("decision", 0.86), ("the next step is here", "user", "x"): ("todo", 0.87), ("store it in the pipeline", "assistant", "x"): ("architecture", 0.82), ("it was fixed today", "assistant", "x"): ("fix", 0.8),
        ("the port is there", "user", "x"): ("context", 0.79), ("anything", "", "todo"): ("todo", 1.0), ("Không Được xóa", "", "user_prompt"): ("rule", 0.98), ("éuse the pipeline", "user", "x"): ("architecture", 0.88), ("reuse the pipeline", "user", "x"): None,
    }
    rows = spark.createDataFrame([(*k,) for k in cases], "t string, role string, type string")
    got = {(r.t, r.role, r.type): r.k and tuple(r.k) for r in rows.withColumn("k", L.learnt_kind(F.col("t"), F.col("role"), F.col("type"))).collect()}
    assert got == cases


def test_learning_once_and_roles_by_message(spark):
    rows = [(1, "a", 1, None, "m", "- We must  never push"), (2, "a", 2, "user", "m", "we MUST never push!"), (3, "b", 3, "user", "n", "We must never push"), (4, "a", 4, "user", "z", None)]
    events = spark.createDataFrame([(f"e{i}", s, q, r, m, t) for i, s, q, r, m, t in rows], "id string, session string, seq long, role string, message string, text string")
    events = events.withColumn("project", F.lit("p")).withColumn("agent", F.lit("g")).withColumn("source_event", F.lit(None).cast("string")).withColumn("ts", F.lit("t")).withColumn("type", F.lit("x"))
    got = sorted((r.session, r.event, r.content, r.kind, r.importance) for r in L.learnt(events).collect())
    assert got == [("a", "e1", "We must never push", "rule", "critical"), ("b", "e3", "We must never push", "rule", "critical")]
    assert L.learnt(events.limit(0)).count() == 0


def test_signals_of_tools(spark):
    data = [{"tool": "apply_patch", "input": "*** Add File: a.ts\n*** Update File: b.ts", "path": "c.ts"}, {"args": json.dumps({"cmd": "npm test"}), "code": "1"}, {"command": "tsc", "message": "0 failed, passed"}, {"x": 1}]
    events = spark.createDataFrame([(i, "tool_call", json.dumps(x)) for i, x in enumerate(data)] + [(9, "file_edit", "{")], "id long, type string, data string")
    got = {(r.id, r.kind, r.text, r.action, r.check_kind, r.check_status) for r in O.signals(events).collect()}
    assert got == {
        (0, "file", "c.ts", "modified", None, None), (0, "file", "a.ts", "created", None, None), (0, "file", "b.ts", "modified", None, None), (1, "command", "npm test", None, None, None), (1, "test", "npm test", None, "test", "failed"),
        (2, "command", "tsc", None, None, None), (2, "test", "tsc", None, "build", "passed"),
    }


def test_texts_with_a_budget_and_sections(spark):
    lines = spark.createDataFrame([(1, 0, "a" * 20), (1, 1, "b" * 20), (1, 2, "c" * 100), (1, 3, "d"), (2, 0, "e" * 500)], "id long, pos long, line string")
    got = {(r.id, r.pos): r.line for r in H.fitted_lines(lines, 30).collect()}
    assert got == {(1, 0): "a" * 20, (1, 1): "b" * 20, (1, 2): "c" * 56 + "…", (2, 0): "e" * 95 + "…"}
    assert column(spark, ["a\n\nb\nc", "a\n\nb"], lambda t: H.compact_bullets(t, 2)) == ["a\nb\n... (1 more items omitted)", "a\n\nb"]
    put = lambda t: H.with_section(t, F.lit("<b>new<e>"), "<b>", "<e>")
    assert column(spark, ["x <b>old<e> y", "x", "", "<b>only<e>"], put) == ["x\n\n<b>new<e>\n\ny", "x\n\n<b>new<e>", "<b>new<e>", "<b>new<e>"]
