"""Hook payloads, activities, buffers, recovered sessions, procedures."""

import json

from pyspark.sql import functions as F

from tessera.operators import capture as K
from tessera.operators import skills as W


def test_hooks_and_activities(spark):
    rows = spark.createDataFrame([(json.dumps({"hook_event_name": "Stop"}),), ("{}",), (None,)], "p string")
    assert [r[0] and tuple(r[0]) for r in rows.select(K.hook_event(F.col("p"), "h")).collect()] == [("session_idle", "h:h:Stop:::idle"), None, None]
    events = spark.createDataFrame([(1, "file_read", '{"filePath": "a/.ENV"}'), (2, "file_write", '{"filePath": "a.ts", "Api-Key": "x"}'), (3, "command", '{"filePath": "id_rsa", "command": "password: hunter22"}')], "id long, type string, data string")
    assert {r.id: json.loads(r.data) for r in K.activity_events(events).collect()} == {2: {"filePath": "a.ts", "Api-Key": "[REDACTED]"}, 3: {"filePath": "id_rsa", "command": "[REDACTED:password_assignment]"}}
    texts = spark.createDataFrame([(json.dumps({"message": {"content": ["a", {"text": "b", "x": "c"}], "y": "d"}, "z": {"text": "e"}}),), ('"f"',), ("{",), (None,)], "t string")
    assert [r[0] for r in texts.select(K.deep_texts("t")).collect()] == [["a", "b"], ["f"], [], []]


def test_buffers(spark):
    events = spark.createDataFrame([(1, i, "session_end" if i == 4 else "x") for i in range(8)], "session long, seq long, type string")
    assert {r.seq: r.flush for r in K.flushes(events, 3).collect()} == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2, 6: 2, 7: 2}


def test_sessions_found_again(spark):
    convs = spark.createDataFrame([("a", ["/w/p/x"], 3), ("b", ["/w"], 2), ("c", ["/w/pp"], 9), ("d", ["/w/p", "/z"], 1)], "id string, workspaces array<string>, last_input long")
    projects = spark.createDataFrame([("one", "/w/p")], "project string, root string")
    assert [(r.id, r.place) for r in K.recovered(convs, projects, 2).orderBy("place").collect()] == [("a", 1), ("b", 2)]
    one, two = "01234567-89ab-cdef-0123-456789abcdef", "11234567-89ab-cdef-0123-456789abcdef"
    files = spark.createDataFrame([(f"/s/r-{one}.jsonl", "2024-01-01", None), (f"/t/{one}.jsonl", "2024-02-01", None), ("/s/new.jsonl", "2024-03-01", one), ("/s/x.jsonl", "2024-01-01", two)], "path string, modified string, meta_id string")
    got = K.discovered(spark.createDataFrame([(one,), (two,), ("none",)], "id string"), files.withColumn("modified", F.to_timestamp("modified")))
    assert {r.id: (r.path, r.rank) for r in got.collect()} == {one: (f"/t/{one}.jsonl", 0), two: ("/s/x.jsonl", 1)}


def test_procedures_need_success(spark):
    rows = [("a", 1, "file_edit", {"path": "x.ts"}), ("a", 2, "test", {"name": "unit", "passed": True}), ("a", 3, "command", {"command": "x", "exitCode": 2}), ("b", 1, "command", {"command": "ls"}), ("c", 1, "command", {"command": "make API_KEY=abcd"})]
    events = spark.createDataFrame([("p", s, n, t, json.dumps(x)) for s, n, t, x in rows], "project string, session string, seq long, type string, data string")
    tasks = spark.createDataFrame([("a", "todo", 1, False), ("b", "open", 1, False), ("c", "Done it", 2, True), ("c", "done  IT", 1, True)], "session string, task string, place long, completed boolean")
    got = {r.session: (r.task, r.steps, r.verification, r.files) for r in W.skills(events, tasks).collect()}
    assert got == {"a": ("todo", ["Update x.ts", "Verify: unit"], ["Test passed: unit"], ["x.ts"]), "c": ("done IT", ["Run: make API_KEY=[REDACTED]"], [], [])}
