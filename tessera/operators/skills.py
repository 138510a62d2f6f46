"""Procedures learnt from sessions that succeeded.

Events: project, session, seq, type, data (JSON). Tasks: session, task, place, completed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import ellipsis
from tessera.operators.handoff import ordered_distinct
from tessera.operators.lineage import stored
from tessera.operators.tools import outcome

# Keys that name a file, a command, and what an event is about; the most tasks, steps, checks and files of a session.
FILE_KEYS, COMMAND_KEYS = ["path", "file", "filePath", "filename", "target"], ["command", "cmd", "script"]
LABEL_KEYS = ["name", "test", "suite", "title", "message", "text", "result", "status"]
TASKS, STEPS, CHECKS, FILES = 5, 16, 10, 24
#: Files that stand for steps where there are none.
INSTEAD = 8


def masked(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")
    text = F.regexp_replace(text, r"\bsk-[A-Za-z0-9_-]{8,}\b", "[REDACTED]")
    return F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|password|passwd|secret)\b(\s*[:=]\s*)([\"']?)[^\s\"'`]+", "$1$2[REDACTED]")


def _said(data: Column, keys: list[str], most: int) -> Column:
    first = F.coalesce(*[F.nullif(F.trim(F.get_json_object(data, f"$.{k}")), F.lit("")) for k in keys])
    return ellipsis(masked(first), most)


def skills(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """``project, session, task, steps, verification, files, fingerprint``: a procedure for each task of a session with evidence of success.

    Evidence is a completed task, or a test, commit or deploy that succeeded. Without a completed task the first other one stands
    for it. Steps are what was done, in order and each once; failed commands and tests are none. A list is a session's
    answer and has a fixed bound; a session with files but no steps updates its files; it is formed from the rows within that bound alone.
    """
    ended, file = outcome(F.col("type"), F.col("data")), _said(F.col("data"), FILE_KEYS, 260)
    rows = events.select("project", "session", "seq", "type", ended.alias("ended"), file.alias("file"), _said(F.col("data"), COMMAND_KEYS, 420).alias("command"), _said(F.col("data"), LABEL_KEYS, 300).alias("label"))
    rows = stored(rows, "signs")  # what an event tells is worked out once, for steps, checks, files and proof
    good, kind = F.col("ended") == "succeeded", F.col("type")
    about = F.coalesce("label", "command")
    step = (
        F.when(kind.isin("file_write", "file_edit"), F.concat(F.lit("Update "), "file")).when((kind == "command") & (F.coalesce("ended", F.lit("")) != "failed"), F.concat(F.lit("Run: "), "command"))
        .when((kind == "test") & good, F.concat(F.lit("Verify: "), F.coalesce(about, F.lit("project tests")))).when((kind == "commit") & good, F.coalesce(F.concat(F.lit("Commit: "), "label"), F.lit("Commit verified changes")))
        .when((kind == "deploy") & good, F.coalesce(F.concat(F.lit("Deploy: "), "label"), F.lit("Deploy verified build")))
    )
    check = (
        F.when((kind == "test") & good, F.concat(F.lit("Test passed: "), F.coalesce(about, F.lit("Tests passed")))).when((kind == "commit") & good, F.coalesce(F.concat(F.lit("Commit: "), "label"), F.lit("Commit completed")))
        .when((kind == "deploy") & good, F.coalesce(F.concat(F.lit("Deploy: "), "label"), F.lit("Deployment completed")))
    )
    names = ["steps", "verification", "files"]

    def listed(text: Column, name: str, most: int) -> DataFrame:
        x = ordered_distinct(rows.select("session", F.col("seq").alias("place"), text.alias("text")).where("text IS NOT NULL"), "session", most)
        return x.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda r: r["text"]).alias(name))

    done = tasks.where("completed").select("session", F.col("task").alias("text"), "place")
    chosen = ordered_distinct(done, "session", TASKS).select("session", F.col("text").alias("task"))
    other = tasks.where("NOT completed").join(chosen.select("session").distinct(), "session", "left_anti").groupBy("session").agg(F.min_by("task", "place").alias("task"))
    proven = rows.where(kind.isin("test", "commit", "deploy") & good).select("session").distinct()
    wanted = chosen.unionByName(other.join(proven, "session", "left_semi"))
    out = rows.groupBy("session").agg(F.min("project").alias("project")).join(wanted, "session")
    for text, name, most in zip((step, check, F.col("file")), names, (STEPS, CHECKS, FILES), strict=True):
        out = out.join(listed(text, name, most), "session", "left")
    # without steps the first files stand for them
    updates = F.transform(F.slice("files", 1, INSTEAD), lambda f: F.concat(F.lit("Update "), f))
    out = out.withColumn("steps", F.coalesce("steps", updates)).where("size(steps) > 0")
    empty = F.array().cast("array<string>")
    out = out.select("project", "session", ellipsis(masked(F.col("task")), 280).alias("task"), *[F.coalesce(n, empty).alias(n) for n in names])
    return out.withColumn("fingerprint", F.sha2(F.concat_ws("\n", "project", "task", *[F.array_join(n, "|") for n in names]), 256))
