"""Answers to questions from ranked facts alone.

Questions: ask, project, question. Facts: project, kind, value, source, place (the order in which a source tells them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.classify import intent
from tessera.functions.scoring import choose
from tessera.functions.text import squeeze
from tessera.operators.conversation import ASKS_TODO, _any, plain
from tessera.operators.lineage import stored
from tessera.operators.retrieval import pack_greedy

# What a kind counts for an intent (10, if it isn't listed), what a source counts, and how answers call kinds.
INTENT_WEIGHTS = {
    "previous_agent": {"previous_agent": 100, "task": 35, "phase": 25}, "current_task": {"task": 100, "request": 95, "activity": 90, "phase": 75, "file": 65, "next_action": 55, "blocker": 45}, "next_action": {"next_action": 100, "todo": 80, "task": 65, "blocker": 60, "file": 40},
    "last_file": {"file": 100, "task": 65, "next_action": 40}, "blocker": {"blocker": 100, "task": 60, "next_action": 50, "file": 35}, "decision": {"decision": 100, "rule": 85, "architecture": 80, "task": 45, "file": 30}, "completed": {"completed": 100, "progress": 70, "task": 30},
    "status": {"progress": 100, "task": 85, "phase": 75, "blocker": 65, "next_action": 60},
    "summary": {"task": 100, "request": 98, "activity": 96, "next_action": 95, "file": 90, "blocker": 85, "previous_agent": 80, "phase": 75, "completed": 60, "todo": 60, "decision": 55, "rule": 54, "architecture": 53, "fix": 52, "progress": 50, "test": 45, "goal": 35},
}
SOURCE_WEIGHTS = {"checkpoint": 20, "handoff": 18, "session-origin": 14, "work-state": 8}
LABELS = {
    "previous_agent": "Agent trước", "request": "Yêu cầu hiện tại", "activity": "Đang làm", "goal": "Mục tiêu", "phase": "Phase", "task": "Task hiện tại", "file": "File hiện tại", "todo": "TODO", "next_action": "Tiếp theo", "blocker": "Blocker", "decision": "Quyết định", "rule": "Quy tắc", "architecture": "Kiến trúc",
    "fix": "Đã sửa", "completed": "Đã hoàn thành", "test": "Test", "progress": "Tiến độ",
}
# The kinds that an answer shows, in order, and those of which it shows three instead of one.
SUMMARY_ORDER = ["previous_agent", "request", "activity", "phase", "task", "file", "todo", "next_action", "blocker", "decision", "rule", "architecture", "fix", "completed", "test", "progress", "goal"]
INTENT_ORDER = {
    "previous_agent": ["previous_agent"], "current_task": ["request", "activity", "task", "file", "next_action"], "next_action": ["next_action", "task", "file", "todo"], "last_file": ["file", "task", "next_action"], "blocker": ["blocker"], "decision": ["decision"], "completed": ["completed"],
    "status": ["progress", "task", "next_action", "blocker"], "summary": SUMMARY_ORDER,
}
TODO_ORDER = ["todo", "task", "next_action", "file"]
THREE = ["todo", "blocker", "decision", "completed"]
#: Kinds that a checkpoint adds to what was handed over.
DURABLE = ["rule", "architecture", "fix"]


def ranked_facts(wanted: DataFrame, facts: DataFrame, most: int = 32, budget: int = 6400, partitions: int | None = None) -> DataFrame:
    """``project, intent, kind, value, source, rank`` of facts for each wanted (``project, intent``): each (kind, value) once, the best first, as many as fit.

    Once a project has facts that were handed over, they and the durable ones of its checkpoint are all that counts.
    """
    # score falls as place rises, whatever the intent: of a source's equal facts the first alone can be the best, so facts are reduced before they meet intents
    key = F.lower(squeeze(F.col("value")))
    first = F.min(F.struct(F.col("place").isNull().alias("unplaced"), "place", "value")).alias("x")
    told = facts.where(key != "").groupBy("project", "kind", key.alias("key"), "source").agg(first).select("project", "kind", "key", "source", "x.place", "x.value")
    rows = wanted.select("project", "intent").distinct().join(told, "project")
    pairs = [F.lit(x) for i, kinds in INTENT_WEIGHTS.items() for k, w in kinds.items() for x in (f"{i}:{k}", w)]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws(":", "intent", "kind")), F.lit(10))
    score = weight + choose(F.col("source"), SOURCE_WEIGHTS, 0) + F.greatest(F.lit(0.0), 5 - 0.01 * F.col("place"))
    best = rows.withColumn("score", score).groupBy("project", "intent", "kind", "key").agg(F.max_by(F.struct("value", "source", "place", "score"), F.struct("score", -F.col("place"), "source")).alias("x"))
    order = Window.partitionBy("project", "intent").orderBy(F.desc("x.score"), "x.place", "kind", "key")
    ranks = best.withColumn("rank", F.row_number().over(order)).select("project", "intent", "kind", "x.value", "x.source", "rank").withColumn("group", F.concat_ws("\n", "intent", "project"))
    ranks = stored(ranks, "ranks")  # packed and looked up
    picked = pack_greedy(ranks.select("group", "rank", "kind", "value", "source"), budget, most, "group", "rank", partitions).select("group", F.explode("picked").alias("rank"))
    chosen = ranks.join(picked, ["group", "rank"]).drop("group")
    handed = F.max(F.col("source") == "handoff").over(Window.partitionBy("project", "intent"))
    return chosen.withColumn("handed", handed).where(~F.col("handed") | (F.col("source") == "handoff") | ((F.col("source") == "checkpoint") & F.col("kind").isin(DURABLE))).drop("handed")


def local_answers(questions: DataFrame, facts: DataFrame, most: int = 32, budget: int = 6400) -> DataFrame:
    """``ask, intent, answer, source``: a line for each fact that the intent shows (three of some kinds, one of others); without any, no answer and the source ``none``.

    An explicit question for things to do shows those first, whatever its intent. Facts are ranked once for each project and intent, not for each question.
    """
    asked = questions.select("ask", "project", plain(F.coalesce("question", F.lit(""))).alias("q"))
    asked = asked.select("ask", "project", intent(F.col("q")).alias("intent"), _any(F.col("q"), ASKS_TODO[:2]).alias("todo"))
    rows = stored(ranked_facts(asked, facts, most, budget), "rows")
    k = F.row_number().over(Window.partitionBy("project", "intent", "kind").orderBy("rank"))
    shown = rows.withColumn("k", k).where(F.col("k") <= F.when(F.col("kind").isin(THREE), 3).otherwise(1))
    orders = F.create_map(*[x for i, kinds in INTENT_ORDER.items() for x in (F.lit(i), F.array(*map(F.lit, kinds)))])
    line = F.concat(choose(F.col("kind"), LABELS), F.lit(": "), F.col("value"))

    def text(place: Column) -> Column:
        lines = F.array_sort(F.collect_list(F.when(place > 0, F.struct(place.alias("p"), "k", line.alias("line")))))
        return F.nullif(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit(""))

    by = shown.groupBy("project", "intent").agg(text(F.array_position(F.try_element_at(orders, F.col("intent")), F.col("kind"))).alias("plain"), text(F.array_position(F.array(*map(F.lit, TODO_ORDER)), F.col("kind"))).alias("listed"))
    first = rows.groupBy("project", "intent").agg(F.min_by("source", "rank").alias("source"))
    out = asked.join(by, ["project", "intent"], "left").join(first, ["project", "intent"], "left").withColumn("answer", F.when(F.col("todo"), F.col("listed")).otherwise(F.col("plain")))
    return out.select("ask", "intent", "answer", F.when(F.col("answer").isNull(), "none").otherwise(F.col("source")).alias("source"))
