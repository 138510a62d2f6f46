"""Folding ordered observations into current state.

Observations: project, kind, key, text, status, ts, seq, confidence, ord.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.folds import sorted_fold

#: The later an item is in this list, the sooner it is the current one.
CURRENT = ["in_progress", "blocked", "pending"]


def latest_by_kind(observations: DataFrame) -> DataFrame:
    """The last text of each kind; a maximum, so nothing but one row per task and key is shuffled."""
    order = F.struct("ts", "seq")
    return observations.groupBy("project", "kind").agg(F.max_by("text", order).alias("text"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("seen"))


def recent_distinct(rows: DataFrame, most: int, group: str = "project", key: str = "key") -> DataFrame:
    """The last occurrence of each key, of these the last ``most``, in order of time."""
    last = rows.groupBy(group, key).agg(F.max_by("text", F.struct("ts", "seq")).alias("text"), F.max(F.struct("ts", "seq")).alias("o"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("o")))
    return last.withColumn("k", k).where(F.col("k") <= most).select(group, key, "text", F.col("o.seq").alias("seq"))


def first_distinct(rows: DataFrame, most: int, group: str = "project", key: str = "key") -> DataFrame:
    """The first occurrence of each key, of these the last ``most``."""
    first = rows.groupBy(group, key).agg(F.min_by("text", F.struct("ts", "seq")).alias("text"), F.min(F.struct("ts", "seq")).alias("o"))
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("o")))
    return first.withColumn("k", k).where(F.col("k") <= most).select(group, key, "text", F.col("o.seq").alias("seq"))


# A title that only numbers an item.
PLACEHOLDER = r"(?iu)^(?:Phase|TODO|Task|Việc)\s+\d+$"


def work_items(observations: DataFrame) -> DataFrame:
    """By item: its status after all observations (completed stays; pending changes nothing once it is in progress or blocked), best confidence, last order.

    The lattice needs no fold: an item that was ever completed is completed; else its last status other than pending
    counts, and of a cancelled one its very last. A title that only numbers the item never replaces another.
    """
    order = F.struct("ts", "seq")
    moved = F.when(F.col("status").isin("in_progress", "blocked", "cancelled"), F.col("status"))
    named = F.when(~F.col("text").rlike(PLACEHOLDER), F.col("text"))
    rows = observations.groupBy("project", "key").agg(
        F.max(F.col("status") == "completed").alias("ever"), F.max_by(moved, F.when(moved.isNotNull(), order)).alias("moved"), F.max_by("status", F.when(F.col("status").isNotNull(), order)).alias("last"),
        F.coalesce(F.max_by(named, F.when(named.isNotNull(), order)), F.min_by("text", order)).alias("title"), F.max("confidence").alias("confidence"), F.max_by("ord", F.when(F.col("ord").isNotNull(), order)).alias("ord"),
    )
    status = F.when(F.col("ever"), "completed").when(F.col("moved").isin("in_progress", "blocked"), F.col("moved")).otherwise(F.coalesce("last", F.lit("pending")))
    return rows.select("project", "key", "title", status.alias("status"), "confidence", "ord")


def incremental_items(previous: DataFrame, observations: DataFrame) -> DataFrame:
    """Items (as from ``work_items``) after further observations. Items are told by their order, else by their title.

    The items so far are the first observation of their key, so the same lattice gives what a fold from the start would.
    """
    key = lambda name: F.coalesce(F.concat(F.lit("order:"), F.col("ord").cast("string")), F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))))
    kinds = observations.schema
    so_far = previous.select("project", key("title").alias("key"), F.col("title").alias("text"), "status", F.lit(None).cast(kinds["ts"].dataType).alias("ts"), F.lit(None).cast(kinds["seq"].dataType).alias("seq"), "confidence", "ord")
    new = observations.select("project", key(F.coalesce(F.nullif("key", F.lit("")), F.col("text"))).alias("key"), "text", "status", "ts", "seq", "confidence", "ord")
    return work_items(so_far.unionByName(new))


def progress(items: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("completed", "in_progress", "blocked", "pending", "cancelled")]
    return items.groupBy("project").agg(F.count(F.lit(1)).alias("total"), *counts)


def current_item(items: DataFrame) -> DataFrame:
    """By project the first item in progress, else blocked, else pending."""
    rank = F.array_position(F.array(*map(F.lit, CURRENT)), F.col("status"))
    rows = items.where(F.col("status").isin(CURRENT)).groupBy("project").agg(F.min(F.struct(rank.alias("r"), F.coalesce("ord", F.lit(1 << 40)).alias("o"), F.col("key").alias("key"), F.col("status").alias("status"))).alias("x"))
    return rows.select("project", F.col("x.key").alias("key"), F.col("x.status").alias("status"))


def active_files(actions: DataFrame, most: int = 5) -> DataFrame:
    """By project the files last touched, without those whose last action deleted them (``file, action, ts, seq``)."""
    last = actions.groupBy("project", "file").agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.max(F.struct("ts", "seq")).alias("o")).where("action <> 'deleted'")
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("o")))
    return last.withColumn("k", k).where(F.col("k") <= most).select("project", "file", "action", F.col("k").alias("place"))


def scenes(facts: DataFrame, most: int = 5) -> DataFrame:
    """Facts (``project, kind, id, text, importance, confidence``) by scene: counts, best importance, mean confidence, a summary of the first."""
    scene = F.when(F.col("kind").isin("rule", "architecture"), "project-knowledge").when(F.col("kind").isin("decision", "fix"), "implementation").when(F.col("kind") == "todo", "continuation").otherwise("session-context")
    rows = facts.withColumn("scene", scene)
    k = F.row_number().over(Window.partitionBy("project", "scene").orderBy(F.desc("importance"), F.desc("confidence"), "id"))
    top = rows.withColumn("k", k).where(F.col("k") <= most).groupBy("project", "scene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda s: s["text"]), " | ").alias("summary"))
    sums = rows.groupBy("project", "scene").agg(F.count(F.lit(1)).alias("facts"), F.max("importance").alias("importance"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return sums.join(top, ["project", "scene"])


def semantic_state(observations: DataFrame, partitions: int | None = None) -> DataFrame:
    """The value of each (project, scope, kind) after all observations, in the order of ``seq``.

    A later observation (``ts``) replaces the state; at equal times one of the same session does, or one that is at least as sure. The rule
    for equal times is no order on observations, so all of them are folded one after the other.
    """
    by = ["project", "scope", "kind"]
    rows = observations.where("ts IS NOT NULL").select(*by, "ts", "seq", F.col("session").cast("string").alias("session"), F.col("confidence").cast("double").alias("confidence"), "text")

    def later(state: dict, row: dict) -> bool:
        if "ts" not in state or row["ts"] != state["ts"]:
            return "ts" not in state or row["ts"] > state["ts"]
        return row["session"] == state["session"] or (row["confidence"] or 0.0) >= (state["confidence"] or 0.0)

    def step(state: dict, row: dict) -> list:
        seen = state.get("seen", 0) + 1
        if later(state, row):
            state.update(row)
        state["seen"] = seen
        return []

    def end(key: tuple, state: dict) -> list:
        return [(*key, state["text"], state["confidence"], state["seen"])]

    return sorted_fold(rows, by, ["seq"], lambda key: {}, step, end, "project string, scope string, kind string, value string, confidence double, seen long", partitions)


def ring(rows: DataFrame, most: int, group: str, *order: str) -> DataFrame:
    """The newest ``most`` rows of each group."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("__k", k).where(F.col("__k") <= most).drop("__k")


def intent_facts(facts: DataFrame, weights: dict[str, int], sources: dict[str, int], most: int = 12) -> DataFrame:
    """Facts (``project, kind, value, source, place``) ranked for an intent, each (kind, value) once."""
    from tessera.functions.scoring import choose

    score = choose(F.col("kind"), weights, 10) + choose(F.col("source"), sources, 0) + F.greatest(F.lit(0.0), 5 - 0.01 * F.col("place"))
    best = facts.withColumn("score", score).groupBy("project", "kind", F.lower(F.trim("value")).alias("norm")).agg(F.max_by(F.struct("value", "source", "place", "score"), F.struct("score", -F.col("place"))).alias("x")).select("project", "kind", "x.*")
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "place", "kind"))
    return best.withColumn("rank", k).where(F.col("rank") <= most)
