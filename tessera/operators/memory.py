"""Records: scans, upserts, expiry, deduplication, consolidation, supersession, lifecycle.

Columns: id, project, type, content, importance, tags, source, created, updated, expires, superseded_by, topic, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators.lineage import stored

# Tags that say nothing about a topic.
GENERIC_TAGS = ["decision", "rule", "todo", "summary", "activity", "user", "error", "file", "write", "command", "learned", "session", "architecture", "fix", "context", "opencode", "agy", "codex"]
CLASS_RANK = {"class:permanent": 4, "class:task": 3, "class:session": 2, "class:transient": 1}


def with_active(memories: DataFrame, now: Column) -> DataFrame:
    return memories.withColumn("active", S.active(F.col("expires"), F.col("superseded_by"), now))


def listed(memories: DataFrame, project: str, now: Column, only_active: bool = True) -> DataFrame:
    rows = memories.where(F.col("project") == project)
    return (with_active(rows, now).where("active").drop("active") if only_active else rows).orderBy(F.desc("created"), "id")


def filtered(memories: DataFrame, now: Column, types: list[str] | None = None, tags: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """By type, by any of some tags, by effective importance (0: no bound)."""
    rows = with_active(memories, now).where("active")
    if types:
        rows = rows.where(F.col("type").isin(types))
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    rows = rows.withColumn("effective", S.effective_importance(F.col("type"), F.col("importance"), F.col("updated"), F.col("active"), now))
    return rows.where(F.col("effective") >= least) if least else rows


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """The last row of each key; rows of ``new`` come after those of ``old``."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order)))
    return rows.withColumn("__k", last).where("__k = 1").drop("__k", "__new")


def exact_copies(memories: DataFrame) -> DataFrame:
    """The first record of each fingerprint, with how many others it stands for."""
    key = T.fingerprint("project", "type", F.lower(F.trim("content")))
    return memories.groupBy(key.alias("fingerprint")).agg(F.min_by("id", F.col("seq")).alias("id"), (F.count(F.lit(1)) - 1).alias("copies"))


def consolidation(memories: DataFrame) -> DataFrame:
    """Groups of records of one project and type with equal content: the canonical record, and all tags and sources in order of rank.

    Only keys and tags are shuffled, not texts; groups of one record are gone before lists are formed.
    """
    rank = S.first_tag(F.col("tags"), CLASS_RANK, F.lit(0))
    rows = memories.where((F.col("type") != "activity") & F.col("superseded_by").isNull()).select(
        "id", "project", "type", F.sha2(T.content_key(F.col("content")), 256).alias("key"), "tags", "source", rank.alias("rank"), S.choose(F.col("importance"), S.BASE).alias("score"), "updated", "created"
    )
    order = F.struct((-F.col("rank")).alias("a"), (-F.col("score")).alias("b"), (-F.unix_micros(F.col("updated").cast("timestamp"))).alias("c"), (-F.unix_micros(F.col("created").cast("timestamp"))).alias("d"), F.col("id").alias("e"))
    groups = rows.groupBy("project", "type", "key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "id", "tags", "source"))).alias("x")).where("size(x) > 1")
    return groups.select(
        "project", "type", F.col("x")[0]["id"].alias("canonical"), F.transform(F.slice("x", 2, F.size("x") - 1), lambda r: r["id"]).alias("duplicates"),
        F.array_distinct(F.flatten(F.transform("x", lambda r: r["tags"]))).alias("tags"), F.array_distinct(F.transform("x", lambda r: r["source"])).alias("sources"),
    )


def superseded(new: DataFrame, old: DataFrame, least: float = 0.6) -> DataFrame:
    """``old_id, new_id``: old records and the largest new one of their project and type (rule or decision) that replaces them: same topic, a shared tag with meaning, or similar words.

    Topics and tags are equi-joins with the new records reduced first, so a tag that all share makes no pairs. Word similarity is one too: words are joined, and shared words counted by pair;
    only the rarest words of each record on the side with few records, as many as similar sets must share one of, are joined.
    """
    def keys(df: DataFrame, p: str) -> DataFrame:
        tags = F.array_distinct(F.filter("tags", lambda t: ~F.lower(t).isin(GENERIC_TAGS)))
        return df.where(F.col("type").isin("rule", "decision") & F.col("superseded_by").isNull()).select(
            F.col("id").alias(f"{p}_id"), "project", "type", F.col("topic").alias(f"{p}_topic"), tags.alias(f"{p}_tags"), T.words_for_topic(F.col("content")).alias(f"{p}_words")
        )

    b = stored(keys(old, "old"), "old")  # words are told once
    a = b.toDF(*[c.replace("old_", "new_") for c in b.columns]) if new is old else stored(keys(new, "new"), "new")
    on = ["project", "type"]
    # of the new records of a topic or tag only the two largest identifiers can be the largest other than an old record's own
    keyed = a.select(*on, "new_id", F.concat(F.lit("topic "), "new_topic").alias("k")).union(a.select(*on, "new_id", F.explode(F.transform("new_tags", lambda t: F.concat(F.lit("tag "), t))).alias("k"))).where("k IS NOT NULL")
    first = keyed.groupBy(*on, "k").agg(F.max("new_id").alias("first"))
    second = keyed.join(first, [*on, "k"]).where("new_id <> first").groupBy(*on, "k").agg(F.max("new_id").alias("second"))
    largest = first.join(second, [*on, "k"], "left")
    wanted = b.select(*on, "old_id", F.concat(F.lit("topic "), "old_topic").alias("k")).union(b.select(*on, "old_id", F.explode(F.transform("old_tags", lambda t: F.concat(F.lit("tag "), t))).alias("k")))
    by_key = wanted.join(largest, [*on, "k"]).select("old_id", F.when(F.col("first") != F.col("old_id"), F.col("first")).otherwise(F.col("second")).alias("new_id")).where("new_id IS NOT NULL")
    known = stored(by_key.groupBy("old_id").agg(F.max("new_id").alias("known")), "known")
    def keyed_words(df: DataFrame, p: str) -> DataFrame:
        # equal hashes of different words only make pairs that the whole sets are compared for in vain
        return df.select(f"{p}_id", F.size(f"{p}_words").alias(f"{p}_n"), F.explode(F.transform(f"{p}_words", lambda w: F.xxhash64("project", "type", w))).alias("w"))

    def candidates(few: DataFrame, p: str, many: DataFrame, q: str) -> DataFrame:
        """Pairs that share one of the words of ``few`` that are rarest in ``many``; those of ``many`` need not be ranked."""
        own, others = stored(keyed_words(few, p), "words"), keyed_words(many, q)
        counts = others.join(own.select("w").distinct(), "w", "left_semi").groupBy("w").count()
        place = F.row_number().over(Window.partitionBy(f"{p}_id").orderBy(F.coalesce("count", F.lit(0)), "w"))
        rare = own.join(counts, "w", "left").withColumn("k", place).where((F.col("k") <= F.col(f"{p}_n") - F.ceil(F.col(f"{p}_n") * least) + 1) & F.col("count").isNotNull())
        fits = (F.least("new_n", "old_n") >= least * F.greatest("new_n", "old_n")) & (F.col("new_id") != F.col("old_id"))
        return others.join(stored(rare.drop("k", "count"), "rare"), "w").where(fits).select("new_id", "old_id").distinct()

    # old records that keys found nothing for meet all new ones; the others only new ones above the smallest that was found in their project and type, which are few
    told = stored(b.select(*on, "old_id").join(known, "old_id", "left"), "told")
    bare = b.join(told.where("known IS NULL").select("old_id"), "old_id", "left_semi")
    above = a.join(told.groupBy(*on).agg(F.min("known").alias("floor")), on).where(F.col("new_id") > F.col("floor")).drop("floor")
    pairs = candidates(bare, "old", a, "new").union(candidates(above, "new", b, "old")).distinct()
    # a pair counts only if its new record is larger than what keys have found for the old one
    shared = stored(pairs.join(told.select("old_id", "known"), "old_id").where(F.col("known").isNull() | (F.col("new_id") > F.col("known"))).select("new_id", "old_id"), "shared")
    similar = shared.join(a.select("new_id", *on, "new_words"), "new_id").join(b.join(shared.select("old_id"), "old_id", "left_semi").select("old_id", *on, "old_words"), ["old_id", *on]).where(T.jaccard(F.col("new_words"), F.col("old_words")) >= least)
    pairs = known.select(F.col("known").alias("new_id"), "old_id").union(similar.select("new_id", "old_id"))
    return pairs.groupBy("old_id").agg(F.max("new_id").alias("new_id"))


def remember(new: DataFrame, old: DataFrame, now: Column) -> DataFrame:
    """Store new records: redacted, with inferred importance and expiry; what they supersede is marked."""
    days = S.default_expiry_days(F.col("type"), F.col("importance"))
    fresh = new.withColumn("content", T.redact(F.col("content"))).withColumn("importance", F.coalesce("importance", S.infer_importance(F.col("type"), F.col("content"))))
    fresh = fresh.withColumn("expires", F.coalesce("expires", (F.col("created").cast("timestamp") + F.make_dt_interval(days)).cast(new.schema["expires"].dataType)))
    gone = superseded(fresh, old).withColumnRenamed("new_id", "by")
    marked = old.join(gone, old["id"] == gone["old_id"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "by")).drop("old_id", "by")
    return marked.select(*old.columns).unionByName(fresh.select(*old.columns))


def pruned(memories: DataFrame, now: Column, retention_days: int = 30) -> DataFrame:
    """Without expired records and without superseded ones older than the retention."""
    gone = F.col("superseded_by").isNotNull() & (S.age_days(F.col("updated"), now) >= retention_days)
    return memories.where((F.col("expires").isNull() | (F.col("expires") > now)) & ~gone)


def assessed(memories: DataFrame, now: Column, sources: Column | None = None) -> DataFrame:
    q = S.quality(F.col("type"), F.col("importance"), F.col("content"), F.col("tags"), F.col("updated"), F.lit(1) if sources is None else sources, now)
    return memories.withColumns(q)


def lifecycle_review(memories: DataFrame, now: Column) -> DataFrame:
    """Counts by project."""
    rows = assessed(memories, now)
    tiers = [F.count_if(F.col("tier") == t).alias(t) for t in ("trusted", "useful", "weak", "noise")]
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("total"), *tiers, F.count_if("stale").alias("stale"), F.count_if("protected").alias("protected"), F.count_if("prune").alias("prunable"))


def maintain(memories: DataFrame, now: Column) -> DataFrame:
    """Expire, merge equal records, prune superseded ones, then what its quality makes prunable."""
    kept = pruned(memories, now)
    copies = consolidation(kept).select(F.explode("duplicates").alias("id"))
    return assessed(kept.join(copies, "id", "left_anti"), now).where(~F.col("prune")).select(*memories.columns)


def activity_summary(activities: DataFrame, least: int = 4, newest: int = 50) -> DataFrame:
    """One summary for each project with enough recent activities: how many of each kind among the newest, and the distinct latest values."""
    last = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("id")))
    rows = activities.withColumn("k", last).where(F.col("k") <= newest)
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("activities"), F.sort_array(F.collect_set("type")).alias("types"), F.max("ts").alias("last"), F.count_if(F.col("type") == "error").alias("errors")).where(F.col("activities") >= least)


def lookup(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Records by identifier (``id``), and whether there is such a record: ``id, found`` and its columns."""
    return ids.select("id").distinct().join(memories.withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def deleted(memories: DataFrame, ids: DataFrame | None = None, projects: DataFrame | None = None) -> DataFrame:
    """Without some records (``id``), and without all records of some projects (``project``)."""
    if ids is not None:
        memories = memories.join(ids.select("id"), "id", "left_anti")
    return memories if projects is None else memories.join(projects.select("project"), "project", "left_anti").select(*memories.columns)


def recent(memories: DataFrame, now: Column, most: int = 10, kind: str | None = None) -> DataFrame:
    """By project the newest active records (of one type)."""
    rows = with_active(memories, now).where("active")
    rows = rows if kind is None else rows.where(F.col("type") == kind)
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("created"), "id"))
    return rows.withColumn("place", k).where(F.col("place") <= most).drop("active")


def fact_union(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Facts (``project, kind, value, place``) of several sources, told by name and order of the sources."""
    out = None
    for i, (name, rows) in enumerate(sources):
        rows = rows.select("project", "kind", "value", F.col("place").cast("long").alias("place")).withColumn("source", F.lit(name)).withColumn("source_order", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    return out
