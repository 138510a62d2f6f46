"""Session logs: normalising, deduplication, manifests, line filters, facts.

Events: project, session, seq, type, role, ts, text, source_event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions import transcript as R

#: A fact with one of these is mostly noise, wherever in the line it is; with each, a word that such a line has in lower case, which is cheaper to look for.
NOISY_FACTS = {
    r"(?i)npm (notice|warn|err)": "npm ", r"(?i)\d+ packages? in \d+": " package", r"(?i)found \d+ vulnerabilities": " vulnerabilities", r"(?i)up to date": "up to date", r"(?i)added \d+ packages": " packages",
}


def deduplicated(events: DataFrame) -> DataFrame:
    """Of events with one source identifier (else one id) the one with the largest sequence number."""
    own = F.concat(F.lit("i:"), F.col("seq").cast("string"))  # no null in it, so an event without source stands for itself
    key = F.concat_ws(":", F.col("session").cast("string"), F.coalesce(F.concat(F.lit("s:"), F.col("source_event")), own))
    last = F.row_number().over(Window.partitionBy("project", "__key").orderBy(F.desc("seq"), F.desc("ts")))
    return events.withColumn("__key", key).withColumn("__k", last).where("__k = 1").drop("__k", "__key")


def activity_copies(events: DataFrame) -> DataFrame:
    """The first event of each (project, type, data)."""
    return events.groupBy(F.sha2(F.to_json(F.struct("project", "type", "data")), 256).alias("digest")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("seen"))


def manifest(events: DataFrame) -> DataFrame:
    """By session: last sequence number, number of events, first and last time, status by the last event."""
    last = F.max_by("type", F.struct("seq", "ts"))
    status = F.when(F.col("last_type") == "session_end", "idle").when(F.col("last_type") == "error", "error").otherwise("active")
    rows = events.groupBy("project", "session").agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), last.alias("last_type"))
    return rows.withColumn("status", status)


def beyond(events: DataFrame, manifests: DataFrame) -> DataFrame:
    """Events above the sequence number that each session's manifest has."""
    return events.join(manifests.select("session", "last_seq"), "session", "left").where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))).drop("last_seq")


def lines(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def repeated_lines(texts: DataFrame, most: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Lines without those that a text has had ``most`` times before, white space and case aside."""
    rows = lines(texts, id_col, text_col).withColumn("key", T.squeeze(F.lower("line")))
    k = F.row_number().over(Window.partitionBy("id", "key").orderBy("pos"))
    return rows.withColumn("k", k).where(F.col("k") <= most).select("id", "pos", "line")


def kept_transcripts(texts: DataFrame, most: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, text``: what stays of each transcript - no noise, no secrets, each line at most ``most`` times, case aside."""
    rows = lines(texts, id_col, text_col).select("id", "pos", R.kept_line(F.col("line")).alias("line")).where("line IS NOT NULL")
    k = F.row_number().over(Window.partitionBy("id", F.lower("line")).orderBy("pos"))
    kept = rows.withColumn("k", k).where(F.col("k") <= most).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return texts.select(F.col(id_col).alias("id")).distinct().join(kept, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def facts(texts: DataFrame, least: int = 15, importance: float = 0.3, most: int = 10) -> DataFrame:
    """By session the most important distinct lines with their category: ``id, pos, line, category, importance``."""
    # Words that make a line important.
    high = ["nhớ", "remember", "quy tắc", "rule", "từ giờ", "from now", "không được", "must not", "luôn luôn", "always", "never", "critical", "important", "blocker", "deploy", "production", "architecture"]
    rows = lines(texts).withColumn("line", T.trimmed(F.col("line"))).where(F.length("line") >= least)
    # bound once: the category is used several times, and Spark would repeat its patterns wherever it is named
    rows = rows.withColumn("category", F.transform(F.array("line"), S.fact_category)[0])
    low = F.lower("line")
    score = F.lit(0.5) + sum((F.when(F.contains(low, F.lit(w)), 0.15).otherwise(0.0) for w in high), F.lit(0.0))
    score = score + F.when(F.col("category").isin("rule", "architecture", "blocker"), 0.2).when(F.col("category").isin("decision", "deploy"), 0.15).when(F.col("category").isin("fix", "next_action"), 0.1).otherwise(0.0)
    score = score - F.when(F.length("line") < 20, 0.3).when(F.length("line") > 500, 0.1).otherwise(0.0)
    score = score - sum((F.when(F.contains(low, F.lit(w)) & F.col("line").rlike(p), 0.4).otherwise(0.0) for p, w in NOISY_FACTS.items()), F.lit(0.0))
    score = score - F.when(low.isin("ok", "done", "success", "error", "warning"), 0.4).otherwise(0.0)
    rows = rows.withColumn("importance", F.transform(F.array(score), lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6))[0])
    # of equal lines the first that is important enough (told in the aggregate: a filter before it would work everything out twice); then the best of each session
    first = rows.groupBy("id", T.squeeze(low).alias("key")).agg(F.min_by(F.struct("pos", "line", "category", "importance"), F.when(F.col("importance") >= importance, F.col("pos"))).alias("f")).where("f IS NOT NULL").select("id", "f.*")
    k = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("importance"), "pos"))
    return first.withColumn("k", k).where(F.col("k") <= most).drop("k")


def message_types(messages: DataFrame) -> DataFrame:
    """Session events of messages by role."""
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").when(F.col("role").contains("tool"), "tool_result").otherwise("custom")
    return messages.withColumn("type", kind)


def parsed_times(rows: DataFrame, columns: list[str]) -> Column:
    """The first of some columns that is a time: text in ISO form, or a number of seconds (below 1e11) or milliseconds."""
    def one(c: Column) -> Column:
        number = F.try_to_number(c.cast("string"), F.lit("9999999999999999"))
        seconds = number.cast("double") / F.when(number < 100_000_000_000, F.lit(1.0)).otherwise(F.lit(1000.0))
        return F.coalesce(F.when(c.cast("string").rlike("^[0-9]+$"), F.timestamp_micros((seconds * 1_000_000).cast("long"))), F.try_to_timestamp(c.cast("string")))

    return F.coalesce(*[one(F.col(c)) for c in columns])


def after(rows: DataFrame, clock: int, id_: int, clock_col: str = "clock", id_col: str = "id") -> DataFrame:
    """Rows beyond a composite cursor, in order; the first condition reaches the scan."""
    return rows.where((F.col(clock_col) >= clock) & ((F.col(clock_col) > clock) | (F.col(id_col) > id_))).orderBy(clock_col, id_col)


def capture_health(manifests: DataFrame, remote: DataFrame) -> DataFrame:
    """By project: events not yet stored remotely (``session, remote_seq``)."""
    both = manifests.join(remote, "session", "left").withColumn("pending", F.greatest(F.lit(0), F.col("last_seq") - F.coalesce("remote_seq", F.lit(-1))))
    return both.groupBy("project").agg(F.count(F.lit(1)).alias("sessions"), F.sum("pending").alias("pending"), F.count_if(F.col("status") == "error").alias("errors"), F.max("last_ts").alias("last_ts"))
