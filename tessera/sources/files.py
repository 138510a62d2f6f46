"""Files, logs and journals as tables, and immutable content-addressed writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.paths import is_source
from tessera.operators.folds import sorted_fold


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, hash, size`` of source files below ``root``; sensitive ones and ignored folders are left out before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return files.withColumn("path", path).where(is_source(F.col("path"))).select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of JSON lines: parsed where it can be, else the raw line as an event of type ``custom``."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("event"), "value").select(
        "event.*", F.when(F.to_json("event") == "{}", F.col("value")).alias("raw"), F.coalesce(F.col("event.type"), F.lit("custom")).alias("kind")
    )


def journal(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """Observations of all readable journal files of a version; corrupt files are skipped."""
    files = spark.read.schema(f"version int, observations array<struct<{schema}>>, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return files.where((F.col("version") == version) & F.col("_corrupt").isNull()).select(F.explode("observations").alias("o")).select("o.*")


def hunks(diffs: DataFrame) -> DataFrame:
    """``file, from_line, to_line`` of unified diffs (``file, diff``): the lines after the change."""
    found = diffs.select("file", F.explode(F.split("diff", "\n")).alias("l")).where(F.col("l").startswith("@@"))
    start = F.regexp_extract("l", r"\+([0-9]+)", 1).cast("int")
    count = F.coalesce(F.nullif(F.regexp_extract("l", r"\+[0-9]+,([0-9]+)", 1), F.lit("")).cast("int"), F.lit(1))
    return found.select("file", start.alias("from_line"), F.greatest(start, start + count - 1).alias("to_line"))


def write_assets(rows: DataFrame, path: str, digest: str = "digest") -> None:
    """Append what is not there yet, by digest."""
    spark = rows.sparkSession
    rows = rows.dropDuplicates([digest])
    try:
        old = spark.read.schema(rows.schema).parquet(path)
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = spark.createDataFrame([], rows.schema)
    rows.join(old.select(digest), digest, "left_anti").select(*rows.columns).write.mode("append").parquet(path)


def chunk_numbers(events: DataFrame, size: int = 100) -> DataFrame:
    """The number of the chunk of each event, by its place in the session."""
    return events.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1) / size).cast("int"))


def bounded_chunks(events: DataFrame, most: int = 100, most_bytes: int = 512 * 1024, partitions: int | None = None) -> DataFrame:
    """``session, seq, line, chunk``: lines in order, a new chunk where one would have more than ``most`` lines or ``most_bytes`` bytes (with ends of lines).

    A chunk holds a line at least. Where one ends depends on all before it, so sessions are folded.
    """

    def step(state: dict, row: dict) -> list:
        size = len(row["line"].encode()) + 1
        if state["n"] and (state["n"] >= most or state["bytes"] + size > most_bytes):
            state.update(n=0, bytes=0, chunk=state["chunk"] + 1)
        state["n"] += 1
        state["bytes"] += size
        return [(row["session"], row["seq"], row["line"], state["chunk"])]

    kind = events.schema["session"].dataType.simpleString()
    return sorted_fold(events.select("session", "seq", "line"), ["session"], ["seq"], lambda key: {"n": 0, "bytes": 0, "chunk": 0}, step, lambda key, state: [], f"session {kind}, seq long, line string, chunk long", partitions)


def chunk_files(chunks: DataFrame) -> DataFrame:
    """``session, key, content``: a chunk as an immutable object, named by its first and last number and its digest, so writing it again changes nothing."""
    rows = chunks.groupBy("session", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("x"))
    content = F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n"))
    place = lambda at: F.lpad(F.element_at("x", at)["seq"].cast("string"), 12, "0")
    return rows.select("session", F.concat(place(1), F.lit("-"), place(-1), F.lit("-"), F.substring(F.sha2(content, 256), 1, 16), F.lit(".jsonl")).alias("key"), content.alias("content"))


def pending(events: DataFrame, written: DataFrame) -> DataFrame:
    """Events beyond the last number that a session's written objects (``session, key``) hold, whatever a cursor says: what a crash has left out."""
    last = written.groupBy("session").agg(F.max(F.regexp_extract("key", "^[0-9]+-([0-9]+)-", 1).cast("long")).alias("last"))
    return events.join(last, "session", "left").where(F.col("last").isNull() | (F.col("seq") > F.col("last"))).drop("last")
