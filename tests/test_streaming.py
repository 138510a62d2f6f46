import tempfile

from pyspark.sql import functions as F

from tessera.streaming import wal

SCHEMA = "session long, event string, ts timestamp, project string, type string, data string, value double"


def batch(spark, rows, path):
    df = spark.createDataFrame(rows, "session long, event string, second long, project string, type string, data string, value double")
    df.select("session", "event", F.timestamp_seconds("second").alias("ts"), "project", "type", "data", "value").coalesce(1).write.mode("append").parquet(path)


def run(query):
    query.processAllAvailable()
    query.stop()


def test_numbers_go_on_across_runs_and_repeats_are_dropped(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    path, check = f"{root}/log", f"{root}/check"
    got = []

    def write(df, _):
        got.extend(tuple(r) for r in df.collect())

    batch(spark, [(1, "a", 1, "p", "t", "x", 1.0), (1, "b", 2, "p", "t", "y", 1.0), (2, "a", 1, "p", "t", "x", 1.0), (1, "a", 3, "p", "t", "x", 1.0)], path)
    wal.consume(wal.numbered(wal.log(spark, path, SCHEMA)), check, write).awaitTermination()
    assert sorted(got) == [(1, "a", 0), (1, "b", 1), (2, "a", 0)]
    batch(spark, [(1, "b", 4, "p", "t", "y", 1.0), (1, "c", 5, "p", "t", "z", 1.0)], path)
    wal.consume(wal.numbered(wal.log(spark, path, SCHEMA)), check, write).awaitTermination()
    assert sorted(got) == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (2, "a", 0)]


def test_consumers_are_independent(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    batch(spark, [(1, "a", 1, "p", "t", "x", 1.0), (1, "b", 2, "p", "t", "x", 2.0), (1, "c", 90000, "p", "u", "x", 4.0)], f"{root}/log")
    seen, distinct = [], []
    log = wal.log(spark, f"{root}/log", SCHEMA)
    wal.consume(log, f"{root}/c1", lambda df, _: seen.extend(r.event for r in df.collect())).awaitTermination()
    wal.consume(wal.distinct_activity(log), f"{root}/c2", lambda df, _: distinct.extend(r.type for r in df.collect())).awaitTermination()
    assert sorted(seen) == ["a", "b", "c"] and sorted(distinct) == ["t", "u"]
    again = []
    wal.consume(log, f"{root}/c1", lambda df, _: again.extend(df.collect())).awaitTermination()
    assert again == []


def test_windows(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    batch(spark, [(1, "a", 10, "p", "t", "x", 1.0), (1, "b", 20, "p", "t", "x", 2.0), (1, "c", 900000, "p", "t", "x", 4.0)], f"{root}/log")
    q = wal.windowed(wal.log(spark, f"{root}/log", SCHEMA)).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{root}/c").start()
    run(q)
    assert sorted((r.n, r.value) for r in spark.sql("SELECT n, value FROM w").collect()) == [(1, 4.0), (2, 3.0)]
