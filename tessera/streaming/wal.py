"""An append-only event log as a stream: each consumer is a query with its own checkpoint."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Identifiers of a session that are remembered.
REMEMBERED = 2000


def log(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def numbered(events: DataFrame) -> DataFrame:
    """``session, event, seq``: events (``session, event, ts``) without repeats, numbered by session without gaps.

    A session's state is its next number and the last identifiers it has seen.
    """

    def step(key: tuple, batches, state: GroupState):
        seq, seen = state.get if state.exists else (0, [])
        known, seen = set(seen), list(seen)
        for rows in batches:
            out = []
            for event in rows.sort_values(["ts", "event"])["event"]:
                if event in known:
                    continue
                out.append((key[0], event, seq))
                seq += 1
                known.add(event)
                seen.append(event)
            yield pd.DataFrame(out, columns=["session", "event", "seq"])
        state.update((seq, seen[-REMEMBERED:]))

    return events.groupBy("session").applyInPandasWithState(step, "session long, event string, seq long", "seq long, seen array<string>", "append", GroupStateTimeout.NoTimeout)


def distinct_activity(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of (project, type, data) within the delay."""
    return events.withWatermark("ts", delay).withColumn("digest", F.sha2(F.to_json(F.struct("project", "type", "data")), 256)).dropDuplicatesWithinWatermark(["digest"])


def windowed(events: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; late events within the delay still count."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def consume(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """One consumer: what is there now, batch by batch; its place is kept only when a batch has been written."""
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
