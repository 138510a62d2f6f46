"""Connected components by minimum labels, with every round's labels in a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id`` and ``component`` (the smallest identifier that links reach) for every identifier in ``edges``.

    A round takes the smallest label among neighbours and then the label of that label, so long chains shrink
    quickly. It ends when no label changes. Minima are formed before the shuffle, so a hub is no hot key.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("id")).agg(F.least(F.first("u"), F.min("v")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("v"), F.col("component").alias("c")), "v").groupBy(F.col("u").alias("id")).agg(F.min("c").alias("c"))
        near = labels.join(seen, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        jump = near.join(labels.select(F.col("id").alias("component"), F.col("component").alias("j")), "component").select("id", "old", F.least("component", "j").alias("component"))
        new = stored(jump, "labels")
        if new.where("old <> component").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
