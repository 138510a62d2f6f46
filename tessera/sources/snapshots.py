"""Snapshots of named tables: copies under one folder each, with a catalogue table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CATALOGUE = "snapshot string, name string, rows long, created timestamp"


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(CATALOGUE).parquet(f"{root}/catalogue")
    except Exception as e:  # none has been taken yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], CATALOGUE)


def create(tables: dict[str, DataFrame], root: str, snapshot: str, created) -> None:
    """Write every table; the catalogue's rows come last, so a snapshot that broke off is none."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        path = f"{root}/{snapshot}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((snapshot, name, spark.read.schema(df.schema).parquet(path).count(), created))
    spark.createDataFrame(rows, CATALOGUE).coalesce(1).write.mode("append").parquet(f"{root}/catalogue")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots, newest first."""
    return catalogue(spark, root).groupBy("snapshot").agg(F.max("created").alias("created"), F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows")).orderBy(F.desc("created"), F.desc("snapshot"))


def restore(spark: SparkSession, root: str, snapshot: str) -> dict[str, DataFrame]:
    names = [r["name"] for r in catalogue(spark, root).where(F.col("snapshot") == snapshot).collect()]
    return {name: spark.read.parquet(f"{root}/{snapshot}/{name}") for name in names}


def outdated(spark: SparkSession, root: str, keep: int = 10) -> DataFrame:
    """Snapshots beyond the newest ``keep``."""
    place = F.row_number().over(Window.orderBy(F.desc("created"), F.desc("snapshot")))  # a row for each snapshot
    return listed(spark, root).withColumn("place", place).where(F.col("place") > keep).select("snapshot")
