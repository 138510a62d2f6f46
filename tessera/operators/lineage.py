"""Cutting the lineage of iterative queries."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names for driver and executors; a temporary one stands in only in a local session."""
    master, base = spark.sparkContext.master, spark.conf.get("spark.checkpoint.dir", None)
    if base is None and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or _own_folder(spark.sparkContext.applicationId)).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is used several times is worked out once, in columns that scans can prune."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder that the cluster names; a temporary one stands in only in a local session."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if base is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(base or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
