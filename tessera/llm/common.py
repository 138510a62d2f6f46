"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only where that setting is missing in a local session (tests) a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with more underscores in front for as long as one of the tables has such a column (in any case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Numbered:
    """A table under numbered column names, so that an operator's own columns clash with none of them."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.rows = docs.toDF(*[f"c{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        """The number of a column (told by its name in this case, else in any)."""
        same = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name} among {self.names}")
        return f"c{same[0]}"

    def back(self, out: DataFrame) -> DataFrame:
        """The columns of the table under their names."""
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(self.names)])


def whole_number(docs: DataFrame, column: str) -> bool:
    """Whether a column holds whole numbers that fit a long."""
    return docs.select(f"`{column}`").schema[0].dataType.typeName() in ("byte", "short", "integer", "long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def text_slices(batch: pa.RecordBatch, column: str, bytes_at_once: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, a single long text aside."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + bytes_at_once, side="right")))
        yield batch.slice(start, end - start)
        start = end


def let_go() -> None:
    """Give memory back at the end of a partition: workers live on and serve other operators."""
    pa.default_memory_pool().release_unused()
