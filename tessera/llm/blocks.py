"""Tables of counters or bits over a whole corpus, of bounded size, added up by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let_go
from tessera.llm.shingles import U, _mixed

#: Counters of a block.
BLOCK = 1 << 16
#: Partial tables that one task adds up at a time, at most about so many.
FAN_IN = 64


def _packed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, dtype=np.int64)
    for x in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(x), dtype="<i8")
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [_packed(total)]})


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK, dtype=np.uint8)
    for x in pdf["counts"]:
        total |= np.frombuffer(zlib.decompress(x), dtype=np.uint8)
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _gathered(rows: DataFrame, count: Callable, meet: Callable) -> list:
    """The blocks of all partitions' tables: they meet block by block in rounds of bounded width."""
    part = rows.mapInArrow(count, "block int, counts binary")
    groups = max(1, rows.rdd.getNumPartitions())
    while groups > 1:
        groups = -(-groups // FAN_IN)
        part = part.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(groups))).groupBy("block", "g").applyInPandas(lambda pdf: meet(pdf), "block int, counts binary")
    return part.collect()


def table_size(wanted: int, least: int, most: int) -> int:
    """The power of two from ``wanted`` on, within bounds that are powers of two."""
    return min(most, max(least, 1 << max(0, wanted - 1).bit_length()))


def summed(rows: DataFrame, size: int, columns: list[str], buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]]) -> np.ndarray:
    """``size`` counters: how often ``buckets`` names each for the rows of ``rows``.

    Every partition counts for itself; no task adds up more than about ``FAN_IN`` partial tables. What comes to the
    driver has the size of the table.
    """
    blocks = -(-size // BLOCK)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = np.zeros(blocks * BLOCK, dtype=np.int32), False
        for batch in batches:
            for at in buckets(batch):
                np.add.at(own, at, 1)
                seen = True
        let_go()
        if seen:
            full = [i for i in range(blocks) if own[i * BLOCK : (i + 1) * BLOCK].any()]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_packed(own[i * BLOCK : (i + 1) * BLOCK]) for i in full], pa.binary())], ["block", "counts"])

    out = np.zeros(blocks * BLOCK, dtype=np.int64)
    for r in _gathered(rows.select(*columns), count, _added):
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(zlib.decompress(r["counts"]), dtype="<i8")
    return out[:size]


def _bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (_mixed(ids.astype(np.int64).view(U)) & U(size - 1)).astype(np.int64)


class Marked:
    """A broadcast bit for the hash of each identifier of a table.

    The table of bits has 16 for each identifier, between bounds that don't depend on the data. Where it is full it lets rows
    through, so what follows ``within`` has to look again; ``without`` holds only rows that are surely not listed.
    """

    def __init__(self, bits: np.ndarray, spark):
        self.held = spark.sparkContext.broadcast(bits)

    def _chosen(self, rows: DataFrame, column: str, inside: bool) -> DataFrame:
        held = self.held

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = held.value
            for batch in batches:
                at = _bits(batch.column(column).to_numpy(), len(bits) * 8)
                yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) == inside))

        return rows.mapInArrow(run, rows.schema)

    def within(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose identifier may be listed, among them all that are."""
        return self._chosen(rows, column, True)

    def without(self, rows: DataFrame, column: str) -> DataFrame:
        """The other rows."""
        return self._chosen(rows, column, False)


#: Bounds of a table of bits.
BITS_LEAST, BITS_MOST = 1 << 19, 1 << 27


def marked_ids(ids: DataFrame, column: str) -> Marked:
    """The table of bits of ``ids``, a stored table without nulls in ``column``."""
    size = table_size(16 * ids.count(), BITS_LEAST, BITS_MOST)
    blocks = -(-size // (8 * BLOCK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(blocks * BLOCK, dtype=np.uint8)
        for batch in batches:
            at = _bits(batch.column(column).to_numpy(), size)
            np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        full = [i for i in range(blocks) if own[i * BLOCK : (i + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([zlib.compress(own[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1) for i in full], pa.binary())], ["block", "counts"])

    out = np.zeros(blocks * BLOCK, dtype=np.uint8)
    for r in _gathered(ids.select(column), count, _joined):
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] |= np.frombuffer(zlib.decompress(r["counts"]), dtype=np.uint8)
    return Marked(out, ids.sparkSession)
