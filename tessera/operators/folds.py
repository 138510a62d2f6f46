"""Folds over ordered rows whose rule is not associative, for keys of any size.

Rows are range-sorted by key and order, so a key may run over many partitions. A task folds its sorted rows one after the other and
holds one state. Where a key goes on in the next partition, its state is handed over: the next round starts there with that state
and reads that partition alone. A key in one partition costs no round, one in n partitions n rounds; no task holds more than a state and a slice of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from tessera.operators.lineage import shared_folder

#: Rows that a task turns into Python values at a time.
ROWS = 1024

Start = Callable[[tuple], Any]
Step = Callable[[Any, dict], Iterable[tuple]]
End = Callable[[tuple, Any], Iterable[tuple]]


def _folder(by: list[str], start: Start, step: Step, end: End, schema: StructType, goes_on: set[int], joined: set[int], states: dict[int, bytes]) -> Callable:
    """The fold of a task's rows. ``joined``: parts whose first key began before them; ``goes_on``: parts whose last key goes on in the next; ``states``: what was handed to a part."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        part, key, state, live, first = None, None, None, False, True

        def close(last: bool) -> None:
            if live and last and part in goes_on:
                out.append((*[None] * (len(schema) - 2), part, pickle.dumps(state)))
            elif live:
                out.extend((*row, part, None) for row in end(key, state))

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return made

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for row in batch.slice(at, ROWS).to_pylist():
                    new_part, new_key = row.pop("__part"), tuple(row[c] for c in by)
                    if new_part != part or new_key != key:
                        close(new_part != part)
                        first = new_part != part
                        part, key = new_part, new_key
                        if states:  # a later round: the first key of the parts that were handed a state
                            live = first and part in states
                            state = pickle.loads(states[part]) if live else None
                        else:
                            live = not (first and part in joined)
                            state = start(key) if live else None
                    if live:
                        out.extend((*made, part, None) for made in step(state, row))
                if out:
                    yield flush()
        close(True)
        if out:
            yield flush()

    return run


def sorted_fold(rows: DataFrame, by: list[str], order: list[str], start: Start, step: Step, end: End, schema: StructType | str, partitions: int | None = None) -> DataFrame:
    """``start(key)`` makes a state, ``step(state, row)`` changes it and returns rows, ``end(key, state)`` returns those at the end of a key.

    Rows of a key come in the order of ``order``, nulls first. States must be picklable and of bounded size. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    out = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    inner = StructType([*[StructField(f.name, f.dataType, True) for f in out], StructField("__at", IntegerType()), StructField("__state", BinaryType())])
    keys = [*by, *order]
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    base = shared_folder(spark, "fold")
    ranged.sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(f"{base}/rows")
    stored = spark.read.schema(StructType([*rows.schema, StructField("__part", IntegerType())])).parquet(f"{base}/rows")
    # a row for each partition: its first and last key
    ends = stored.groupBy("__part").agg(F.min(F.struct(*by)).alias("a"), F.max(F.struct(*by)).alias("b")).orderBy("__part").collect()
    joined = {y["__part"] for x, y in zip(ends, ends[1:], strict=False) if x["b"] == y["a"]}
    follower = {x["__part"]: y["__part"] for x, y in zip(ends, ends[1:], strict=False) if x["b"] == y["a"]}
    active, states, k = None, {}, 0
    while active is None or active:
        fold = _folder(by, start, step, end, inner, set(follower), joined, states)
        some = stored if active is None else stored.where(F.col("__part").isin(sorted(active))).repartition(len(active), "__part")
        # files are cut and packed by Spark as it likes: parts are put together again before they are folded
        whole = some.repartition("__part") if active is None else some
        whole.sortWithinPartitions("__part", *keys).mapInArrow(fold, inner).write.parquet(f"{base}/out/round={k}")
        handed = spark.read.schema(inner).parquet(f"{base}/out/round={k}").where("__state IS NOT NULL").select("__at", "__state").collect() if follower else []
        states = {follower[r["__at"]]: bytes(r["__state"]) for r in handed}
        active, k = set(states), k + 1
    return spark.read.schema(inner).parquet(*[f"{base}/out/round={i}" for i in range(k)]).where("__state IS NULL").select(*[f.name for f in out])
