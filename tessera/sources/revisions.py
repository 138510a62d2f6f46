"""Guarded writes: a table of revisions with a log of commits, for writers that don't know of each other.

A commit writes its rows first and then claims the next number of the log, which only one writer can. Who comes second judges its changes anew against what the
first has written. A change names the revision that it was made from: it is taken if that still is the last one, else it is a conflict. Readers see
what commits name and nothing else, so a writer that dies leaves no trace.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.lineage import stored

#: How often a writer tries to claim a number.
ATTEMPTS = 50


def _local(path: str) -> str | None:
    return path if "://" not in path and not path.startswith("file:") else "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else None


def _claim(spark: SparkSession, folder: str, number: int, entry: dict) -> bool:
    """Create the log's entry of a number with its content at once; False if there is one."""
    name, text = f"{number:012}.json", json.dumps(entry)
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        own = f"{local}/.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(text)
        try:
            os.link(own, f"{local}/{name}")  # fails where there is one, and never shows half of an entry
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    own = jvm.org.apache.hadoop.fs.Path(f"{folder}/.{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(own)
    out.write(bytearray(text.encode()))
    out.close()
    renamed = fs.rename(own, target)  # stores that rename atomically refuse where there is one
    if not renamed:
        fs.delete(own, False)
    return renamed


def commits(spark: SparkSession, path: str) -> list[dict]:
    """The log's entries in order: as many as there were commits."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/log")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = sorted(x.getPath().toString() for x in fs.listStatus(folder) if not x.getPath().getName().startswith("."))
    return [json.loads(r[0]) for r in spark.read.text(names, wholetext=True).withColumn("f", F.input_file_name()).orderBy("f").select("value").collect()] if names else []


def history(spark: SparkSession, path: str) -> DataFrame | None:
    """All revisions (``key, revision``, the columns of the changes, ``commit``); None before the first commit."""
    made = [c for c in commits(spark, path) if c["rows"]]
    return spark.read.schema(made[0]["schema"]).parquet(*[f"{path}/{c['data']}" for c in made]) if made else None


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last revision of each key."""
    rows = history(spark, path)
    if rows is None:
        return None
    others = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.max_by(F.struct(*others), "revision").alias("x")).select("key", "x.*")


def commit(changes: DataFrame, path: str) -> tuple[int, DataFrame]:
    """Take changes (``key, base`` and other columns; base 0: a new key) and return the commit's number and the conflicts: ``changes`` with ``last``, the revision that is there.

    Of several changes of a key in one commit the first by all columns is taken. All that are taken become visible at once.
    """
    spark = changes.sparkSession
    others = [c for c in changes.columns if c not in ("key", "base")]
    changes = stored(changes, "changes")
    for _ in range(ATTEMPTS):
        number = len(commits(spark, path))
        now = current(spark, path)
        last = changes.withColumn("last", F.lit(0).cast("long")) if now is None else changes.join(now.select("key", F.col("revision").alias("last")), "key", "left").na.fill(0, ["last"])
        place = F.row_number().over(Window.partitionBy("key").orderBy((F.col("base") == F.col("last")).desc(), *changes.columns))
        judged = stored(last.withColumn("ok", (F.col("base") == F.col("last")) & (place == 1)), "judged")
        data = f"data/{uuid.uuid4().hex}"
        taken = judged.where("ok").select("key", (F.col("base") + 1).cast("long").alias("revision"), *others, F.lit(number).cast("long").alias("commit"))
        taken.write.parquet(f"{path}/{data}")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in taken.schema)
        if _claim(spark, f"{path}/log", number, {"data": data, "rows": taken.count(), "schema": ddl}):
            return number, judged.where("NOT ok").drop("ok")
    raise RuntimeError(f"no number of the log of {path} could be claimed")
