"""Exact deduplication by a distributed content sort (DataFrame operations only).

Normalised texts are range-partitioned by splitters that Spark samples from the data, each range is sorted
externally, equal texts then stand next to each other and a window compares neighbours in full. A text with very
many copies would fill one range; such texts are found first by counting 64-bit hashes (with map-side
pre-aggregation) and get a salt, so that their copies spread over several ranges. Each salted part is sorted and
compared like any other text, and the parts of one text are merged by its SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Numbered, ascii_lower, stored

#: At most so many texts are treated as hot, so the broadcast list of hashes has at most so many 16-byte rows.
HOT_TEXTS = 100_000
#: A text with no more copies than this is never split.
LEAST_HOT = 256
#: Characters of a text that lead the sort.
HEAD = 48


def with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", least_hot: int = LEAST_HOT) -> DataFrame:
    """``docs`` with ``__keep``, ``__size``, ``__kept`` and ``__sha`` (null text counts as empty)."""
    rows = docs.count()
    bound = max(least_hot, -(-rows // HOT_TEXTS))
    keyed = docs.withColumn("__norm", ascii_lower(F.coalesce(F.col(text_col), F.lit(""))))
    # rows / bound texts at most can have more than bound copies: the list is small whatever the input
    hot = stored(keyed.groupBy(F.xxhash64("__norm").alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound), "hot-texts")
    some = not hot.isEmpty()
    if some:
        keyed = keyed.withColumn("__h", F.xxhash64("__norm")).join(F.broadcast(hot), "__h", "left").drop("__h")
        keyed = keyed.withColumn("__salt", F.when(F.col("__n").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(id_col), F.ceil(F.col("__n") / bound))).cast("int"))
    else:
        keyed = keyed.withColumn("__n", F.lit(None).cast("long")).withColumn("__salt", F.lit(0))
    best = F.max(id_col) if keep == "largest" else F.min(id_col)
    order = F.col(id_col).desc_nulls_last() if keep == "largest" else F.col(id_col).asc_nulls_last()
    # the splitters that Spark samples are short: the head of a text, then a hash that parts texts with equal heads
    keyed = keyed.withColumn("__head", F.substring("__norm", 1, HEAD)).withColumn("__hash", F.xxhash64("__norm"))
    same = Window.partitionBy("__head", "__hash", "__salt", "__norm").orderBy(order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = (
        keyed.repartitionByRange("__head", "__hash", "__salt")
        .withColumn("__keep", best.over(whole))
        .withColumn("__size", F.count(F.lit(1)).over(whole))
        .withColumn("__first", F.row_number().over(same) == 1)
        .withColumn("__sha", F.sha2(F.encode("__norm", "UTF-8"), 256))
        .drop("__norm", "__head", "__hash")
    )
    if some:
        merged = keyed.where(F.col("__n").isNotNull()).groupBy(F.sha2(F.encode("__norm", "UTF-8"), 256).alias("__sha")).agg(best.alias("__all_keep"), F.count(F.lit(1)).alias("__all_size"))
        out = out.join(F.broadcast(merged), "__sha", "left").withColumn("__keep", F.when(F.col("__all_size").isNull(), F.col("__keep")).otherwise(F.col("__all_keep"))).withColumn("__size", F.coalesce("__all_size", "__size"))
    return out.withColumn("__kept", F.col("__first") & F.col(id_col).eqNullSafe(F.col("__keep")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", least_hot: int = LEAST_HOT) -> DataFrame:
    """One row per row of ``docs`` with its group of equal texts.

    Texts are equal when identical after lower-casing A-Z. Of a group the row with the largest identifier stays
    (``keep="smallest"``: the smallest); of repeated rows with that identifier one stays. A null text counts as
    empty, a null identifier loses to any other, an empty table gives an empty result. Columns: the identifier, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``; other columns of ``docs`` play no part, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    out = with_groups(slim, "__id", "__text", keep, least_hot)
    return out.select(F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), F.col("__sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``, whatever their names.

    Rows are judged as in ``exact_dedup``: null texts are copies of empty ones, one of repeated rows stays, an empty table stays empty.
    """
    own = Numbered(docs)
    return own.back(with_groups(own.rows, own.of(id_col), own.of(text_col), keep).where("__kept"))
