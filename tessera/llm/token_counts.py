"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are encoded where they lie and only their lengths are counted, with map-side pre-aggregation. Suffix sums
run in two levels: within ranges of SPAN lengths, and over the ranges, so the longer the longest text is the more
tasks share the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.bpe import encode_documents
from tessera.llm.common import stored

SPAN = 1024


def length_histogram(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``n_tokens`` and ``docs``: how many rows have that encoded length, as a stored table, so the corpus is encoded once.

    Null and empty texts have length 0, repeated rows count each, very long texts are encoded in chunks, an empty table
    gives an empty histogram; other columns play no part, whatever their names.
    """
    return stored(encode_documents(docs, id_col, text_col).groupBy(F.size("token_ids").cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs")), "histogram")


def suffix_sums(histogram: DataFrame, span: int = SPAN) -> DataFrame:
    """For each length that occurs, taken as a context limit.

    ``docs_from`` and ``tokens_from`` count the documents at least so long and their tokens, ``docs_longer`` and
    ``tokens_longer`` those longer, ``truncated_tokens`` is the total after cutting every document at the limit, ``lost_tokens`` what
    that drops, ``share_within`` the share of documents that fit. An empty histogram gives an empty table.
    """
    rows = histogram.withColumn("tokens", F.col("n_tokens") * F.col("docs")).withColumn("range", F.floor(F.col("n_tokens") / span))
    ranges = rows.groupBy("range").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    # a row for each range of lengths: few, whatever the number of documents
    over = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = ranges.select("range", F.coalesce(F.sum("d").over(over), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("tokens_above"), F.sum("d").over(whole).alias("all_docs"), F.sum("t").over(whole).alias("all_tokens"))
    here = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.join(above, "range").withColumn("docs_from", F.sum("docs").over(here) + F.col("docs_above")).withColumn("tokens_from", F.sum("tokens").over(here) + F.col("tokens_above"))
    out = out.withColumn("docs_longer", F.col("docs_from") - F.col("docs")).withColumn("tokens_longer", F.col("tokens_from") - F.col("tokens"))
    kept = F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")
    return out.select(
        "n_tokens", "docs", "docs_from", "tokens_from", "docs_longer", "tokens_longer", kept.alias("truncated_tokens"), (F.col("all_tokens") - kept).alias("lost_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit``, ``docs_longer`` and ``truncated_tokens`` for any limits, whether such a length occurs or not."""
    each = sums.select("*", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit"))
    longer = F.when(F.col("n_tokens") > F.col("limit"), F.struct("docs_from", "tokens_from"))
    # the total is the tokens of the shortest and all longer documents
    found = each.groupBy("limit").agg(F.min_by(longer, F.when(F.col("n_tokens") > F.col("limit"), F.col("n_tokens"))).alias("x"), F.max("tokens_from").alias("all_tokens"))
    docs, tokens = F.coalesce("x.docs_from", F.lit(0)), F.coalesce("x.tokens_from", F.lit(0))
    return found.select("limit", docs.alias("docs_longer"), (F.col("all_tokens") - tokens + docs * F.col("limit")).alias("truncated_tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and ``n_tokens``: the smallest length within which that share of the documents lies."""
    each = sums.select("n_tokens", "share_within", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return each.where("share_within >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
