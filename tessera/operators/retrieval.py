"""Ranked retrieval: lexical, vector, hybrid, code, wiki and skill search, and context packing."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.folds import sorted_fold
from tessera.operators.lineage import stored

from tessera.functions import scoring as S
from tessera.functions import text as T


def scored(memories: DataFrame, query: str, query_tokens: list[str], now: Column) -> DataFrame:
    """Active records with ``keyword``, ``importance_score``, ``recent``, ``priority`` and ``score``."""
    words = F.concat_ws(" ", F.col("content"), F.array_join("tags", " "), F.col("type"))
    rows = memories.withColumn("active", S.active(F.col("expires"), F.col("superseded_by"), now)).where("active")
    # a record without any of the tokens goes before its words are counted
    some = F.lower(words).rlike("|".join(map(re.escape, query_tokens)))
    rows = rows.where(some).withColumn("keyword", S.keyword_score(T.tokenize(words), query_tokens)).where("keyword > 0")
    return rows.withColumns({
        "importance_score": S.effective_importance(F.col("type"), F.col("importance"), F.col("updated"), F.lit(True), now),
        "recent": S.recency(F.col("updated"), F.col("created"), now),
        "priority": S.type_priority(F.col("type"), S.preferred_types(query)),
    }).withColumn("score", S.hybrid_score(F.col("keyword"), F.col("importance_score"), F.col("recent"), F.col("priority")))


def lexical_search(memories: DataFrame, query: str, query_tokens: list[str], now: Column, k: int = 8, least: float = 0.05) -> DataFrame:
    """One pass over the records; only the k best of each task meet."""
    return scored(memories, query, query_tokens, now).where(F.col("score") >= least).orderBy(F.desc("score"), "id").limit(k)


def simple_search(memories: DataFrame, query_tokens: list[str], now: Column, k: int = 10) -> DataFrame:
    """Share of query tokens found plus a boost by importance."""
    rows = memories.withColumn("active", S.active(F.col("expires"), F.col("superseded_by"), now)).where("active")
    low = F.lower(F.concat_ws(" ", F.col("content"), F.array_join("tags", " ")))
    hits = sum((F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in query_tokens), F.lit(0))
    effective = S.effective_importance(F.col("type"), F.col("importance"), F.col("updated"), F.lit(True), now)
    return rows.withColumn("score", hits / max(1, len(query_tokens)) + effective / 500).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def vector_search(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k nearest by cosine; ``id`` and ``vector``."""
    return vectors.withColumn("score", S.cosine(F.col("vector"), F.array(*map(F.lit, query)))).orderBy(F.desc("score"), "id").limit(k)


def hybrid_merge(lexical: DataFrame, vector: DataFrame, k: int = 8) -> DataFrame:
    """Both results by id: .55 of the lexical score and .45 of the cosine, where positive."""
    both = lexical.select("id", F.col("score").alias("lexical")).join(vector.select("id", F.col("score").alias("vector")), "id", "full_outer")
    return both.withColumn("score", 0.55 * F.coalesce("lexical", F.lit(0.0)) + 0.45 * F.greatest(F.lit(0.0), F.coalesce("vector", F.lit(0.0)))).orderBy(F.desc("score"), "id").limit(k)


def rerank(hits: DataFrame, query_tokens: list[str], k: int = 10, wants_tests: bool = False) -> DataFrame:
    """Vector hits (``id, score, content, path``) again by .75 of the cosine and .25 of the words, less for tests and generated files."""
    from tessera.functions.paths import is_test

    lexical = S.keyword_score(T.tokenize(F.col("content")), query_tokens)
    weight = F.when(is_test(F.col("path")) & F.lit(not wants_tests), 0.35).when(F.col("path").rlike(r"(^|/)(dist|generated|build)/|\.min\.js$|\.d\.ts$"), 0.25).otherwise(1.0)
    return hits.withColumn("score", (0.75 * F.col("score") + 0.25 * lexical) * weight).orderBy(F.desc("score"), "id").limit(k)


def wiki_search(pages: DataFrame, tokens: list[str], k: int = 20) -> DataFrame:
    """``slug, title, tags, summary, content, revision, updated``: the best pages, the newest first among equals."""
    score = S.wiki_score(F.col("slug"), F.col("title"), F.col("tags"), F.col("summary"), F.col("content"), tokens)
    return pages.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), F.desc("updated"), "slug").limit(k)


def missing_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    return records.join(vectors, "id", "left_anti")


def orphan_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    return vectors.join(records, "id", "left_anti")


def stale_vectors(records: DataFrame, vectors: DataFrame) -> DataFrame:
    """Records whose content is not the one that was embedded (``hash`` on both sides)."""
    return records.join(vectors.select("id", F.col("hash").alias("__h")), "id").where("hash <> __h").drop("__h")


def hash_embedding(rows: DataFrame, dimensions: int = 128) -> DataFrame:
    """``id`` and ``vector``: counts of hashed words, scaled to length 1; rows are ``id, text``.

    A row's words are counted where it is read, each distinct word of a batch is hashed once, and counts of equal identifiers are put together; words are not shuffled.
    """

    @F.arrow_udf("array<int>")
    def counted(text: pa.Array) -> pa.Array:
        words = pc.ascii_split_whitespace(text)
        each, row = pc.list_flatten(words).dictionary_encode(), pc.list_parent_indices(words).to_numpy()
        known, code = each.dictionary.cast(pa.binary()).to_pylist(), each.indices.to_numpy()
        place = np.frombuffer(b"".join(hashlib.sha256(w).digest()[:4] for w in known), ">u4").astype(np.int64) % dimensions
        some = np.array([w != b"" for w in known], bool)[code]
        n = np.bincount(row[some] * dimensions + place[code[some]], minlength=len(text) * dimensions)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1) * dimensions, pa.int32()), pa.array(n, pa.int32()))

    @F.arrow_udf("array<double>")
    def scaled(parts: pa.Array) -> pa.Array:
        n = np.zeros((len(parts), dimensions), np.int64)
        np.add.at(n, pc.list_parent_indices(parts).to_numpy(), pc.list_flatten(pc.list_flatten(parts)).to_numpy().reshape(-1, dimensions))
        x = n / np.sqrt((n * n).sum(axis=1, keepdims=True))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1) * dimensions, pa.int32()), pa.array(x.reshape(-1)))

    texts = rows.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select("id", counted(F.lower("text")).alias("n"))
    return texts.groupBy("id").agg(F.collect_list("n").alias("parts")).select("id", scaled("parts").alias("vector"))


def mean_pool(tokens: DataFrame) -> DataFrame:
    """Token vectors (``id, place, vector``) averaged component by component, without forming a text's matrix."""
    each = tokens.select("id", F.posexplode("vector").alias("d", "x"))
    means = each.groupBy("id", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("vector"))


def pack_prefix(items: DataFrame, budget: int, extra: int = 0, group: str = "query_id", order: str = "rank", text: str = "text") -> DataFrame:
    """Items in order until the first that does not fit the budget of characters (each costs ``extra`` more)."""
    used = F.sum(F.length(text) + extra).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("used", used).where(F.col("used") <= budget)


def pack_greedy(items: DataFrame, budget: int = 3200, most: int = 12, group: str = "query_id", order: str = "rank", partitions: int | None = None) -> DataFrame:
    """Items (``kind, value, source``) in order, skipping what does not fit; the first always fits. ``picked`` lists their ranks.

    Where the first ``most`` fit together they are the choice. In other groups it depends on all before it, so it is a fold over each group's
    sorted costs; its state has at most ``most`` ranks.
    """
    cost = F.length("kind") + F.length("value") + F.length("source") + 16
    costs = items.select(F.col(group).alias("g"), F.col(order).cast("int").alias("r"), cost.alias("c"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("r", "c"))
    firsts = costs.withColumn("k", place).where(F.col("k") <= max(most, 1)).groupBy("g").agg(F.sum("c").alias("used"), F.transform(F.array_sort(F.collect_list(F.struct("k", "r"))), lambda x: x["r"]).alias("picked"))
    firsts = stored(firsts.withColumn("fits", (F.col("used") <= budget) | (F.size("picked") == 1)), "firsts")
    fitting, others = firsts.where("fits").select(F.col("g").alias(group), F.col("used").cast("int").alias("used"), "picked"), firsts.where("NOT fits").select("g")
    if others.isEmpty():
        return fitting
    costs = costs.join(others, costs["g"].eqNullSafe(others["g"]), "left_semi")

    def step(state: dict, row: dict) -> list:
        if not state["picked"] or (state["used"] + row["c"] <= budget and len(state["picked"]) < most):
            state["used"] += row["c"]
            state["picked"].append(row["r"])
        return []

    kind = items.schema[group].dataType.simpleString()
    out = sorted_fold(costs, ["g"], ["r", "c"], lambda key: {"used": 0, "picked": []}, step, lambda key, state: [(*key, state["used"], state["picked"])], f"g {kind}, used int, picked array<int>", partitions)
    return fitting.unionByName(out.withColumnRenamed("g", group))


def line_windows(files: DataFrame, size: int = 80, step: int = 70, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Overlapping windows of lines: ``id, part, start_line, end_line, content, hash``; blank ones go but keep their number."""
    lines = files.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines")).withColumn("n", F.size("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    each = lines.select("id", "lines", "n", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    start = F.col("part") * step + 1
    each = each.withColumn("start_line", start).withColumn("end_line", F.least(start + size - 1, F.col("n"))).withColumn("content", F.array_join(F.slice("lines", start, F.lit(size)), "\n"))
    return each.where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "").select("id", "part", "start_line", "end_line", "content", F.sha2("content", 256).alias("hash"))
