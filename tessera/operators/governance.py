"""Review states, conflicts, summaries, and the roll-up of impact.

Reviews: slug, digest, status (pending, approved, rejected), risk, at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import squeeze
from tessera.operators.lineage import stored

RISKS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def conflicts(pages: DataFrame) -> DataFrame:
    """``slug, others``: pages that share a title, case and white space aside, with pages of another content (``slug, title, digest``).

    Contents are counted by title and digest, and a page's others are all of its title less those of its own content, so no
    pairs are formed.
    """
    rows = pages.withColumn("key", squeeze(F.lower("title")))
    same = rows.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("own"))
    every = rows.groupBy("key").agg(F.count(F.lit(1)).alias("all"))
    return rows.join(same, ["key", "digest"]).join(every, "key").where("all > own").select("slug", (F.col("all") - F.col("own")).alias("others"))


def gate(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """``slug, verdict`` of candidates (``slug, digest, needs_review``) by the last review of that very content: allow, deny, wait, approve (no review needed) or create (one is)."""
    last = reviews.groupBy("slug", "digest").agg(F.max_by("status", "at").alias("status"))
    rows = candidates.join(last, ["slug", "digest"], "left")
    verdict = F.when(F.col("status") == "approved", "allow").when(F.col("status") == "rejected", "deny").when(~F.col("needs_review"), "approve").when(F.col("status") == "pending", "wait").otherwise("create")
    return rows.select("slug", verdict.alias("verdict"))


def summary(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("risk").agg(F.count(F.lit(1)).alias("reviews"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "approved", "rejected")])


def impact_rollup(impacts: DataFrame, group: str = "session") -> DataFrame:
    """The worst risk, the sum of scores and the distinct files of ``risk, score, file``."""
    rank = F.array_position(F.array(*map(F.lit, RISKS)), F.col("risk"))
    rows = impacts.groupBy(group).agg(F.max(rank).alias("r"), F.sum("score").alias("score"), F.count_distinct("file").alias("files"))
    return rows.select(group, F.element_at(F.array(*map(F.lit, RISKS)), F.col("r").cast("int")).alias("risk"), "score", "files")


def new_candidates(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose fingerprint is not known yet, each fingerprint once (the smallest identifier)."""
    return candidates.join(known.select("fingerprint"), "fingerprint", "left_anti").groupBy("fingerprint").agg(F.min("id").alias("id"))


def open_actions(actions: DataFrame, done: DataFrame) -> DataFrame:
    """Actions (``project, title``) that no completed title of the project equals, case and white space aside."""
    key = squeeze(F.lower("title"))
    return actions.withColumn("key", key).join(done.select("project", key.alias("key")), ["project", "key"], "left_anti").select("project", "title").distinct()


def surviving_edges(edges: DataFrame, vertices: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges both whose ends exist and lie in files that did not change (``file``)."""
    kept = stored(vertices.join(changed.select("file"), "file", "left_anti").select("id"), "kept")
    return edges.join(kept.withColumnRenamed("id", "src"), "src", "left_semi").join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
