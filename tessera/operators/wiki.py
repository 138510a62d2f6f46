"""Knowledge pages: links, revisions, quality, governance; and the requests of a hub.

Pages: slug, title, summary, content, tags, revision, updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T

# Words that make a page critical.
CRITICAL = r"(?i)\b(architecture|security|authentication|authorization|auth|database|production|deploy|deployment|payment|billing|permission|permissions|acl|credential|secret|migration)\b"


def links(pages: DataFrame, targets: Column) -> DataFrame:
    """``slug, target`` for each distinct link of each page."""
    return pages.select("slug", F.explode(F.array_distinct(targets)).alias("target")).where("target <> ''")


def backlinks(found: DataFrame) -> DataFrame:
    return found.groupBy(F.col("target").alias("slug")).agg(F.count(F.lit(1)).alias("backlinks"))


def orphans(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Pages that no other page links to."""
    return pages.join(found.where("slug <> target").select(F.col("target").alias("slug")), "slug", "left_anti")


def broken(pages: DataFrame, found: DataFrame) -> DataFrame:
    return found.join(pages.select(F.col("slug").alias("target")), "target", "left_anti")


def latest(revisions: DataFrame) -> DataFrame:
    """The newest revision of each page."""
    cols = [c for c in revisions.columns if c != "slug"]
    return revisions.groupBy("slug").agg(F.max_by(F.struct(*cols), "revision").alias("x")).select("slug", "x.*")


def title_conflicts(pages: DataFrame) -> DataFrame:
    """Titles, case and white space aside, of more than one page."""
    return pages.groupBy(T.squeeze(F.lower("title")).alias("title")).agg(F.count(F.lit(1)).alias("pages"), F.min("slug").alias("first")).where("pages > 1")


def quality_report(pages: DataFrame, now: Column, stale_days: int = 90) -> DataFrame:
    """One row of counts."""
    return pages.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(S.age_days(F.col("updated"), now) > stale_days).alias("stale"), F.count_if(F.length("content") < 80).alias("short"), F.count_if(F.col("summary").isNull()).alias("without_summary"),
    )


def governed(candidates: DataFrame, source: Column) -> DataFrame:
    """``confidence``, ``critical``, ``needs_review`` and ``risk`` of candidate pages."""
    head = F.concat_ws(" ", "title", "summary", F.substring("content", 1, 2000), F.array_join("tags", " "))
    base = F.when(source == "skill", 0.96).when(source == "memory", 0.94).otherwise(0.88)
    n = F.length("content")
    confidence = base + F.when(F.arrays_overlap("tags", F.array(F.lit("class:permanent"), F.lit("class:task"))), 0.03).otherwise(0.0) + F.when(n >= 200, 0.02).otherwise(0.0) - F.when(n < 80, 0.05).otherwise(0.0) - F.when(F.length("title") < 4, 0.05).otherwise(0.0)
    rows = candidates.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), 4)).withColumn("critical", head.rlike(CRITICAL))
    review = (F.col("confidence") < 0.86) | (F.col("critical") & (F.col("confidence") < 0.94))
    return rows.withColumn("needs_review", review).withColumn("risk", F.when(F.col("critical"), "high").when(review, "medium").otherwise("low"))


def changes(ledger: DataFrame, now: DataFrame) -> DataFrame:
    """By ``key``: created, updated or unchanged against a ledger of digests."""
    both = now.join(ledger.select("key", F.col("digest").alias("was")), "key", "left")
    return both.select("key", F.when(F.col("was").isNull(), "created").when(F.col("was") != F.col("digest"), "updated").otherwise("unchanged").alias("change"))


def requests(rows: DataFrame) -> DataFrame:
    """By principal: requests, errors and time (``principal, failed, ms``)."""
    return rows.groupBy("principal").agg(F.count(F.lit(1)).alias("requests"), F.count_if("failed").alias("errors"), F.round(F.sum(F.greatest(F.lit(0.0), "ms")), 4).alias("ms"), F.round(F.max("ms"), 4).alias("slowest"))


def allowed(wanted: DataFrame, grants: DataFrame, owners: DataFrame) -> DataFrame:
    """Requests (``principal, team, scope``) of a team's owner or under a grant of that scope."""
    owner = wanted.join(owners, ["principal", "team"], "left_semi")
    granted = wanted.join(grants.select("principal", "team", F.explode("scopes").alias("scope")).distinct(), ["principal", "team", "scope"], "left_semi")
    return owner.union(granted).distinct()
