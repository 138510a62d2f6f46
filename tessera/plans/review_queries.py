"""Queries over reviews and what follows changes, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import governance as V
from tessera.plans import inputs as I


def page_conflicts(spark, d):
    return V.conflicts(I.wiki_pages(spark, d).select("slug", "title", (F.col("page_id") % 3).alias("digest")))


def _reviews(spark, d):
    e = I.table(spark, d, "events")
    return e.select(F.concat(F.lit("page-"), F.col("event_id") % 300).alias("slug"), (F.col("event_id") % 4).alias("digest"), I.pick(["pending", "approved", "rejected", "pending", "approved"], F.col("event_id") % 5).alias("status"), I.pick(V.RISKS, F.col("user_id") % 4).alias("risk"), F.col("event_id").alias("at"))


def review_gate(spark, d):
    c = I.wiki_pages(spark, d).select("slug", (F.col("page_id") % 6).alias("digest"), (F.col("page_id") % 2 == 0).alias("needs_review"))
    return V.gate(c, _reviews(spark, d))


def review_summary(spark, d):
    return V.summary(_reviews(spark, d))


def impact_rollup(spark, d):
    e = I.table(spark, d, "events")
    rows = e.select(F.col("user_id").alias("session"), I.pick(["LOW", "MEDIUM", "HIGH", "CRITICAL"], (F.col("event_id") * 7 + F.col("user_id")) % (F.col("user_id") % 4 + 1)).alias("risk"), (F.col("event_id") % 30).alias("score"), F.concat(F.lit("f"), F.col("event_id") % 40).alias("file"))
    return V.impact_rollup(rows)


def new_candidates(spark, d):
    o = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256).alias("fingerprint"))
    return V.new_candidates(o, o.where("id % 4 = 0"))


def open_actions(spark, d):
    o = I.observations(spark, d).withColumn("title", F.concat(F.lit("Do  "), F.col("key")))
    return V.open_actions(o.select("project", "title"), o.where("status = 'completed'").select("project", F.upper("title").alias("title")))


def surviving_edges(spark, d):
    v = I.vertices(spark, d)
    changed = v.where("type = 'class'").select("file").distinct().where("file LIKE '%n1%'")
    return V.surviving_edges(I.edges(spark, d), v, changed).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

REVIEWS = "re AS (SELECT 'page-' || (event_id % 300) AS slug, event_id % 4 AS digest, ['pending', 'approved', 'rejected', 'pending', 'approved'][((event_id % 5) + 1)::int] AS status, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][((user_id % 4) + 1)::int] AS risk, event_id AS n FROM events)"
SQL = {
    "page_conflicts": rf"WITH {I.WIKI}, p AS (SELECT slug, trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS key, page_id % 3 AS digest FROM wp) SELECT a.slug, count(*) AS others FROM p a JOIN p b ON a.key = b.key AND a.digest <> b.digest GROUP BY a.slug",
    "review_gate": f"WITH {I.WIKI}, {REVIEWS}, l AS (SELECT slug, digest, arg_max(status, n) AS status FROM re GROUP BY ALL) SELECT w.slug, CASE WHEN status = 'approved' THEN 'allow' WHEN status = 'rejected' THEN 'deny' WHEN page_id % 2 <> 0 THEN 'approve' WHEN status = 'pending' THEN 'wait' ELSE 'create' END AS verdict FROM wp w LEFT JOIN l ON l.slug = w.slug AND l.digest = page_id % 6",
    "review_summary": f"WITH {REVIEWS} SELECT risk, count(*) AS reviews, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'rejected') AS rejected FROM re GROUP BY risk",
    "impact_rollup": "SELECT user_id AS session, ['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'][(max((event_id * 7 + user_id) % (user_id % 4 + 1)) + 1)::int] AS risk, sum(event_id % 30)::bigint AS score, count(DISTINCT event_id % 40) AS files FROM events GROUP BY user_id",
    "new_candidates": "WITH o AS (SELECT doc_id AS id, sha256(lower(coalesce(text, ''))) AS fingerprint FROM documents) SELECT fingerprint, min(id) AS id FROM o WHERE fingerprint NOT IN (SELECT fingerprint FROM o WHERE id % 4 = 0) GROUP BY 1",
    "open_actions": f"WITH {I.OBS} SELECT DISTINCT project, 'Do  ' || key AS title FROM obs WHERE (project, key) NOT IN (SELECT (project, key) FROM obs WHERE status = 'completed')",
    "surviving_edges": f"WITH {I.GRAPH}, k AS (SELECT id FROM v WHERE file NOT IN (SELECT file FROM v WHERE type = 'class' AND file LIKE '%n1%')) SELECT type, count(*) AS n FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY type",
}
