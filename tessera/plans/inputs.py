"""How the given tables stand for the engine's own: for Spark, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-06-15 00:00:00"


def now() -> Column:
    return F.expr(f"timestamp_ntz'{NOW}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def floor_div(a: str, n: int) -> Column:
    return F.expr(f"{a} div {n}")


TYPES = ["code", "activity", "decision", "rule", "todo", "summary"]
LEVELS = ["critical", "high", "normal", "temporary"]
CLASSES = ["class:permanent", "class:task", "class:session", "class:transient", None]


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    created = F.expr("timestamp_ntz'2024-06-01 00:00:00' - make_dt_interval(cast(doc_id % 400 as int))")
    cls = pick([c or "" for c in CLASSES], floor_div("doc_id", 3) % 5)
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("p"), F.col("doc_id") % 7).alias("project"), pick(TYPES, F.col("doc_id") % 6).alias("type"), F.coalesce("text", F.lit("")).alias("content"),
        pick(LEVELS, floor_div("doc_id", 6) % 4).alias("importance"), F.filter(F.array(cls, "source", "lang"), lambda t: t.isNotNull() & (t != "")).alias("tags"), "source", created.alias("created"),
        (created + F.expr("make_dt_interval(0, cast((doc_id * 7) % 30 as int))")).alias("updated"), F.when(F.col("doc_id") % 11 == 0, created + F.expr("make_dt_interval(30)")).alias("expires"),
        F.when(F.col("doc_id") % 13 == 0, F.col("doc_id") + 1).alias("superseded_by"), F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("topic"), F.col("doc_id") % 50)).alias("topic"), F.col("doc_id").alias("seq"),
    )


MEM = """mem AS (SELECT *, created + to_hours(((id * 7) % 30)::int) AS updated, CASE WHEN id % 11 = 0 THEN created + to_days(30) END AS expires FROM (
SELECT doc_id AS id, 'p' || (doc_id % 7) AS project, ['code', 'activity', 'decision', 'rule', 'todo', 'summary'][((doc_id % 6) + 1)::int] AS type, coalesce(text, '') AS content,
  ['critical', 'high', 'normal', 'temporary'][(((doc_id // 6) % 4) + 1)::int] AS importance,
  list_filter([['class:permanent', 'class:task', 'class:session', 'class:transient', NULL][(((doc_id // 3) % 5) + 1)::int], source, lang], lambda t: t IS NOT NULL AND t <> '') AS tags, source,
  TIMESTAMP '2024-06-01' - to_days((doc_id % 400)::int) AS created,
  CASE WHEN doc_id % 13 = 0 THEN doc_id + 1 END AS superseded_by, CASE WHEN doc_id % 4 = 0 THEN 'topic' || (doc_id % 50) END AS topic, doc_id AS seq FROM documents)),
act AS (SELECT *, (expires IS NULL OR expires > TIMESTAMP '2024-06-15') AND superseded_by IS NULL AS active, greatest(0, (epoch_us(TIMESTAMP '2024-06-15') - epoch_us(updated)) / 86400000000.0) AS age FROM mem),
imp AS (SELECT *, CASE WHEN NOT active THEN 0.0 WHEN importance = 'critical' THEN 100.0 ELSE
  CASE importance WHEN 'high' THEN 75.0 WHEN 'normal' THEN 50.0 ELSE 20.0 END * pow(0.5, age / CASE type WHEN 'activity' THEN 14 WHEN 'summary' THEN 30 WHEN 'todo' THEN 90 WHEN 'decision' THEN 365 WHEN 'rule' THEN 730 ELSE 180 END) END AS effective FROM act)"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The star schema as code: a file for each region, a module for each nation, functions, classes, interfaces, methods."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("long")
    return (
        t("region").select(F.expr("concat('r:', r_regionkey)").alias("id"), F.col("r_name").alias("name"), F.lit("file").alias("type"), F.expr("concat('src/core/region', r_regionkey, '.ts')").alias("file"), none.alias("start_line"), none.alias("end_line"))
        .unionByName(t("nation").select(F.expr("concat('n:', n_nationkey)").alias("id"), F.col("n_name").alias("name"), F.lit("module").alias("type"), F.expr("concat('src/storage/nation', n_nationkey, '.ts')").alias("file"), none.alias("start_line"), none.alias("end_line")))
        .unionByName(t("customer").select(F.expr("concat('c:', c_custkey)").alias("id"), F.col("c_name").alias("name"), F.lit("function").alias("type"), F.expr("concat('src/retrieval/', c_mktsegment, '/n', c_nationkey, '.ts')").alias("file"), F.expr("(c_custkey % 500) * 10 + 1").alias("start_line"), F.expr("(c_custkey % 500) * 10 + 9").alias("end_line")))
        .unionByName(t("supplier").select(F.expr("concat('s:', s_suppkey)").alias("id"), F.expr("concat('supplier', s_suppkey % 60)").alias("name"), F.lit("class").alias("type"), F.expr("concat('src/memory/n', s_nationkey, '.ts')").alias("file"), F.expr("s_suppkey * 5").alias("start_line"), F.expr("s_suppkey * 5 + 30").alias("end_line")))
        .unionByName(t("part").select(F.expr("concat('p:', p_partkey)").alias("id"), F.expr("concat('part', p_partkey)").alias("name"), F.lit("interface").alias("type"), F.expr("if(p_partkey % 5 = 0, concat('tests/', p_brand, '.test.ts'), concat('src/internal/', p_brand, '.ts'))").alias("file"), F.expr("p_partkey % 90").alias("start_line"), F.expr("p_partkey % 90 + p_size").cast("long").alias("end_line")))
        .unionByName(t("orders").select(F.expr("concat('o:', o_orderkey)").alias("id"), F.expr("concat('order', o_orderkey % 700)").alias("name"), F.lit("method").alias("type"), F.expr("concat('src/runtime/', substr(o_orderpriority, 1, 1), '/', o_custkey % 20, '.ts')").alias("file"), F.col("o_orderkey").alias("start_line"), F.expr("o_orderkey + 4").alias("end_line")))
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    e = lambda df, src, dst, kind, ord_: df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.expr(kind).alias("type"), F.expr(ord_).cast("long").alias("ord"))
    line = t("lineitem")
    kind = "case when l_returnflag = 'R' then 'CALL_REFERENCE' when l_returnflag = 'A' then 'WRITES' else 'IMPORTS' end"
    return (
        e(t("nation"), "concat('r:', n_regionkey)", "concat('n:', n_nationkey)", "'DEFINES'", "n_nationkey")
        .unionByName(e(t("customer"), "concat('c:', c_custkey)", "concat('n:', c_nationkey)", "'USES_TYPE'", "1000 + c_custkey"))
        .unionByName(e(t("supplier"), "concat('s:', s_suppkey)", "concat('n:', s_nationkey)", "'INHERITS'", "10000000 + s_suppkey"))
        .unionByName(e(t("orders"), "concat('o:', o_orderkey)", "concat('c:', o_custkey)", "'CALLS'", "20000000 + o_orderkey"))
        .unionByName(e(line, "concat('o:', l_orderkey)", "concat('p:', l_partkey)", kind, "100000000 + l_orderkey * 10 + l_linenumber"))
        .unionByName(e(line.where("l_linenumber = 1"), "concat('p:', l_partkey)", "concat('s:', l_suppkey)", "'IMPLEMENTS'", "1000000000 + l_orderkey"))
    )


GRAPH = """v AS (
SELECT 'r:' || r_regionkey AS id, r_name AS name, 'file' AS type, 'src/core/region' || r_regionkey || '.ts' AS file, NULL::bigint AS start_line, NULL::bigint AS end_line FROM region
UNION ALL SELECT 'n:' || n_nationkey, n_name, 'module', 'src/storage/nation' || n_nationkey || '.ts', NULL, NULL FROM nation
UNION ALL SELECT 'c:' || c_custkey, c_name, 'function', 'src/retrieval/' || c_mktsegment || '/n' || c_nationkey || '.ts', (c_custkey % 500) * 10 + 1, (c_custkey % 500) * 10 + 9 FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'supplier' || (s_suppkey % 60), 'class', 'src/memory/n' || s_nationkey || '.ts', s_suppkey * 5, s_suppkey * 5 + 30 FROM supplier
UNION ALL SELECT 'p:' || p_partkey, 'part' || p_partkey, 'interface', CASE WHEN p_partkey % 5 = 0 THEN 'tests/' || p_brand || '.test.ts' ELSE 'src/internal/' || p_brand || '.ts' END, p_partkey % 90, p_partkey % 90 + p_size FROM part
UNION ALL SELECT 'o:' || o_orderkey, 'order' || (o_orderkey % 700), 'method', 'src/runtime/' || substr(o_orderpriority, 1, 1) || '/' || (o_custkey % 20) || '.ts', o_orderkey, o_orderkey + 4 FROM orders),
e AS (
SELECT 'r:' || n_regionkey AS src, 'n:' || n_nationkey AS dst, 'DEFINES' AS type, n_nationkey::bigint AS ord FROM nation
UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'USES_TYPE', 1000 + c_custkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'INHERITS', 10000000 + s_suppkey FROM supplier
UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'CALLS', 20000000 + o_orderkey FROM orders
UNION ALL SELECT 'o:' || l_orderkey, 'p:' || l_partkey, CASE WHEN l_returnflag = 'R' THEN 'CALL_REFERENCE' WHEN l_returnflag = 'A' THEN 'WRITES' ELSE 'IMPORTS' END, 100000000 + l_orderkey * 10 + l_linenumber FROM lineitem
UNION ALL SELECT 'p:' || l_partkey, 's:' || l_suppkey, 'IMPLEMENTS', 1000000000 + l_orderkey FROM lineitem WHERE l_linenumber = 1)"""


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as events: every fifth has the source identifier of the one before, so the log holds repeats."""
    m = table(spark, sf_dir, "conversations")
    source = F.when(F.col("turn") % 3 != 2, F.concat(F.lit("m"), F.expr("turn - if(turn % 5 = 4, 1, 0)")))
    kind = F.when(F.expr("(conv_id + turn) % 29 = 0"), "error").when(F.col("turn") == 7, "session_end").when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("custom")
    return m.select(F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project"), F.col("conv_id").alias("session"), F.col("turn").alias("seq"), kind.alias("type"), "role", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))").alias("ts"), F.coalesce("text", F.lit("")).alias("text"), source.alias("source_event"))


SESSIONS = """ev AS (SELECT 'p' || (conv_id % 7) AS project, conv_id AS session, turn AS seq,
CASE WHEN (conv_id + turn) % 29 = 0 THEN 'error' WHEN turn = 7 THEN 'session_end' WHEN role = 'user' THEN 'user_message' WHEN role = 'assistant' THEN 'assistant_message' ELSE 'custom' END AS type, role,
TIMESTAMP '2024-01-01' + to_hours(conv_id::int) + to_minutes(turn::int) AS ts, coalesce(text, '') AS text,
CASE WHEN turn % 3 <> 2 THEN 'm' || (turn - CASE WHEN turn % 5 = 4 THEN 1 ELSE 0 END) END AS source_event FROM conversations)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = pick(["pending", "in_progress", "blocked", "pending", "cancelled", "pending", "in_progress", "completed", "pending", "pending", "blocked"], F.col("event_id") % 11)
    return e.select(
        F.concat(F.lit("p"), F.col("user_id") % 20).alias("project"), F.col("event_type").alias("kind"), F.concat(F.lit("k"), F.col("event_id") % 97).alias("key"), F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"), status.alias("status"), F.col("ts"),
        F.col("event_id").alias("seq"), F.expr("(event_id % 41) / 41.0D").alias("confidence"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 10).alias("ord"), F.col("user_id").alias("session"), F.concat(F.lit("s"), F.col("event_id") % 13).alias("scope"),
    )


OBS = """obs AS (SELECT 'p' || (user_id % 20) AS project, event_type AS kind, 'k' || (event_id % 97) AS key, event_type || ' ' || props AS text,
['pending', 'in_progress', 'blocked', 'pending', 'cancelled', 'pending', 'in_progress', 'completed', 'pending', 'pending', 'blocked'][((event_id % 11) + 1)::int] AS status, ts, event_id AS seq,
(event_id % 41) / 41.0::double AS confidence, CASE WHEN event_id % 7 <> 0 THEN event_id % 10 END AS ord, user_id AS session, 's' || (event_id % 13) AS scope FROM events)"""


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 50).alias("project"), F.col("event_type").alias("type"), "ts", F.col("props").alias("data"), "value")


ACTIVITY = "a AS (SELECT event_id AS id, 'p' || (user_id % 50) AS project, event_type AS type, ts, props AS data, value FROM events)"


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    title = F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")), F.lit("untitled"))
    content = F.regexp_replace("html", "<[^>]*>", " ")
    return p.select(
        F.concat(F.lit("page-"), F.col("page_id")).alias("slug"), title.alias("title"), F.when(F.col("page_id") % 3 != 0, F.substring(title, 1, 40)).alias("summary"), content.alias("content"), F.array(pick(["class:permanent", "class:task", "the", "guide"], F.col("page_id") % 4), F.lit("wiki")).alias("tags"),
        F.col("page_id").alias("revision"), F.expr("timestamp_ntz'2024-06-01 00:00:00' - make_dt_interval(cast(page_id % 200 as int))").alias("updated"), "html", "url", "page_id",
    )


WIKI = """wp AS (SELECT 'page-' || page_id AS slug, title, CASE WHEN page_id % 3 <> 0 THEN substr(title, 1, 40) END AS summary, regexp_replace(html, '<[^>]*>', ' ', 'g') AS content,
[['class:permanent', 'class:task', 'the', 'guide'][((page_id % 4) + 1)::int], 'wiki'] AS tags, page_id AS revision, TIMESTAMP '2024-06-01' - to_days((page_id % 200)::int) AS updated, html, url, page_id
FROM (SELECT *, coalesce(nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''), 'untitled') AS title FROM pages))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
