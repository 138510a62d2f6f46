"""Queries over the typed graph, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.operators import graph as G
from tessera.plans import inputs as I


def _g(spark, d):
    return I.edges(spark, d), I.vertices(spark, d)


def graph_stats(spark, d):
    e, v = _g(spark, d)
    return G.stats(v, e)


def find_symbols(spark, d):
    return G.find_symbols(I.vertices(spark, d), "order12").select("id", "name", "file")


def callers(spark, d):
    e, v = _g(spark, d)
    return G.neighbours(e, v, v.where("type = 'function'"), P.CALLS, reverse=True).select("id", "file")


def dependencies(spark, d):
    e, v = _g(spark, d)
    return G.neighbours(e, v, v.where("type = 'method'"), P.DEPENDENCY).select("id", "file")


def direct_callers(spark, d):
    e, v = _g(spark, d)
    return G.resolved(e.where("type = 'CALLS'"), v).groupBy("dst").agg(F.count(F.lit(1)).alias("calls"))


def call_trace(spark, d):
    e, _ = _g(spark, d)
    start = I.table(spark, d, "orders").select(F.expr("concat('o:', o_orderkey)").alias("origin"))
    return G.trace(e, start.withColumn("id", F.col("origin")), P.DEPENDENCY, 3)


def impact(spark, d):
    e, _ = _g(spark, d)
    start = I.table(spark, d, "part").select(F.expr("concat('p:', p_partkey)").alias("origin"))
    return G.reach(e, start.withColumn("id", F.col("origin")), P.IMPACT, 4, reverse=True, via=False).where("depth > 0").groupBy("origin", "depth").agg(F.count(F.lit(1)).alias("reached"))


def blast_radius(spark, d):
    e, v = _g(spark, d)
    s = I.table(spark, d, "supplier")
    changed = s.select(F.expr("concat('s:', s_suppkey)").alias("id"), F.expr("case when s_suppkey % 3 = 0 then 'deleted' when s_suppkey % 3 = 1 then 'renamed' else 'modified' end").alias("status"))
    return G.blast_radius(e, v, changed)


def shortest_paths(spark, d):
    e, _ = _g(spark, d)
    pairs = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("pair"), F.expr("concat('o:', o_orderkey)").alias("src"), F.when(F.col("o_orderkey") % 9 == 0, F.expr("concat('o:', o_orderkey)")).otherwise(F.expr("concat('n:', o_orderkey % 25)")).alias("dst"))
    return G.shortest_paths(e, pairs, P.DEPENDENCY, 3)


def blast_files(spark, d):
    e, v = _g(spark, d)
    s = I.table(spark, d, "supplier")
    return G.blast_files(e, v, s.select((F.col("s_suppkey") % 20).alias("change"), F.expr("concat('s:', s_suppkey)").alias("id")), 2)


def changed_symbols(spark, d):
    v = I.vertices(spark, d)
    line = I.table(spark, d, "customer")
    hunks = line.select(F.expr("concat('src/retrieval/', c_mktsegment, '/n', c_nationkey, '.ts')").alias("file"), F.expr("(c_custkey * 7) % 4000").alias("from_line"), F.expr("(c_custkey * 7) % 4000 + 12").alias("to_line"))
    whole = I.table(spark, d, "region").select(F.expr("concat('src/core/region', r_regionkey, '.ts')").alias("file"), F.lit(None).cast("long").alias("from_line"), F.lit(None).cast("long").alias("to_line"))
    return G.changed_symbols(hunks.unionByName(whole), v)


def containing_symbol(spark, d):
    c = I.table(spark, d, "customer")
    lines = c.select(F.col("c_custkey").alias("ref"), F.expr("concat('src/memory/n', c_nationkey, '.ts')").alias("file"), F.expr("c_custkey % 600").alias("line"))
    return G.containing_symbol(lines, I.vertices(spark, d))


def file_dependencies(spark, d):
    e, v = _g(spark, d)
    return G.file_dependencies(e, v)


def hotspots(spark, d):
    e, v = _g(spark, d)
    return G.hotspots(e, v).select("file", "symbols", "incoming", "outgoing", "cross", "writes", "refs", "score")


def cluster_pairs(spark, d):
    e, v = _g(spark, d)
    return G.cluster_pairs(e, v)


def cohesion(spark, d):
    e, v = _g(spark, d)
    return G.cohesion(G.cluster_pairs(e, v), v.select("file", P.subsystem(F.col("file")).alias("cluster")).distinct())


def degrees(spark, d):
    e, v = _g(spark, d)
    return G.degrees(e, v)


def dead_code(spark, d):
    e, v = _g(spark, d)
    return G.dead_code(e, v).select("id", "score", "confidence")


def layers(spark, d):
    return G.layers(I.vertices(spark, d))


def manifest_diff(spark, d):
    o = I.table(spark, d, "orders")
    rows = o.select(F.expr("concat('f', o_orderkey % 5000)").alias("path"), F.col("o_orderstatus").alias("hash"), "o_orderkey")
    old = rows.where("o_orderkey % 3 <> 0").groupBy("path").agg(F.max("hash").alias("hash"))
    return G.manifest_diff(old, rows.where("o_orderkey % 4 <> 0").groupBy("path").agg(F.max("hash").alias("hash")))


def resolved_by_name(spark, d):
    c = I.table(spark, d, "customer")
    return G.resolved_by_name(c.select(F.col("c_custkey").alias("call"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("order"), F.col("c_custkey") % 900)).alias("name")), I.vertices(spark, d))


def tests_edges(spark, d):
    e, v = _g(spark, d)
    turned = e.where("type = 'IMPORTS'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "ord")
    return G.tests_edges(turned, v).groupBy("src", "type").agg(F.count(F.lit(1)).alias("n"))


def cluster_rollup(spark, d):
    e, v = _g(spark, d)
    return G.rollup(e, v.select("id", P.subsystem(F.col("file")).alias("cluster")))


def neighbourhood(spark, d):
    e, v = _g(spark, d)
    return G.neighbourhood(e, v, v.where("type IN ('function', 'class')"), P.USAGE, 2)


def dead_code_list(spark, d):
    e, v = _g(spark, d)
    return G.dead_code_list(e, v, 50).select("id", "score")


def dead_code_confidence(spark, d):
    e, v = _g(spark, d)
    return G.confidence_counts(G.dead_code(e, v))


def file_dependency_lists(spark, d):
    e, v = _g(spark, d)
    return G.file_dependency_lists(e, v).select("file", F.array_join("targets", ",").alias("targets"), F.array_join("sources", ",").alias("sources"))


def file_rollup(spark, d):
    e, v = _g(spark, d)
    return G.rollup(e, v.select("id", "file"), "file")


def layer_rollup(spark, d):
    e, v = _g(spark, d)
    return G.rollup(e, v.select("id", P.layer(F.col("file"))["layer"].alias("layer")), "layer")


def cluster_labels(spark, d):
    return I.vertices(spark, d).select("file", P.cluster_label(P.subsystem(F.col("file"))).alias("label")).distinct()


def compact_symbols(spark, d):
    return G.compact_symbols(I.vertices(spark, d))


def chunk_ranges(spark, d):
    v = I.vertices(spark, d)
    return G.chunk_ranges(v).groupBy("file").agg(F.count("id").alias("symbols"), F.min("start_line").alias("first"), F.max("end_line").alias("last"))


def test_files(spark, d):
    f = F.col("file")
    return I.vertices(spark, d).select("file").distinct().select("file", P.is_test(f).alias("test"), P.is_public(f).alias("public"), P.is_sensitive(f).alias("sensitive"), P.is_source(f).alias("source"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

W = f"WITH {I.GRAPH}"
TEST = r"({0} LIKE 'tests/%' OR contains({0}, '/tests/') OR contains({0}, '__tests__') OR regexp_matches({0}, '\.(test|spec)\.[^.]+$'))"
SUB = "CASE WHEN split_part(file, '/', 1) IN ('src', 'packages') THEN split_part(file, '/', 1) || '/' || split_part(file, '/', 2) ELSE split_part(file, '/', 1) END"


def _in(labels):
    return "(" + ", ".join(f"'{x}'" for x in labels) + ")"


def _case(column, table, default):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in table.items()) + f" ELSE {default} END"


def _reach(start, labels, depth, reverse):
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return f"""st AS (SELECT {start} AS origin), ee AS (SELECT {near} AS n, {far} AS f, type, ord FROM e WHERE type IN {_in(labels)}),
walk(origin, id, depth) AS (SELECT origin, origin, 0 FROM st UNION SELECT w.origin, ee.f, w.depth + 1 FROM walk w JOIN ee ON ee.n = w.id WHERE w.depth < {depth}),
best AS (SELECT origin, id, min(depth) AS depth FROM walk GROUP BY ALL)"""


R = f"WITH RECURSIVE {I.GRAPH}"
ENDS = "r AS (SELECT e.*, a.file AS src_file, b.file AS dst_file FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst)"
PAIRS = f"cp AS (SELECT least(src_file, dst_file) AS a, greatest(src_file, dst_file) AS b, sum({_case('type', P.CLUSTER_WEIGHT, 0)})::bigint AS weight FROM r WHERE src_file <> dst_file AND type IN {_in(P.CLUSTER_WEIGHT)} GROUP BY ALL)"
DEAD = rf"""u AS (SELECT * FROM e WHERE type IN ('CALLS', 'CALL_REFERENCE', 'IMPORTS', 'USES_TYPE', 'WRITES', 'INHERITS', 'IMPLEMENTS', 'ROUTE', 'TESTS')), s AS (SELECT v.*, (SELECT count(*) FROM u WHERE u.src = v.id) AS outgoing FROM v WHERE type IN ('function', 'method', 'class', 'interface', 'property') AND NOT {TEST.format('file')} AND NOT regexp_matches(file, '(^|/)bin/') AND NOT regexp_matches(file, '(^|/)(index|main|server|cli)\\.[^./]+$') AND id NOT IN (SELECT dst FROM u)),
q AS (SELECT *, 50 + CASE WHEN type IN ('function', 'method') THEN 20 ELSE 0 END - CASE WHEN type = 'property' THEN 15 ELSE 0 END + CASE WHEN outgoing = 0 THEN 10 ELSE 0 END + CASE WHEN contains(file, '/internal/') THEN 10 ELSE 0 END + CASE WHEN starts_with(name, '_') THEN 5 ELSE 0 END AS score FROM s)"""
SQL = {
    "neighbourhood": f"""{W}, d AS (SELECT e.* FROM e WHERE type IN ('CALLS', 'CALL_REFERENCE', 'IMPORTS', 'USES_TYPE', 'WRITES', 'INHERITS', 'IMPLEMENTS', 'ROUTE', 'TESTS') AND src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v)), x AS (SELECT src AS a, dst AS b, type, ord, 'out' AS direction FROM d UNION ALL SELECT dst, src, type, ord, 'in' FROM d),
h AS (SELECT a AS origin, b AS id, direction, arg_min(x.type, (x.ord, x.type)) AS via FROM x JOIN v ON v.id = x.a AND v.type IN ('function', 'class') GROUP BY ALL),
t AS (SELECT h.origin, x.b AS id, h.direction, arg_min(x.type, (x.ord, x.type)) AS via FROM h JOIN x ON x.a = h.id AND x.direction = h.direction WHERE x.b <> h.origin GROUP BY ALL)
SELECT origin, id, direction, via, 1::int AS depth FROM h UNION ALL SELECT origin, id, direction, via, 2 FROM t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.origin = t.origin AND h.id = t.id AND h.direction = t.direction)""",
    "dead_code_list": f"{W}, {DEAD} SELECT id, score FROM q WHERE score >= 55 ORDER BY score DESC, file, name, id LIMIT 50",
    "dead_code_confidence": f"{W}, {DEAD} SELECT count_if(score >= 75)::bigint AS high, count_if(score >= 55 AND score < 75)::bigint AS medium, count_if(score < 55)::bigint AS low, count(*) AS total FROM q",
    "file_dependency_lists": f"""{W}, {ENDS}, p AS (SELECT DISTINCT src_file, dst_file FROM r WHERE type IN ('CALLS', 'CALL_REFERENCE', 'IMPORTS', 'USES_TYPE', 'WRITES', 'INHERITS', 'IMPLEMENTS', 'ROUTE') AND src_file <> dst_file)
SELECT f.file, coalesce(t, '') AS targets, coalesce(s, '') AS sources FROM (SELECT DISTINCT file FROM v) f LEFT JOIN (SELECT src_file AS file, string_agg(dst_file, ',' ORDER BY dst_file) AS t FROM p GROUP BY 1) o USING (file) LEFT JOIN (SELECT dst_file AS file, string_agg(src_file, ',' ORDER BY src_file) AS s FROM p GROUP BY 1) i USING (file)""",
    "file_rollup": f"{W}, {ENDS} SELECT src_file AS a, dst_file AS b, count(*) AS edges FROM r WHERE src_file <> dst_file GROUP BY ALL",
    "layer_rollup": rf"""{W}, l AS (SELECT id, CASE WHEN {TEST.format('file')} THEN 'tests' WHEN file LIKE 'bin/%' OR regexp_matches(file, '/(mcp|cli|api|routes|hooks)/') THEN 'interface' WHEN regexp_matches(file, '/(runtime|processor|retrieval|snapshot|code-intelligence)/') THEN 'application' WHEN regexp_matches(file, '/(core|memory)/|(^|/)types\.[^.]+$') THEN 'domain' WHEN regexp_matches(file, '/(storage|production|security|config|utils)/') THEN 'infrastructure' ELSE 'unknown' END AS layer FROM v)
SELECT x.layer AS a, y.layer AS b, count(*) AS edges FROM e JOIN l x ON x.id = e.src JOIN l y ON y.id = e.dst WHERE x.layer <> y.layer GROUP BY ALL""",
    "cluster_labels": f"{W} SELECT DISTINCT file, CASE split_part(file, '/', 2) WHEN 'core' THEN 'Core' WHEN 'storage' THEN 'Storage' WHEN 'retrieval' THEN 'Retrieval' WHEN 'memory' THEN 'Memory' WHEN 'runtime' THEN 'Runtime' WHEN 'internal' THEN 'internal' ELSE 'Tests' END AS label FROM v",
    "compact_symbols": f"{W} SELECT id, name, type, file, start_line, end_line FROM v",
    "chunk_ranges": f"{W}, g AS (SELECT file, count(*) AS n, min(start_line) AS a, max(end_line) AS b FROM v WHERE type <> 'file' AND start_line IS NOT NULL AND end_line IS NOT NULL GROUP BY 1) SELECT f.file, coalesce(n, 0) AS symbols, a AS first, b AS last FROM (SELECT DISTINCT file FROM v) f LEFT JOIN g USING (file)",
    "graph_stats": f"{W} SELECT 'vertex' AS kind, type, count(*) AS n FROM v GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type",
    "find_symbols": f"{W} SELECT id, name, file FROM v WHERE contains(lower(name), 'order12') OR contains(lower(file), 'order12') ORDER BY (lower(name) = 'order12') DESC, file, id LIMIT 20",
    "callers": f"{W} SELECT id, file FROM v WHERE id IN (SELECT src FROM e WHERE type IN {_in(P.CALLS)} AND dst IN (SELECT id FROM v WHERE type = 'function'))",
    "dependencies": f"{W} SELECT id, file FROM v WHERE id IN (SELECT dst FROM e WHERE type IN {_in(P.DEPENDENCY)} AND src IN (SELECT id FROM v WHERE type = 'method'))",
    "direct_callers": f"{W} SELECT dst, count(*) AS calls FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst WHERE e.type = 'CALLS' GROUP BY dst",
    "call_trace": f"""{R}, {_reach("'o:' || o_orderkey AS origin FROM orders) SELECT origin FROM q", P.DEPENDENCY, 3, False).replace("st AS (SELECT 'o:'", "st AS (WITH q AS (SELECT 'o:'").replace("FROM q AS origin)", "FROM q)")} SELECT origin, id, depth FROM best""",
    "impact": f"""{R}, {_reach("'p:' || p_partkey AS origin FROM part) SELECT origin FROM q", P.IMPACT, 4, True).replace("st AS (SELECT 'p:'", "st AS (WITH q AS (SELECT 'p:'").replace("FROM q AS origin)", "FROM q)")} SELECT origin, depth, count(*) AS reached FROM best WHERE depth > 0 GROUP BY ALL""",
    "blast_radius": f"""{R}, {_reach("'s:' || s_suppkey AS origin FROM supplier) SELECT origin FROM q", P.BLAST, 4, True).replace("st AS (SELECT 's:'", "st AS (WITH q AS (SELECT 's:'").replace("FROM q AS origin)", "FROM q)")},
hop AS (SELECT b.origin, b.id, b.depth, (SELECT first(ee.type ORDER BY ee.ord, ee.type) FROM ee JOIN best p ON p.origin = b.origin AND p.id = ee.n AND p.depth = b.depth - 1 WHERE ee.f = b.id) AS via FROM best b WHERE b.depth > 0),
sums AS (SELECT origin, count(*) AS reached, count(DISTINCT file) AS files, sum(greatest(1, ({_case('via', P.BLAST_WEIGHT, 1)}) - (depth - 1))) AS w FROM hop LEFT JOIN v USING (id) GROUP BY origin),
own AS (SELECT 's:' || s_suppkey AS origin, CASE s_suppkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 5 ELSE 2 END + 3 AS own FROM supplier),
res AS (SELECT origin, coalesce(reached, 0) AS reached, coalesce(files, 0) AS files, (own + coalesce(w, 0))::bigint AS score FROM own LEFT JOIN sums USING (origin))
SELECT *, CASE WHEN score >= 30 THEN 'CRITICAL' WHEN score >= 16 THEN 'HIGH' WHEN score >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM res""",
    "shortest_paths": f"""WITH RECURSIVE {I.GRAPH}, d AS (SELECT src, dst, type, ord FROM e WHERE type IN ('CALLS', 'CALL_REFERENCE', 'IMPORTS', 'USES_TYPE', 'WRITES', 'INHERITS', 'IMPLEMENTS', 'ROUTE')),
q AS (SELECT o_orderkey AS pair, 'o:' || o_orderkey AS src, CASE WHEN o_orderkey % 9 = 0 THEN 'o:' || o_orderkey ELSE 'n:' || (o_orderkey % 25) END AS dst FROM orders),
w(pair, id, dst, n, ords, steps) AS (SELECT pair, src, dst, 0, []::bigint[], [{{'id': src, 'via': NULL::varchar, 'ord': NULL::bigint}}] FROM q
UNION ALL SELECT w.pair, d.dst, w.dst, n + 1, list_append(ords, d.ord), list_append(steps, {{'id': d.dst, 'via': d.type, 'ord': d.ord}}) FROM w JOIN d ON d.src = w.id WHERE n < 3 AND w.id <> w.dst),
b AS (SELECT pair, steps FROM w WHERE id = dst QUALIFY row_number() OVER (PARTITION BY pair ORDER BY n, list_transform(steps[2:], lambda x: {{'o': x.ord, 'i': x.id, 't': x.via}})) = 1)
SELECT pair, (unnest(range(0, len(steps))))::int AS place, unnest(list_transform(steps, lambda x: x.id)) AS id, unnest(list_transform(steps, lambda x: x.via)) AS via, unnest(list_transform(steps, lambda x: x.ord)) AS ord FROM b""",
    "blast_files": rf"""WITH {I.GRAPH}, d AS (SELECT src, dst FROM e WHERE type IN ('CALLS', 'CALL_REFERENCE', 'USES_TYPE', 'TESTS', 'ROUTE', 'WRITES', 'IMPORTS', 'INHERITS', 'IMPLEMENTS', 'DEFINES')), c AS (SELECT s_suppkey % 20 AS change, 's:' || s_suppkey AS id FROM supplier),
h AS (SELECT DISTINCT change, c.id AS origin, d.src AS id, 1 AS depth FROM c JOIN d ON d.dst = c.id), t AS (SELECT change, origin, id, min(depth) AS depth FROM (SELECT * FROM h UNION ALL SELECT h.change, h.origin, d.src, 2 FROM h JOIN d ON d.dst = h.id WHERE d.src <> h.origin) GROUP BY ALL),
f AS (SELECT change, file, min(depth)::int AS depth, count(DISTINCT v.id) AS symbols, starts_with(lower(file), 'tests/') OR contains(lower(file), '/tests/') OR contains(lower(file), '__tests__') OR regexp_matches(lower(file), '\.(test|spec)\.[^.]+$') AS is_test FROM t JOIN v ON v.id = t.id GROUP BY change, file)
SELECT change, file, depth, symbols, is_test, CASE WHEN bool_or(is_test) OVER (PARTITION BY change) THEN is_test ELSE row_number() OVER (PARTITION BY change ORDER BY depth, file) <= 10 END AS suggested FROM f""",
    "changed_symbols": f"""{W}, h AS (SELECT 'src/retrieval/' || c_mktsegment || '/n' || c_nationkey || '.ts' AS file, (c_custkey * 7) % 4000 AS a, (c_custkey * 7) % 4000 + 12 AS b FROM customer UNION ALL SELECT 'src/core/region' || r_regionkey || '.ts', NULL, NULL FROM region),
dr AS (SELECT DISTINCT v.id, v.file FROM v JOIN h USING (file) WHERE v.type <> 'file' AND v.start_line IS NOT NULL AND (a IS NULL OR (start_line <= b AND end_line >= a)))
SELECT * FROM dr UNION ALL SELECT v.id, v.file FROM v WHERE type = 'file' AND file IN (SELECT file FROM h) AND file NOT IN (SELECT file FROM dr)""",
    "containing_symbol": f"""{W}, l AS (SELECT c_custkey AS ref, 'src/memory/n' || c_nationkey || '.ts' AS file, c_custkey % 600 AS line FROM customer)
SELECT ref, id AS symbol FROM l JOIN v USING (file) WHERE line BETWEEN start_line AND end_line QUALIFY row_number() OVER (PARTITION BY ref ORDER BY end_line - start_line, id) = 1""",
    "file_dependencies": f"""{W}, {ENDS}, p AS (SELECT src_file, dst_file, count(*) AS n FROM r WHERE type IN {_in(P.DEPENDENCY)} AND src_file <> dst_file GROUP BY ALL)
SELECT f.file, coalesce(targets, 0) AS targets, coalesce(outgoing, 0)::bigint AS outgoing, coalesce(sources, 0) AS sources, coalesce(incoming, 0)::bigint AS incoming FROM (SELECT DISTINCT file FROM v) f
LEFT JOIN (SELECT src_file AS file, count(*) AS targets, sum(n) AS outgoing FROM p GROUP BY 1) o USING (file) LEFT JOIN (SELECT dst_file AS file, count(*) AS sources, sum(n) AS incoming FROM p GROUP BY 1) i USING (file)""",
    "hotspots": f"""{W}, {ENDS}, x AS (SELECT src_file AS file, 0 AS i, 1 AS o, 0 AS wi, {_case('type', P.HOTSPOT_WEIGHT, 1)} AS wo, (src_file <> dst_file)::int AS c, 0 AS w, 0 AS cr FROM r
UNION ALL SELECT dst_file, 1, 0, {_case('type', P.HOTSPOT_WEIGHT, 1)}, 0, (src_file <> dst_file)::int, (type = 'WRITES')::int, (type = 'CALL_REFERENCE')::int FROM r),
s AS (SELECT file, sum(i) AS incoming, sum(o) AS outgoing, sum(wi) AS wi, sum(wo) AS wo, sum(c) AS "cross", sum(w) AS writes, sum(cr) AS refs FROM x GROUP BY file),
f AS (SELECT file, n AS symbols, coalesce(incoming, 0)::bigint AS incoming, coalesce(outgoing, 0)::bigint AS outgoing, coalesce("cross", 0)::bigint AS "cross", coalesce(writes, 0)::bigint AS writes, coalesce(refs, 0)::bigint AS refs,
  round(0.4 * n + 1.75 * coalesce(wi, 0) + 0.65 * coalesce(wo, 0) + 1.5 * coalesce("cross", 0) + 3 * coalesce(writes, 0) + 2 * coalesce(refs, 0), 2)::double AS score FROM (SELECT file, count(*) AS n FROM v GROUP BY file) LEFT JOIN s USING (file))
SELECT file, symbols, incoming, outgoing, "cross", writes, refs, score FROM f WHERE score > 0 QUALIFY row_number() OVER (ORDER BY score DESC, file) <= greatest(1, least(30, ceil((SELECT count(DISTINCT file) FROM v) * 0.15)))""",
    "cluster_pairs": f"{W}, {ENDS}, {PAIRS} SELECT * FROM cp",
    "cohesion": f"""{W}, {ENDS}, {PAIRS}, m AS (SELECT DISTINCT file, {SUB} AS cluster FROM v), x AS (SELECT ma.cluster AS ca, mb.cluster AS cb, weight FROM cp JOIN m ma ON ma.file = a JOIN m mb ON mb.file = b),
i AS (SELECT ca AS cluster, sum(weight) AS internal FROM x WHERE ca = cb GROUP BY 1), o AS (SELECT cluster, sum(weight) AS external FROM (SELECT ca AS cluster, weight FROM x WHERE ca <> cb UNION ALL SELECT cb, weight FROM x WHERE ca <> cb) GROUP BY 1)
SELECT cluster, files, coalesce(internal, 0)::bigint AS internal, coalesce(external, 0)::bigint AS external, CASE WHEN coalesce(internal, 0) + coalesce(external, 0) > 0 THEN round(coalesce(internal, 0) / (coalesce(internal, 0) + coalesce(external, 0)), 4) ELSE 0 END::double AS cohesion
FROM (SELECT cluster, count(*) AS files FROM m GROUP BY 1) LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster)""",
    "degrees": f"{W} SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM v LEFT JOIN (SELECT src AS id, count(*) AS o FROM e GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM e GROUP BY 1) USING (id)",
    "dead_code": rf"""{W}, u AS (SELECT * FROM e WHERE type IN {_in(P.USAGE)}), s AS (SELECT v.*, (SELECT count(*) FROM u WHERE u.src = v.id) AS outgoing FROM v WHERE type IN ('function', 'method', 'class', 'interface', 'property') AND NOT {TEST.format('file')} AND NOT regexp_matches(file, '(^|/)bin/') AND NOT regexp_matches(file, '(^|/)(index|main|server|cli)\.[^./]+$') AND id NOT IN (SELECT dst FROM u)),
q AS (SELECT id, 50 + CASE WHEN type IN ('function', 'method') THEN 20 ELSE 0 END - CASE WHEN type = 'property' THEN 15 ELSE 0 END + CASE WHEN outgoing = 0 THEN 10 ELSE 0 END + CASE WHEN contains(file, '/internal/') THEN 10 ELSE 0 END + CASE WHEN name LIKE '\_%' ESCAPE '\' THEN 5 ELSE 0 END AS score FROM s)
SELECT id, score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'medium' ELSE 'low' END AS confidence FROM q""",
    "layers": rf"""{W}, f AS (SELECT DISTINCT file FROM v), k AS (SELECT file, CASE WHEN {TEST.format('file')} THEN 1 WHEN regexp_matches(file, '(^bin|/mcp|/cli|/api|/routes|/hooks)/') THEN 2 WHEN regexp_matches(file, '/(runtime|processor|retrieval|snapshot|code-intelligence)/') THEN 3 WHEN regexp_matches(file, '/(core|memory)/|(^|/)types\.[^/]+$') THEN 4 WHEN regexp_matches(file, '/(storage|production|security|config|utils)/') THEN 5 ELSE 6 END AS k FROM f)
SELECT file, ['tests', 'interface', 'application', 'domain', 'infrastructure', 'unknown'][k] AS layer, [1.0, 0.9, 0.85, 0.9, 0.85, 0.35][k]::double AS confidence FROM k""",
    "manifest_diff": """WITH r AS (SELECT 'f' || (o_orderkey % 5000) AS path, o_orderstatus AS hash, o_orderkey FROM orders), a AS (SELECT path, max(hash) AS was FROM r WHERE o_orderkey % 3 <> 0 GROUP BY 1), b AS (SELECT path, max(hash) AS now FROM r WHERE o_orderkey % 4 <> 0 GROUP BY 1)
SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'deleted' WHEN was <> now THEN 'modified' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (path)""",
    "resolved_by_name": f"""{W}, o AS (SELECT name, min(id) AS target FROM v WHERE type IN ('function', 'method') GROUP BY name HAVING count(*) = 1) SELECT c_custkey AS call, target FROM customer JOIN o ON o.name = CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'order' || (c_custkey % 900) END""",
    "tests_edges": f"{W}, t AS (SELECT e.dst AS src, a.file AS af, b.file AS bf FROM e JOIN v a ON a.id = e.dst JOIN v b ON b.id = e.src WHERE e.type = 'IMPORTS') SELECT src, 'TESTS' AS type, count(*) AS n FROM t WHERE {TEST.format('af')} AND NOT {TEST.format('bf')} GROUP BY src",
    "cluster_rollup": f"{W}, m AS (SELECT id, {SUB} AS cluster FROM v) SELECT x.cluster AS a, y.cluster AS b, count(*) AS edges FROM e JOIN m x ON x.id = e.src JOIN m y ON y.id = e.dst WHERE x.cluster <> y.cluster GROUP BY ALL",
    "test_files": rf"{W} SELECT DISTINCT file, {TEST.format('file')} AS test, regexp_matches(file, '(^|/)bin/') OR regexp_matches(file, '(^|/)(index|main|server|cli)\.[^./]+$') AS public, false AS sensitive, file LIKE '%.ts' AS source FROM v",
}
