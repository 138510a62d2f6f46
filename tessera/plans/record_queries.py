"""Queries over records and texts, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import memory as M
from tessera.operators import retrieval as R
from tessera.plans import inputs as I

QUERY = "what the decision and the storage of the"
TOKENS = ["the", "thing", "and", "storage", "the"]
TOK = r"list_filter(string_split(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\-./]+', ' ', 'g'), ' '), lambda t: length(t) > 1)"
WORDS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_-]+', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains(['dùng','sử','dụng','use','using','the','a','an','cho','và','là','của','to','for','with','quyết','định'], w)))"
KEYWORD = "((" + " + ".join(f"(CASE WHEN len(list_filter(tok, lambda t: t = '{t}')) > 0 THEN 1 + ln(1 + len(list_filter(tok, lambda t: t = '{t}'))) ELSE 0 END)" for t in TOKENS) + f") / {len(TOKENS)})"
PRIORITY = "CASE type WHEN 'rule' THEN 1.0 WHEN 'decision' THEN 1.0 WHEN 'todo' THEN 0.8 WHEN 'summary' THEN 0.6 WHEN 'activity' THEN 0.3 ELSE 0.4 END"
LEXICAL = f""", tk AS (SELECT *, {TOK.format("content || ' ' || array_to_string(tags, ' ') || ' ' || type")} AS tok FROM imp WHERE active),
kw AS (SELECT *, {KEYWORD} AS keyword FROM tk), lex AS (SELECT id, 0.55 * keyword + 0.20 * effective / 100 + 0.15 * exp(-ln(2) * age / 30) + 0.10 * {PRIORITY} AS score FROM kw WHERE keyword > 0)"""


def mem(spark, d):
    return I.memories(spark, d)


def act(spark, d):
    return M.with_active(mem(spark, d), I.now())


def lexical_topk(spark, d):
    return R.lexical_search(mem(spark, d), QUERY, TOKENS, I.now()).select("id", F.round("score", 6).alias("score"))


def keyword_scores(spark, d):
    return R.scored(mem(spark, d), QUERY, TOKENS, I.now()).select("id", F.round("keyword", 6).alias("keyword"), F.round("recent", 6).alias("recent"), F.round("priority", 6).alias("priority"), F.round("score", 6).alias("score"))


def simple_search(spark, d):
    return R.simple_search(mem(spark, d), ["the", "und", "storage"], I.now()).select("id", F.round("score", 6).alias("score"))


def recency_decay(spark, d):
    return mem(spark, d).select("id", F.round(S.recency(F.col("updated"), F.col("created"), I.now()), 6).alias("recency"))


def effective_importance(spark, d):
    return act(spark, d).select("id", F.round(S.effective_importance(F.col("type"), F.col("importance"), F.col("updated"), F.col("active"), I.now()), 6).alias("effective"))


def active_filter(spark, d):
    return M.listed(mem(spark, d), "p3", I.now()).select("id", "type")


def tag_filter(spark, d):
    return M.filtered(mem(spark, d), I.now(), ["rule", "todo", "code"], ["class:task", "en"], 30.0).select("id", F.round("effective", 6).alias("effective"))


def default_expiry(spark, d):
    return mem(spark, d).select("id", S.default_expiry_days(F.col("type"), F.col("importance")).alias("days"))


def importance_rules(spark, d):
    c = F.col("content")
    return mem(spark, d).select("id", S.infer_importance(F.col("type"), c).alias("inferred"), S.score_importance(F.col("type"), c).alias("scored"), S.looks_like(c).alias("looks_like"))


def type_priority(spark, d):
    return mem(spark, d).select("id", S.type_priority(F.col("type"), S.preferred_types(QUERY)).alias("priority"))


def lifecycle_tiers(spark, d):
    return M.assessed(mem(spark, d), I.now()).select("id", "score", "tier", "stale", "protected", "prune")


def lifecycle_review(spark, d):
    return M.lifecycle_review(mem(spark, d), I.now())


def fingerprint_dedup(spark, d):
    return M.exact_copies(mem(spark, d)).select("fingerprint", "id", "copies")


def consolidation(spark, d):
    c = M.consolidation(mem(spark, d))
    return c.select("project", "type", "canonical", F.array_join(F.transform("duplicates", lambda x: x.cast("string")), ",").alias("duplicates"), F.array_join("tags", ",").alias("tags"), F.array_join("sources", ",").alias("sources"))


def supersession(spark, d):
    m = mem(spark, d)
    return M.superseded(m, m)


def pruned(spark, d):
    return M.pruned(mem(spark, d), I.now()).select("id")


def maintenance(spark, d):
    return M.maintain(mem(spark, d), I.now()).select("id")


def upsert_latest(spark, d):
    m = mem(spark, d)
    side = lambda key: m.select(key.alias("id"), "seq", "type", F.sha2("content", 256).alias("digest"))
    return M.upsert(side(F.col("id") % 100), side(F.col("id") * 3 % 140 + 40))


def remembered(spark, d):
    m = mem(spark, d).withColumn("superseded_by", F.lit(None).cast("long"))
    out = M.remember(m.where("id % 5 = 1").withColumn("importance", F.lit(None).cast("string")), m.where("id % 5 <> 1"), I.now())
    return out.select("id", "importance", "superseded_by")


def secret_redaction(spark, d):
    red = T.redact(F.col("content"))
    return mem(spark, d).select("id", F.sha2(red, 256).alias("digest"), F.regexp_count(red, F.lit(r"\[REDACTED:")).alias("redacted"))


_SECRETS = [
    ("openai_key", r"\bsk-[A-Za-z0-9_\-]{20,}\b"), ("huggingface_token", r"\bhf_[A-Za-z0-9]{20,}\b"), ("hf_s3_access_key", r"\bHFAK[A-Za-z0-9]{8,}\b"), ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b"), ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"), ("password_assignment", r"""(?i)\b(password|passwd|pwd)\s*[:=]\s*["'']?[^"''\s]{6,}["'']?"""), ("secret_assignment", r"""(?i)\b(secret|api[_-]?key|access[_-]?token|refresh[_-]?token)\s*[:=]\s*["'']?[^"''\s]{8,}["'']?"""),
    ("cookie", r"(?i)\b(cookie|set-cookie)\s*[:=]\s*[^;\n]{8,}"),
]
_FOUND = " || ".join(f"list_transform(regexp_extract_all(content, '{p}'), lambda v: '[REDACTED:{k}]' || chr(1) || v)" for k, p in _SECRETS)
REDACT = f"list_reduce([content] || {_FOUND}, lambda t, m: replace(t, split_part(m, chr(1), 2), split_part(m, chr(1), 1)))"


def content_keys(spark, d):
    return mem(spark, d).select("id", F.sha2(T.content_key(F.col("content")), 256).alias("key"), F.sha2(T.squeeze(F.col("content")), 256).alias("squeezed"))


def retrieval_terms(spark, d):
    return mem(spark, d).select("id", F.array_join(T.retrieval_terms(F.col("content")), " ").alias("terms"))


def topic_words(spark, d):
    return mem(spark, d).select("id", F.size(T.words_for_topic(F.col("content"))).alias("words"), T.token_estimate(F.col("content")).alias("tokens"))


def slugs(spark, d):
    return mem(spark, d).select("id", T.slug(F.col("content")).alias("slug"), T.path_segment(F.col("content")).alias("segment"))


def clipped(spark, d):
    return mem(spark, d).select("id", F.sha2(T.head_and_tail(F.col("content")), 256).alias("ends"))


def fact_category(spark, d):
    return mem(spark, d).select("id", S.fact_category(F.col("content")).alias("category"))


def candidate_class(spark, d):
    c = S.candidate(F.col("importance"), (F.col("id") % 100) / 100, F.col("type"))
    return mem(spark, d).select("id", F.round(c["score"], 6).alias("score"), c["knowledge_class"].alias("knowledge_class"))


def vector_topk(spark, d):
    return R.vector_search(I.vectors(spark, d), I.QUERY_VECTOR).select("id", "label", F.round("score", 6).alias("score"))


def hybrid_merge(spark, d):
    lexical = R.lexical_search(mem(spark, d), QUERY, TOKENS, I.now(), 24)
    return R.hybrid_merge(lexical, R.vector_search(I.vectors(spark, d), I.QUERY_VECTOR, 24)).select("id", F.round("score", 6).alias("score"))


def semantic_rerank(spark, d):
    hits = R.vector_search(I.vectors(spark, d), I.QUERY_VECTOR, 40).join(mem(spark, d).select("id", "content", F.concat(F.when(F.col("id") % 3 == 0, F.lit("tests/")).otherwise(F.lit("src/")), F.col("id"), F.lit(".ts")).alias("path")), "id")
    return R.rerank(hits, ["the", "and"]).select("id", F.round("score", 6).alias("score"))


def missing_vectors(spark, d):
    return R.missing_vectors(mem(spark, d), I.vectors(spark, d)).select("id")


def orphan_vectors(spark, d):
    return R.orphan_vectors(mem(spark, d).where("id % 2 = 0"), I.vectors(spark, d)).select("id")


def stale_vectors(spark, d):
    v = I.vectors(spark, d).select("id", F.when(F.col("id") % 3 == 0, F.lit("old")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    return R.stale_vectors(mem(spark, d).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash")), v).select("id")


def memory_lookup(spark, d):
    return M.lookup(mem(spark, d), I.table(spark, d, "events").select((F.col("event_id") * 3).alias("id"))).select("id", "found", "project")


def deletions(spark, d):
    m = mem(spark, d)
    return M.deleted(m, I.table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id")), m.where("type = 'summary' AND importance = 'critical'").select("project").distinct().where("project < 'p3'")).select("id")


def recent_memories(spark, d):
    return M.recent(mem(spark, d), I.now()).select("project", "place", "id").unionByName(M.recent(mem(spark, d), I.now(), 3, "rule").select("project", (F.col("place") + 100).alias("place"), "id"))


def fact_sources(spark, d):
    m = mem(spark, d)
    parts = [(t, m.where(F.col("type") == t).select("project", F.col("importance").alias("kind"), "content", F.col("seq").alias("place"))) for t in ("decision", "todo", "rule", "code")]
    return M.fact_union([(t, x.withColumnRenamed("content", "value")) for t, x in parts]).groupBy("project", "source", "source_order").agg(F.count(F.lit(1)).alias("facts"), F.min("place").alias("first"))


def wiki_link_targets(spark, d):
    text = F.regexp_replace("content", r"\s+", "]] [[")
    return mem(spark, d).select("id", F.explode(T.wiki_links(text)).alias("target")).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def stable_digests(spark, d):
    m = mem(spark, d)
    return m.select("id", F.sha2(T.stable_json(F.to_json(F.struct("project", "id", "type"))), 256).alias("digest"))


def redacted_json(spark, d):
    c = I.table(spark, d, "customer")
    data = F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("apiKey"), F.concat(F.lit("password = "), "c_name").alias("note")).alias("in"), F.array("c_mktsegment").alias("list"), F.col("c_custkey").alias("pwd")))
    return c.select("c_custkey", T.redact_json(data).alias("data"))


def composed_tokens(spark, d):
    return mem(spark, d).select("id", F.explode(T.tokenize(T.nfkc("content"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def hash_embedding(spark, d):
    e = R.hash_embedding(mem(spark, d).select("id", F.col("content").alias("text")))
    return e.select("id", F.posexplode("vector").alias("place", "x")).where("x > 0").select("id", "place", F.round("x", 6).alias("x"))


def mean_pool(spark, d):
    v = I.vectors(spark, d).select((F.col("id") % 37).alias("id"), F.col("id").alias("place"), "vector")
    return R.mean_pool(v).select("id", F.posexplode("vector").alias("d", "x")).select("id", "d", F.round("x", 6).alias("x"))


def context_pack_prefix(spark, d):
    m = I.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    return R.pack_prefix(m, 1500, 1).select("query_id", "rank", "used")


def context_pack_greedy(spark, d):
    m = I.table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("value"), F.lit("log").alias("source"))
    return R.pack_greedy(m, 1200, 5).select("query_id", "used", F.array_join(F.transform("picked", lambda x: x.cast("string")), ",").alias("picked"))


def line_windows(spark, d):
    return R.line_windows(mem(spark, d), 8, 7, "id", "content")


def fragments(spark, d):
    rows = mem(spark, d).select("id", F.posexplode(F.split(F.col("content"), "\n")).alias("pos", "line"))
    return rows.where(T.useful_fragment(F.col("line"))).groupBy("id").agg(F.count(F.lit(1)).alias("useful"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n not in ("mem", "act")}

W = f"WITH {I.MEM}"
GREEDY = """WITH RECURSIVE m AS (SELECT conv_id AS query_id, turn::int AS rank, length(role) + length(coalesce(text, '')) + 3 + 16 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT query_id, 1 AS k, c AS used, [rank] AS picked FROM m WHERE k = 1
UNION ALL SELECT m.query_id, m.k::int, CASE WHEN f.used + m.c <= 1200 AND len(f.picked) < 5 THEN f.used + m.c ELSE f.used END, CASE WHEN f.used + m.c <= 1200 AND len(f.picked) < 5 THEN list_append(f.picked, m.rank) ELSE f.picked END
FROM f JOIN m ON m.query_id = f.query_id AND m.k = f.k + 1)
SELECT query_id, used::int AS used, array_to_string(picked, ',') AS picked FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC) = 1"""
QUALITY = r"""q AS (SELECT *, CASE WHEN list_contains(tags, 'class:permanent') THEN 'p' WHEN list_contains(tags, 'class:task') THEN 't' WHEN list_contains(tags, 'class:session') THEN 's' WHEN list_contains(tags, 'class:transient') THEN 'x' ELSE 'n' END AS cls, length(trim(content)) AS n, lower(trim(content)) AS low FROM act),
q2 AS (SELECT *, age >= CASE cls WHEN 'p' THEN 730 WHEN 't' THEN 180 WHEN 's' THEN 45 WHEN 'x' THEN 7 ELSE CASE type WHEN 'rule' THEN 730 WHEN 'decision' THEN 365 WHEN 'code' THEN 180 WHEN 'todo' THEN 120 WHEN 'summary' THEN 45 ELSE 14 END END AS stale,
  cls = 'p' OR type IN ('rule', 'decision') OR importance = 'critical' AS protected,
  n < 8 OR regexp_matches(low, '^ok(ay)?[.!]?$') OR regexp_matches(low, '^done[.!]?$') OR regexp_matches(low, '^thanks?[.!]?$') OR regexp_matches(low, '^test(ing)?[.!]?$') OR regexp_matches(low, '^npm notice\b') OR regexp_matches(low, '^changed [0-9]+ packages?') OR regexp_matches(low, '^packages? are looking for funding') AS noise FROM q),
q3 AS (SELECT *, greatest(0, least(100, 50 + CASE cls WHEN 'p' THEN 25 WHEN 't' THEN 15 WHEN 's' THEN 2 WHEN 'x' THEN -25 ELSE 0 END + CASE importance WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'normal' THEN 0 ELSE -15 END + CASE WHEN type IN ('rule', 'decision') THEN 10 ELSE 0 END
  + CASE WHEN n < 12 THEN -30 WHEN n < 30 THEN -10 WHEN n <= 1200 THEN 8 WHEN n > 5000 THEN -15 ELSE 0 END + CASE WHEN noise THEN -35 ELSE 0 END + CASE WHEN stale THEN -15 ELSE 0 END)) AS score FROM q2),
q4 AS (SELECT *, CASE WHEN score >= 80 THEN 'trusted' WHEN score >= 55 THEN 'useful' WHEN score >= 30 THEN 'weak' ELSE 'noise' END AS tier FROM q3),
q5 AS (SELECT *, NOT protected AND ((tier = 'noise' AND (importance = 'temporary' OR type = 'activity' OR cls = 'x')) OR (stale AND tier IN ('noise', 'weak'))) AS prune FROM q4)"""
KEY = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower(content), '[“”"''`]', '', 'g'), '[.!?]+$', '', 'g'), '\s+', ' ', 'g'))"""
GROUPS = f"""g AS (SELECT *, row_number() OVER (PARTITION BY project, type, key ORDER BY rank DESC, score DESC, updated DESC, created DESC, id) AS k, count(*) OVER (PARTITION BY project, type, key) AS c FROM (
SELECT *, {KEY} AS key, CASE importance WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'normal' THEN 50 ELSE 20 END AS score,
CASE WHEN list_contains(tags, 'class:permanent') THEN 4 WHEN list_contains(tags, 'class:task') THEN 3 WHEN list_contains(tags, 'class:session') THEN 2 WHEN list_contains(tags, 'class:transient') THEN 1 ELSE 0 END AS rank FROM {{src}} WHERE type <> 'activity' AND superseded_by IS NULL))"""
PRUNED = "(expires IS NULL OR expires > TIMESTAMP '2024-06-15') AND NOT (superseded_by IS NOT NULL AND age >= 30)"
INFER = "CASE WHEN contains(lower(content), 'không được') OR contains(lower(content), 'bắt buộc') OR contains(lower(content), 'must not') OR contains(lower(content), 'critical') THEN 'critical' WHEN type IN ('rule', 'decision') THEN 'high' WHEN type = 'todo' THEN 'normal' WHEN type IN ('activity', 'summary') THEN 'temporary' ELSE 'normal' END"


def _any(words):
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


GENERIC = "[" + ",".join(f"'{t}'" for t in M.GENERIC_TAGS) + "]"
def _supersede(src: str, new: str, old: str) -> str:
    return f"""s AS (SELECT id, project, type, topic, list_distinct(list_filter(tags, lambda t: NOT list_contains({GENERIC}, lower(t)))) AS mt, {WORDS.format('content')} AS words FROM {src}),
pairs AS (SELECT a.id AS new_id, b.id AS old_id FROM s a JOIN s b ON a.project = b.project AND a.type = b.type AND a.id <> b.id WHERE a.type IN ('rule', 'decision') AND {new} AND {old}
AND (a.topic = b.topic OR len(list_intersect(a.mt, b.mt)) > 0 OR (len(a.words) > 0 AND len(b.words) > 0 AND len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) >= 0.6)))"""


COS = "list_cosine_similarity(embedding::double[], [" + ", ".join(map(str, I.QUERY_VECTOR)) + "]::double[])"
CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(content, '{p}') THEN '{n}'"
    for n, p in [("rule", r"(?i)\b(rule|policy|standard|convention|always|never|must|should|quy tắc|từ giờ|không được)\b"), ("fix", r"(?i)\b(fix|fixed|bug|issue|error|lỗi)\b"), ("blocker", r"(?i)\b(blocker|blocked|stuck|cannot|không thể)\b"), ("next_action", r"(?i)\b(next|todo|action|task|cần làm)\b"), ("deploy", r"(?i)\b(deploy|release|publish|ship)\b"), ("architecture", r"(?i)\b(architecture|design|structure|pattern)\b"), ("file", r"(?i)\.(ts|js|py|go|rs|java|cpp|c|h)\b")]
) + " ELSE 'decision' END"

SQL = {
    "lexical_topk": f"{W} {LEXICAL} SELECT id, round(score, 6) AS score FROM lex WHERE score >= 0.05 ORDER BY lex.score DESC, id LIMIT 8",
    "keyword_scores": f"{W} {LEXICAL} SELECT id, round(keyword, 6) AS keyword, round(exp(-ln(2) * age / 30), 6) AS recent, ({PRIORITY})::double AS priority, round(0.55 * keyword + 0.20 * effective / 100 + 0.15 * exp(-ln(2) * age / 30) + 0.10 * {PRIORITY}, 6) AS score FROM kw WHERE keyword > 0",
    "simple_search": f"{W}, h AS (SELECT id, effective, lower(content || ' ' || array_to_string(tags, ' ')) AS low FROM imp WHERE active), r AS (SELECT id, (contains(low, 'the')::int + contains(low, 'und')::int + contains(low, 'storage')::int) / 3 + effective / 500 AS score FROM h) SELECT id, round(score, 6) AS score FROM r WHERE score > 0 ORDER BY r.score DESC, id LIMIT 10",
    "recency_decay": f"{W} SELECT id, round(exp(-ln(2) * age / 30), 6) AS recency FROM act",
    "effective_importance": f"{W} SELECT id, round(effective, 6) AS effective FROM imp",
    "active_filter": f"{W} SELECT id, type FROM act WHERE active AND project = 'p3'",
    "tag_filter": f"{W} SELECT id, round(effective, 6) AS effective FROM imp WHERE active AND type IN ('rule', 'todo', 'code') AND (list_contains(tags, 'class:task') OR list_contains(tags, 'en')) AND effective >= 30",
    "default_expiry": f"{W} SELECT id, CASE WHEN type = 'activity' THEN 14 WHEN type = 'summary' THEN 30 WHEN importance = 'temporary' THEN 30 END AS days FROM mem",
    "importance_rules": f"""{W} SELECT id, {INFER} AS inferred,
CASE WHEN {_any(['không được', 'tuyệt đối', 'must not', 'never '])} THEN 'critical' WHEN type IN ('rule', 'decision') THEN 'high' WHEN type = 'todo' THEN 'normal' WHEN {_any(['error', 'failed', 'exception'])} THEN 'normal' ELSE 'temporary' END AS scored,
CASE WHEN {_any(['không được', 'bắt buộc', 'phải luôn', 'tuyệt đối', 'never ', 'must ', 'always ', 'do not '])} THEN 'rule' WHEN {_any(['todo', 'cần làm', 'chưa xong', 'còn phải', 'next:', 'next step', 'pending'])} THEN 'todo' WHEN {_any(['quyết định', 'chọn ', 'sử dụng ', 'dùng ', 'decided', 'decision', 'we will use', 'use '])} THEN 'decision' END AS looks_like FROM mem""",
    "type_priority": f"{W} SELECT id, ({PRIORITY})::double AS priority FROM mem",
    "lifecycle_tiers": f"{W}, {QUALITY} SELECT id, score, tier, stale, protected, prune FROM q5",
    "lifecycle_review": f"{W}, {QUALITY} SELECT project, count(*) AS total, count_if(tier = 'trusted')::bigint AS trusted, count_if(tier = 'useful')::bigint AS useful, count_if(tier = 'weak')::bigint AS weak, count_if(tier = 'noise')::bigint AS noise, count_if(stale)::bigint AS stale, count_if(protected)::bigint AS protected, count_if(prune)::bigint AS prunable FROM q5 GROUP BY project",
    "fingerprint_dedup": f"{W} SELECT sha256(project || '|' || type || '|' || lower(trim(content, ' '))) AS fingerprint, min(id) AS id, count(*) - 1 AS copies FROM mem GROUP BY 1",
    "consolidation": f"""{W}, {GROUPS.format(src='mem')}, t AS (SELECT project, type, key, tag, min(struct_pack(k := k, i := i)) AS o FROM (SELECT project, type, key, k, unnest(tags) AS tag, generate_subscripts(tags, 1) AS i FROM g WHERE c > 1) GROUP BY ALL),
so AS (SELECT project, type, key, source, min(k) AS o FROM g WHERE c > 1 AND source IS NOT NULL GROUP BY ALL)
SELECT project, type, min(id) FILTER (k = 1) AS canonical, string_agg(id::varchar, ',' ORDER BY k) FILTER (k > 1) AS duplicates,
(SELECT string_agg(tag, ',' ORDER BY o) FROM t WHERE t.project = g.project AND t.type = g.type AND t.key = g.key) AS tags, (SELECT string_agg(source, ',' ORDER BY o) FROM so WHERE so.project = g.project AND so.type = g.type AND so.key = g.key) AS sources
FROM g WHERE c > 1 GROUP BY project, type, key""",
    "stale_vectors": f"{W} SELECT id FROM mem WHERE id % 3 = 0 AND id IN (SELECT vec_id FROM embeddings)",
    "memory_lookup": f"{W}, q AS (SELECT DISTINCT event_id * 3 AS id FROM events) SELECT q.id, mem.id IS NOT NULL AS found, project FROM q LEFT JOIN mem ON mem.id = q.id",
    "deletions": f"{W} SELECT id FROM mem WHERE id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) AND project NOT IN (SELECT project FROM mem WHERE type = 'summary' AND importance = 'critical' AND project < 'p3')",
    "recent_memories": f"{W}, a1 AS (SELECT project, (row_number() OVER (PARTITION BY project ORDER BY created DESC, id))::int AS place, id FROM act WHERE active QUALIFY place <= 10), a2 AS (SELECT project, (row_number() OVER (PARTITION BY project ORDER BY created DESC, id))::int AS place, id FROM act WHERE active AND type = 'rule' QUALIFY place <= 3) SELECT * FROM a1 UNION ALL SELECT project, place + 100, id FROM a2",
    "fact_sources": f"{W} SELECT project, type AS source, (list_position(['decision', 'todo', 'rule', 'code'], type) - 1)::int AS source_order, count(*) AS facts, min(seq) AS first FROM mem WHERE type IN ('decision', 'todo', 'rule', 'code') GROUP BY ALL",
    "wiki_link_targets": rf"""{W}, x AS (SELECT DISTINCT id, substr(trim(regexp_replace(lower(w), '[^a-z0-9]+', '-', 'g'), '-'), 1, 120) AS target FROM (SELECT id, unnest(regexp_extract_all(regexp_replace(content, '\s+', ']] [[', 'g'), '\[\[([^\[\]]+)\]\]', 1)) AS w FROM mem)) SELECT target, count(*) AS n FROM x WHERE target <> '' GROUP BY 1""",
    "stable_digests": f"""{W} SELECT id, sha256('{{"id":' || id || ',"project":"' || project || '","type":"' || type || '"}}') AS digest FROM mem""",
    "redacted_json": """SELECT c_custkey, '{"name": "' || c_name || '", "in": {"apiKey": "[REDACTED]", "note": "[REDACTED:password_assignment]"}, "list": ["' || c_mktsegment || '"], "pwd": "[REDACTED]"}' AS data FROM customer""",
    "composed_tokens": rf"""{W} SELECT token, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}_\-./]+', ' ', 'g'), ' ')) AS token FROM mem) WHERE length(token) > 1 GROUP BY 1""",
    "supersession": f"{W}, {_supersede(src='mem WHERE superseded_by IS NULL', new='true', old='true')} SELECT max(new_id) AS new_id, old_id FROM pairs GROUP BY old_id",
    "pruned": f"{W} SELECT id FROM act WHERE {PRUNED}",
    "maintenance": f"{W}, pr AS (SELECT * FROM act WHERE {PRUNED}), {GROUPS.format(src='pr')}, {QUALITY} SELECT id FROM q5 WHERE {PRUNED} AND NOT prune AND id NOT IN (SELECT id FROM g WHERE c > 1 AND k > 1)",
    "upsert_latest": f"{W}, u AS (SELECT id % 100 AS id, seq, type, sha256(content) AS digest, 0 AS n FROM mem UNION ALL SELECT id * 3 % 140 + 40, seq, type, sha256(content), 1 FROM mem) SELECT id, seq, type, digest FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, seq DESC) = 1",
    "remembered": f"""{W}, n AS (SELECT * REPLACE ({INFER} AS importance, {REDACT} AS content) FROM mem WHERE id % 5 = 1), o AS (SELECT * FROM mem WHERE id % 5 <> 1), u AS (SELECT *, true AS fresh FROM n UNION ALL SELECT *, false FROM o),
{_supersede(src='u', new='a.id % 5 = 1', old='b.id % 5 <> 1')}
SELECT id, importance, (SELECT max(new_id) FROM pairs WHERE old_id = id) AS superseded_by FROM o UNION ALL SELECT id, importance, NULL FROM n""",
    "secret_redaction": f"{W} SELECT id, sha256({REDACT}) AS digest, len(regexp_extract_all({REDACT}, '\\[REDACTED:'))::int AS redacted FROM mem",
    "content_keys": f"{W} SELECT id, sha256({KEY}) AS key, sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))) AS squeezed FROM mem",
    "retrieval_terms": rf"{W}, x AS (SELECT id, list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_./:-]+'), lambda t: length(t) >= 2 AND NOT regexp_matches(t, '^[0-9]+$')) AS l FROM mem) SELECT id, array_to_string(list_filter(l, lambda t, i: list_position(l, t) = i)[1:40], ' ') AS terms FROM x",
    "topic_words": f"{W} SELECT id, len({WORDS.format('content')})::int AS words, ceil(length(content) / 3.5)::bigint AS tokens FROM mem",
    "slugs": f"{W} SELECT id, substr(regexp_replace(regexp_replace(lower(content), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS slug, coalesce(nullif(regexp_replace(regexp_replace(content, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'unknown') AS segment FROM mem",
    "clipped": f"{W} SELECT id, sha256(CASE WHEN length(content) > 1000 THEN substr(content, 1, 350) || chr(10) || '...' || chr(10) || right(content, 150) ELSE content END) AS ends FROM mem",
    "fact_category": f"{W} SELECT id, {CATEGORY} AS category FROM mem",
    "candidate_class": f"{W} SELECT id, round(greatest(0, least(1, 0.75 * CASE importance WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 WHEN 'normal' THEN 0.6 ELSE 0.25 END + 0.25 * ((id % 100) / 100))), 6)::double AS score, CASE WHEN importance = 'temporary' OR (id % 100) / 100 < 0.78 THEN 'transient' WHEN type IN ('rule', 'architecture') THEN 'permanent' WHEN type IN ('decision', 'todo', 'fix') THEN 'task' ELSE 'session' END AS knowledge_class FROM mem",
    "vector_topk": f"SELECT vec_id AS id, label, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 10",
    "hybrid_merge": f"{W} {LEXICAL}, l AS (SELECT id, score FROM lex WHERE score >= 0.05 ORDER BY score DESC, id LIMIT 24), v AS (SELECT vec_id AS id, {COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 24), m AS (SELECT coalesce(l.id, v.id) AS id, 0.55 * coalesce(l.score, 0) + 0.45 * greatest(0, coalesce(v.score, 0)) AS s FROM l FULL JOIN v ON l.id = v.id) SELECT id, round(s, 6) AS score FROM m ORDER BY s DESC, id LIMIT 8",
    "semantic_rerank": f"""{W}, v AS (SELECT vec_id AS id, {COS} AS score FROM embeddings ORDER BY score DESC, id LIMIT 40), t AS (SELECT v.id, v.score, {TOK.format('content')} AS tok FROM v JOIN mem USING (id)),
r AS (SELECT id, (0.75 * score + 0.25 * ((CASE WHEN list_contains(tok, 'the') THEN 1 + ln(1 + len(list_filter(tok, lambda t: t = 'the'))) ELSE 0 END + CASE WHEN list_contains(tok, 'and') THEN 1 + ln(1 + len(list_filter(tok, lambda t: t = 'and'))) ELSE 0 END) / 2)) * CASE WHEN id % 3 = 0 THEN 0.35 ELSE 1 END AS s FROM t)
SELECT id, round(s, 6) AS score FROM r ORDER BY s DESC, id LIMIT 10""",
    "missing_vectors": "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "orphan_vectors": "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)",
    "hash_embedding": rf"{W}, w AS (SELECT id, unnest(regexp_split_to_array(trim(lower(content)), '\s+')) AS w FROM mem), c AS (SELECT id, (('0x' || substr(sha256(w), 1, 8))::bigint % 128)::int AS place, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL) SELECT id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM c",
    "mean_pool": "WITH x AS (SELECT vec_id % 37 AS id, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings) SELECT id, d::int AS d, round(avg(x), 6) AS x FROM x GROUP BY ALL",
    "context_pack_prefix": "SELECT conv_id AS query_id, turn AS rank, (sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))::bigint AS used FROM conversations QUALIFY used <= 1500",
    "context_pack_greedy": GREEDY,
    "line_windows": rf"{W}, l AS (SELECT id, string_split(content, chr(10)) AS l FROM mem), w AS (SELECT id, l, unnest(range(0, greatest(0, ceil((len(l) - 8) / 7))::bigint + 1)) AS part FROM l), c AS (SELECT id, part::int AS part, (part * 7 + 1)::int AS start_line, least(part * 7 + 8, len(l))::int AS end_line, array_to_string(l[(part * 7 + 1):(part * 7 + 8)], chr(10)) AS content FROM w) SELECT id, part, start_line, end_line, content, sha256(content) AS hash FROM c WHERE trim(regexp_replace(content, '\s+', ' ', 'g')) <> ''",
    "fragments": rf"{W}, l AS (SELECT id, unnest(string_split(content, chr(10))) AS line FROM mem) SELECT id, count(*) AS useful FROM l WHERE length(line) BETWEEN 12 AND 1000 AND len(regexp_extract_all(line, '\p{{L}}')) >= 6 AND NOT regexp_matches(line, '^https?://\S+$') AND NOT regexp_matches(line, '^[A-Za-z0-9+/=]{{40,}}$') GROUP BY id",
}
