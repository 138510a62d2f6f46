"""Queries over session logs, work state, knowledge pages and requests, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from tessera.functions import text as T
from tessera.operators import memory as M
from tessera.operators import retrieval as R
from tessera.operators import session as E
from tessera.operators import answers as A
from tessera.operators import conversation as CV
from tessera.operators.lineage import shared_folder
from tessera.operators import state as ST
from tessera.operators import wiki as K
from tessera.plans import inputs as I
from tessera.sources import tail


def _texts(spark, d):
    return I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def event_dedup(spark, d):
    return E.deduplicated(I.session_events(spark, d)).select("project", "session", "seq")


def activity_copies(spark, d):
    a = I.activities(spark, d)
    return E.activity_copies(a).select("id", "seen")


def activity_summary(spark, d):
    s = M.activity_summary(I.activities(spark, d))
    return s.select("project", "activities", F.array_join("types", ",").alias("types"), "errors")


def session_manifest(spark, d):
    return E.manifest(I.session_events(spark, d)).select("project", "session", "last_seq", "events", "last_type", "status", F.expr("timestampdiff(SECOND, first_ts, last_ts)").alias("seconds"))


def events_beyond(spark, d):
    e = I.session_events(spark, d)
    return E.beyond(e, E.manifest(e.where("seq < 4 AND session % 3 <> 0"))).select("session", "seq")


def capture_health(spark, d):
    m = E.manifest(I.session_events(spark, d))
    remote = I.table(spark, d, "conversations").where("turn < 3 AND conv_id % 4 <> 0").groupBy(F.col("conv_id").alias("session")).agg(F.max("turn").alias("remote_seq"))
    return E.capture_health(m, remote).select("project", "sessions", "pending", "errors")


def keyset_page(spark, d):
    o = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.expr("o_custkey % 50").cast("int").alias("clock"))
    return E.after(o, 40, 500)


def message_types(spark, d):
    return E.message_types(I.table(spark, d, "conversations")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def repeated_lines(spark, d):
    return E.repeated_lines(_texts(spark, d), 2).groupBy("id").agg(F.count(F.lit(1)).alias("kept"), F.sum("pos").alias("places"))


def session_facts(spark, d):
    return E.facts(_texts(spark, d)).select("id", "pos", "category", "importance")


def chunk_numbers(spark, d):
    from tessera.sources.files import chunk_numbers as numbers

    e = I.table(spark, d, "events").select((F.col("user_id") % 10).alias("session"), F.col("event_id").alias("seq"))
    return numbers(e).groupBy("session", "chunk").agg(F.count(F.lit(1)).alias("events"), F.min("seq").alias("first"), F.max("seq").alias("last"))


def event_times(spark, d):
    e = I.table(spark, d, "events").select("event_id", F.expr("case event_id % 4 when 0 then cast(1700000000 + event_id as string) when 1 then cast(1700000000000 + event_id * 1000 as string) when 2 then '2024-02-03T04:05:06' else 'soon' end").alias("a"), F.lit("2024-01-01T00:00:00").alias("b"))
    return e.select("event_id", F.unix_seconds(E.parsed_times(e, ["a", "b"])).alias("second"))


def latest_per_kind(spark, d):
    return ST.latest_by_kind(I.observations(spark, d))


def recent_distinct(spark, d):
    return ST.recent_distinct(I.observations(spark, d), 8)


def first_distinct(spark, d):
    return ST.first_distinct(I.observations(spark, d), 8)


def work_items(spark, d):
    return ST.work_items(I.observations(spark, d)).select("project", "key", "title", "status", F.round("confidence", 6).alias("confidence"), "ord")


def work_progress(spark, d):
    return ST.progress(ST.work_items(I.observations(spark, d)))


def current_item(spark, d):
    return ST.current_item(ST.work_items(I.observations(spark, d)))


def active_files(spark, d):
    o = I.observations(spark, d).select("project", F.col("key").alias("file"), F.when(F.col("kind") == "error", "deleted").otherwise("modified").alias("action"), "ts", "seq")
    return ST.active_files(o).select("project", "file", "action", "place")


def _facts(spark, d):
    o = I.observations(spark, d)
    kind = I.pick(["rule", "decision", "todo", "fix", "context"], F.col("seq") % 5)
    return o.select("project", kind.alias("kind"), F.col("seq").alias("id"), "text", F.expr("(seq % 17) / 17.0D").alias("importance"), "confidence")


def scenes(spark, d):
    return ST.scenes(_facts(spark, d)).select("project", "scene", "facts", F.round("importance", 6).alias("importance"), F.round("confidence", 4).alias("confidence"), "summary")


def semantic_state(spark, d):
    return ST.semantic_state(I.observations(spark, d).withColumn("ts", F.date_trunc("week", "ts"))).select("project", "scope", "kind", "value", F.round("confidence", 6).alias("confidence"), "seen")


def audit_ring(spark, d):
    return ST.ring(I.observations(spark, d).select("project", "seq", "kind"), 5, "project", "seq")


def intent_facts(spark, d):
    f = _facts(spark, d).select("project", "kind", F.col("text").alias("value"), I.pick(["checkpoint", "handoff", "session-origin", "work-state"], F.col("id") % 4).alias("source"), (F.col("id") % 200).alias("place"))
    return ST.intent_facts(f, {"decision": 100, "rule": 85, "todo": 45}, {"checkpoint": 20, "handoff": 18, "session-origin": 14, "work-state": 8}).select("project", "rank", "kind", F.round("score", 4).alias("score"), "place")


def _links(spark, d):
    p = I.wiki_pages(spark, d)
    return K.links(p, F.transform(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), T.slug))


def page_links(spark, d):
    return _links(spark, d)


def backlinks(spark, d):
    return K.backlinks(_links(spark, d))


def orphan_pages(spark, d):
    p = I.wiki_pages(spark, d).withColumn("slug", T.slug(F.col("title")))
    links = K.links(p, F.transform(F.regexp_extract_all("html", F.lit(">([A-Za-z]+)</a>"), 1), T.slug))
    return K.orphans(p, links).select("page_id")


def broken_links(spark, d):
    return K.broken(I.wiki_pages(spark, d), _links(spark, d)).groupBy("slug").agg(F.count(F.lit(1)).alias("broken"))


def latest_revision(spark, d):
    p = I.wiki_pages(spark, d).select((F.col("page_id") % 40).alias("slug"), "revision", "title")
    return K.latest(p)


def title_conflicts(spark, d):
    p = I.wiki_pages(spark, d).select("slug", "title")
    return K.title_conflicts(p)


def wiki_quality(spark, d):
    return K.quality_report(I.wiki_pages(spark, d), I.now())


def governance(spark, d):
    source = I.pick(["skill", "memory", "wiki"], F.col("page_id") % 3)
    return K.governed(I.wiki_pages(spark, d), source).select("slug", "confidence", "critical", "needs_review", "risk")


def wiki_search(spark, d):
    return R.wiki_search(I.wiki_pages(spark, d), ["the", "ench", "page-7", "guide", "the"]).select("slug", F.col("score").cast("long").alias("score"))


def page_changes(spark, d):
    p = I.wiki_pages(spark, d)
    old = p.where("page_id % 5 <> 0").select(F.col("slug").alias("key"), F.when(F.col("page_id") % 3 == 0, F.lit("old")).otherwise(F.sha2("html", 256)).alias("digest"))
    return K.changes(old, p.select(F.col("slug").alias("key"), F.sha2("html", 256).alias("digest")))


def hub_requests(spark, d):
    e = I.table(spark, d, "events").select(F.concat(F.lit("agent"), F.col("user_id")).alias("principal"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("ms"))
    return K.requests(e)


def hub_access(spark, d):
    o = I.table(spark, d, "orders")
    wanted = o.select(F.col("o_custkey").alias("principal"), (F.col("o_orderkey") % 7).alias("team"), F.col("o_orderstatus").alias("scope"))
    c = I.table(spark, d, "customer")
    grants = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("principal"), (F.col("c_custkey") % 7).alias("team"), F.array(F.lit("O"), F.lit("P")).alias("scopes"))
    owners = c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("principal"), F.lit(3).cast("long").alias("team"))
    return K.allowed(wanted, grants, owners)


def event_windows(spark, d):
    a = I.activities(spark, d)
    return a.groupBy(F.window("ts", "1 day").alias("w"), "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "type", "n", "value")


# Questions, and by hand whether each goes on from what was said before.
QUESTIONS = [
    ("Tiếp tục task trước, đang làm gì?", False), ("Tại sao?", True), ("why so", True), ("What about the build of the package", True), ("còn TODO nào", False), ("nó ở đâu", False), ("list all files", False), ("then  what", True), ("is it done", True),
    ("resume that work", False), ("vậy thì sao", True), ("thế còn file nào", False), ("Sao vậy?", True),
]
FACT_KINDS = ["task", "next_action", "file", "decision", "blocker", "todo", "rule"]


def conversation_focus(spark, d):
    m = I.table(spark, d, "conversations")
    n = F.col("conv_id") * 5 + F.col("turn") * 3
    facts = F.array(*[F.struct(I.pick(FACT_KINDS, (n + j) % 7).alias("kind"), F.concat(F.lit(["Item  ", "item ", "ITEM "][j]), ((n * (j + 1)) % 11).cast("string")).alias("value"), F.lit("log").alias("source")) for j in range(3)])
    asked = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(turn * 3 + if(turn % 6 = 5, 13, 0) as int))")
    turns = m.select(F.col("conv_id").alias("project"), F.col("turn").alias("seq"), asked.alias("asked"), I.pick([q for q, _ in QUESTIONS], (F.col("conv_id") + F.col("turn") * 2) % 13).alias("question"), facts.alias("facts"))
    told = F.array_join(F.transform("focus", lambda f: F.concat_ws(":", f["kind"], f["value"])), ",")
    return CV.focus(turns).select("project", "seq", "used", "previous_intent", F.size("prior").cast("long").alias("n_prior"), told.alias("focus"), "answer")


def tailed_log(spark, d):
    """Messages written as logs of lines, a file for each of seven projects, and read again by the byte."""
    m = I.table(spark, d, "conversations").where("text IS NOT NULL")
    line = F.when(F.col("turn") % 4 == 3, F.concat(F.lit("plain "), F.regexp_replace("text", "\\s+", " "))).otherwise(F.to_json(F.struct("role", F.regexp_replace("text", "\\s+", " ").alias("content"), F.col("turn").alias("time"))))
    folder = shared_folder(spark, "log")
    m.select((F.col("conv_id") % 7).alias("p"), "conv_id", "turn", line.alias("value")).repartition("p").sortWithinPartitions("p", "conv_id", "turn").select("p", "value").write.partitionBy("p").text(folder)
    out = tail.transcript_events(tail.lines(spark, folder, ending=".txt", partBytes="65536"))
    return out.select(F.regexp_extract("path", "p=([0-9]+)", 1).cast("long").alias("p"), "seq", "type", "role", F.unix_seconds("ts").alias("second"), F.sha2("data", 256).alias("data_sha256"))


ANSWER_KINDS = ["task", "next_action", "file", "decision", "blocker", "todo", "rule", "progress", "fix", "completed"]
ANSWER_QUESTIONS = ["đang làm gì", "next step", "file cuối", "blocker", "decision", "hoàn thành chưa", "progress", "what is this", "todo list", "việc còn lại"]


def local_answers(spark, d):
    o = I.observations(spark, d)
    source = F.when(F.col("project") == "p3", "work-state").otherwise(I.pick(["checkpoint", "session-origin", "work-state", "checkpoint"], F.col("seq") % 4))
    source = F.when(F.col("project").isin("p1", "p2") & (F.col("seq") % 5 == 0), "handoff").otherwise(source)
    facts = o.where("project <> 'p9'").select("project", I.pick(ANSWER_KINDS, F.col("seq") % 10).alias("kind"), F.concat("kind", F.lit("  "), "key").alias("value"), source.alias("source"), (F.col("seq") % 300).alias("place"))
    asks = o.select("project").distinct().select("project", F.posexplode(F.array(*map(F.lit, ANSWER_QUESTIONS))).alias("n", "question")).select(F.concat_ws(":", "project", "n").alias("ask"), "project", "question")
    return A.local_answers(asks, facts)


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}

LINES = "l AS (SELECT doc_id AS id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)"
HIGH = ["nhớ", "quy tắc", "từ giờ", "không được", "luôn luôn", "remember", "rule", "from now", "must not", "always", "never", "critical", "important", "blocker", "deploy", "production", "architecture"]
CATEGORY = "CASE " + " ".join(
    f"WHEN regexp_matches(line, '{p}') THEN '{n}'"
    for n, p in [("rule", r"(?i)\b(rule|policy|standard|convention|always|never|must|should|quy tắc|từ giờ|không được)\b"), ("fix", r"(?i)\b(fix|fixed|bug|issue|error|lỗi)\b"), ("blocker", r"(?i)\b(blocker|blocked|stuck|cannot|không thể)\b"), ("next_action", r"(?i)\b(next|todo|action|task|cần làm)\b"), ("deploy", r"(?i)\b(deploy|release|publish|ship)\b"), ("architecture", r"(?i)\b(architecture|design|structure|pattern)\b"), ("file", r"(?i)\.(ts|js|py|go|rs|java|cpp|c|h)\b")]
) + " ELSE 'decision' END"
ITEMS = f"""WITH {I.OBS}, it AS (SELECT project, key, arg_max(text, (ts, seq)) AS title, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) IN ('in_progress', 'blocked') THEN arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) ELSE arg_max(status, (ts, seq)) END AS status, max(confidence) AS confidence, arg_max(ord, (ts, seq)) FILTER (ord IS NOT NULL) AS ord FROM obs GROUP BY project, key)"""
FACTS = "fa AS (SELECT project, ['rule', 'decision', 'todo', 'fix', 'context'][((seq % 5) + 1)::int] AS kind, seq AS id, substr(text, 1, 30) AS text, (seq % 17) / 17.0::double AS importance, confidence FROM obs)"
SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
LINKS = f"""ln AS (SELECT DISTINCT slug, {SLUG.format('h')} AS target FROM (SELECT slug, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS h FROM wp) WHERE {SLUG.format('h')} <> '')"""
TOKENS = ["the", "ench", "page-7", "guide"]
WSCORE = " + ".join(
    f"CASE WHEN slug = '{t}' THEN 12 ELSE 0 END + CASE WHEN lower(title) = '{t}' THEN 10 ELSE 0 END + CASE WHEN contains(lower(title), '{t}') THEN 6 ELSE 0 END + CASE WHEN contains(slug, '{t}') THEN 5 ELSE 0 END + CASE WHEN list_contains(tags, '{t}') THEN 5 WHEN contains(tags[1], '{t}') OR contains(tags[2], '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(coalesce(summary, '')), '{t}') THEN 2 ELSE 0 END + CASE WHEN contains(lower(content), '{t}') THEN 1 ELSE 0 END"
    for t in TOKENS
)
def _focus_sql():
    at = lambda values, index: "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() for v in values) + f"][({index} + 1)::int]"
    q = "(conv_id + turn * 2) % 13"
    # intents of the questions, by hand
    intents = ["current_task", "summary", "summary", "summary", "summary", "summary", "summary", "summary", "completed", "summary", "summary", "last_file", "summary"]
    facts = ", ".join(f"{{'k': {at(FACT_KINDS, f'((conv_id * 5 + turn * 3 + {j}) % 7)')}, 'v': '{w} ' || ((conv_id * 5 + turn * 3) * {j + 1} % 11)}}" for j, w in enumerate(["Item", "item", "ITEM"]))
    merge = lambda xs: f"list_filter({xs}, lambda x, i: list_position(list_transform({xs}, lambda y: y.k || lower(y.v)), x.k || lower(x.v)) = i)[1:8]"
    first = lambda k: f"(list_filter(prior, lambda z: z.k = '{k}')[1]).v"
    labels = {"task": "Task liên quan", "next_action": "Việc tiếp theo", "file": "File liên quan", "decision": "Quyết định liên quan", "blocker": "Blocker", "todo": "TODO"}
    told = lambda ks, n: "nullif(array_to_string(list_filter([" + ", ".join(f"'{labels[k]}: ' || {first(k)} || '.'" for k in ks) + f"], lambda x: x IS NOT NULL)[1:{n}], ' '), '')"
    return f"""WITH RECURSIVE t AS (SELECT conv_id AS project, turn AS seq, turn * 3 + CASE WHEN turn % 6 = 5 THEN 13 ELSE 0 END AS hour, {at([f for _, f in QUESTIONS], q)} AS follows, {at(intents, q)} AS intent, {q} AS q, [{facts}] AS facts FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY hour, seq) AS k FROM t),
f AS (SELECT project, k, seq, hour, q, intent, false AS used, NULL::varchar AS before, facts[1:0] AS prior, {merge("facts")} AS focus FROM o WHERE k = 1
UNION ALL SELECT o.project, o.k, o.seq, o.hour, o.q, o.intent, o.follows AND o.hour - f.hour <= 12 AND len(f.focus) > 0, CASE WHEN o.hour - f.hour <= 12 THEN f.intent END, CASE WHEN o.hour - f.hour <= 12 THEN f.focus ELSE f.focus[1:0] END,
  CASE WHEN o.follows AND o.hour - f.hour <= 12 THEN {merge("(o.facts || f.focus)")} ELSE {merge("o.facts")} END FROM f JOIN o ON o.project = f.project AND o.k = f.k + 1)
SELECT project, seq, used, before AS previous_intent, len(prior) AS n_prior, array_to_string(list_transform(focus, lambda x: x.k || ':' || x.v), ',') AS focus,
  CASE WHEN NOT used OR intent <> 'summary' THEN NULL WHEN q IN (1, 2, 12) THEN {told(["decision", "blocker", "next_action", "task", "file"], 2)} WHEN q = 7 THEN {told(["next_action", "todo", "task", "blocker", "file", "decision"], 3)} ELSE {told(["task", "next_action", "file", "decision", "blocker"], 3)} END AS answer FROM f"""


def _answers_sql():
    # intents of the questions, their weights and orders, by hand
    intents = ["current_task", "next_action", "last_file", "blocker", "decision", "completed", "status", "summary", "summary", "summary"]
    weights = {
        "current_task": "CASE kind WHEN 'task' THEN 100 WHEN 'file' THEN 65 WHEN 'next_action' THEN 55 WHEN 'blocker' THEN 45 ELSE 10 END", "next_action": "CASE kind WHEN 'next_action' THEN 100 WHEN 'todo' THEN 80 WHEN 'task' THEN 65 WHEN 'blocker' THEN 60 WHEN 'file' THEN 40 ELSE 10 END",
        "last_file": "CASE kind WHEN 'file' THEN 100 WHEN 'task' THEN 65 WHEN 'next_action' THEN 40 ELSE 10 END", "blocker": "CASE kind WHEN 'blocker' THEN 100 WHEN 'task' THEN 60 WHEN 'next_action' THEN 50 WHEN 'file' THEN 35 ELSE 10 END",
        "decision": "CASE kind WHEN 'decision' THEN 100 WHEN 'rule' THEN 85 WHEN 'task' THEN 45 WHEN 'file' THEN 30 ELSE 10 END", "completed": "CASE kind WHEN 'completed' THEN 100 WHEN 'progress' THEN 70 WHEN 'task' THEN 30 ELSE 10 END", "status": "CASE kind WHEN 'progress' THEN 100 WHEN 'task' THEN 85 WHEN 'blocker' THEN 65 WHEN 'next_action' THEN 60 ELSE 10 END",
        "summary": "CASE kind WHEN 'task' THEN 100 WHEN 'next_action' THEN 95 WHEN 'file' THEN 90 WHEN 'blocker' THEN 85 WHEN 'completed' THEN 60 WHEN 'todo' THEN 60 WHEN 'decision' THEN 55 WHEN 'rule' THEN 54 WHEN 'fix' THEN 52 WHEN 'progress' THEN 50 ELSE 10 END",
    }
    orders = {
        "current_task": ["task", "file", "next_action"], "next_action": ["next_action", "task", "file", "todo"], "last_file": ["file", "task", "next_action"], "blocker": ["blocker"], "decision": ["decision"], "completed": ["completed"], "status": ["progress", "task", "next_action", "blocker"],
        "summary": ["task", "file", "todo", "next_action", "blocker", "decision", "rule", "fix", "completed", "progress"],
    }
    listed = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
    weight = "CASE intent " + " ".join(f"WHEN '{i}' THEN {w}" for i, w in weights.items()) + " END"
    order = "CASE WHEN q.todo THEN ['todo', 'task', 'next_action', 'file'] ELSE CASE q.intent " + " ".join(f"WHEN '{i}' THEN {listed(o)}" for i, o in orders.items()) + " END END"
    label = "CASE kind WHEN 'task' THEN 'Task hiện tại' WHEN 'file' THEN 'File hiện tại' WHEN 'todo' THEN 'TODO' WHEN 'next_action' THEN 'Tiếp theo' WHEN 'blocker' THEN 'Blocker' WHEN 'decision' THEN 'Quyết định' WHEN 'rule' THEN 'Quy tắc' WHEN 'fix' THEN 'Đã sửa' WHEN 'completed' THEN 'Đã hoàn thành' WHEN 'progress' THEN 'Tiến độ' END"
    return f"""WITH {I.OBS}, q AS (SELECT project, n, {listed(intents)}[n + 1] AS intent, n >= 8 AS todo FROM (SELECT DISTINCT project FROM obs), (SELECT unnest(range(0, 10)) AS n)),
f AS (SELECT project, {listed(ANSWER_KINDS)}[(seq % 10 + 1)::int] AS kind, kind || '  ' || key AS value, CASE WHEN project IN ('p1', 'p2') AND seq % 5 = 0 THEN 'handoff' WHEN project = 'p3' THEN 'work-state' ELSE ['checkpoint', 'session-origin', 'work-state', 'checkpoint'][(seq % 4 + 1)::int] END AS source, seq % 300 AS place FROM obs WHERE project <> 'p9'),
s AS (SELECT i.project, intent, kind, value, source, place, {weight} + CASE source WHEN 'checkpoint' THEN 20 WHEN 'handoff' THEN 18 WHEN 'session-origin' THEN 14 ELSE 8 END + greatest(0, 5 - 0.01::double * place) AS score FROM (SELECT DISTINCT project, intent FROM q) i JOIN f USING (project)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY project, intent, kind, value ORDER BY score DESC, place, source DESC) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY project, intent ORDER BY score DESC, place, kind, value) AS rank FROM b QUALIFY rank <= 32),
c AS (SELECT * FROM (SELECT *, bool_or(source = 'handoff') OVER (PARTITION BY project, intent) AS handed FROM r) WHERE NOT handed OR source = 'handoff' OR source = 'checkpoint' AND kind IN ('rule', 'architecture', 'fix')),
k AS (SELECT *, row_number() OVER (PARTITION BY project, intent, kind ORDER BY rank) AS k FROM c QUALIFY k <= CASE WHEN kind IN ('todo', 'blocker', 'decision', 'completed') THEN 3 ELSE 1 END),
w AS (SELECT q.project, q.n, q.intent AS intent, string_agg({label} || ': ' || value, chr(10) ORDER BY list_position({order}, k.kind), k.k) FILTER (list_contains({order}, k.kind)) AS answer FROM q LEFT JOIN k ON k.project = q.project AND k.intent = q.intent GROUP BY q.project, q.n, q.intent, q.todo)
SELECT w.project || ':' || n AS ask, intent, answer, CASE WHEN answer IS NULL THEN 'none' ELSE (SELECT arg_min(source, rank) FROM c WHERE c.project = w.project AND c.intent = w.intent) END AS source FROM w"""


ANSWERS = _answers_sql()
FOCUS = _focus_sql()


SQL = {
    "event_dedup": f"WITH {I.SESSIONS} SELECT project, session, seq FROM ev QUALIFY row_number() OVER (PARTITION BY project, session, coalesce(source_event, 'seq' || seq) ORDER BY seq DESC) = 1",
    "activity_copies": f"WITH {I.ACTIVITY} SELECT min(id) AS id, count(*) AS seen FROM a GROUP BY project, type, data",
    "activity_summary": f"WITH {I.ACTIVITY}, r AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, id DESC) <= 50) SELECT project, count(*) AS activities, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count_if(type = 'error')::bigint AS errors FROM r GROUP BY project HAVING count(*) >= 4",
    "session_manifest": f"WITH {I.SESSIONS}, m AS (SELECT project, session, max(seq) AS last_seq, count(*) AS events, arg_max(type, (seq, ts)) AS last_type, date_diff('second', min(ts), max(ts)) AS seconds FROM ev GROUP BY project, session) SELECT *, CASE last_type WHEN 'session_end' THEN 'idle' WHEN 'error' THEN 'error' ELSE 'active' END AS status FROM m",
    "events_beyond": f"WITH {I.SESSIONS}, m AS (SELECT session, max(seq) AS s FROM ev WHERE seq < 4 AND session % 3 <> 0 GROUP BY 1) SELECT session, seq FROM ev LEFT JOIN m USING (session) WHERE s IS NULL OR seq > s",
    "capture_health": f"WITH {I.SESSIONS}, m AS (SELECT project, session, max(seq) AS l, arg_max(type, seq) AS t FROM ev GROUP BY ALL), r AS (SELECT conv_id AS session, max(turn) AS s FROM conversations WHERE turn < 3 AND conv_id % 4 <> 0 GROUP BY 1) SELECT project, count(*) AS sessions, sum(greatest(0, l - coalesce(s, -1)))::bigint AS pending, count_if(t = 'error')::bigint AS errors FROM m LEFT JOIN r USING (session) GROUP BY project",
    "keyset_page": "SELECT o_orderkey AS id, (o_custkey % 50)::int AS clock FROM orders WHERE o_custkey % 50 > 40 OR (o_custkey % 50 = 40 AND o_orderkey > 500)",
    "message_types": "SELECT CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE CASE WHEN contains(role, 'tool') THEN 'tool_result' ELSE 'custom' END END AS type, count(*) AS n FROM conversations GROUP BY 1",
    "repeated_lines": rf"WITH {LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) ORDER BY pos) AS k FROM l) SELECT id, count(*) AS kept, sum(pos)::bigint AS places FROM k WHERE k <= 2 GROUP BY id",
    "session_facts": rf"""WITH {LINES}, c AS (SELECT *, {CATEGORY} AS category FROM l WHERE length(trim(line)) >= 15),
s AS (SELECT *, round(greatest(0, least(1, 0.5::double + {" + ".join(f"CASE WHEN contains(lower(line), '{w}') THEN 0.15::double ELSE 0 END" for w in HIGH)} + CASE WHEN category IN ('rule', 'architecture', 'blocker') THEN 0.2 WHEN category IN ('decision', 'deploy') THEN 0.15 WHEN category IN ('fix', 'next_action') THEN 0.1 ELSE 0 END::double - CASE WHEN length(line) < 20 THEN 0.3 WHEN length(line) > 500 THEN 0.1 ELSE 0 END::double)), 6) AS importance FROM c),
f AS (SELECT * FROM s WHERE importance >= 0.3 QUALIFY row_number() OVER (PARTITION BY id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) ORDER BY pos) = 1)
SELECT id, pos::int AS pos, category, importance FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY importance DESC, pos) <= 10""",
    "chunk_numbers": "WITH c AS (SELECT user_id % 10 AS session, event_id AS seq, (row_number() OVER (PARTITION BY user_id % 10 ORDER BY event_id) - 1) // 100 AS chunk FROM events) SELECT session, chunk::int AS chunk, count(*) AS events, min(seq) AS first, max(seq) AS last FROM c GROUP BY ALL",
    "event_times": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1700000000 + event_id WHEN 1 THEN 1700000000 + event_id WHEN 2 THEN epoch(TIMESTAMP '2024-02-03 04:05:06')::bigint ELSE epoch(TIMESTAMP '2024-01-01')::bigint END AS second FROM events",
    "latest_per_kind": f"WITH {I.OBS} SELECT project, kind, arg_max(text, (ts, seq)) AS text, max(seq) AS last_seq, count(*) AS seen FROM obs GROUP BY project, kind",
    "recent_distinct": f"WITH {I.OBS}, r AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY ts DESC, seq DESC) = 1) SELECT project, key, text, seq FROM r QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 8",
    "first_distinct": f"WITH {I.OBS}, r AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY ts, seq) = 1) SELECT project, key, text, seq FROM r QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 8",
    "work_items": f"{ITEMS} SELECT project, key, title, status, round(confidence, 6) AS confidence, ord FROM it",
    "work_progress": f"{ITEMS} SELECT project, count(*) AS total, count_if(status = 'completed')::bigint AS completed, count_if(status = 'in_progress')::bigint AS in_progress, count_if(status = 'blocked')::bigint AS blocked, count_if(status = 'pending')::bigint AS pending, count_if(status = 'cancelled')::bigint AS cancelled FROM it GROUP BY project",
    "current_item": f"{ITEMS} SELECT project, key, status FROM it WHERE status IN ('in_progress', 'blocked', 'pending') QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE status WHEN 'in_progress' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END, coalesce(ord, 1::bigint << 40), key) = 1",
    "active_files": f"WITH {I.OBS}, r AS (SELECT project, key AS file, CASE WHEN kind = 'error' THEN 'deleted' ELSE 'modified' END AS action, ts, seq FROM obs QUALIFY row_number() OVER (PARTITION BY project, key ORDER BY ts DESC, seq DESC) = 1) SELECT project, file, action, (row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC))::int AS place FROM r WHERE action <> 'deleted' QUALIFY place <= 5",
    "scenes": f"""WITH {I.OBS}, {FACTS}, s AS (SELECT *, CASE WHEN kind IN ('rule', 'architecture') THEN 'project-knowledge' WHEN kind IN ('decision', 'fix') THEN 'implementation' WHEN kind = 'todo' THEN 'continuation' ELSE 'session-context' END AS scene FROM fa),
k AS (SELECT *, row_number() OVER (PARTITION BY project, scene ORDER BY importance DESC, confidence DESC, id) AS k FROM s)
SELECT project, scene, count(*) AS facts, round(max(importance), 6) AS importance, round(avg(confidence), 4) AS confidence, string_agg(text, ' | ' ORDER BY k) FILTER (k <= 5) AS summary FROM k GROUP BY ALL""",
    "tailed_log": r"""WITH l AS (SELECT conv_id % 7 AS p, conv_id, turn, role, turn % 4 = 3 AS plain, CASE WHEN turn % 4 = 3 THEN 'plain ' || regexp_replace(text, '\s+', ' ', 'g') ELSE '{"role":' || to_json(role) || ',"content":' || to_json(regexp_replace(text, '\s+', ' ', 'g')) || ',"time":' || turn || '}' END AS line FROM conversations WHERE text IS NOT NULL)
SELECT p, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY p ORDER BY conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS seq, CASE WHEN plain THEN 'custom' WHEN role = 'user' THEN 'user_prompt' WHEN role = 'assistant' THEN 'assistant_message' ELSE 'message' END AS type,
  CASE WHEN NOT plain THEN role END AS role, CASE WHEN NOT plain THEN turn END AS second, sha256(CASE WHEN plain THEN '{"format":"raw-line","content":' || to_json(line) || '}' ELSE line END) AS data_sha256 FROM l""",
    "local_answers": ANSWERS,
    "conversation_focus": FOCUS,
    "semantic_state": f"""WITH {I.OBS}, f AS (SELECT project, scope, kind, count(*) AS seen, list_reduce(list({{'week': date_trunc('week', ts), 'session': session, 'confidence': confidence, 'text': text}} ORDER BY seq),
  lambda x, y: CASE WHEN y.week > x.week OR (y.week = x.week AND (y.session = x.session OR y.confidence >= x.confidence)) THEN y ELSE x END) AS s FROM obs GROUP BY ALL)
SELECT project, scope, kind, s.text AS value, round(s.confidence, 6) AS confidence, seen FROM f""",
    "audit_ring": f"WITH {I.OBS} SELECT project, seq, kind FROM obs QUALIFY row_number() OVER (PARTITION BY project ORDER BY seq DESC) <= 5",
    "intent_facts": f"""WITH {I.OBS}, {FACTS}, f AS (SELECT project, kind, text AS value, id % 200 AS place, CASE kind WHEN 'decision' THEN 100 WHEN 'rule' THEN 85 WHEN 'todo' THEN 45 ELSE 10 END + [20, 18, 14, 8][((id % 4) + 1)::int] + greatest(0, 5 - 0.01::double * (id % 200)) AS score FROM fa),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY project, kind, lower(trim(value)) ORDER BY score DESC, place) = 1)
SELECT project, (row_number() OVER (PARTITION BY project ORDER BY score DESC, place, kind))::int AS rank, kind, round(score, 4) AS score, place FROM b QUALIFY rank <= 12""",
    "page_links": f"WITH {I.WIKI}, {LINKS} SELECT slug, target FROM ln",
    "backlinks": f"WITH {I.WIKI}, {LINKS} SELECT target AS slug, count(*) AS backlinks FROM ln GROUP BY 1",
    "orphan_pages": f"WITH {I.WIKI}, q AS (SELECT *, {SLUG.format('title')} AS s FROM wp), l AS (SELECT s, unnest(regexp_extract_all(html, '>([A-Za-z]+)</a>', 1)) AS t FROM q) SELECT page_id FROM q WHERE s NOT IN (SELECT {SLUG.format('t')} FROM l WHERE {SLUG.format('t')} <> s AND {SLUG.format('t')} <> '')",
    "broken_links": f"WITH {I.WIKI}, {LINKS} SELECT slug, count(*) AS broken FROM ln WHERE target NOT IN (SELECT slug FROM wp) GROUP BY slug",
    "latest_revision": f"WITH {I.WIKI} SELECT page_id % 40 AS slug, revision, title FROM wp QUALIFY row_number() OVER (PARTITION BY page_id % 40 ORDER BY revision DESC) = 1",
    "title_conflicts": rf"WITH {I.WIKI} SELECT trim(regexp_replace(lower(title), '\s+', ' ', 'g')) AS title, count(*) AS pages, min(slug) AS first FROM wp GROUP BY 1 HAVING count(*) > 1",
    "wiki_quality": f"WITH {I.WIKI} SELECT count(*) AS pages, count_if((epoch_us(TIMESTAMP '2024-06-15') - epoch_us(updated)) / 86400000000.0 > 90)::bigint AS stale, count_if(length(content) < 80)::bigint AS short, count_if(summary IS NULL)::bigint AS without_summary FROM wp",
    "governance": rf"""WITH {I.WIKI}, c AS (SELECT slug, round(greatest(0, least(1, [0.96, 0.94, 0.88][((page_id % 3) + 1)::int]::double + CASE WHEN list_contains(tags, 'class:permanent') OR list_contains(tags, 'class:task') THEN 0.03 ELSE 0 END::double + CASE WHEN length(content) >= 200 THEN 0.02 ELSE 0 END::double - CASE WHEN length(content) < 80 THEN 0.05 ELSE 0 END::double - CASE WHEN length(title) < 4 THEN 0.05 ELSE 0 END::double)), 4) AS confidence,
regexp_matches(concat_ws(' ', title, summary, substr(content, 1, 2000), array_to_string(tags, ' ')), '{K.CRITICAL}') AS critical FROM wp), n AS (SELECT *, confidence < 0.86 OR (critical AND confidence < 0.94) AS needs_review FROM c)
SELECT slug, confidence, critical, needs_review, CASE WHEN critical THEN 'high' WHEN needs_review THEN 'medium' ELSE 'low' END AS risk FROM n""",
    "wiki_search": f"WITH {I.WIKI}, s AS (SELECT slug, updated, {WSCORE} AS score FROM wp) SELECT slug, score::bigint AS score FROM s WHERE score > 0 ORDER BY score DESC, updated DESC, slug LIMIT 20",
    "page_changes": f"WITH {I.WIKI} SELECT slug AS key, CASE WHEN page_id % 5 = 0 THEN 'created' WHEN page_id % 3 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM wp",
    "hub_requests": "SELECT 'agent' || user_id AS principal, count(*) AS requests, count_if(event_type = 'error')::bigint AS errors, round(sum(greatest(0, value)), 4) AS ms, round(max(value), 4) AS slowest FROM events GROUP BY 1",
    "hub_access": "WITH w AS (SELECT DISTINCT o_custkey AS principal, o_orderkey % 7 AS team, o_orderstatus AS scope FROM orders) SELECT * FROM w WHERE (principal % 5 = 0 AND team = 3 AND principal IN (SELECT c_custkey FROM customer)) OR (principal % 2 = 0 AND principal % 7 = team AND scope IN ('O', 'P') AND principal IN (SELECT c_custkey FROM customer))",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
}
