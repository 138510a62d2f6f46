"""Queries over transcripts, learnt memories, tool events and handed-over state, each with its DuckDB SQL.

The given texts are invented words, so what people and tools say is put in front of their lines, one phrase for each line; the SQL holds
its own copies of the rules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import transcript as R
from tessera.operators import capture as K
from tessera.operators import handoff as H
from tessera.operators import learned as L
from tessera.operators import session as E
from tessera.operators import skills as W
from tessera.operators import state as ST
from tessera.operators import tools as O
from tessera.plans import inputs as I

PHRASES = [
    "We decided on", "You must not touch", "from now on write", "cần làm", "fixed the thing in", "pipeline: use", "the path is", "npm notice", "added 12 packages", "$ ls", "42%", "Loading...", "Tool call: run", "api_key = abc12345", "token: t0k", "Authorization: Bearer zzz", "next step", "Không được sửa", "quyết định",
    "switched to the adapter", "implemented", "see src/core/a.ts for", "[============]", "password=hunter2", "the port is at", "TODO", "", "chọn vite thay", "- [ ] follow-up on", "up to date", "never again", "luôn", "hoàn thành", "retrieval: move", "<system> note", "error in docs/b.md:",
]
TEMPLATES = [
    '{"tool":"Edit","input":{"file_path":"src/a{id}.ts"}}', '{"command":"npm run test -- {id}","exitCode":0}', '{"cmd":"npx eslint src/{user}","code":"1","passed":"no"}',
    '{"type":"function_call","name":"apply_patch","arguments":"*** Update File: src/u{user}.ts\\n+ x\\n*** Add File: b{id}.md"}', '{"tool_name":"create_file","path":"docs/{id}.md","status":"completed"}', '{"tool":"delete file","target":"tmp/{id}.c","ok":true}',
    '{"arguments":"{\\"command\\":\\"pytest -q t{user}\\"}","output":"3 failed","status":"failed"}', '{"calls":[{"script":"cargo build","state":"running"},{"script":"ls {id}"}]}', '{"message":"nothing here {id}","outcome":"broken"}', '{"tool":"write","file":"a\\nb{id}.txt","result":"ok"}',
    '{"cmd":" tsc --noEmit ","result":"all green {user}","exit_code":"0"}', '{"input":"*** Delete File: old/{user}.py","content":"keep me"}', '{"a":{"thinking":"no","b":[{"type":"reasoning","x":1},"npm notice x","token=q{user}"]},"cot":"x","n":{id}}',
]
TOOL_TYPES = ["file_edit", "tool_call", "command", "tool_result", "file_write", "commit", "decision", "error"]
PACKAGES = ["next", "react", "vue", "svelte", "express", "pg", "mysql2", "sqlite3", "redis", "redux", "mobx", "vite", "webpack"]


def _said(spark, d):
    """The messages of conversations, a phrase in front of each line."""
    m = I.table(spark, d, "conversations")
    text = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.concat(I.pick(PHRASES, (F.col("conv_id") * 7 + F.col("turn") * 3 + i) % len(PHRASES)), F.lit(" "), x)), "\n")
    kind = F.when(F.expr("(conv_id + turn) % 23 = 0"), "decision").when(F.expr("(conv_id + turn) % 31 = 0"), "todo").when(F.col("role") == "user", "user_prompt").otherwise("assistant_message")
    return m.select(
        F.concat(F.lit("p"), F.col("conv_id") % 7).alias("project"), F.concat(F.lit("agent"), F.col("conv_id") % 3).alias("agent"), F.col("conv_id").alias("session"), F.concat_ws(":", F.lit("e"), "conv_id", "turn").alias("id"), F.when(F.col("turn") % 5 != 4, F.concat(F.lit("s"), F.expr("turn - if(turn % 5 = 3, 1, 0)"))).alias("source_event"),
        F.col("turn").alias("seq"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), cast(turn as int))").alias("ts"), kind.alias("type"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("role"), F.concat(F.lit("m"), F.expr("turn div 3")).alias("message"), text.alias("text"),
    )


def _lines(spark, d):
    return E.lines(_said(spark, d))


def _tool_events(spark, d):
    e = I.table(spark, d, "events")
    data = F.replace(F.replace(I.pick(TEMPLATES, F.col("event_id") % len(TEMPLATES)), F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{user}"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 20).alias("project"), I.pick(TOOL_TYPES, F.expr("(event_id div 3) % 8")).alias("type"), "ts", data.alias("data"))


def noise_lines(spark, d):
    return _lines(spark, d).groupBy("id").agg(F.count_if(R.is_noise(F.col("line"))).alias("noise"), F.count_if(R.is_durable(F.col("line"))).alias("durable"))


def kept_transcripts(spark, d):
    return E.kept_transcripts(_said(spark, d), 2).select("id", F.sha2("text", 256).alias("digest"))


def dropped_events(spark, d):
    e = _said(spark, d).withColumn("content", F.split_part("text", F.lit("\n"), F.lit(1)))
    kind = I.pick(["system_note", "tool_call", "ephemeral", "assistant_message", "tool_call"], (F.col("session") + F.col("seq")) % 5)
    return e.select("id", R.drops_event(kind, F.col("seq") % 2 == 0, F.col("content")).alias("dropped"))


def kept_event_data(spark, d):
    return _tool_events(spark, d).select("id", F.sha2(R.kept_data("data"), 256).alias("digest"))


def reasoning_stripped(spark, d):
    return _tool_events(spark, d).select("id", F.sha2(R.without_reasoning("data"), 256).alias("digest"))


def sensitive_lines(spark, d):
    return _said(spark, d).select("id", F.sha2(R.without_sensitive_lines(F.col("text")), 256).alias("digest"))


def learnt_memories(spark, d):
    return L.learnt(_said(spark, d)).select("session", "fingerprint", "kind", "type", "content", F.round("confidence", 4).alias("confidence"), "importance", "event", F.col("pos").cast("long").alias("pos"))


def memory_pipeline(spark, d):
    return L.pipeline(_said(spark, d))["stats"]


def pipeline_index(spark, d):
    c = L.pipeline(_said(spark, d))["candidates"]
    return c.select("session", "fingerprint", "knowledge_class", F.round("score", 6).alias("score"), F.array_join("terms", " ").alias("terms"), F.array_join("tags", ",").alias("tags"))


def session_work_state(spark, d):
    return L.work_state(L.pipeline(_said(spark, d))["candidates"])


def hierarchy_links(spark, d):
    return L.hierarchy_links(L.pipeline(_said(spark, d))["candidates"])


def merged_checkpoint(spark, d):
    x = L.enriched(L.learnt(_said(spark, d))).select("session", "fingerprint", "score", "ts", "content", "seq")
    x = x.withColumn("session", F.col("session") % 5)
    return L.merged_checkpoint(x.where("seq % 2 = 0").drop("seq"), x.where("seq % 2 = 1").drop("seq"), 40).select("session", "fingerprint", F.round("score", 6).alias("score"), "place")


def activity_memories(spark, d):
    e = _tool_events(spark, d)
    return e.withColumn("m", L.activity_memory(F.col("type"), F.col("data"))).where("m IS NOT NULL").select("id", "m.type", "m.content", F.array_join("m.tags", ",").alias("tags"))


def tool_signals(spark, d):
    return O.signals(_tool_events(spark, d))


def edited_files(spark, d):
    e = _tool_events(spark, d).select("id", "data", O.leaves("data").alias("all"))
    return e.select("id", F.explode(O.edited_files(O.tool_name(F.col("data"), F.col("all")), F.col("all"))).alias("file"))


def event_outcomes(spark, d):
    return _tool_events(spark, d).select("id", O.outcome(F.col("type"), F.col("data")).alias("outcome"))


def offload_counts(spark, d):
    return _tool_events(spark, d).groupBy("project").agg(F.count_if(F.col("type").isin(H.OFFLOAD_TYPES)).alias("eligible"), F.count(F.lit(1)).alias("events"))


def offload_nodes(spark, d):
    e = _tool_events(spark, d)
    nodes = e.select(F.concat(F.lit("n"), F.col("id") % 400).alias("id"), F.col("id").alias("seq"), F.col("type").alias("kind"), F.length("data").alias("bytes"), F.concat(F.lit("r"), F.expr("id div 800")).alias("source_ref"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("f"), F.expr("id div 1200"))).alias("file"))
    return H.merged_nodes(nodes).select("id", "kind", "bytes", "seen", F.array_join("source_refs", ",").alias("source_refs"), F.array_join("files", ",").alias("files"))


def asset_prefixes(spark, d):
    a = I.table(spark, d, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("id"))
    asked = a.select(F.when(F.col("id") < "4", F.upper(F.substring("id", 1, 12))).when(F.col("id") < "8", F.substring("id", 1, 7)).when(F.col("id") < "c", F.concat(F.substring("id", 1, 20), F.lit("0"))).otherwise(F.col("id")).alias("ref")).distinct()
    return H.by_prefix(asked, a)


def last_values(spark, d):
    return H.last_values(I.observations(spark, d), ["click", "view", "purchase", "error"])


def _checks(spark, d):
    return I.observations(spark, d).select("project", F.col("kind"), F.concat(F.lit("Run  "), F.col("key")).alias("command"), F.when(F.col("status") == "completed", "passed").when(F.col("status") == "blocked", "failed").otherwise("running").alias("status"), "ts", "seq")


def recent_checks(spark, d):
    return H.recent_checks(_checks(spark, d))


def test_statuses(spark, d):
    o = I.observations(spark, d)
    checks = H.recent_checks(_checks(spark, d))
    return H.test_status(checks, o.select("project", F.concat("kind", F.lit(" "), "status").alias("text"), "ts", "seq"))


def next_actions(spark, d):
    o = I.observations(spark, d)
    items = ST.work_items(o)
    explicit = o.where("kind = 'purchase'").select("project", F.concat(F.lit("Next: "), "key").alias("text"), "seq")
    return H.next_actions(explicit, items, ST.current_item(items))


def ordered_distinct(spark, d):
    t = I.table(spark, d, "documents").select("source", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("p", "text"), "doc_id").withColumn("place", F.struct("doc_id", "p"))
    return H.ordered_distinct(t, "source", 20).select("source", "k", "text")


def substantive_states(spark, d):
    v = H.last_values(I.observations(spark, d), ["error", "signup"])
    v = v.withColumn("files", F.when(F.col("project") == "p3", F.array(F.lit("x"))).otherwise(F.array()))
    return v.select("project", H.substantive(v, ["signup"], ["files"]).alias("substantive"))


def phases(spark, d):
    o = I.observations(spark, d)
    current = o.where("ord IS NOT NULL").groupBy("project").agg(F.max_by("ord", "seq").alias("ord"))
    known = o.where("ord IS NOT NULL").select("project", "ord", F.col("text").alias("objective"), F.when(F.col("status") == "blocked", F.col("key")).alias("why"), "seq")
    return H.with_phase(current, known)


def fitted_lines(spark, d):
    t = I.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return H.fitted_lines(t, 120)


def compact_bullets(spark, d):
    return I.table(spark, d, "documents").select("doc_id", F.sha2(H.compact_bullets(F.coalesce("text", F.lit("")), 4), 256).alias("digest"))


def auto_sections(spark, d):
    t = I.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<!-- a -->old"), F.col("source"), F.lit("<!-- z -->"))).otherwise("").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    return t.select("doc_id", F.sha2(H.with_section(F.concat("text", F.lit("\n"), "mark", F.lit("\n\n"), F.lit("end")), F.concat(F.lit("<!-- a -->new"), "doc_id", F.lit("<!-- z -->")), "<!-- a -->", "<!-- z -->"), 256).alias("digest"))


def _packages(spark, d):
    o = I.table(spark, d, "orders")
    name = lambda k: I.pick(PACKAGES, (F.col("o_orderkey") * k) % len(PACKAGES))
    text = F.concat(F.lit('{"dependencies":{"'), name(1), F.lit('":"1","x":"2"},"devDependencies":{"'), name(5), F.lit('":"1"},"scripts":{"'), F.when(F.col("o_orderkey") % 3 == 0, "deploy:").otherwise("run:"), F.col("o_orderkey"), F.lit('":"x"}}'))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("json"))


def package_evidence(spark, d):
    return H.evidence(_packages(spark, d)).select("id", "framework", "database", "state", "build_tool", F.array_join("deploy_scripts", ",").alias("deploy_scripts"))


def evidence_conflicts(spark, d):
    e = H.evidence(_packages(spark, d)).join(I.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("We run "), I.pick(["Express", "redis", "MobX", "nothing", "koa", "MySQL"], F.col("o_custkey") % 6), F.lit(" "), "o_orderpriority").alias("memory")), "id")
    return e.select("id", H.evidence_conflict(F.col("memory"), F.col("framework"), F.col("database"), F.col("state")).alias("conflict"))


def wiki_candidates(spark, d):
    c = I.table(spark, d, "documents")
    kind, class_ = F.when(F.col("doc_id") % 2 == 0, "memory").otherwise("scene"), I.pick(["permanent", "task", "session", "transient"], F.col("doc_id") % 4)
    scene = I.pick(["implementation", "session-context", "continuation"], F.col("doc_id") % 3)
    return c.where(H.wiki_candidate(kind, class_, scene, F.coalesce("text", F.lit("")))).select("doc_id")


def injections(spark, d):
    e = I.table(spark, d, "events")
    age = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") * 37) % 50000)
    return e.where(H.may_inject(age, F.col("event_id") % 4)).select("event_id")


def found_files(spark, d):
    return H.found_files(_said(spark, d).withColumn("seq", F.struct("session", "seq")))


def dangerous_commands(spark, d):
    e = I.table(spark, d, "events")
    commands = ["rm -rf /srv/{}", "RM -RF ~/{}", "chmod -R 777 {}", "chown -R root {}", "DROP TABLE u{}", "truncate table t{}", "ls {}", "systemctl stop s{}", "git push --force {}", "chmod 777 {}"]
    paths = ["/etc/{}", "/usr/lib/{}", "/var/www/{}", "/a/public_html/{}", "/srv/prod/{}", "/x/.env", "/x/.env.{}", "/my/Secret/{}", "/home/{}"]
    put = lambda values: F.replace(I.pick(values, F.col("event_id") % len(values)), F.lit("{}"), F.col("user_id").cast("string"))
    return e.select("event_id", P.dangerous_command(put(commands)).alias("command"), P.dangerous_path(put(paths)).alias("path"))


def rule_matches(spark, d):
    from tessera.operators.extraction import matched_rules

    n, e = I.table(spark, d, "nation"), I.table(spark, d, "events")
    texts = ["Never delete", "Keep production safe", "Only edit source files", "deploy on Monday", "be kind"]
    rules = n.select(F.col("n_nationkey").cast("long").alias("rule_id"), F.concat_ws(" ", I.pick(texts, F.col("n_nationkey") % 5), "n_name").alias("text"), F.when(F.col("n_nationkey") % 4 != 3, I.pick(["path", "command", "security"], F.col("n_nationkey") % 3)).alias("category"))
    targets = ["/var/www/{}", "/app/src/{}", "npm run deploy {}", "rm -rf {}", "/lib/{}", "chmod 777 {}", "ls {}"]
    kind = F.when((F.col("event_id") % 7).isin(0, 1, 4), "path").otherwise("command")
    t = e.select(F.col("event_id").alias("target_id"), F.replace(I.pick(targets, F.col("event_id") % 7), F.lit("{}"), F.col("user_id").cast("string")).alias("text"), kind.alias("type"))
    return matched_rules(rules, t).groupBy("target_id", "family").agg(F.count(F.lit(1)).alias("rules"), F.min("rule_id").alias("first"))


def resolved_symbols(spark, d):
    v = I.vertices(spark, d)
    part = v.where("type = 'interface'").select(F.upper(F.substring("name", 3, 4))).union(v.where("type = 'module'").select(F.substring("name", 1, 2))).union(v.where("type = 'function'").select(F.substring("file", 10, 9)))
    asked = v.select(F.col("name").alias("asked")).union(v.where("type = 'class'").select("id")).union(part).union(v.where("type = 'file'").select(F.concat(F.lit(" no "), "name"))).distinct()
    return H.resolved_symbols(asked, v.withColumn("qualified", F.concat_ws(".", "type", "name")))


def incremental_items(spark, d):
    o = I.observations(spark, d).withColumn("text", F.when(F.col("seq") % 6 == 0, F.concat(F.lit("Task "), F.col("ord"))).otherwise(F.col("key"))).where("text IS NOT NULL")
    first, second = (o.where(c) for c in ("seq % 2 = 0", "seq % 2 = 1"))
    start = ST.incremental_items(ST.work_items(first).where("false"), first)
    return ST.incremental_items(start, second).select("project", "key", "title", "status", F.round("confidence", 6).alias("confidence"), "ord")


def handoff_states(spark, d):
    o = I.observations(spark, d)
    items = ST.work_items(o)
    explicit = o.where("kind = 'purchase'").select("project", F.concat(F.lit("Next: "), "key").alias("text"), "seq")
    current = ST.current_item(items)
    tests = H.test_status(H.recent_checks(_checks(spark, d)), o.select("project", F.col("kind").alias("text"), "ts", "seq"))
    return H.handoff(items, current, H.next_actions(explicit, items, current), tests).select("project", "task", F.array_join("completed", "|").alias("completed"), F.array_join("remaining", "|").alias("remaining"), "next_action", "tests", "digest")


def found_lines(spark, d):
    return H.found_lines(_said(spark, d).withColumn("seq", F.struct("session", "seq")), r"(?i)\b(decided|todo|fixed)\b", 5, 60)


def latest_texts(spark, d):
    return H.latest_texts(_said(spark, d).withColumn("seq", F.struct("session", "seq")), {"user_prompt": 55, "assistant_message": 75})


HOOKS = [
    '{"hook_event_name":"SessionStart","session_id":"{id}"}', '{"hook_event_name":"PostToolUse","tool_name":"Edit","tool_use_id":"t{id}","tool_input":{"file_path":"src/{user}.ts"}}', '{"hook_event_name":"PostToolUse","tool_name":"Write","session_id":"s{user}","tool_input":{"file_path":"b{id}"}}',
    '{"hook_event_name":"PostToolUse","tool_name":"Bash","session_id":"s{user}"}', '{"hook_event_name":"Stop","session_id":"s{user}"}', '{"hook_event_name":"Other{id}"}', '{"session_id":"s{user}"}', '{"hook_event_name":"PostToolUse","tool_name":"Edit","session_id":"s{id}"}',
]


def hook_events(spark, d):
    e = I.table(spark, d, "events")
    data = F.replace(F.replace(I.pick(HOOKS, F.col("event_id") % 8), F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{user}"), F.col("user_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), F.explode(F.filter(F.array(K.hook_event(data, "hook")), lambda h: h.isNotNull())).alias("h")).select("id", "h.type", "h.source_event")


def activity_events(spark, d):
    e = I.table(spark, d, "events")
    data = F.to_json(F.struct(F.concat(F.lit("src/"), F.when(F.col("event_id") % 7 == 0, ".env").when(F.col("event_id") % 7 == 1, "key.pem").otherwise("a.ts")).alias("filePath"), F.concat(F.lit("x"), "user_id").alias("api_key"), F.col("event_type").alias("note")))
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("p"), F.col("user_id") % 20).alias("project"), I.pick(["file_read", "file_write", "command"], F.col("event_id") % 3).alias("type"), "ts", data.alias("data"))
    return K.activity_events(rows).select("id", "type", "data")


def deep_texts(spark, d):
    return _tool_events(spark, d).select("id", F.array_join(K.deep_texts("data"), "|").alias("texts"))


def event_flushes(spark, d):
    o = I.observations(spark, d).select("session", "seq", F.when(F.col("seq") % 37 == 0, "session_end").otherwise(F.col("kind")).alias("type"))
    return K.flushes(o, 20).groupBy("session", "flush").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


def recovered_sessions(spark, d):
    o = I.table(spark, d, "orders")
    spaces = F.array(F.concat(F.lit("/home/u"), F.col("o_custkey") % 9, F.lit("/p"), F.col("o_orderkey") % 11, F.lit("/x")), F.concat(F.lit("/srv/"), F.col("o_orderkey") % 5))
    convs = o.select(F.col("o_orderkey").alias("id"), spaces.alias("workspaces"), F.col("o_orderdate").alias("last_input"))
    n = I.table(spark, d, "nation")
    projects = n.select(F.col("n_name").alias("project"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("/home/u"), F.col("n_nationkey") % 9)).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("/srv/"), F.col("n_nationkey") % 7, F.lit("/deep/q"))).otherwise(F.concat(F.lit("/home/u1/p"), F.col("n_nationkey") % 11, F.lit("/x"))).alias("root"))
    return K.recovered(convs, projects, 8).select("project", "id", "place")


def discovered_files(spark, d):
    e = I.table(spark, d, "events")
    uuid = lambda c: F.regexp_replace(F.substring(F.md5(c.cast("string")), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    own = uuid(F.col("user_id"))
    path = F.concat(F.lit("/s/"), F.col("event_id") % 50, F.lit("/rollout-"), "event_id", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("-"), own)).otherwise(""), F.lit(".jsonl"))
    files = e.select(path.alias("path"), F.col("ts").alias("modified"), F.when(F.col("event_id") % 3 == 0, own).alias("meta_id"))
    return K.discovered(e.select(own.alias("id")).distinct(), files)


def incremental_index(spark, d):
    """The old side lacks some files and has others with another hash; the new side lacks some too: that is what is compared."""
    v, e = I.vertices(spark, d), I.edges(spark, d)
    files = v.select(F.col("file").alias("path")).distinct().withColumn("k", F.length("path") % 4)
    side = lambda rows, hash_: {"manifest": rows.select("path", hash_.alias("hash")), "vertices": v.join(rows.select(F.col("path").alias("file")), "file", "left_semi"), "edges": e}
    out = K.incremental_index(side(files.where("k <> 0"), F.when(F.col("k") == 1, F.lit("old")).otherwise(F.lit("same"))), side(files.where("k <> 2"), F.lit("same")))
    kind = lambda df, name, by: df.groupBy(F.lit(name).alias("what"), F.col(by).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return kind(out["files"], "file", "status").unionByName(kind(out["vertices"], "vertex", "type")).unionByName(kind(out["edges"], "edge", "type"))


DONE = [
    '{"path":"src/{id}.ts"}', '{"command":"make {user}","exitCode":0}', '{"cmd":"rm {id}","exitCode":1}', '{"name":"suite {user}","passed":true}', '{"name":"t{id}","passed":false}', '{"message":"token=abc{user} done"}', "{}", '{"file":"lib/{user}.py"}', '{"text":"x"}',
]
DONE_TYPES = ["file_write", "command", "command", "test", "test", "commit", "deploy", "file_edit", "user_prompt"]


def skills(spark, d):
    e = I.table(spark, d, "events")
    data = F.replace(F.replace(I.pick(DONE, F.col("event_id") % 9), F.lit("{id}"), F.col("event_id").cast("string")), F.lit("{user}"), F.col("user_id").cast("string"))
    events = e.select(F.concat(F.lit("p"), F.col("user_id") % 20).alias("project"), F.col("user_id").alias("session"), F.col("event_id").alias("seq"), I.pick(DONE_TYPES, F.col("event_id") % 9).alias("type"), data.alias("data"))
    tasks = e.select(F.col("user_id").alias("session"), F.concat(F.lit("Do  "), "event_type").alias("task"), F.col("event_id").alias("place"), (F.col("user_id") % 3 != 0).alias("completed"))
    return W.skills(events, tasks).select("project", "session", "task", F.array_join("steps", "|").alias("steps"), F.array_join("verification", "|").alias("verification"), F.array_join("files", "|").alias("files"), "fingerprint")


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_")}


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _at(values, index):
    return f"{_list(values)}[(({index}) + 1)::int]"


SAID = f"""sd AS (SELECT 'p' || (conv_id % 7) AS project, 'agent' || (conv_id % 3) AS agent, conv_id AS session, 'e:' || conv_id || ':' || turn AS id, CASE WHEN turn % 5 <> 4 THEN 's' || (turn - CASE WHEN turn % 5 = 3 THEN 1 ELSE 0 END) END AS source_event, turn AS seq,
TIMESTAMP '2024-01-01' + to_hours(conv_id::int) + to_minutes(turn::int) AS ts, CASE WHEN (conv_id + turn) % 23 = 0 THEN 'decision' WHEN (conv_id + turn) % 31 = 0 THEN 'todo' WHEN role = 'user' THEN 'user_prompt' ELSE 'assistant_message' END AS type, CASE WHEN turn % 3 <> 2 THEN role END AS role, 'm' || (turn // 3) AS message,
array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x, i: {_list(PHRASES)}[((conv_id * 7 + turn * 3 + i - 1) % {len(PHRASES)} + 1)::int] || ' ' || x), chr(10)) AS text FROM conversations),
sl AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM sd)"""
NOISE = r"""regexp_matches(trim(line), '(?i)^<SYSTEM MESSAGE>|^<EPHEMERAL MESSAGE>|^<system>|^<ephemeral>|^ManageTask:|^Task \d+ status:|^Task \d+ killed|^Task \d+ loading|^Thought for \d+ tokens|^Prioritizing Tool Usage|^Tool call:|^Tool response:|^npm notice|^npm WARN|^added \d+ packages|^removed \d+ packages|^up to date|^\d+ packages are looking for funding|^run `npm fund` for details|^[\d.]+%|^\[={10,}\]|^Loading\.\.\.|^Processing\.\.\.|^bash-\d+\.\d+\$|^\$ |^\s*$')"""
DURABLE = "regexp_matches(lower(line), 'decision|decided|rule|convention|architecture|pattern|fixed|resolved|implemented|created|updated|deleted|deployed|blocker|blocked|issue|bug|error|next|todo|action|requirement|must|should|important')"
MASKED = "trim(line)"
for _p in [r"(?i)(api[_-]?key)[:\s=]+\S+", r"(?i)(token)[:\s=]+\S+", r"(?i)(secret)[:\s=]+\S+", r"(?i)(password)[:\s=]+\S+", r"(?i)(bearer)\s+\S+", r"(?i)(authorization):\s*\S+"]:
    MASKED = rf"regexp_replace({MASKED}, '{_p}', '\1: [REDACTED]', 'g')"
TOOLS = f"""te AS (SELECT event_id AS id, 'p' || (user_id % 20) AS project, {_at(TOOL_TYPES, '(event_id // 3) % 8')} AS type, ts, replace(replace({_at(TEMPLATES, f'event_id % {len(TEMPLATES)}')}, '{{id}}', event_id::varchar), '{{user}}', user_id::varchar) AS data, user_id FROM events)"""
CRITICAL = r"regexp_matches(content, '(?i)không được|tuyệt đối|bắt buộc|đừng\s+|must not|do not|don''t|\bnever\b')"
PERSISTENT = r"regexp_matches(content, '(?i)từ giờ|về sau|mỗi lần|luôn luôn|\bluôn\b|quy tắc|workflow|\balways\b|\brequired\b|\bmust\b|from now on')"
DECIDED = r"regexp_matches(content, '(?i)\bchốt\b|quyết định|sẽ dùng|chọn .+ thay|đổi sang|chuyển sang|\bdecided\b|\bchosen\b|we will use|use .+ instead|switch(?:ed)? to')"
TODO = r"regexp_matches(content, '(?i)\btodo\b|cần làm|cần thêm|cần sửa|cần kiểm tra|tiếp theo|bước tiếp theo|còn phải|còn cần|next step|\bneed to\b|\bremaining\b|follow[- ]?up')"
FIXED = r"regexp_matches(content, '(?i)đã sửa|đã fix|đã khắc phục|đã xử lý|hoàn tất|hoàn thành|\bfixed\b|\bresolved\b|\bimplemented\b|\bcompleted\b|\bpasses?\b')"
BUILT = "regexp_matches(content, '(?i)kiến trúc|pipeline|adapter|schema|runtime|namespace|storage|lưu trữ|workflow|session core|memory engine|retrieval')"
ACTS = r"regexp_matches(content, '(?i)\bdùng\b|\btách\b|\bthay\b|\bchuyển\b|\blưu\b|\bmap\b|\buse\b|\bsplit\b|\bstore\b|\breplace\b|\bmove\b')"
PLACE = r"regexp_matches(content, '(?i)đường dẫn|\bpath\b|\bport\b|\bendpoint\b|\bdomain\b|\bbucket\b|\brepository\b|\brepo\b|\bbranch\b|/[A-Za-z0-9._/-]{4,}')"
ASSIGNED = r"regexp_matches(content, '(?i)\blà\b|\bở\b|\bdùng\b|\bnằm\b|\bis\b|\buse\b|located|runs on')"


def _learnt(source):
    """Memories ``lm`` of the events of a table expression, with score, class, terms."""
    return rf"""nr AS (SELECT session, message, arg_max(lower(role), (seq, id)) AS named FROM {source} WHERE role <> '' GROUP BY ALL),
wr AS (SELECT s.* REPLACE (coalesce(nullif(lower(s.role), ''), named, '') AS role) FROM {source} s LEFT JOIN nr ON nr.session = s.session AND nr.message = s.message),
fg AS (SELECT * REPLACE (trim(regexp_replace(regexp_replace(replace(content, chr(13), ''), '^[\s>*#\-•]+', ''), '\s+', ' ', 'g')) AS content) FROM (SELECT * EXCLUDE (text), unnest(p) AS content, generate_subscripts(p, 1) AS nth FROM (SELECT *, regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS p FROM wr))),
fu AS (SELECT * FROM fg WHERE length(content) BETWEEN 12 AND 1000 AND len(regexp_extract_all(content, '\p{{L}}')) >= 6 AND NOT regexp_matches(content, '^(?:https?://\S+|[A-Za-z0-9+/=]{{80,}})$') QUALIFY row_number() OVER (PARTITION BY id, content ORDER BY nth) = 1),
fp AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY nth) - 1 AS pos, role = 'user' OR type = 'user_prompt' AS u, role = 'assistant' OR type = 'assistant_message' AS a FROM fu),
fk AS (SELECT *, CASE WHEN type = 'decision' THEN 'decision' WHEN type = 'todo' THEN 'todo' WHEN u AND ({CRITICAL} OR {PERSISTENT}) THEN 'rule' WHEN {DECIDED} THEN CASE WHEN {BUILT} THEN 'architecture' ELSE 'decision' END WHEN u AND {TODO} THEN 'todo' WHEN {BUILT} AND {ACTS} THEN 'architecture' WHEN a AND {FIXED} THEN 'fix' WHEN u AND {PLACE} AND {ASSIGNED} THEN 'context' END AS kind,
CASE WHEN type IN ('decision', 'todo') THEN 1.0 WHEN u AND {CRITICAL} THEN 0.98 WHEN u AND {PERSISTENT} THEN 0.92 WHEN {DECIDED} THEN CASE WHEN u THEN 0.93 ELSE 0.86 END WHEN u AND {TODO} THEN 0.87 WHEN {BUILT} AND {ACTS} THEN CASE WHEN u THEN 0.88 ELSE 0.82 END WHEN a AND {FIXED} THEN 0.80 ELSE 0.79 END::double AS confidence FROM fp WHERE pos < 50),
lk AS (SELECT *, sha256(project || '|' || kind || '|' || trim(regexp_replace(regexp_replace(lower(content), '[^\p{{L}}\p{{N}}:/._-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS fingerprint FROM fk WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session, fingerprint ORDER BY seq, id, pos) = 1),
lm AS (SELECT *, CASE kind WHEN 'rule' THEN 'rule' WHEN 'todo' THEN 'todo' WHEN 'fix' THEN 'code' WHEN 'context' THEN 'code' ELSE 'decision' END AS mtype,
CASE WHEN kind = 'rule' AND {CRITICAL} THEN 'critical' WHEN kind IN ('architecture', 'decision', 'rule') THEN 'high' WHEN kind IN ('fix', 'context') THEN 'normal' WHEN regexp_matches(lower(content), 'không được|tuyệt đối|must not|never ') THEN 'critical' ELSE 'normal' END AS importance FROM lk),
en AS (SELECT *, 0.75::double * CASE importance WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.85 ELSE 0.6 END::double + 0.25::double * confidence AS score, CASE WHEN confidence < 0.78 THEN 'transient' WHEN kind IN ('rule', 'architecture') THEN 'permanent' WHEN kind IN ('decision', 'todo', 'fix') THEN 'task' ELSE 'session' END AS class FROM lm)"""


CLEAN = "cl AS (SELECT * FROM sd QUALIFY row_number() OVER (PARTITION BY session, coalesce(agent || ':' || source_event, id) ORDER BY seq DESC, id) = 1)"
LEAF = r"""lv AS (SELECT te.id, te.type AS event_type, te.data, j.id AS n, j.parent, regexp_replace(lower(j.key), '[^a-z0-9]', '', 'g') AS k, j.type, trim(j.value->>'$') AS v FROM te, json_tree(te.data) j),
pt AS (SELECT id, parent, lower(v) AS pt FROM lv WHERE k = 'type' AND type = 'VARCHAR'),
tn AS (SELECT te.id, lower(coalesce(nullif(trim(te.data->>'$.tool'), ''), nullif(trim(te.data->>'$.toolName'), ''), nullif(trim(te.data->>'$.tool_name'), ''), deep, '')) AS name FROM te LEFT JOIN (SELECT lv.id, arg_min(v, n) AS deep FROM lv LEFT JOIN pt ON pt.id = lv.id AND pt.parent = lv.parent WHERE lv.type = 'VARCHAR' AND v <> '' AND (k IN ('tool', 'toolname') OR k = 'name' AND regexp_matches(pt, 'tool|function|command')) GROUP BY lv.id) USING (id))"""
OBS_ITEMS = f"""{I.OBS}, it AS (SELECT project, key, arg_max(text, (ts, seq)) AS title, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) IN ('in_progress', 'blocked') THEN arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) ELSE arg_max(status, (ts, seq)) END AS status, arg_max(ord, (ts, seq)) FILTER (ord IS NOT NULL) AS ord FROM obs GROUP BY project, key)"""
CHECKS = "ck AS (SELECT project, kind, 'Run  ' || key AS command, CASE status WHEN 'completed' THEN 'passed' WHEN 'blocked' THEN 'failed' ELSE 'running' END AS status, ts, seq FROM obs)"
_NAME = lambda k: _at(PACKAGES, f"(o_orderkey * {k}) % {len(PACKAGES)}")
PACKED = f"""pk AS (SELECT o_orderkey AS id, list_distinct([{_NAME(1)}, 'x', {_NAME(5)}]) AS ks, o_custkey, o_orderpriority FROM orders),
ed AS (SELECT *, CASE WHEN list_contains(ks, 'next') THEN 'Next.js' WHEN list_contains(ks, 'react') THEN 'React' WHEN list_contains(ks, 'vue') THEN 'Vue' WHEN list_contains(ks, 'svelte') THEN 'Svelte' WHEN list_contains(ks, 'express') THEN 'Express' END AS framework,
CASE WHEN list_contains(ks, 'pg') THEN 'PostgreSQL' WHEN list_contains(ks, 'mysql2') THEN 'MySQL' WHEN list_contains(ks, 'sqlite3') THEN 'SQLite' WHEN list_contains(ks, 'redis') THEN 'Redis' END AS database, CASE WHEN list_contains(ks, 'redux') THEN 'Redux' WHEN list_contains(ks, 'mobx') THEN 'MobX' END AS state,
CASE WHEN list_contains(ks, 'vite') THEN 'Vite' WHEN list_contains(ks, 'webpack') THEN 'Webpack' END AS build_tool, CASE WHEN id % 3 = 0 THEN 'npm run deploy:' || id ELSE '' END AS deploy_scripts FROM pk)"""
KEYS = "k IN ('filepath', 'filename', 'file', 'path', 'target')"
SQL = {
    "noise_lines": f"WITH {SAID} SELECT id, count_if({NOISE})::bigint AS noise, count_if(NOT {NOISE} AND {DURABLE})::bigint AS durable FROM sl GROUP BY id",
    "kept_transcripts": f"WITH {SAID}, k AS (SELECT id, pos, {MASKED} AS m FROM sl WHERE NOT {NOISE} QUALIFY row_number() OVER (PARTITION BY id, lower({MASKED}) ORDER BY pos) <= 2) SELECT id, sha256(coalesce(string_agg(m, chr(10) ORDER BY pos), '')) AS digest FROM sd LEFT JOIN k USING (id) GROUP BY id",
    "dropped_events": f"WITH {SAID}, x AS (SELECT id, session, seq, split_part(text, chr(10), 1) AS line FROM sd) SELECT id, (session + seq) % 5 IN (0, 2) OR ((session + seq) % 5 IN (1, 4) AND seq % 2 <> 0) OR (line <> '' AND {NOISE}) AS dropped FROM x",
    "kept_event_data": rf"""WITH {TOOLS} SELECT id, sha256(CASE id % 13 WHEN 10 THEN replace(data, '" tsc --noEmit "', '"tsc --noEmit"') WHEN 12 THEN replace(replace(data, '"npm notice x",', ''), 'token=q' || user_id, 'token: [REDACTED]') ELSE data END) AS digest FROM te""",
    "reasoning_stripped": """WITH """ + TOOLS + """ SELECT id, sha256(CASE WHEN id % 13 = 12 THEN '{"a":{"b":[{"type":"reasoning","omitted":"[private reasoning omitted]"},"npm notice x","token=q' || user_id || '"]},"n":' || id || '}' ELSE data END) AS digest FROM te""",
    "sensitive_lines": f"WITH {SAID} SELECT id, sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(upper(x), 'SECRET|TOKEN|API_KEY|APIKEY|PASSWORD|PASS=')), chr(10))) AS digest FROM sd",
    "learnt_memories": f"WITH {SAID}, {_learnt('sd')} SELECT session, fingerprint, kind, mtype AS type, content, round(confidence, 4) AS confidence, importance, id AS event, pos FROM lm",
    "memory_pipeline": f"""WITH {SAID}, {CLEAN}, {_learnt('cl')}, x AS (SELECT session AS id, count(*) AS extracted, count_if(class <> 'transient')::bigint AS persisted, count_if(class = 'permanent')::bigint AS permanent, count_if(class = 'task')::bigint AS task, count_if(class = 'session')::bigint AS session, count_if(class = 'transient')::bigint AS transient FROM en GROUP BY en.session)
SELECT a.id, input_events, coalesce(normalized_events, 0) AS normalized_events, coalesce(extracted, 0) AS extracted, coalesce(persisted, 0) AS persisted, coalesce(permanent, 0) AS permanent, coalesce(task, 0) AS task, coalesce(x.session, 0) AS session, coalesce(transient, 0) AS transient FROM (SELECT session AS id, count(*) AS input_events FROM sd GROUP BY 1) a LEFT JOIN (SELECT session AS id, count(*) AS normalized_events FROM cl GROUP BY 1) b USING (id) LEFT JOIN x USING (id)""",
    "pipeline_index": rf"""WITH {SAID}, {CLEAN}, {_learnt('cl')}, t AS (SELECT *, list_filter(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}_./:-]+'), lambda w: length(w) >= 2 AND NOT regexp_matches(w, '^[0-9]+$')) AS w FROM en WHERE class <> 'transient')
SELECT session, fingerprint, class AS knowledge_class, round(score, 6) AS score, array_to_string(list_filter(w, lambda y, i: list_position(w, y) = i)[1:40], ' ') AS terms, mtype || ',level:fact,class:' || class || ',kind:' || kind AS tags FROM t""",
    "session_work_state": rf"""WITH {SAID}, {CLEAN}, {_learnt('cl')}, f AS (SELECT * FROM en WHERE class <> 'transient' QUALIFY row_number() OVER (PARTITION BY session, kind, lower(content) ORDER BY -score, seq, id, pos) = 1)
SELECT session, kind, (row_number() OVER (PARTITION BY session, kind ORDER BY -score, seq, id, pos))::int AS place, content FROM f""",
    "hierarchy_links": f"""WITH {SAID}, {CLEAN}, {_learnt('cl')}, f AS (SELECT id, 'fact:' || fingerprint AS fact, 'scene:' || project || ':' || CASE WHEN kind IN ('rule', 'architecture') THEN 'project-knowledge' WHEN kind IN ('decision', 'fix') THEN 'implementation' WHEN kind = 'todo' THEN 'continuation' ELSE 'session-context' END AS scene, 'knowledge:' || project || ':' || class AS known, class FROM en WHERE class <> 'transient')
SELECT id AS src, fact AS dst, 'supports' AS type FROM f UNION SELECT fact, scene, 'belongs_to' FROM f UNION SELECT scene, known, 'promotes_to' FROM f WHERE class IN ('permanent', 'task')""",
    "merged_checkpoint": f"""WITH {SAID}, {_learnt('sd')}, b AS (SELECT session % 5 AS session, fingerprint, score, ts, seq % 2 AS g FROM en), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY session, fingerprint ORDER BY score DESC, g, ts) = 1)
SELECT session, fingerprint, round(score, 6) AS score, (row_number() OVER (PARTITION BY session ORDER BY score DESC, ts DESC, fingerprint))::int AS place FROM f QUALIFY place <= 40""",
    "activity_memories": f"""WITH {TOOLS} SELECT id, CASE type WHEN 'decision' THEN 'decision' ELSE 'activity' END AS type, CASE type WHEN 'decision' THEN coalesce(data->>'$.content', 'Decision recorded') WHEN 'error' THEN 'Error: ' || coalesce(data->>'$.message', '') WHEN 'file_write' THEN 'Modified file: ' || coalesce(data->>'$.filePath', '') ELSE 'Command: ' || coalesce(data->>'$.command', '') END AS content,
CASE type WHEN 'decision' THEN 'decision' WHEN 'error' THEN 'error' WHEN 'file_write' THEN 'file,write' ELSE 'command' END AS tags FROM te WHERE type IN ('decision', 'error', 'file_write', 'command')""",
    "tool_signals": rf"""WITH {TOOLS}, {LEAF},
ac AS (SELECT te.id, te.type AS t, CASE WHEN te.type IN ('file_edit', 'file_write') THEN 'modified' WHEN regexp_matches(name, '\b(delete|remove|unlink)\b') THEN 'deleted' WHEN regexp_matches(name, '\b(create|add[_-]?file|new[_-]?file)\b') THEN 'created' WHEN regexp_matches(name, '\b(edit|write|patch|apply[_-]?patch|replace|update[_-]?file)\b') THEN 'modified' END AS action FROM te JOIN tn USING (id)),
fi AS (SELECT DISTINCT lv.id, 'file' AS kind, v AS text, action, NULL AS check_kind, NULL AS check_status, CASE WHEN t IN ('file_edit', 'file_write') THEN 1.0 ELSE 0.96 END::double AS confidence FROM lv JOIN ac USING (id) WHERE action IS NOT NULL AND type = 'VARCHAR' AND v <> '' AND {KEYS} AND length(v) < 1000 AND NOT contains(v, chr(10))),
pa AS (SELECT DISTINCT id, 'file' AS kind, trim(f) AS text, action, NULL AS check_kind, NULL AS check_status, 0.99::double AS confidence FROM (SELECT id, unnest(regexp_extract_all(v, '(?im)^\*\*\* Update File:\s*(.+)$', 1)) AS f, 'modified' AS action FROM lv WHERE k IN ('patch', 'diff', 'arguments', 'input') AND type = 'VARCHAR'
UNION ALL SELECT id, unnest(regexp_extract_all(v, '(?im)^\*\*\* Add File:\s*(.+)$', 1)), 'created' FROM lv WHERE k IN ('patch', 'diff', 'arguments', 'input') AND type = 'VARCHAR' UNION ALL SELECT id, unnest(regexp_extract_all(v, '(?im)^\*\*\* Delete File:\s*(.+)$', 1)), 'deleted' FROM lv WHERE k IN ('patch', 'diff', 'arguments', 'input') AND type = 'VARCHAR')),
al AS (SELECT * FROM fi UNION ALL SELECT * FROM pa WHERE (id, text, action) NOT IN (SELECT (id, text, action) FROM fi)),
ar AS (SELECT id, v FROM lv WHERE k IN ('arguments', 'args') AND type = 'VARCHAR' AND v LIKE '{{%' AND json_valid(v)),
cm AS (SELECT DISTINCT id, v AS text FROM (SELECT id, v FROM lv WHERE k IN ('command', 'cmd', 'script') AND type = 'VARCHAR' AND v <> '' UNION ALL SELECT ar.id, trim(j.value->>'$') FROM ar, json_tree(ar.v) j WHERE j.key IN ('command', 'cmd', 'script') AND j.type = 'VARCHAR')),
ex AS (SELECT id, arg_min(try_cast(v AS double), n) AS code FROM lv WHERE k IN ('exitcode', 'code') AND try_cast(v AS double) IS NOT NULL GROUP BY id),
wd AS (SELECT id, string_agg(lower(v), chr(10) ORDER BY n) AS w FROM lv WHERE k IN ('status', 'state', 'result', 'output', 'outputsummary', 'message', 'text') AND type = 'VARCHAR' GROUP BY id),
ch AS (SELECT cm.id, text, CASE WHEN regexp_matches(lower(text), '\b(typecheck|type-check)\b|\btsc\b[\s\S]*--noemit\b') THEN 'typecheck' WHEN regexp_matches(lower(text), '\b(eslint|lint)\b') THEN 'lint' WHEN regexp_matches(lower(text), '\b(vitest|jest|pytest)\b|\bgo\s+test\b|\bcargo\s+test\b|\b(npm|pnpm|yarn)\s+(run\s+)?test\b') THEN 'test' WHEN regexp_matches(lower(text), '\b(npm|pnpm|yarn)\s+(run\s+)?build\b|\bcargo\s+build\b|\bgo\s+build\b|\btsc\b') THEN 'build' END AS check_kind,
CASE WHEN code IS NOT NULL THEN CASE WHEN code = 0 THEN 'passed' ELSE 'failed' END WHEN regexp_matches(w, '\b(error|failed|failure|failing)\b') AND NOT regexp_matches(w, '\b0\s+failed\b') THEN 'failed' WHEN regexp_matches(w, '\b(success|successful|completed|passed|green)\b') THEN 'passed' WHEN regexp_matches(w, '\b(running|started|in[_ -]?progress)\b') THEN 'running' ELSE 'unknown' END AS check_status FROM cm LEFT JOIN ex USING (id) LEFT JOIN wd USING (id))
SELECT id, kind, text, action, check_kind, check_status, confidence FROM al UNION ALL SELECT id, 'command', text, NULL, NULL, NULL, 0.98 FROM cm UNION ALL SELECT id, 'test', text, NULL, check_kind, check_status, 0.98 FROM ch WHERE check_kind IS NOT NULL""",
    "edited_files": rf"""WITH {TOOLS}, {LEAF}, ok AS (SELECT id FROM tn WHERE regexp_matches(name, '(^|[_-])(write|edit|patch|replace|multiedit|create|delete|remove|rename|move)([_-]|$)'))
SELECT DISTINCT id, f AS file FROM (SELECT id, v AS f FROM lv WHERE (k IN ('targetpath', 'sourcepath') OR {KEYS}) AND type = 'VARCHAR' AND length(v) < 500 AND NOT contains(v, chr(10)) AND regexp_matches(v, '(^|/)[^/]+\.[A-Za-z0-9]+$') UNION ALL SELECT id, unnest(regexp_extract_all(v, '(?m)^\*\*\* (?:Update|Add|Delete) File:\s*(.+)$', 1)) FROM lv WHERE type = 'VARCHAR') JOIN ok USING (id)""",
    "event_outcomes": rf"""WITH {TOOLS}, x AS (SELECT id, type, coalesce(data->>'$.passed', data->>'$.ok') AS y, coalesce(try_cast(data->>'$.exitCode' AS double), try_cast(data->>'$.exit_code' AS double), try_cast(data->>'$.code' AS double)) AS c, lower(coalesce(data->>'$.status', data->>'$.result', data->>'$.outcome')) AS w FROM te)
SELECT id, CASE WHEN coalesce(y = 'no', false) OR coalesce(c <> 0, false) OR coalesce(regexp_matches(w, '\b(fail(?:ed)?|error|broken|cancelled)\b'), false) THEN 'failed' WHEN coalesce(y = 'true', false) OR coalesce(c = 0, false) OR coalesce(regexp_matches(w, '\b(pass(?:ed)?|success(?:ful)?|succeeded|ok|green|complete(?:d)?)\b'), false) OR type IN ('commit', 'deploy') THEN 'succeeded' END AS outcome FROM x""",
    "offload_counts": f"WITH {TOOLS} SELECT project, count_if(type IN ('tool_call', 'tool_result', 'file_read', 'file_write', 'file_edit', 'command', 'test', 'artifact'))::bigint AS eligible, count(*) AS events FROM te GROUP BY project",
    "offload_nodes": f"""WITH {TOOLS}, n AS (SELECT 'n' || (id % 400) AS id, id AS seq, type AS kind, length(data) AS bytes, 'r' || (id // 800) AS r, CASE WHEN id % 3 <> 0 THEN 'f' || (id // 1200) END AS f FROM te),
r AS (SELECT id, string_agg(r, ',' ORDER BY s, r) AS source_refs FROM (SELECT id, r, min(seq) AS s FROM n GROUP BY id, r QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, r DESC) <= 8) GROUP BY id), f AS (SELECT id, string_agg(f, ',' ORDER BY s, f) AS files FROM (SELECT id, f, min(seq) AS s FROM n WHERE f IS NOT NULL GROUP BY id, f QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, f) <= 6) GROUP BY id)
SELECT id, arg_max(kind, seq) AS kind, arg_max(bytes, seq)::int AS bytes, count(*) AS seen, coalesce(any_value(source_refs), '') AS source_refs, coalesce(any_value(files), '') AS files FROM n LEFT JOIN r USING (id) LEFT JOIN f USING (id) GROUP BY id""",
    "asset_prefixes": """WITH a AS (SELECT sha256(event_id::varchar) AS id FROM events), q AS (SELECT DISTINCT CASE WHEN id < '4' THEN upper(substr(id, 1, 12)) WHEN id < '8' THEN substr(id, 1, 7) WHEN id < 'c' THEN substr(id, 1, 20) || '0' ELSE id END AS ref FROM a),
h AS (SELECT ref, count(a.id) AS n, min(a.id) AS id FROM q LEFT JOIN a ON length(ref) >= 8 AND substr(a.id, 1, 8) = lower(substr(ref, 1, 8)) AND starts_with(a.id, lower(ref)) GROUP BY ref) SELECT ref, CASE WHEN length(ref) < 8 THEN 'invalid' WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS state, CASE WHEN n = 1 THEN id END AS id FROM h""",
    "last_values": f"WITH {I.OBS} SELECT project, " + ", ".join(f"arg_max(text, (ts, seq)) FILTER (kind = '{k}') AS \"{k}\"" for k in ("click", "view", "purchase", "error")) + " FROM obs GROUP BY project",
    "recent_checks": f"WITH {I.OBS}, {CHECKS}, l AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY project, kind, command ORDER BY ts DESC, seq DESC) = 1) SELECT project, kind, command, status, (row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC))::int AS place FROM l QUALIFY place <= 20",
    "test_statuses": f"""WITH {I.OBS}, {CHECKS}, l AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY project, kind, command ORDER BY ts DESC, seq DESC) = 1), t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 10), c AS (SELECT project, bool_or(status = 'failed') AS f, bool_or(status = 'passed') AS p FROM t GROUP BY 1),
n AS (SELECT project, bool_or(regexp_matches(lower(x), 'failed|failing|failure|error|✗|❌')) AS b, bool_or(regexp_matches(lower(x), 'passed|passing|green|success|✓|✅')) AS g FROM (SELECT project, kind || ' ' || status AS x FROM obs QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 10) GROUP BY 1)
SELECT project, CASE WHEN f THEN 'failing' WHEN p THEN 'passing' WHEN b THEN 'failing' WHEN g THEN 'passing' ELSE 'unknown' END AS status FROM c FULL JOIN n USING (project)""",
    "next_actions": f"""WITH {OBS_ITEMS}, cu AS (SELECT * FROM it WHERE status IN ('in_progress', 'blocked', 'pending') QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE status WHEN 'in_progress' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END, coalesce(ord, 1099511627776), key) = 1),
al AS (SELECT project, 'Next: ' || key AS text, 0 AS g, seq AS p FROM obs WHERE kind = 'purchase' UNION ALL SELECT project, title, 1, 0 FROM cu UNION ALL (SELECT project, title, 2, row_number() OVER (PARTITION BY project ORDER BY coalesce(ord, 1099511627776), key) AS p FROM it WHERE status = 'pending' QUALIFY p <= 5)),
u AS (SELECT project, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, g, p FROM al QUALIFY row_number() OVER (PARTITION BY project, lower(text) ORDER BY g DESC, p DESC) = 1), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY project ORDER BY g DESC, p DESC) <= 8)
SELECT project, (row_number() OVER (PARTITION BY project ORDER BY g, p))::int AS place, text FROM l""",
    "ordered_distinct": r"""WITH w AS (SELECT source, doc_id, unnest(w) AS text, generate_subscripts(w, 1) AS p FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\s+') AS w FROM documents)), u AS (SELECT * FROM w WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source, lower(text) ORDER BY doc_id, p) = 1)
SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id, p))::int AS k, text FROM u QUALIFY k <= 20""",
    "substantive_states": f"WITH {I.OBS} SELECT project, coalesce(arg_max(text, (ts, seq)) FILTER (kind = 'signup'), '') <> '' OR project = 'p3' AS substantive FROM obs GROUP BY project",
    "phases": f"""WITH {I.OBS}, c AS (SELECT project, arg_max(ord, seq) AS ord FROM obs WHERE ord IS NOT NULL GROUP BY 1), k AS (SELECT * FROM obs WHERE ord IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, ord ORDER BY seq) = 1)
SELECT c.project, c.ord, k.text AS objective, coalesce(CASE WHEN k.status = 'blocked' THEN key END, 'not recorded') AS why FROM c LEFT JOIN k ON k.project = c.project AND k.ord = c.ord""",
    "fitted_lines": r"""WITH l AS (SELECT doc_id AS id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)), s AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY pos) - 1 AS e FROM l),
b AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY pos), 0) AS before, ceil(e / 3.5::double) <= 120 AS fits FROM s), o AS (SELECT *, sum((NOT fits)::int) OVER (PARTITION BY id ORDER BY pos) AS bad, greatest(0, 120 - ceil(before / 3.5::double)) AS rest, trim(regexp_replace(line, '\s+', ' ', 'g')) AS q FROM b),
g AS (SELECT id, pos, CASE WHEN bad = 0 THEN line WHEN rest >= 16 THEN CASE WHEN length(q) > floor(rest * 3.2::double) THEN rtrim(substr(q, 1, floor(rest * 3.2::double)::int - 1)) || '…' ELSE q END END AS line, bad FROM o WHERE bad <= 1 AND (bad = 0 OR NOT fits))
SELECT id, pos::int AS pos, line FROM g WHERE line IS NOT NULL AND (bad = 0 OR line <> '')""",
    "compact_bullets": "WITH l AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS x FROM documents) SELECT doc_id, sha256(CASE WHEN len(x) <= 4 THEN t ELSE array_to_string(x[1:4], chr(10)) || chr(10) || '... (' || (len(x) - 4) || ' more items omitted)' END) AS digest FROM l",
    "auto_sections": r"""SELECT doc_id, sha256(CASE WHEN doc_id % 2 = 0 THEN trim(CASE WHEN rtrim(coalesce(text, '') || chr(10)) = '' THEN '' ELSE rtrim(coalesce(text, '') || chr(10)) || chr(10) || chr(10) END || '<!-- a -->new' || doc_id || '<!-- z -->' || chr(10) || chr(10) || ltrim(chr(10) || chr(10) || 'end')) ELSE trim(trim(coalesce(text, '') || chr(10) || chr(10) || chr(10) || 'end') || chr(10) || chr(10) || '<!-- a -->new' || doc_id || '<!-- z -->') END) AS digest FROM documents""",
    "package_evidence": f"WITH {PACKED} SELECT id, framework, database, state, build_tool, deploy_scripts FROM ed",
    "evidence_conflicts": f"""WITH {PACKED}, m AS (SELECT *, lower('We run ' || {_at(['Express', 'redis', 'MobX', 'nothing', 'koa', 'MySQL'], 'o_custkey % 6')}) AS t FROM ed) SELECT id, CASE WHEN framework IS NOT NULL AND contains(t, 'express') AND framework <> 'Express' THEN 'express' WHEN framework IS NOT NULL AND contains(t, 'koa') THEN 'koa'
WHEN database IS NOT NULL AND contains(t, 'mysql') AND database <> 'MySQL' THEN 'mysql' WHEN database IS NOT NULL AND contains(t, 'redis') AND database <> 'Redis' THEN 'redis' WHEN state IS NOT NULL AND contains(t, 'mobx') AND state <> 'MobX' THEN 'mobx' END AS conflict FROM m""",
    "wiki_candidates": "SELECT doc_id FROM documents WHERE CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 <> 2 ELSE doc_id % 3 <> 1 END AND length(trim(coalesce(text, ''))) >= 20",
    "injections": "SELECT event_id FROM events WHERE event_id % 9 = 0 OR ((event_id * 37) % 50000 >= 60 AND (event_id % 4 = 0 OR (event_id * 37) % 50000 >= 21600))",
    "incremental_items": f"""WITH {I.OBS}, o AS (SELECT project, text, status, ts, seq, confidence, ord, coalesce('order:' || ord, lower(trim(regexp_replace(key, '\\s+', ' ', 'g')))) AS key FROM (SELECT * REPLACE (CASE WHEN seq % 6 = 0 THEN 'Task ' || ord ELSE key END AS text) FROM obs) WHERE text IS NOT NULL),
fa AS (SELECT project, key, bool_or(status = 'completed') AS ever, arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) AS moved, arg_max(status, (ts, seq)) AS last, coalesce(arg_max(text, (ts, seq)) FILTER (NOT regexp_matches(text, '(?i)^(?:Phase|TODO|Task|Việc)\\s+\\d+$')), arg_min(text, (ts, seq))) AS title, max(confidence) AS confidence, any_value(ord) AS ord FROM o WHERE seq % 2 = 0 GROUP BY ALL),
fi AS (SELECT project, coalesce('order:' || ord, lower(title)) AS key, title, CASE WHEN ever THEN 'completed' WHEN moved IN ('in_progress', 'blocked') THEN moved ELSE last END AS status, confidence, ord FROM fa),
al AS (SELECT project, key, title AS text, status, TIMESTAMP '1970-01-01' AS ts, -1 AS seq, confidence, ord FROM fi UNION ALL SELECT project, key, text, status, ts, seq, confidence, ord FROM o WHERE seq % 2 = 1),
fb AS (SELECT project, key, bool_or(status = 'completed') AS ever, arg_max(status, (ts, seq)) FILTER (status IN ('in_progress', 'blocked', 'cancelled')) AS moved, arg_max(status, (ts, seq)) AS last, coalesce(arg_max(text, (ts, seq)) FILTER (NOT regexp_matches(text, '(?i)^(?:Phase|TODO|Task|Việc)\\s+\\d+$')), arg_min(text, (ts, seq))) AS title, max(confidence) AS confidence, any_value(ord) AS ord FROM al GROUP BY ALL)
SELECT project, key, title, CASE WHEN ever THEN 'completed' WHEN moved IN ('in_progress', 'blocked') THEN moved ELSE last END AS status, round(confidence, 6) AS confidence, ord FROM fb""",
    "handoff_states": f"""WITH {OBS_ITEMS}, {CHECKS}, cu AS (SELECT * FROM it WHERE status IN ('in_progress', 'blocked', 'pending') QUALIFY row_number() OVER (PARTITION BY project ORDER BY CASE status WHEN 'in_progress' THEN 1 WHEN 'blocked' THEN 2 ELSE 3 END, coalesce(ord, 1099511627776), key) = 1),
sq AS (SELECT project, key, status, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, title, coalesce(ord, 1099511627776) AS o FROM it),
dn AS (SELECT project, string_agg(t, '|' ORDER BY o, key) AS completed FROM (SELECT * FROM (SELECT * FROM sq WHERE status = 'completed' QUALIFY row_number() OVER (PARTITION BY project, lower(t) ORDER BY o, key) = 1) QUALIFY row_number() OVER (PARTITION BY project ORDER BY o, key) <= 30) GROUP BY 1),
rm AS (SELECT project, string_agg(t, '|' ORDER BY o, key) AS remaining FROM (SELECT * FROM (SELECT * FROM sq WHERE status NOT IN ('completed', 'cancelled') QUALIFY row_number() OVER (PARTITION BY project, lower(t) ORDER BY o, key) = 1) QUALIFY row_number() OVER (PARTITION BY project ORDER BY o, key) <= 30) GROUP BY 1),
al AS (SELECT project, 'Next: ' || key AS text, 0 AS g, seq AS p FROM obs WHERE kind = 'purchase' UNION ALL SELECT project, title, 1, 0 FROM cu UNION ALL (SELECT project, title, 2, row_number() OVER (PARTITION BY project ORDER BY coalesce(ord, 1099511627776), key) AS p FROM it WHERE status = 'pending' QUALIFY p <= 5)),
u AS (SELECT project, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, g, p FROM al QUALIFY row_number() OVER (PARTITION BY project, lower(text) ORDER BY g DESC, p DESC) = 1), l AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY project ORDER BY g DESC, p DESC) <= 8),
nx AS (SELECT project, text AS next_action FROM l WHERE (project, lower(text)) NOT IN (SELECT (project, lower(t)) FROM sq WHERE status = 'completed') QUALIFY row_number() OVER (PARTITION BY project ORDER BY g, p) = 1),
ll AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY project, kind, command ORDER BY ts DESC, seq DESC) = 1), tt AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 10), c AS (SELECT project, bool_or(status = 'failed') AS f, bool_or(status = 'passed') AS p FROM tt GROUP BY 1),
n AS (SELECT project, bool_or(contains(x, 'error')) AS b FROM (SELECT project, kind AS x FROM obs QUALIFY row_number() OVER (PARTITION BY project ORDER BY ts DESC, seq DESC) <= 10) GROUP BY 1),
r AS (SELECT project, cu.title AS task, coalesce(completed, '') AS completed, coalesce(remaining, '') AS remaining, next_action, CASE WHEN f THEN 'failing' WHEN p THEN 'passing' WHEN b THEN 'failing' ELSE 'unknown' END AS tests FROM (SELECT DISTINCT project FROM it) LEFT JOIN cu USING (project) LEFT JOIN dn USING (project) LEFT JOIN rm USING (project) LEFT JOIN nx USING (project) LEFT JOIN c USING (project) LEFT JOIN n USING (project))
SELECT *, sha256(coalesce(task, '-') || chr(10) || completed || chr(10) || remaining || chr(10) || coalesce(next_action, '-') || chr(10) || tests) AS digest FROM r""",
    "found_lines": rf"""WITH {SAID}, f AS (SELECT project, session, seq, generate_subscripts(x, 1) AS p, trim(regexp_replace(unnest(x), '\s+', ' ', 'g')) AS t FROM (SELECT *, regexp_split_to_array(text, '\n+') AS x FROM sd)), m AS (SELECT *, CASE WHEN length(t) > 60 THEN substr(t, 1, 60) || '…' ELSE t END AS text FROM f WHERE length(t) BETWEEN 4 AND 500 AND regexp_matches(t, '(?i)\b(decided|todo|fixed)\b')),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY project, lower(text) ORDER BY session DESC, seq DESC, p DESC) = 1) SELECT project, (row_number() OVER (PARTITION BY project ORDER BY session DESC, seq DESC, p DESC))::int AS k, text FROM u QUALIFY k <= 5""",
    "latest_texts": rf"""WITH {SAID}, x AS (SELECT project, type, session, seq, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM sd WHERE type IN ('user_prompt', 'assistant_message')), l AS (SELECT * FROM x WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY project, type ORDER BY session DESC, seq DESC) = 1)
SELECT project, type, CASE WHEN length(t) > CASE type WHEN 'user_prompt' THEN 55 ELSE 75 END THEN substr(t, 1, CASE type WHEN 'user_prompt' THEN 55 ELSE 75 END) || '…' ELSE t END AS text FROM l""",
    "hook_events": f"""SELECT event_id AS id, {_at(['session_start', 'file_edit', 'file_write', 'tool_result', 'session_idle', 'custom', '', 'tool_result'], 'event_id % 8')} AS type, CASE event_id % 8 WHEN 0 THEN 'hook:' || event_id || ':SessionStart:::start' WHEN 1 THEN 'hook:hook:PostToolUse:t' || event_id || ':src/' || user_id || '.ts:file' WHEN 2 THEN 'hook:s' || user_id || ':PostToolUse::b' || event_id || ':file'
WHEN 3 THEN 'hook:s' || user_id || ':PostToolUse:::tool-result' WHEN 4 THEN 'hook:s' || user_id || ':Stop:::idle' WHEN 5 THEN 'hook:hook:Other' || event_id || ':::custom' ELSE 'hook:s' || event_id || ':PostToolUse:::tool-result' END AS source_event FROM events WHERE event_id % 8 <> 6""",
    "activity_events": """SELECT event_id AS id, ['file_read', 'file_write', 'command'][((event_id % 3) + 1)::int] AS type, '{"filePath": "src/' || CASE event_id % 7 WHEN 0 THEN '.env' WHEN 1 THEN 'key.pem' ELSE 'a.ts' END || '", "api_key": "[REDACTED]", "note": "' || event_type || '"}' AS data FROM events WHERE event_id % 3 = 2 OR event_id % 7 > 1""",
    "deep_texts": f"WITH {TOOLS} SELECT id, coalesce(CASE id % 13 WHEN 8 THEN data->>'$.message' WHEN 11 THEN data->>'$.content' END, '') AS texts FROM te",
    "event_flushes": """WITH o AS (SELECT user_id AS session, event_id AS seq, event_id % 37 = 0 AS e FROM events), s AS (SELECT *, coalesce(sum(e::int) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM o), r AS (SELECT *, (row_number() OVER (PARTITION BY session, p ORDER BY seq) - 1) // 20 AS f FROM s),
n AS (SELECT *, (dense_rank() OVER (PARTITION BY session ORDER BY p, f) - 1)::int AS flush FROM r) SELECT session, flush, count(*) AS n, min(seq) AS first FROM n GROUP BY ALL""",
    "recovered_sessions": """WITH c AS (SELECT o_orderkey AS id, o_orderdate AS t, unnest(['/home/u' || (o_custkey % 9) || '/p' || (o_orderkey % 11) || '/x', '/srv/' || (o_orderkey % 5)]) AS path FROM orders), p AS (SELECT n_name AS project, CASE n_nationkey % 3 WHEN 0 THEN '/home/u' || (n_nationkey % 9) WHEN 1 THEN '/srv/' || (n_nationkey % 7) || '/deep/q' ELSE '/home/u1/p' || (n_nationkey % 11) || '/x' END AS root FROM nation),
m AS (SELECT DISTINCT project, id, t FROM p JOIN c ON root = path OR starts_with(path, root || '/') OR starts_with(root, path || '/')) SELECT project, id, (row_number() OVER (PARTITION BY project ORDER BY t DESC, id))::int AS place FROM m QUALIFY place <= 8""",
    "discovered_files": r"""WITH f AS (SELECT regexp_replace(md5(user_id::varchar), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS own, event_id, user_id, ts FROM events), g AS (SELECT *, '/s/' || (event_id % 50) || '/rollout-' || event_id || CASE WHEN user_id % 2 = 0 THEN '-' || own ELSE '' END || '.jsonl' AS path FROM f)
SELECT own AS id, path, (CASE WHEN user_id % 2 = 0 THEN 0 ELSE 1 END)::int AS rank FROM g WHERE user_id % 2 = 0 OR event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY own ORDER BY ts DESC, path) = 1""",
    "incremental_index": f"""WITH {I.GRAPH}, w AS (SELECT *, length(file) % 4 AS k FROM v), x AS (SELECT DISTINCT e.* FROM e JOIN w a ON a.id = e.src LEFT JOIN w b ON b.id = e.dst WHERE (a.k = 3 AND b.k = 3) OR a.k IN (0, 1))
SELECT 'file' AS what, ['added', 'modified', 'deleted', 'unchanged'][(k + 1)::int] AS kind, count(DISTINCT file) AS n FROM w GROUP BY k UNION ALL SELECT 'vertex', type, count(*) FROM w WHERE k <> 2 GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM x GROUP BY type""",
    "skills": r"""WITH x AS (SELECT user_id AS session, event_id AS seq, event_id % 9 AS t, user_id, event_type FROM events),
y AS (SELECT session, seq, CASE t WHEN 0 THEN 'Update src/' || seq || '.ts' WHEN 1 THEN 'Run: make ' || user_id WHEN 3 THEN 'Verify: suite ' || user_id WHEN 5 THEN 'Commit: token=[REDACTED] done' WHEN 6 THEN 'Deploy verified build' WHEN 7 THEN 'Update lib/' || user_id || '.py' END AS step,
CASE t WHEN 3 THEN 'Test passed: suite ' || user_id WHEN 5 THEN 'Commit: token=[REDACTED] done' WHEN 6 THEN 'Deployment completed' END AS check_, CASE t WHEN 0 THEN 'src/' || seq || '.ts' WHEN 7 THEN 'lib/' || user_id || '.py' END AS file FROM x),
s AS (SELECT session, string_agg(step, '|' ORDER BY f) AS steps FROM (SELECT session, step, min(seq) AS f FROM y WHERE step IS NOT NULL GROUP BY session, step QUALIFY row_number() OVER (PARTITION BY session ORDER BY f) <= 16) GROUP BY 1),
c AS (SELECT session, string_agg(check_, '|' ORDER BY f) AS verification FROM (SELECT session, check_, min(seq) AS f FROM y WHERE check_ IS NOT NULL GROUP BY session, check_ QUALIFY row_number() OVER (PARTITION BY session ORDER BY f) <= 10) GROUP BY 1),
f AS (SELECT session, string_agg(file, '|' ORDER BY f) AS files FROM (SELECT session, file, min(seq) AS f FROM y WHERE file IS NOT NULL GROUP BY session, file QUALIFY row_number() OVER (PARTITION BY session ORDER BY f) <= 24) GROUP BY 1),
a AS (SELECT session, 'Do ' || event_type AS task FROM (SELECT session, event_type, min(seq) AS f FROM x WHERE session % 3 <> 0 GROUP BY ALL QUALIFY row_number() OVER (PARTITION BY session ORDER BY f) <= 5)
  UNION ALL SELECT session, 'Do ' || arg_min(event_type, seq) FROM x WHERE session % 3 = 0 AND session IN (SELECT session FROM y WHERE check_ IS NOT NULL) GROUP BY session),
r AS (SELECT 'p' || (session % 20) AS project, session, task, steps, coalesce(verification, '') AS verification, coalesce(files, '') AS files FROM a JOIN s USING (session) LEFT JOIN c USING (session) LEFT JOIN f USING (session))
SELECT *, sha256(project || chr(10) || task || chr(10) || steps || chr(10) || verification || chr(10) || files) AS fingerprint FROM r""".replace("GROUP BY ALL QUALIFY", "GROUP BY session, event_type QUALIFY"),
    "found_files": rf"""WITH {SAID}, f AS (SELECT project, seq, session, unnest(x) AS text, generate_subscripts(x, 1) AS p FROM (SELECT *, regexp_extract_all(text, '(?i)(?:^|[\s"''`(])((?:\.{{0,2}}/|/)?(?:[\w.@+-]+/)*[\w.@+-]+\.(?:ts|tsx|js|jsx|mjs|cjs|vue|py|go|rs|java|kt|swift|php|rb|json|yaml|yml|toml|md|css|scss|html|sql))(?:$|[\s"''`),:])', 1) AS x FROM sd)),
u AS (SELECT project, lower(text) AS key, max((session, seq, p)) AS place, arg_max(text, (session, seq, p)) AS text FROM f GROUP BY ALL) SELECT project, (row_number() OVER (PARTITION BY project ORDER BY place DESC))::int AS k, text FROM u QUALIFY k <= 8""",
    "dangerous_commands": f"""SELECT event_id, {_at(['root deletion', 'home deletion', 'open permissions', '', 'loss of data', 'loss of data', '', 'stop of a service', '', 'open permissions'], 'event_id % 10')} AS c, {_at(['system configuration', 'system binaries', 'production web', 'production web', 'production path', 'environment file', 'environment file', 'sensitive file', ''], 'event_id % 9')} AS p FROM events""",
    "rule_matches": f"""WITH r AS (SELECT n_nationkey::bigint AS rule_id, n_nationkey % 5 AS t, CASE WHEN n_nationkey % 4 <> 3 THEN {_at(['path', 'command', 'security'], 'n_nationkey % 3')} END AS category FROM nation), e AS (SELECT event_id AS target_id, event_id % 7 AS t, CASE WHEN event_id % 7 IN (0, 1, 4) THEN 'path' ELSE 'command' END AS type FROM events),
f AS (SELECT target_id, type, 'production' AS family, 1 AS rt FROM e WHERE t = 0 UNION ALL SELECT target_id, type, 'source', 2 FROM e WHERE t IN (0, 4) UNION ALL SELECT target_id, type, 'deploy', 3 FROM e WHERE t = 2 UNION ALL SELECT target_id, type, 'never', 0 FROM e WHERE t IN (3, 5))
SELECT target_id, family, count(*) AS rules, min(rule_id) AS first FROM f JOIN r ON r.t = f.rt WHERE category IS NULL OR category = type OR category = 'security' GROUP BY ALL""",
    "resolved_symbols": f"""WITH {I.GRAPH}, q AS (SELECT name AS asked FROM v UNION SELECT id FROM v WHERE type = 'class' UNION SELECT upper(substr(name, 3, 4)) FROM v WHERE type = 'interface' UNION SELECT substr(name, 1, 2) FROM v WHERE type = 'module' UNION SELECT substr(file, 10, 9) FROM v WHERE type = 'function' UNION SELECT ' no ' || name FROM v WHERE type = 'file'),
x AS (SELECT asked, arg_min(v.id, (lower(name) <> lower(asked), file, v.id)) AS id, 1 AS rank FROM q JOIN v ON name = asked OR type || '.' || name = asked GROUP BY asked), b AS (SELECT asked, asked AS id, 0 AS rank FROM q WHERE asked IN (SELECT id FROM v) UNION ALL SELECT * FROM x WHERE asked NOT IN (SELECT id FROM v)),
s AS (SELECT asked, arg_min(v.id, (lower(name) <> lower(trim(asked)), file, v.id)) AS id, 2 AS rank FROM (SELECT asked FROM q WHERE asked NOT IN (SELECT asked FROM b) AND trim(asked) <> '') JOIN v ON contains(lower(name || chr(10) || type || '.' || name || chr(10) || file), lower(trim(asked))) GROUP BY asked)
SELECT asked, id, rank::int AS rank FROM b UNION ALL SELECT asked, id, rank::int FROM s""",
}
SQL["dangerous_commands"] = SQL["dangerous_commands"].replace("SELECT event_id, ", "SELECT event_id, nullif(", 1).replace(" AS c, ", ", '') AS command, nullif(", 1).replace(" AS p FROM", ", '') AS path FROM", 1)
