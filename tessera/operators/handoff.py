"""State that is handed from one agent to the next: last values, checks, next actions, evidence, texts with a budget.

Observations: project, kind, key, text, status, ts, seq, ord, session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.lineage import stored

from tessera.functions.text import squeeze

# Packages that tell of a framework, a database, a state library, a build tool; the first that is there decides.
FRAMEWORKS = [("next", "Next.js"), ("react", "React"), ("vue", "Vue"), ("@angular/core", "Angular"), ("svelte", "Svelte"), ("express", "Express"), ("fastify", "Fastify"), ("@nestjs/core", "NestJS")]
DATABASES = [("pg", "PostgreSQL"), ("postgres", "PostgreSQL"), ("mysql", "MySQL"), ("mysql2", "MySQL"), ("sqlite3", "SQLite"), ("better-sqlite3", "SQLite"), ("mongodb", "MongoDB"), ("redis", "Redis")]
STATE_LIBRARIES = [("redux", "Redux"), ("@reduxjs/toolkit", "Redux"), ("zustand", "Zustand"), ("mobx", "MobX"), ("recoil", "Recoil"), ("jotai", "Jotai")]
BUILD_TOOLS = [("vite", "Vite"), ("webpack", "Webpack"), ("esbuild", "esbuild"), ("rollup", "Rollup"), ("parcel", "Parcel")]
# Names in a memory that can contradict what the code uses.
RIVALS = {"framework": ["express", "fastify", "nestjs", "koa", "hapi"], "database": ["postgresql", "mysql", "sqlite", "mongodb", "redis"], "state": ["redux", "zustand", "mobx", "recoil", "jotai"]}
# Events whose payloads may be moved out of a context.
OFFLOAD_TYPES = ["tool_call", "tool_result", "file_read", "file_write", "file_edit", "command", "test", "artifact"]
FILE_NAME = (
    r"(?i)(?:^|[\s\"'`(])((?:\.{0,2}/|/)?(?:[\w.@+-]+/)*[\w.@+-]+\.(?:ts|tsx|js|jsx|mjs|cjs|vue|py|go|rs|java|kt|swift|php|rb|json|yaml|yml|toml|md|css|scss|html|sql))(?:$|[\s\"'`),:])"
)


def last_values(observations: DataFrame, kinds: list[str]) -> DataFrame:
    """By project the last text of each kind, a column for each: one maximum a kind, so nothing is sorted."""
    order = F.struct("ts", "seq")
    of = lambda k: F.max_by("text", F.when((F.col("kind") == k) & F.col("text").isNotNull(), order)).alias(k)
    return observations.groupBy("project").agg(*map(of, kinds))


def distinct_key(text: Column) -> Column:
    """What repeats are told by: case and white space don't count; ``nfkc`` first if texts may need it."""
    return F.lower(squeeze(text))


def ordered_distinct(rows: DataFrame, by: str, most: int, latest: bool = False) -> DataFrame:
    """Of equal texts (``text, place``) the first (``latest``: the last), of these the first ``most`` (last ``most``), with their spelling."""
    rows = rows.withColumn("__key", distinct_key(F.col("text"))).where("__key <> ''")
    pick, end = (F.max_by, F.max) if latest else (F.min_by, F.min)
    one = rows.groupBy(by, "__key").agg(pick(squeeze(F.col("text")), "place").alias("text"), end("place").alias("place"))
    k = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("place") if latest else F.asc("place")))
    return one.withColumn("k", k).where(F.col("k") <= most).select(by, "place", "text", "k")


def recent_checks(checks: DataFrame, most: int = 20) -> DataFrame:
    """The last check (``project, kind, command, status, ts, seq``) of each command, of these the last ``most``."""
    last = checks.groupBy("project", "kind", distinct_key(F.col("command")).alias("key")).agg(F.max_by(F.struct("command", "status"), F.struct("ts", "seq")).alias("x"), F.max(F.struct("ts", "seq")).alias("o"))
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("o")))
    return last.withColumn("place", k).where(F.col("place") <= most).select("project", "kind", F.col("x.command").alias("command"), F.col("x.status").alias("status"), "place")


def test_status(checks: DataFrame, notes: DataFrame) -> DataFrame:
    """By project ``failing``, ``passing`` or ``unknown``: by its ten last checks, else by the words of its ten last notes (``project, text, ts, seq``)."""
    of = lambda s: F.max((F.col("status") == s).cast("int"))
    told = checks.where("place <= 10").groupBy("project").agg(of("failed").alias("failed"), of("passed").alias("passed"))
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts"), F.desc("seq")))
    low = F.lower("text")
    has = lambda p: F.max(low.rlike(p).cast("int"))
    words = notes.withColumn("k", k).where("k <= 10").groupBy("project").agg(has("failed|failing|failure|error|✗|❌").alias("bad"), has("passed|passing|green|success|✓|✅").alias("good"))
    both = told.join(words, "project", "full")
    return both.select("project", F.when(F.col("failed") == 1, "failing").when(F.col("passed") == 1, "passing").when(F.col("bad") == 1, "failing").when(F.col("good") == 1, "passing").otherwise("unknown").alias("status"))


def next_actions(explicit: DataFrame, items: DataFrame, current: DataFrame, most: int = 8, pending: int = 5) -> DataFrame:
    """What was named as next (``project, text, seq``), then the current item's title, then the first pending ones; of equal ones the last, the last ``most``."""
    titles = current.join(items.select("project", "key", "title"), ["project", "key"]).select("project", F.col("title").alias("text"), F.struct(F.lit(1).alias("g"), F.lit(0).cast("long").alias("p")).alias("place"))
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.coalesce("ord", F.lit(1 << 40)), "key"))
    waiting = items.where("status = 'pending'").withColumn("k", k).where(F.col("k") <= pending).select("project", F.col("title").alias("text"), F.struct(F.lit(2).alias("g"), F.col("k").cast("long").alias("p")).alias("place"))
    named = explicit.select("project", "text", F.struct(F.lit(0).alias("g"), F.col("seq").cast("long").alias("p")).alias("place"))
    out = ordered_distinct(named.unionByName(titles).unionByName(waiting), "project", most, latest=True)
    return out.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("project"))).select("project", (F.col("n") - F.col("k") + 1).cast("int").alias("place"), "text")


def substantive(state: DataFrame, scalars: list[str], lists: list[str]) -> Column:
    """Does a state hold anything: a text, or a list that isn't empty."""
    out = F.lit(False)
    for c in scalars:
        out = out | (F.coalesce(F.col(c), F.lit("")) != "")
    for c in lists:
        out = out | (F.coalesce(F.size(c), F.lit(0)) > 0)
    return out


def with_phase(current: DataFrame, phases: DataFrame) -> DataFrame:
    """The current phase (``project, ord``) with what is known of the phase of that order (``project, ord, objective, why``), the first if several."""
    one = phases.groupBy("project", "ord").agg(F.min_by(F.struct("objective", "why"), "seq").alias("x"))
    return current.join(one, ["project", "ord"], "left").select(*current.columns, F.col("x.objective").alias("objective"), F.coalesce("x.why", F.lit("not recorded")).alias("why"))


def fitted_lines(lines: DataFrame, budget: int, by: str = "id", per_token: float = 3.5, least: int = 16, cut: float = 3.2) -> DataFrame:
    """Lines (``id, pos, line``) from the first on while their text has no more than ``budget`` tokens; of the first that doesn't fit, a part if enough is left.

    Tokens are characters over ``per_token``, rounded up, line breaks included, so a running sum of lengths decides; nothing is collected.
    """
    w = Window.partitionBy(by).orderBy("pos")
    rows = lines.withColumn("end", F.sum(F.length("line") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    rows = rows.withColumn("before", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("fits", F.ceil(F.col("end") / per_token) <= budget)
    first = rows.withColumn("out", F.sum((~F.col("fits")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.greatest(F.lit(0), budget - F.ceil(F.col("before") / per_token))
    room = F.floor(left * cut).cast("int")
    short = F.when(F.length(squeeze(F.col("line"))) > room, F.concat(F.rtrim(F.substring(squeeze(F.col("line")), F.lit(1), room - 1)), F.lit("…"))).otherwise(squeeze(F.col("line")))
    given = F.when(F.col("out") == 0, F.col("line")).when((F.col("out") == 1) & ~F.col("fits") & (left >= least), short)
    return first.where("out <= 1").withColumn("line", given).where(F.col("line").isNotNull() & ((F.col("out") == 0) | (F.col("line") != ""))).select(by, "pos", "line")


def compact_bullets(text: Column, most: int) -> Column:
    """The first lines that aren't blank, and how many were left out; a short text as it is."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    more = F.array(F.concat(F.lit("... ("), (F.size(lines) - most).cast("string"), F.lit(" more items omitted)")))
    return F.when(F.size(lines) <= most, text).otherwise(F.array_join(F.concat(F.slice(lines, 1, most), more), "\n"))


def with_section(text: Column, section: Column, begin: str, end: str) -> Column:
    """``text`` with the part between two marks (and these) replaced by ``section``, which comes last if there is no such part."""
    start, stop = F.locate(begin, text), F.locate(end, text)
    head, tail = F.rtrim(F.substring(text, F.lit(1), start - 1)), F.ltrim(F.substring(text, stop + len(end), F.length(text)))
    parts = lambda *xs: F.trim(F.array_join(F.filter(F.array(*xs), lambda x: x != ""), "\n\n"))
    return F.when((start > 0) & (stop >= start), parts(head, section, tail)).otherwise(parts(F.trim(text), section))


def by_prefix(asked: DataFrame, assets: DataFrame) -> DataFrame:
    """The asset (``id``: 64 hexadecimal digits) that each reference (``ref``: 8 or more of them) names: ``state`` is found, missing, ambiguous or invalid.

    References and assets meet by their first eight digits.
    """
    ref = asked.select("ref", F.lower(F.trim("ref")).alias("p")).withColumn("ok", F.col("p").rlike("^[a-f0-9]{8,64}$")).withColumn("h", F.when(F.col("ok"), F.substring("p", 1, 8)))
    known = assets.select("id", F.substring("id", 1, 8).alias("h"))
    hit = F.when(F.col("id").startswith(F.col("p")), F.col("id"))
    out = ref.join(known, "h", "left").groupBy("ref", "ok").agg(F.count(hit).alias("n"), F.min(hit).alias("id"))
    state = F.when(~F.col("ok"), "invalid").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return out.select("ref", state.alias("state"), F.when(F.col("n") == 1, F.col("id")).alias("id"))


def merged_nodes(nodes: DataFrame, refs: int = 8, files: int = 6) -> DataFrame:
    """Nodes (``id, seq, kind, bytes, source_ref, file``) by identifier: the newest kind and size, the last ``refs`` distinct references, the first ``files`` files."""
    newest = nodes.groupBy("id").agg(F.max_by(F.struct("kind", "bytes"), "seq").alias("x"), F.count(F.lit(1)).alias("seen"))
    first = lambda c: nodes.where(F.col(c).isNotNull()).groupBy("id", c).agg(F.min("seq").alias("s"))
    last = Window.partitionBy("id").orderBy(F.desc("s"), F.desc("source_ref"))
    early = Window.partitionBy("id").orderBy("s", "file")
    listed = lambda rows, c, w, most: rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", c))).alias("l"))
    a, b = listed(first("source_ref"), "source_ref", last, refs), listed(first("file"), "file", early, files)
    empty = F.array().cast("array<string>")
    out = newest.join(a.select("id", F.col("l.source_ref").alias("source_refs")), "id", "left").join(b.select("id", F.col("l.file").alias("files")), "id", "left")
    return out.select("id", "x.kind", "x.bytes", "seen", F.coalesce("source_refs", empty).alias("source_refs"), F.coalesce("files", empty).alias("files"))


def evidence(packages: DataFrame) -> DataFrame:
    """What package files (``id, json``) tell: ``framework, database, state, build_tool, deploy_scripts``."""
    maps = "struct<dependencies:map<string,string>,devDependencies:map<string,string>,scripts:map<string,string>>"
    none = F.create_map().cast("map<string,string>")
    m = packages.select("id", F.from_json("json", maps).alias("m"))
    keys = F.array_union(F.map_keys(F.coalesce("m.dependencies", none)), F.map_keys(F.coalesce("m.devDependencies", none)))
    rows = m.select("id", keys.alias("keys"), F.map_keys(F.coalesce("m.scripts", none)).alias("scripts"))

    def first(rules: list[tuple[str, str]]) -> Column:
        out = None
        for key, name in rules:
            out = F.when(F.array_contains("keys", key), name) if out is None else out.when(F.array_contains("keys", key), name)
        return out

    scripts = F.transform(F.filter("scripts", lambda s: s.rlike("deploy|release|publish")), lambda s: F.concat(F.lit("npm run "), s))
    return rows.select("id", first(FRAMEWORKS).alias("framework"), first(DATABASES).alias("database"), first(STATE_LIBRARIES).alias("state"), first(BUILD_TOOLS).alias("build_tool"), scripts.alias("deploy_scripts"))


def evidence_conflict(text: Column, framework: Column, database: Column, state: Column) -> Column:
    """The first name in a memory's text that contradicts what the code uses; null if none does."""
    low, out = F.lower(text), None
    for used, names in zip((framework, database, state), RIVALS.values(), strict=True):
        for name in names:
            test = used.isNotNull() & F.contains(low, F.lit(name)) & ~F.contains(F.lower(used), F.lit(name))
            out = F.when(test, name) if out is None else out.when(test, name)
    return out


def wiki_candidate(kind: Column, class_: Column, scene: Column, content: Column) -> Column:
    """May a memory or a scene become a page: not of a session only, and with some content."""
    memory = (kind == "memory") & ~F.coalesce(class_, F.lit("")).isin("session", "transient")
    return (memory | ((kind == "scene") & (F.coalesce(scene, F.lit("")) != "session-context"))) & (F.length(F.trim(content)) >= 20)


def may_inject(age_seconds: Column, call: Column, retry: int = 60, pause: int = 6 * 3600) -> Column:
    """Is a context given again: never just after it was, else on a first call or after a long pause; always if it never was."""
    return age_seconds.isNull() | ((age_seconds >= retry) & ((call == 0) | (age_seconds >= pause)))


def found_files(texts: DataFrame, most: int = 8) -> DataFrame:
    """The last distinct file names in texts (``project, seq, text``)."""
    each = texts.select("project", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(FILE_NAME), 1)).alias("p", "text")).withColumn("place", F.struct("seq", "p"))
    return ordered_distinct(each, "project", most, latest=True).select("project", "k", "text")


def resolved_symbols(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """``asked, id, rank``: the symbol that a word names - by identifier (0), by exact name or qualified name (1), else one whose name, qualified name or file holds it, whatever the case (2).

    Of several the one whose whole name it is comes first, then by file and identifier. Words and symbols meet by the rarest three letters of
    a word (fewer, if it is shorter), so no word is tried on every symbol. ``symbols`` may have ``qualified``.
    """
    full = symbols.select("id", "name", F.col("qualified" if "qualified" in symbols.columns else "name").alias("qualified"), "file")
    words = stored(asked.select("asked").where(F.trim("asked") != "").distinct(), "asked")
    by_id = words.join(full.select(F.col("id").alias("asked"), "id"), "asked").select("asked", "id", F.lit(0).alias("rank"))
    # of symbols with the same names and file only the one with the smallest identifier can be meant
    rows = stored(full.groupBy("name", "qualified", "file").agg(F.min("id").alias("id")), "symbols")
    whole = F.lower("name") != F.lower(F.trim("asked"))
    order = F.struct(whole.alias("w"), F.col("file").alias("f"), F.col("id").alias("i"))
    named = rows.select(F.explode(F.array_distinct(F.array("name", "qualified"))).alias("asked"), "id", "name", "file")
    by_name = words.join(named, "asked").groupBy("asked").agg(F.min_by("id", order).alias("id")).withColumn("rank", F.lit(1))
    exact = stored(by_id.unionByName(by_name).groupBy("asked").agg(F.min_by("id", "rank").alias("id"), F.min("rank").alias("rank")), "exact")
    low = stored(words.join(exact, "asked", "left_anti").withColumn("low", F.lower(F.trim("asked"))), "words")
    grams = lambda t, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))
    # a word on one line lies in the names or in the file; of a file that holds it only the first symbol can be meant, as one with that very name is met by its name
    names = rows.withColumn("text", F.lower(F.concat_ws("\n", F.when(F.contains(F.lower("qualified"), F.lower("name")), F.lit(None)).otherwise(F.col("name")), "qualified")))
    files = rows.groupBy("file").agg(F.min_by(F.struct("id", "name"), "id").alias("x")).select("x.id", "x.name", "file", F.lower("file").alias("text"))
    line, lines = low.where(~F.contains("low", F.lit("\n"))), low.where(F.contains("low", F.lit("\n")))
    found = None
    for own, held in ((line, names), (line, files), (lines, rows.withColumn("text", F.lower(F.concat_ws("\n", "name", "qualified", "file"))))):
        for n in (1, 2, 3):
            some = own.where(F.length("low") >= 3) if n == 3 else own.where(F.length("low") == n)
            if some.isEmpty():
                continue
            asks = some.select("asked", "low", F.explode(grams(F.col("low"), n)).alias("gram"))
            # only what words ask for is written
            parts = stored(held.select("id", F.explode(grams(F.col("text"), n)).alias("gram")).join(asks.select("gram").distinct(), "gram", "left_semi"), "grams")
            counts = parts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
            rare = asks.join(counts, "gram", "left").groupBy("asked", "low").agg(F.min_by("gram", F.coalesce("n", F.lit(0))).alias("gram"))
            hits = rare.join(parts, "gram").join(held, "id").where(F.contains(F.col("text"), F.col("low"))).select("asked", "id", "name", "file")
            found = hits if found is None else found.unionByName(hits)
    if found is None:
        return exact
    return exact.unionByName(found.groupBy("asked").agg(F.min_by("id", order).alias("id")).withColumn("rank", F.lit(2)))


def handoff(items: DataFrame, current: DataFrame, actions: DataFrame, tests: DataFrame, most: int = 30) -> DataFrame:
    """By project what the next agent gets: ``task, completed, remaining, next_action, tests, digest``.

    Lists hold distinct titles in order; an action that is a completed title is none. The digest covers the state alone, not who
    captured it or when, so equal states have equal digests.
    """
    place = F.struct(F.coalesce("ord", F.lit(1 << 40)).alias("o"), F.col("key").alias("k"))
    titled = items.select("project", "key", "status", F.col("title").alias("text"), place.alias("place"))

    def listed(rows: DataFrame, name: str) -> DataFrame:
        x = ordered_distinct(rows.select("project", "text", "place"), "project", most)
        return x.groupBy("project").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda r: r["text"]).alias(name))

    done = listed(titled.where("status = 'completed'"), "completed")
    rest = listed(titled.where("status NOT IN ('completed', 'cancelled')"), "remaining")
    closed = titled.where("status = 'completed'").select("project", distinct_key(F.col("text")).alias("key")).distinct()
    open_ = actions.withColumn("key", distinct_key(F.col("text"))).join(closed, ["project", "key"], "left_anti")
    first = open_.groupBy("project").agg(F.min_by("text", "place").alias("next_action"))
    task = current.join(titled.select("project", "key", F.col("text").alias("task")), ["project", "key"]).select("project", "task")
    none = F.array().cast("array<string>")
    out = items.select("project").distinct()
    for part in (task, done, rest, first, tests.select("project", F.col("status").alias("tests"))):
        out = out.join(part, "project", "left")
    out = out.withColumn("completed", F.coalesce("completed", none)).withColumn("remaining", F.coalesce("remaining", none)).withColumn("tests", F.coalesce("tests", F.lit("unknown")))
    text = F.concat_ws("\n", F.coalesce("task", F.lit("-")), F.array_join("completed", "|"), F.array_join("remaining", "|"), F.coalesce("next_action", F.lit("-")), "tests")
    return out.withColumn("digest", F.sha2(text, 256))


def found_lines(texts: DataFrame, pattern: str, most: int, longest: int = 300) -> DataFrame:
    """The last distinct lines of texts (``project, seq, text``) that meet a pattern, cut to ``longest`` characters, the newest first."""
    each = texts.select("project", "seq", F.posexplode(F.split("text", r"\n+")).alias("p", "line")).withColumn("text", squeeze(F.col("line"))).where(F.length("text").between(4, 500) & F.col("text").rlike(pattern))
    cut = F.when(F.length("text") > longest, F.concat(F.substring("text", 1, longest), F.lit("…"))).otherwise(F.col("text"))
    return ordered_distinct(each.select("project", F.struct("seq", "p").alias("place"), cut.alias("text")), "project", most, latest=True).select("project", "k", "text")


def latest_texts(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """By project and type the last text that isn't blank, cut to the type's limit."""
    text = squeeze(F.col("text"))
    last = events.where(F.col("type").isin(list(limits)) & (text != "")).groupBy("project", "type").agg(F.max_by(text, "seq").alias("text"))
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]), F.col("type"))
    return last.select("project", "type", F.when(F.length("text") > limit, F.concat(F.substring(F.col("text"), F.lit(1), limit), F.lit("…"))).otherwise(F.col("text")).alias("text"))
