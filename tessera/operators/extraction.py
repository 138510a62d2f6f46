"""Observations from event text, section scopes, rules of a profile, budgets of a context, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import classify as C
from tessera.functions.text import squeeze

# The lines that tell of something, with how sure they are.
LINE_RULES = [
    ("goal", r"(?i)^(?:mục tiêu|goal|objective)\s*(?::|-)\s*(.+)$", 0.97), ("plan", r"(?i)^(?:kế hoạch|plan)\s*(?::|-)\s*(.+)$", 0.95), ("todo", r"(?i)^[-*]\s*\[[ xX]\]\s*(.+)$", 0.96), ("next_action", r"(?i)^(?:next|next action|next step|tiếp theo|bước tiếp theo)\s*(?::|-)\s*(.+)$", 0.93),
    ("blocker", r"(?i)^(?:blocker|blocked|vướng)\s*(?::|-)\s*(.+)$", 0.90), ("warning", r"(?i)^(?:warning|cảnh báo)\s*(?::|-)\s*(.+)$", 0.90), ("decision", r"(?i)^(?:decision|quyết định)\s*(?::|-)\s*(.+)$", 0.88), ("activity", r"(?i)^(?:working on|đang làm)\s*(?::|-)?\s*(.+)$", 0.86),
]
PHASE = r"(?i)\b(?:phase|giai đoạn|giai doan|stage)\s*(\d+)"


def line_observations(events: DataFrame) -> DataFrame:
    """``id, pos, kind, text, status, confidence`` of the lines of events (``id, text``): one row for each rule that a line meets."""
    # squeezed before lines are rows: behind the filter it would be worked out for each of its bounds and again
    lines = events.select("id", F.posexplode(F.transform(F.split("text", "\n"), squeeze)).alias("pos", "line")).where(F.length("line").between(5, 1200))
    found = [F.when(F.col("line").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("text"), F.lit(c).alias("confidence"))) for k, p, c in LINE_RULES]
    advice = F.col("line").rlike(r"(?i)^(?:next|next action|next step|tiếp theo|bước tiếp theo|cần làm tiếp)\b")
    low = F.lower("line")
    phase = F.when((F.contains(low, F.lit("phase")) | F.contains(low, F.lit("giai")) | F.contains(low, F.lit("stage"))) & F.col("line").rlike(PHASE) & ~advice, F.struct(F.lit("phase").alias("kind"), F.concat(F.lit("Phase "), F.regexp_extract("line", PHASE, 1)).alias("text"), F.lit(0.93).alias("confidence")))
    each = lines.select("id", "pos", "line", F.explode(F.filter(F.array(*found, phase), lambda x: x.isNotNull())).alias("o"))
    done = F.col("line").rlike(r"^[-*]\s*\[[xX]\]")
    return each.select("id", "pos", "o.kind", "o.text", F.when(F.col("o.kind") == "todo", F.when(done, "completed").otherwise("pending")).otherwise(C.status_of(F.col("line"))).alias("status"), "o.confidence")


def scoped_lines(texts: DataFrame, heading: str = r"^#+\s+(.*)$") -> DataFrame:
    """Lines (``id, pos, line``) with the heading above them: the last heading's text, carried forward within each text."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    own = F.when(F.col("line").rlike(heading), F.regexp_extract("line", heading, 1))
    over = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(own, ignorenulls=True).over(over)).where(~F.col("line").rlike(heading))


# Labels of fields in order, with the kind they tell and how sure it is. ``@`` kinds depend on the scope, ``*`` ones hold for the whole project.
FIELDS = [
    ("*mission", 0.99, ["mission", "sứ mệnh", "mục tiêu tổng thể", "mục tiêu project", "project goal"]),
    ("@objective", 0.98, ["current objective", "active objective", "mục tiêu hiện tại", "objective", "mục tiêu", "mục đích"]),
    ("@why", 0.98, ["why", "why this", "why this phase", "reason", "rationale", "vì sao", "lý do", "tại sao", "ý nghĩa"]),
    ("*desired_outcome", 0.98, ["desired outcome", "final outcome", "kết quả cuối", "kết quả mong muốn", "mục tiêu cuối"]),
    ("*plan_rationale", 0.98, ["plan rationale", "approach rationale", "why this approach", "tại sao chọn hướng này", "lý do chọn hướng này", "lý do chọn kiến trúc"]),
    ("phase_deliverable", 0.97, ["deliverable", "output", "kết quả cần đạt", "phải tạo ra", "đầu ra"]),
    ("acceptance_criterion", 0.98, ["acceptance criteria", "definition of done", "done khi", "hoàn thành khi", "tiêu chí hoàn thành"]),
    ("dependency", 0.97, ["depends on", "dependency", "dependencies", "phụ thuộc", "cần có trước"]),
    ("open_question", 0.95, ["open question", "open questions", "câu hỏi mở", "chưa quyết định", "chưa rõ"]),
    ("constraint", 0.97, ["constraint", "constraints", "ràng buộc", "giới hạn"]),
]
LISTS = [
    ("acceptance_criterion", "acceptance criteria|definition of done|done khi|tiêu chí hoàn thành"), ("dependency", "dependencies|dependency|phụ thuộc"), ("open_question", "open questions|open question|câu hỏi mở"), ("constraint", "constraints|constraint|ràng buộc"),
]
PHASE_HEAD = r"(?iu)^(?:phase|giai đoạn|giai doan|stage)\s*(\d+)\s*(?:[:\-–—]\s*)?(.*)$"
TASK_HEAD = r"(?iu)^(?:todo|task|việc)\s*(\d+)\s*(?:[:\-–—]\s*)?(.*)$"


def semantic_lines(texts: DataFrame) -> DataFrame:
    """``project, id, block, pos, kind, value, scope, scope_key, scope_order, confidence`` of labelled lines and lists in texts (``project, id, block, text``).

    A heading of a phase or task is the scope of what follows in its block. A label with a list (and a heading of one) opens it; items belong to it until
    a line that is none. What a line is does not depend on others, so the scope is the last heading and the open list is told by the last line that is no item:
    both are windows over the lines of a block. Equal observations of an event count once.
    """
    rows = texts.select("project", "id", "block", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("pos", "raw")).withColumn("line", squeeze(F.col("raw"))).withColumn("low", F.lower("line"))
    field = F.lit(None).cast("struct<kind:string,value:string,confidence:double,list:string>")
    for kind, sure, labels in reversed(FIELDS):
        value = F.lit("")
        for label in reversed(labels):
            starts = F.col("low").startswith(f"{label}:") | F.col("low").startswith(f"{label} -") | F.col("low").startswith(f"{label} —")
            value = F.when(starts, squeeze(F.substring("line", len(label) + 2, 1 << 30))).otherwise(value)
        opened = kind if kind in dict(LISTS) else None
        field = F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(sure).alias("confidence"), F.lit(opened).cast("string").alias("list"))).otherwise(field)
    phase, task = F.col("line").rlike(PHASE_HEAD), F.col("line").rlike(TASK_HEAD)
    head = F.when(phase, F.struct(F.lit("phase").alias("scope"), F.regexp_extract("line", PHASE_HEAD, 1).cast("long").alias("order"))).when(task, F.struct(F.lit("task").alias("scope"), F.regexp_extract("line", TASK_HEAD, 1).cast("long").alias("order")))
    heading = F.lit(None).cast("string")
    for kind, names in reversed(LISTS):
        heading = F.when(F.col("line").rlike(rf"(?iu)^(?:{names})\s*:?\s*$"), kind).otherwise(heading)
    start = F.ltrim("raw")
    item = start.startswith("- ") | start.startswith("* ") | start.rlike(r"^\d+[.)]\s+")
    rows = rows.withColumn("head", head).withColumn("field", F.when(F.col("head").isNull(), F.transform(F.array(F.lit(0)), lambda _: field)[0]))
    rows = rows.withColumn("list", F.when(F.col("head").isNull() & F.col("field").isNull(), heading)).withColumn("item", item & F.col("head").isNull() & F.col("field").isNull() & F.col("list").isNull() & (F.col("line") != ""))
    block = Window.partitionBy("project", "id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mode = F.last(F.when(~F.col("item"), F.struct(F.coalesce("list", "field.list").alias("mode"))), ignorenulls=True).over(block)
    rows = rows.withColumn("scope", F.last("head", ignorenulls=True).over(block)).withColumn("open", mode["mode"])
    bullet = squeeze(F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^[-*]\s+", ""), r"^\d+[.)]\s+", ""))
    told = F.when(F.col("field").isNotNull(), F.struct("field.kind", "field.value", "field.confidence")).when(F.col("item") & F.col("open").isNotNull(), F.struct(F.col("open").alias("kind"), bullet.alias("value"), F.lit(0.96).alias("confidence")))
    rows = rows.withColumn("o", told).where(F.length("o.value") >= 3)
    whole = F.col("o.kind").startswith("*")
    scope = F.when(whole, "project").otherwise(F.coalesce("scope.scope", F.lit("project")))
    of_phase = F.substring("o.kind", 2, 100)
    kind = F.when(whole, of_phase).when(F.col("o.kind").startswith("@"), F.when(scope == "phase", F.concat(F.lit("phase_"), of_phase)).otherwise(of_phase)).otherwise(F.col("o.kind"))
    out = rows.select("project", "id", "block", "pos", kind.alias("kind"), F.col("o.value").alias("value"), scope.alias("scope"), F.when(scope != "project", F.concat_ws(":", "scope.scope", "scope.order")).alias("scope_key"), F.when(scope != "project", F.col("scope.order")).alias("scope_order"), F.col("o.confidence").alias("confidence"))
    first = F.row_number().over(Window.partitionBy("project", "id", "kind", "scope", "scope_key", F.lower("value")).orderBy("block", "pos"))
    return out.withColumn("k", first).where("k = 1").drop("k")


def profile_rules(texts: DataFrame) -> DataFrame:
    """``id, pos, rule, severity``: list items of a profile that demand or forbid something."""
    items = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"^\s*[-*]\s+\S"))
    rule = F.trim(F.regexp_replace("line", r"^\s*[-*]\s+", ""))
    low = F.lower("line")
    severity = F.when(low.rlike(r"\b(never|must not|do not|forbidden)\b|không được"), "block").when(low.rlike(r"\b(must|always|required)\b|bắt buộc"), "require").when(low.rlike(r"\b(should|prefer|avoid)\b"), "warn")
    return items.select("id", "pos", rule.alias("rule"), severity.alias("severity")).where("severity IS NOT NULL")


def matched_rules(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """``rule_id, target_id``: rules (``rule_id, text, category``) that speak of a target (``target_id, text, type``: path or command).

    A rule's words and a target's words meet in a few named families, so both are reduced to the families that they have
    and joined on these; a rule of another category than the target's (security aside) is never meant.
    """
    rule, target = F.lower("text"), F.lower("text")
    has = lambda c, *ws: c.rlike("|".join(ws))
    asked = [("production", has(rule, "production")), ("source", has(rule, "source")), ("deploy", has(rule, "deploy")), ("never", has(rule, "never"))]
    path, command = F.col("type") == "path", F.col("type") == "command"
    met = [
        ("production", path & has(target, "/var/www", "production", "/public_html")), ("source", path & ~has(target, "/src", "/source")),
        ("deploy", command & has(target, "deploy")), ("never", command & has(target, "rm -rf", "chmod 777")),
    ]
    families = lambda found: F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in found]), lambda x: x.isNotNull()))
    have = targets.withColumn("family", families(met)).select("target_id", "type", "family")
    need = rules.withColumn("family", families(asked)).select("rule_id", "category", "family")
    fits = F.col("category").isNull() | (F.col("category") == F.col("type")) | (F.col("category") == "security")
    # a family has many targets and few rules: rules are gathered by family and fanned out at the end
    return have.join(need, "family").where(fits).select("rule_id", "target_id", "family")


def provenance(facts: DataFrame, events: DataFrame) -> DataFrame:
    """``fact, event``: facts (``fact, refs``) and the events (``event, source``) they name by either identifier."""
    refs = facts.select("fact", F.explode("refs").alias("ref"))
    by_id = refs.join(events.select(F.col("event").alias("ref"), "event"), "ref")
    by_source = refs.join(events.where("source IS NOT NULL").select(F.col("source").alias("ref"), "event"), "ref")
    return by_id.select("fact", "event").union(by_source.select("fact", "event")).distinct()


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 3.5)


def cut_to_tokens(text: Column, tokens: Column) -> Column:
    """At most so many tokens of a text, up to its last full stop or end of line if that is in the last three tenths."""
    chars = F.floor(tokens * 3.5)
    head = F.substring(text, F.lit(1), chars.cast("int"))
    back = F.least(*[F.nullif(F.locate(c, F.reverse(head)), F.lit(0)) for c in (".", "\n")])
    ends = chars - back + 1  # characters up to and with the sign
    # whole numbers: 0.7 of 350 characters is less than 245 as a double
    return F.when(estimated_tokens(text) <= tokens, text).when((ends - 1) * 10 > chars * 7, F.substring(head, F.lit(1), ends.cast("int"))).otherwise(head)


def section_budget(sections: DataFrame, budget: int, group: str = "query_id") -> DataFrame:
    """Sections (``priority, title, content``), the highest priority first: whole while they fit, the first that doesn't cut if over 50 tokens are left for it, then none.

    ``place``, ``given`` (tokens), ``cut`` and ``text`` of the sections that are shown. All before the first that doesn't fit are whole, so running
    sums find it, and nothing of a group is gathered.
    """
    head = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))
    own = estimated_tokens(head) + estimated_tokens(F.col("content"))
    order = Window.partitionBy(group).orderBy(F.desc("priority"), "title", F.coalesce("content", F.lit("")))  # equal titles come in the order of their contents
    rows = sections.withColumn("own", own).withColumn("used", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("over", F.sum((F.col("used") > budget).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - (F.col("used") - F.col("own")) - estimated_tokens(head)
    rows = rows.withColumn("trimmed", F.sum("own").over(Window.partitionBy(group)) > budget)
    shown = rows.withColumn("left", left).where((F.col("over") == 0) | ((F.col("over") == 1) & (F.col("left") > 50)))
    cut = F.col("over") == 1
    text = F.concat(head, F.when(cut, cut_to_tokens(F.coalesce("content", F.lit("")), F.col("left"))).otherwise(F.coalesce("content", F.lit(""))))
    return shown.select(group, "priority", "place", F.when(cut, F.lit(budget) - (F.col("used") - F.col("own"))).otherwise(F.col("own")).cast("long").alias("given"), cut.alias("cut"), "trimmed", text.alias("text"))


def context(sections: DataFrame, budget: int, marker: str = "[Context trimmed by the token budget]", group: str = "query_id") -> DataFrame:
    """The text of each group's shown sections, with ``marker`` at the end where something was left out; as long as the budget allows, so it can be joined in one row."""
    parts = section_budget(sections, budget, group).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("x"), F.sum("given").alias("given"), F.bool_or("trimmed").alias("trimmed"))
    texts = F.concat(F.transform("x", lambda r: r["text"]), F.when(F.col("trimmed"), F.array(F.lit(f"\n{marker}\n"))).otherwise(F.array().cast("array<string>")))
    return parts.select(group, F.size("x").cast("long").alias("shown"), "given", "trimmed", F.array_join(texts, "\n\n---\n\n").alias("text"))


def rendered(items: DataFrame, title: Column, group: str = "project") -> DataFrame:
    """A markdown list of each group's items (``place, line``)."""
    rows = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return rows.select(group, F.concat(F.lit("## "), title, F.lit("\n"), F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["line"])), "\n")).alias("text"))


def session_summary(rows: DataFrame, most: int = 5) -> DataFrame:
    """By session the first distinct values of each kind, cut to 120 characters (``session, kind, seq, value``)."""
    first = rows.groupBy("session", "kind", F.substring(squeeze(F.col("value")), 1, 120).alias("value")).agg(F.min("seq").alias("seq"))
    k = F.row_number().over(Window.partitionBy("session", "kind").orderBy("seq"))
    top = first.withColumn("k", k).where(F.col("k") <= most)
    return top.groupBy("session", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda r: r["value"]), " | ").alias("values"), F.count(F.lit(1)).alias("n"))


def merged_streams(messages: DataFrame, parts: DataFrame, by: str = "session") -> DataFrame:
    """Messages and their parts (``session, clock, ord, kind``) in one order, with a start marker before and an idle marker after each session."""
    both = messages.unionByName(parts)
    ends = both.groupBy(by).agg(F.min("clock").alias("a"), F.max("clock").alias("b"))
    marks = ends.select(by, F.col("a").alias("clock"), F.lit(-1).cast("long").alias("ord"), F.lit("session_start").alias("kind")).unionByName(ends.select(by, F.col("b").alias("clock"), F.lit(100).cast("long").alias("ord"), F.lit("session_idle").alias("kind")))
    place = F.row_number().over(Window.partitionBy(by).orderBy("clock", "ord", "kind"))
    return both.unionByName(marks).withColumn("place", place)
