"""Memories learnt from session events: fragments, classes, fingerprints, the pipeline around them, the hierarchy's links.

Events: project, agent, session, id, source_event, seq, ts, type, role, message, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.functions.text import EDGE

# Families of words, English and Vietnamese.
RULE_CRITICAL = ["không được", "tuyệt đối", "bắt buộc", r"đừng\s+", "must not", "do not", "don't", r"\bnever\b"]
RULE_PERSISTENT = ["từ giờ", "về sau", "mỗi lần", "luôn luôn", r"\bluôn\b", "quy tắc", "workflow", r"\balways\b", r"\brequired\b", r"\bmust\b", "from now on"]
DECISION = [r"\bchốt\b", "quyết định", "sẽ dùng", "chọn .+ thay", "đổi sang", "chuyển sang", r"\bdecided\b", r"\bchosen\b", "we will use", "use .+ instead", "switch(?:ed)? to"]
TODO = [r"\btodo\b", "cần làm", "cần thêm", "cần sửa", "cần kiểm tra", "tiếp theo", "bước tiếp theo", "còn phải", "còn cần", "next step", r"\bneed to\b", r"\bremaining\b", "follow[- ]?up"]
FIX = ["đã sửa", "đã fix", "đã khắc phục", "đã xử lý", "hoàn tất", "hoàn thành", r"\bfixed\b", r"\bresolved\b", r"\bimplemented\b", r"\bcompleted\b", r"\bpasses?\b"]
ARCHITECTURE = ["kiến trúc", "pipeline", "adapter", "schema", "runtime", "namespace", "storage", "lưu trữ", "workflow", "session core", "memory engine", "retrieval"]
ARCH_ACTION = [r"\bdùng\b", r"\btách\b", r"\bthay\b", r"\bchuyển\b", r"\blưu\b", r"\bmap\b", r"\buse\b", r"\bsplit\b", r"\bstore\b", r"\breplace\b", r"\bmove\b"]
CONTEXT = ["đường dẫn", r"\bpath\b", r"\bport\b", r"\bendpoint\b", r"\bdomain\b", r"\bbucket\b", r"\brepository\b", r"\brepo\b", r"\bbranch\b", r"/[A-Za-z0-9._/-]{4,}"]
CONTEXT_ASSIGNMENT = [r"\blà\b", r"\bở\b", r"\bdùng\b", r"\bnằm\b", r"\bis\b", r"\buse\b", "located", "runs on"]
# The least confidence of a memory, the most fragments of an event, the memory type of each kind.
LEAST, FRAGMENTS = 0.75, 50
TYPE_OF = {"rule": "rule", "decision": "decision", "architecture": "decision", "todo": "todo", "fix": "code", "context": "code"}


def speaks_of(text: Column, family: list[str]) -> Column:
    return text.rlike("(?iu)" + "|".join(p.replace(r"\b", EDGE) for p in family))


def plain(text: Column) -> Column:
    """Without marks of lists and quotes in front, white space as one blank; ``nfkc`` first if texts may need it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), r"^[\s>*#\-•]+", ""), r"\s+", " "))


def useful(text: Column) -> Column:
    """Long enough, with letters, and no address or encoded data."""
    return F.length(text).between(12, 1000) & (F.regexp_count(text, F.lit(r"\p{L}")) >= 6) & ~text.rlike(r"^(?:https?://\S+|[A-Za-z0-9+/=]{80,})$")


def fragments(text: Column) -> Column:
    """Distinct useful sentences and lines, the first ``FRAGMENTS``."""
    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, r"\n+|(?<=[.!?])\s+"), plain), useful)), 1, FRAGMENTS)


def learnt_kind(text: Column, role: Column, type_: Column) -> Column:
    """``kind`` and ``confidence`` (null: nothing to learn); the first rule that holds decides."""
    user = (role == "user") | (type_ == "user_prompt")
    assistant = (role == "assistant") | (type_ == "assistant_message")
    built = speaks_of(text, ARCHITECTURE)
    out = lambda kind, sure: F.struct(F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), (F.lit(sure) if isinstance(sure, float) else sure).alias("confidence"))
    return (
        F.when(type_ == "decision", out("decision", 1.0)).when(type_ == "todo", out("todo", 1.0))
        .when(user & speaks_of(text, RULE_CRITICAL), out("rule", 0.98)).when(user & speaks_of(text, RULE_PERSISTENT), out("rule", 0.92))
        .when(speaks_of(text, DECISION), out(F.when(built, "architecture").otherwise("decision"), F.when(user, 0.93).otherwise(0.86)))
        .when(user & speaks_of(text, TODO), out("todo", 0.87))
        .when(built & speaks_of(text, ARCH_ACTION), out("architecture", F.when(user, 0.88).otherwise(0.82)))
        .when(assistant & speaks_of(text, FIX), out("fix", 0.8))
        .when(user & speaks_of(text, CONTEXT) & speaks_of(text, CONTEXT_ASSIGNMENT), out("context", 0.79))
    )


def with_roles(events: DataFrame) -> DataFrame:
    """Events without a role get the last one that their message has in the session."""
    role = F.lower(F.coalesce(F.col("role"), F.lit("")))
    named = events.where((role != "") & F.col("message").isNotNull()).groupBy("session", "message").agg(F.max_by(role, F.struct("seq", "id")).alias("__named"))
    return events.join(named, ["session", "message"], "left").withColumn("role", F.coalesce(F.nullif(role, F.lit("")), F.col("__named"), F.lit(""))).drop("__named")


def normalized(events: DataFrame) -> DataFrame:
    """Of events with one source identifier (of an agent and session), else one id, that with the largest sequence number."""
    key = F.coalesce(F.concat(F.col("agent"), F.lit(":"), F.col("source_event")), F.col("id"))
    best = events.where("id IS NOT NULL AND seq IS NOT NULL").withColumn("__key", key)
    k = F.row_number().over(Window.partitionBy("session", "__key").orderBy(F.desc("seq"), "id"))
    return best.withColumn("__k", k).where("__k = 1").drop("__key", "__k")


def learnt(events: DataFrame) -> DataFrame:
    """The memories of each session, each fingerprint where it is first met.

    ``fingerprint, project, agent, session, kind, type, content, confidence, importance, event, source_event, seq, pos, ts``.
    """
    each = with_roles(events).select("project", "agent", "session", "id", "source_event", "seq", "ts", "type", "role", F.posexplode(fragments(F.col("text"))).alias("pos", "content"))
    each = each.withColumn("found", F.transform(F.array(F.struct("content", "role", "type")), lambda x: learnt_kind(x["content"], x["role"], x["type"]))[0]).where(F.col("found.confidence") >= LEAST)
    kind = F.col("found.kind")
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain(F.col("content"))), r"[^\p{L}\p{N}:/._-]+", " "), r"\s+", " "))
    type_ = S.choose(kind, TYPE_OF)
    importance = F.when((kind == "rule") & speaks_of(F.col("content"), RULE_CRITICAL), "critical").when(kind.isin("architecture", "decision", "rule"), "high").when(kind.isin("fix", "context"), "normal").otherwise(S.score_importance(type_, F.col("content")))
    rows = each.select(
        F.sha2(F.concat_ws("|", "project", kind, key), 256).alias("fingerprint"), "project", "agent", "session", kind.alias("kind"), type_.alias("type"), "content", F.col("found.confidence").alias("confidence"),
        importance.alias("importance"), F.col("id").alias("event"), "source_event", "seq", "pos", "ts",
    )
    names = [c for c in rows.columns if c not in ("fingerprint", "session")]
    return rows.groupBy("session", "fingerprint").agg(F.min_by(F.struct(*names), F.struct("seq", "event", "pos")).alias("x")).select("fingerprint", "session", "x.*")


def enriched(memories: DataFrame) -> DataFrame:
    """Adds ``score``, ``knowledge_class``, ``terms`` and ``tags``."""
    c = S.candidate(F.col("importance"), F.col("confidence"), F.col("kind"))
    rows = memories.withColumn("score", c["score"]).withColumn("knowledge_class", c["knowledge_class"]).withColumn("terms", T.retrieval_terms(F.col("content")))
    return rows.withColumn("tags", F.array("type", F.lit("level:fact"), F.concat(F.lit("class:"), "knowledge_class"), F.concat(F.lit("kind:"), "kind")))


def pipeline(events: DataFrame) -> dict[str, DataFrame]:
    """``events`` (normalized), ``candidates`` (durable ones), ``extracted`` (all), ``stats`` by session."""
    clean = normalized(events)
    extracted = enriched(learnt(clean))
    return {"events": clean, "extracted": extracted, "candidates": extracted.where("knowledge_class <> 'transient'"), "stats": class_counts(events, clean, extracted)}


def class_counts(events: DataFrame, clean: DataFrame, extracted: DataFrame) -> DataFrame:
    """By session how many events came in and were left, how many memories were extracted and kept, and their classes."""
    came = events.groupBy("session").agg(F.count(F.lit(1)).alias("input_events"))
    left = clean.groupBy("session").agg(F.count(F.lit(1)).alias("normalized_events"))
    of = lambda c: F.count_if(F.col("knowledge_class") == c).alias(c)
    seen = extracted.groupBy("session").agg(F.count(F.lit(1)).alias("extracted"), F.count_if(F.col("knowledge_class") != "transient").alias("persisted"), *map(of, ("permanent", "task", "session", "transient")))
    seen = seen.toDF("id", *seen.columns[1:])
    out = came.toDF("id", "input_events").join(left.toDF("id", "normalized_events"), "id", "left").join(seen, "id", "left")
    return out.select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "id"])


def work_state(candidates: DataFrame) -> DataFrame:
    """By session what the candidates tell: the first distinct contents of each kind, in order of importance."""
    key = F.lower(T.squeeze(F.col("content")))
    order = F.struct((-F.col("score")).alias("s"), "seq", "event", "pos")
    first = candidates.groupBy("session", "kind", key.alias("key")).agg(F.min_by("content", order).alias("content"), F.min(order).alias("o"))
    k = F.row_number().over(Window.partitionBy("session", "kind").orderBy("o"))
    return first.withColumn("place", k).select("session", "kind", "place", F.trim(F.regexp_replace("content", r"\s+", " ")).alias("content"))


def hierarchy_links(facts: DataFrame) -> DataFrame:
    """``src, dst, type`` of raw events, facts, scenes and knowledge: supports, belongs_to, promotes_to.

    A scene is a session's facts of one group of kinds; permanent and task scenes are promoted to knowledge of the project.
    """
    scene = F.when(F.col("kind").isin("rule", "architecture"), "project-knowledge").when(F.col("kind").isin("decision", "fix"), "implementation").when(F.col("kind") == "todo", "continuation").otherwise("session-context")
    rows = facts.withColumn("fact", F.concat(F.lit("fact:"), "fingerprint")).withColumn("scene", F.concat_ws(":", F.lit("scene"), "project", scene)).withColumn("known", F.concat_ws(":", F.lit("knowledge"), "project", "knowledge_class"))
    link = lambda a, b, kind, of: of.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(kind).alias("type"))
    out = link("event", "fact", "supports", rows).unionByName(link("fact", "scene", "belongs_to", rows)).unionByName(link("scene", "known", "promotes_to", rows.where("knowledge_class IN ('permanent', 'task')")))
    return out.distinct()


def merged_checkpoint(previous: DataFrame, incoming: DataFrame, most: int = 80) -> DataFrame:
    """Facts (``session, fingerprint, score, ts, content``) of both: of one fingerprint the most important (the earlier if equal), the best ``most``."""
    both = previous.withColumn("__from", F.lit(0)).unionByName(incoming.withColumn("__from", F.lit(1)))
    best = F.row_number().over(Window.partitionBy("session", "fingerprint").orderBy(F.desc("score"), "__from", "ts"))
    k = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), F.desc("ts"), "fingerprint"))
    return both.withColumn("__b", best).where("__b = 1").withColumn("place", k).where(F.col("place") <= most).drop("__from", "__b")


def activity_memory(type_: Column, data: Column) -> Column:
    """The memory of an activity (JSON ``data``): ``type``, ``content``, ``tags``; null for activities that leave none."""
    at = lambda key, default="": F.coalesce(F.get_json_object(data, f"$.{key}"), F.lit(default))
    made = lambda kind, content, *tags: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.array(*map(F.lit, tags)).alias("tags"))
    return (
        F.when(type_ == "decision", made("decision", at("content", "Decision recorded"), "decision")).when(type_ == "todo", made("todo", at("content", "TODO recorded"), "todo"))
        .when(type_ == "error", made("activity", F.concat(F.lit("Error: "), at("message")), "error")).when(type_ == "file_write", made("activity", F.concat(F.lit("Modified file: "), at("filePath")), "file", "write"))
        .when(type_ == "command", made("activity", F.concat(F.lit("Command: "), at("command")), "command"))
    )
