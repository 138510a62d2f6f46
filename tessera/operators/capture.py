"""Events as they come in: hook payloads, activities, buffers, and the sessions that are found again later."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from tessera.functions.paths import is_sensitive
from tessera.functions.text import redact_json
from tessera.operators.lineage import stored

# Keys of JSON that hold text, and keys that hold more such keys.
TEXT_KEYS = ["content", "text", "message", "prompt", "summary", "description", "reason", "title", "last_assistant_message", "lastAssistantMessage", "input_messages", "inputMessages"]
CONTAINER_KEYS = ["payload", "data", "content", "message", "messages", "parts", "summary"]
#: Levels of nesting and entries of an array that are looked at; what names a session in a file's name.
DEEPEST, WIDEST = 6, 50
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: Words of 64 bits in a table of identifiers: 32 MiB.
WORDS_MOST = 1 << 22


def hook_event(payload: Column, source: str) -> Column:
    """``type`` and ``source_event`` of a hook's JSON payload; null without a hook."""
    # payload and fields are bound once: Spark would work them out again wherever they are named
    bound = lambda value, told: F.transform(F.array(value), told)[0]
    keys = ["hook_event_name", "tool_name", "tool_input.file_path", "session_id", "tool_use_id"]

    def told(fields: Column) -> Column:
        hook, tool, file, session, use = (fields[k] for k in range(len(keys)))
        base = F.concat_ws(":", F.lit(source), F.coalesce(session, F.lit(source)), hook, F.coalesce(use, F.lit("")), F.coalesce(file, F.lit("")))
        edits = (hook == "PostToolUse") & tool.isin("Edit", "Write") & file.isNotNull()
        made = lambda kind, end: F.struct(kind.alias("type"), F.concat(base, F.lit(end)).alias("source_event"))
        return (
            F.when(hook == "SessionStart", made(F.lit("session_start"), ":start")).when(edits, made(F.when(tool == "Edit", "file_edit").otherwise("file_write"), ":file")).when(hook == "PostToolUse", made(F.lit("tool_result"), ":tool-result"))
            .when(hook == "Stop", made(F.lit("session_idle"), ":idle")).when(hook.isNotNull(), made(F.lit("custom"), ":custom"))
        )

    read = bound(payload, lambda p: F.transform(F.array(*[F.get_json_object(p, f"$.{k}") for k in keys]), lambda v: F.nullif(F.trim(v), F.lit(""))))
    return bound(read, told)


def activity_events(activities: DataFrame) -> DataFrame:
    """Activities (``id, project, type, ts, data``: JSON) as they are stored: without secrets; reads and writes of sensitive files leave none."""
    file = F.get_json_object("data", "$.filePath")
    hidden = F.col("type").isin("file_read", "file_write") & F.coalesce(is_sensitive(file), F.lit(False))
    return activities.where(~hidden).withColumn("data", redact_json("data"))


@F.pandas_udf(ArrayType(StringType()))
def deep_texts(data: pd.Series) -> pd.Series:
    """Strings of JSON under keys of text, in order."""

    def walk(x, key, depth, out):
        if depth > DEEPEST:
            return
        if isinstance(x, str):
            if key is None or key in TEXT_KEYS:
                out.append(x)
        elif isinstance(x, list):
            for v in x[:WIDEST]:
                walk(v, key, depth + 1, out)
        elif isinstance(x, dict):
            for k, v in x.items():
                if k in TEXT_KEYS or k in CONTAINER_KEYS:
                    walk(v, k, depth + 1, out)

    def one(t):
        out = []
        try:
            walk(None if t is None else json.loads(t), None, 0, out)
        except ValueError:
            pass
        return out

    return data.map(one)


def flushes(events: DataFrame, most: int = 100, by: str = "session") -> DataFrame:
    """Adds ``flush``: the number of the write that an event goes out with. A buffer is written when it has ``most`` events, and when a session ends."""
    w = Window.partitionBy(by).orderBy("seq")
    ended = F.coalesce(F.sum((F.col("type") == "session_end").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = events.withColumn("__part", ended)
    rows = rows.withColumn("__full", F.floor((F.row_number().over(Window.partitionBy(by, "__part").orderBy("seq")) - 1) / most))
    return rows.withColumn("flush", F.dense_rank().over(Window.partitionBy(by).orderBy("__part", "__full")) - 1).drop("__part", "__full")


def _ancestors(path: Column) -> Column:
    """A path and all folders above it."""
    parts = F.split(path, "/")
    return F.filter(F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/")), lambda p: p != "")


def recovered(conversations: DataFrame, projects: DataFrame, most: int = 10) -> DataFrame:
    """By project (``project, root``) its last conversations (``id, workspaces, last_input``): those with a workspace that is its root, above or below it.

    Roots and workspaces meet by their ancestors, so no pair is tried in vain; what does not belong is gone before the limit counts.
    """
    spaces = conversations.select("id", "last_input", F.explode("workspaces").alias("path"))
    below = spaces.withColumn("root", F.explode(_ancestors(F.col("path")))).join(projects, "root").select("project", "id", "last_input")
    above = projects.select("project", F.explode(_ancestors(F.col("root"))).alias("path")).join(spaces, "path").select("project", "id", "last_input")
    k = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("last_input"), "id"))
    return below.union(above).distinct().withColumn("place", k).where(F.col("place") <= most)


def discovered(asked: DataFrame, files: DataFrame) -> DataFrame:
    """The newest file (``path, modified, meta_id``) of each session (``id``): by the identifier in its name, else by the one its first row tells."""
    named = files.select(F.explode(F.regexp_extract_all(F.regexp_extract("path", "([^/]*)$", 1), F.lit(UUID), 0)).alias("id"), "path", "modified")
    by = lambda rows, rank: asked.join(rows, "id").select("id", "path", "modified", F.lit(rank).alias("rank"))
    both = by(named, 0).unionByName(by(files.where("meta_id IS NOT NULL").select(F.col("meta_id").alias("id"), "path", "modified"), 1))
    best = both.groupBy("id").agg(F.min_by(F.struct("path", "rank"), F.struct("rank", (-F.unix_micros(F.col("modified").cast("timestamp"))).alias("m"), "path")).alias("x"))
    return best.select("id", "x.path", "x.rank")


def id_bits(ids: DataFrame) -> tuple[DataFrame, int]:
    """A table of bits of ``ids`` (column ``id``) in rows of 64 words (``bucket, words``), and its number of words: at least 8 bits for each up to ``WORDS_MOST``, beyond that fewer."""
    size = min(WORDS_MOST, max(64, 1 << max(0, ids.count() // 8 - 1).bit_length()))
    h = F.xxhash64(F.col("id").cast("string"))
    words = ids.where("id IS NOT NULL").groupBy(F.pmod(F.shiftrightunsigned(h, 6), F.lit(size)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    rows = words.groupBy(F.shiftrightunsigned("word", 6).alias("bucket")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("word") % 64).cast("int").alias("at"), "bits"))).alias("m"))
    return stored(rows.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("words")), "bits"), size


def perhaps(rows: DataFrame, column: str, bits: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` without most of those whose ``column`` is none of the identifiers of ``bits``; none whose is goes. It keeps what an exact join drops out of its shuffle."""
    table, size = bits
    h = F.xxhash64(F.col(column).cast("string"))
    word = F.pmod(F.shiftrightunsigned(h, 6), F.lit(size))
    here = (F.shiftrightunsigned(word, 6) == F.col("__bucket")) & (F.getbit(F.get("__words", (word % 64).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1)
    # a semi join: through an inner one Spark would push the exact join that follows, and shuffle all rows
    return rows.join(F.broadcast(table.toDF("__bucket", "__words")), here, "left_semi")


def incremental_index(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``files`` (path, status), ``vertices`` and ``edges`` after a change; either side has ``manifest`` (path, hash), ``vertices`` and ``edges``.

    Vertices of unchanged files stay and those of added and modified ones come from the new side; old edges stay if both ends do and
    neither lies in a changed file. The status of files and the vertices of either kind are written once, for all that looks at them. Edges
    that belong to neither are mostly told by bits of the identifiers before they are moved; the joins after that are exact. Where no
    identifier is on both sides no edge is either, and each side's edges are made distinct where they lie.
    """
    from tessera.operators.governance import surviving_edges
    from tessera.operators.graph import manifest_diff

    files = stored(manifest_diff(old["manifest"], new["manifest"]), "files")
    changed = files.where("status IN ('added', 'modified')").select(F.col("path").alias("file"))
    kept = stored(old["vertices"].join(files.where("status = 'unchanged'").select(F.col("path").alias("file")), "file", "left_semi"), "vertices")
    fresh = stored(new["vertices"].join(changed, "file", "left_semi"), "vertices")
    of_kept, of_fresh = id_bits(kept.select("id")), id_bits(fresh.select("id"))
    own = perhaps(new["edges"], "src", of_fresh).join(fresh.select(F.col("id").alias("src")), "src", "left_semi").select(*old["edges"].columns)
    stay = surviving_edges(perhaps(perhaps(old["edges"], "src", of_kept), "dst", of_kept), kept, changed).select(*old["edges"].columns)
    twice = perhaps(kept.select("id"), "id", of_fresh).join(perhaps(fresh.select("id"), "id", of_kept), "id", "left_semi")
    edges = stay.distinct().unionByName(own.distinct()) if twice.isEmpty() else stay.unionByName(own).distinct()
    return {"files": files, "vertices": kept.unionByName(fresh), "edges": edges}
