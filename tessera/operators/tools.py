"""What tool events tell: files touched, commands run, checks and how they ended.

The data of an event is JSON of any shape; its leaves are listed once, and all else is column expressions over them.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from tessera.functions import classify as C

# Keys (letters and digits only) by what they hold.
COMMAND_KEYS, ARGUMENT_KEYS = ["command", "cmd", "script"], ["arguments", "args"]
FILE_KEYS, PATCH_KEYS = ["filepath", "filename", "file", "path", "target"], ["patch", "diff", "arguments", "input"]
STATUS_KEYS, EXIT_KEYS = ["status", "state", "result", "output", "outputsummary", "message", "text"], ["exitcode", "code"]
PATCH_HEADS = [("modified", "Update"), ("created", "Add"), ("deleted", "Delete")]
# Keys that tell of success, and the words that stand for yes and no.
PASS_KEYS, NUMBER_KEYS, WORD_KEYS = ["passed", "pass", "success", "succeeded", "ok"], ["exitCode", "exit_code", "code", "statusCode"], ["status", "result", "outcome"]
YES, NO = ["true", "yes", "pass", "passed", "success", "succeeded", "ok"], ["false", "no", "fail", "failed", "error"]
#: Levels of nesting and entries of an array that are looked at.
DEEPEST, WIDEST = 8, 50
LEAVES = ArrayType(StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("number", BooleanType()), StructField("parent", StringType()), StructField("inner", BooleanType())]))


@F.pandas_udf(LEAVES)
def leaves(data: pd.Series) -> pd.Series:
    """Strings and numbers of JSON in order, with their key, their object's ``type``, and whether they come from JSON inside a string of arguments."""

    def walk(x, inner, depth, out):
        if depth > DEEPEST:
            return
        if isinstance(x, list):
            for v in x[:WIDEST]:
                walk(v, inner, depth + 1, out)
        elif isinstance(x, dict):
            kind = x["type"].lower() if isinstance(x.get("type"), str) else ""
            for k, v in x.items():
                key = re.sub("[^a-z0-9]", "", k.lower())
                if isinstance(v, str) or (isinstance(v, (int, float)) and not isinstance(v, bool)):
                    out.append((key, v if isinstance(v, str) else json.dumps(v), not isinstance(v, str), kind, inner))
                if not inner and key in ARGUMENT_KEYS and isinstance(v, str) and v.strip().startswith("{"):
                    walk(_parsed(v.strip()), True, 0, out)
                walk(v, inner, depth + 1, out)

    def one(t):
        out = []
        walk(_parsed(t), False, 0, out)
        return out

    return data.map(one)


def _parsed(text):
    try:
        return None if text is None else json.loads(text)
    except ValueError:
        return None


def strings(all_: Column, keys: list[str], inner: bool | None = False) -> Column:
    """Trimmed strings under some keys."""
    fits = lambda x: x["key"].isin(keys) & ~x["number"] & (F.trim(x["value"]) != "") & (F.lit(True) if inner is None else (x["inner"] == inner))
    return F.transform(F.filter(all_, fits), lambda x: F.trim(x["value"]))


def tool_name(data: Column, all_: Column) -> Column:
    top = [F.nullif(F.trim(F.get_json_object(data, f"$.{k}")), F.lit("")) for k in ("tool", "toolName", "tool_name")]
    named = lambda x: x["key"].isin("tool", "toolname") | ((x["key"] == "name") & x["parent"].rlike("tool|function|command"))
    deep = F.try_element_at(F.filter(all_, lambda x: named(x) & ~x["number"] & ~x["inner"] & (F.trim(x["value"]) != "")), F.lit(1))["value"]
    return F.lower(F.trim(F.coalesce(*top, deep, F.lit(""))))


def commands(all_: Column) -> Column:
    """Commands of the event, then those inside its arguments."""
    return F.array_distinct(F.concat(strings(all_, COMMAND_KEYS), strings(all_, COMMAND_KEYS, True)))


def file_paths(all_: Column) -> Column:
    return F.array_distinct(F.filter(strings(all_, FILE_KEYS), lambda v: (F.length(v) < 1000) & ~F.contains(v, F.lit("\n"))))


def patch_files(patch: Column, kind: str) -> Column:
    """Files under ``Update``, ``Add`` or ``Delete`` heads of a patch."""
    return F.filter(F.transform(F.regexp_extract_all(patch, F.lit(rf"(?im)^\*\*\* {kind} File:\s*(.+)$"), 1), F.trim), lambda f: f != "")


def file_action(type_: Column, name: Column) -> Column:
    return (
        F.when(type_.isin("file_edit", "file_write"), "modified").when(name.rlike(r"\b(delete|remove|unlink)\b"), "deleted").when(name.rlike(r"\b(create|add[_-]?file|new[_-]?file)\b"), "created")
        .when(name.rlike(r"\b(edit|write|patch|apply[_-]?patch|replace|update[_-]?file)\b"), "modified")
    )


def exit_code(all_: Column) -> Column:
    """The first number under a key of exit codes, written as number or as text."""
    value = lambda x: F.when(F.trim(x["value"]) == "", F.lit(0.0)).otherwise(x["value"].try_cast("double"))
    return F.try_element_at(F.filter(F.transform(F.filter(all_, lambda x: x["key"].isin(EXIT_KEYS) & ~x["inner"]), value), lambda v: v.isNotNull()), F.lit(1))


def signals(events: DataFrame) -> DataFrame:
    """``id, kind, text, action, check_kind, check_status, confidence`` of tool events (``id, type, data``), each signal once."""
    rows = events.select("id", "type", "data", leaves("data").alias("all"))
    # bound once, so that what is used several times is worked out once
    rows = rows.select("id", "type", "all", tool_name(F.col("data"), F.col("all")).alias("name"), commands(F.col("all")).alias("commands"), exit_code(F.col("all")).alias("code"), F.array_join(strings(F.col("all"), STATUS_KEYS), "\n").alias("words"))
    nothing = F.lit(None).cast("string")

    def signal(kind, text, action=nothing, check=nothing, status=nothing, sure=F.lit(0.98)):
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), action.alias("action"), check.alias("check_kind"), status.alias("check_status"), sure.alias("confidence"))

    action = file_action(F.col("type"), F.col("name"))
    sure = F.when(F.col("type").isin("file_edit", "file_write"), F.lit(1.0)).otherwise(F.lit(0.96))
    files = F.when(action.isNotNull(), F.transform(file_paths(F.col("all")), lambda f: signal("file", f, action, sure=sure))).otherwise(F.array())

    def patched(made: str, head: str) -> Column:
        named = F.flatten(F.transform(strings(F.col("all"), PATCH_KEYS), lambda p: patch_files(p, head)))
        return F.transform(named, lambda f: signal("file", f, F.lit(made), sure=F.lit(0.99)))

    patches = [patched(made, head) for made, head in PATCH_HEADS]
    run = F.transform("commands", lambda c: signal("command", c))
    checks = F.transform(F.filter("commands", lambda c: C.check_kind(c).isNotNull()), lambda c: signal("test", c, check=C.check_kind(c), status=C.check_status(F.col("code"), F.col("words"))))
    each = rows.select("id", F.posexplode(F.concat(files, *patches, run, checks)).alias("pos", "s")).select("id", "pos", "s.*")
    first = each.groupBy("id", "kind", "text", "action", "check_kind", "check_status").agg(F.min_by("confidence", "pos").alias("confidence"))
    return first


def edited_files(tool: Column, all_: Column) -> Column:
    """Files that a changing tool names, by its keys or in a patch; none for other tools."""
    changes = F.lower(tool).rlike(r"(^|[_-])(write|edit|patch|replace|multiedit|create|delete|remove|rename|move)([_-]|$)")
    clean = lambda v: F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""), "^a/", ""), "^b/", ""), F.lit("\\"), F.lit("/"))
    keys = ["path", "filepath", "filename", "file", "target", "targetpath", "sourcepath"]
    named = F.transform(F.filter(all_, lambda x: x["key"].isin(keys) & ~x["number"] & (F.length(x["value"]) < 500) & x["value"].rlike(r"(^|/)[^/\n]+\.[A-Za-z0-9]+$") & ~F.contains(x["value"], F.lit("\n"))), lambda x: clean(x["value"]))
    heads = [r"(?m)^\*\*\* (?:Update|Add|Delete) File:\s*(.+)$", r"(?m)^\+\+\+\s+b/(.+)$", r"(?m)^---\s+a/(.+)$"]
    marks = r"\*\*\* (Update|Add|Delete) File:|\+\+\+ b/"
    patched = F.flatten(F.transform(F.filter(all_, lambda x: ~x["number"] & ~x["inner"] & x["value"].rlike(marks)), lambda x: F.concat(*[F.transform(F.regexp_extract_all(x["value"], F.lit(h), 1), clean) for h in heads])))
    return F.when(changes, F.array_distinct(F.concat(named, patched))).otherwise(F.array().cast("array<string>"))


def _first(data: Column, keys: list[str], of) -> Column:
    return F.coalesce(*[of(F.get_json_object(data, f"$.{k}")) for k in keys])


def outcome(type_: Column, data: Column) -> Column:
    """``failed``, ``succeeded`` or null, by the event's own keys: yes or no, then exit code, then words; an observed commit or deploy succeeded."""
    said = _first(data, PASS_KEYS, lambda v: F.when(F.lower(F.trim(v)).isin(YES), True).when(F.lower(F.trim(v)).isin(NO), False))
    code = _first(data, NUMBER_KEYS, lambda v: F.when(F.trim(v) != "", v.try_cast("double")))
    words = F.lower(_first(data, WORD_KEYS, lambda v: F.nullif(F.trim(v), F.lit(""))))
    failed = ~F.coalesce(said, F.lit(True)) | F.coalesce(code != 0, F.lit(False)) | F.coalesce(words.rlike(r"\b(fail(?:ed)?|error|broken|cancelled)\b"), F.lit(False))
    good = F.coalesce(said, F.lit(False)) | F.coalesce(code == 0, F.lit(False)) | F.coalesce(words.rlike(r"\b(pass(?:ed)?|success(?:ful)?|succeeded|ok|green|complete(?:d)?)\b"), F.lit(False)) | type_.isin("commit", "deploy")
    return F.when(failed, "failed").when(good, "succeeded")
