"""What a transcript keeps: noise, durable lines, secrets in running text, private reasoning."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import trimmed

# A trimmed line that begins like one of these is noise.
NOISE_LINES = [
    r"(?i)^<SYSTEM MESSAGE>", r"(?i)^<EPHEMERAL MESSAGE>", r"(?i)^<system>", r"(?i)^<ephemeral>",
    r"(?i)^ManageTask:", r"(?i)^Task \d+ status:", r"(?i)^Task \d+ killed", r"(?i)^Task \d+ loading", r"(?i)^Thought for \d+ tokens", r"(?i)^Prioritizing Tool Usage", r"(?i)^Tool call:", r"(?i)^Tool response:",
    r"(?i)^npm notice", r"(?i)^npm WARN", r"(?i)^added \d+ packages", r"(?i)^removed \d+ packages", r"(?i)^up to date", r"(?i)^\d+ packages are looking for funding", r"(?i)^run `npm fund` for details",
    r"^[\d.]+%", r"^\[={10,}\]", r"(?i)^Loading\.\.\.", r"(?i)^Processing\.\.\.",
    r"^bash-\d+\.\d+\$", r"^\$ ", r"^\s*$",
]
# A line with one of these words is durable.
DURABLE = [
    "decision", "decided", "rule", "convention", "architecture", "pattern", "fixed", "resolved", "implemented", "created", "updated", "deleted", "deployed", "blocker", "blocked", "issue", "bug", "error", "next", "todo", "action", "requirement", "must", "should", "important",
]
# What names a secret in running text, and what may stand between the name and the secret.
SENSITIVE = [("api[_-]?key", r"[:\s=]+"), ("token", r"[:\s=]+"), ("secret", r"[:\s=]+"), ("password", r"[:\s=]+"), ("bearer", r"\s+"), ("authorization", r":\s*")]
# Lines with one of these, in any case, never reach a context.
SENSITIVE_WORDS = ["SECRET", "TOKEN", "API_KEY", "APIKEY", "PASSWORD", "PASS="]
# Keys (letters and digits only) and types of private reasoning.
REASONING_KEYS = {"thinking", "reasoning", "reasoningcontent", "chainofthought", "cot", "analysistext", "internalreasoning", "modelthinking"}
REASONING_TYPES = {"reasoning", "thinking", "chain_of_thought", "chain-of-thought", "internal_reasoning", "internal-reasoning"}
#: Levels of nesting that are kept.
DEEPEST = 12


def is_noise(line: Column) -> Column:
    return trimmed(line).rlike("|".join(f"(?:{p})" for p in NOISE_LINES))


def is_durable(line: Column) -> Column:
    """Noise is never durable, whatever words it has."""
    low = F.lower(line)
    has = F.lit(False)
    for w in DURABLE:
        has = has | F.contains(low, F.lit(w))
    return ~is_noise(line) & has


def masked(text: Column) -> Column:
    """The name of each secret, then ``: [REDACTED]``."""
    for name, between in SENSITIVE:
        text = F.regexp_replace(text, rf"(?i)({name}){between}\S+", "$1: [REDACTED]")
    return text


def kept_line(line: Column) -> Column:
    """The trimmed line without secrets; null for noise."""
    return F.when(~is_noise(line), masked(trimmed(line)))


def drops_event(type_: Column, has_result: Column, content: Column) -> Column:
    """System and ephemeral events, calls without a result, and events whose content is noise."""
    low = F.lower(F.coalesce(type_, F.lit("")))
    call = (low == "tool_call") & ~F.coalesce(has_result, F.lit(False))
    return F.contains(low, F.lit("system")) | F.contains(low, F.lit("ephemeral")) | call | (F.coalesce(F.length(content), F.lit(0)).cast("int") > 0) & is_noise(F.coalesce(content, F.lit("")))


def without_sensitive_lines(text: Column) -> Column:
    def bad(line: Column) -> Column:
        out = F.lit(False)
        for w in SENSITIVE_WORDS:
            out = out | F.contains(F.upper(line), F.lit(w))
        return out

    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~bad(x)), "\n")


def _mapped(text: pd.Series, change) -> pd.Series:
    def one(t):
        try:
            return None if t is None else json.dumps(change(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return t

    return text.map(one)


@F.pandas_udf(StringType())
def kept_data(text: pd.Series) -> pd.Series:
    """JSON in which noise strings are gone and others are masked, at any depth; other values stay."""
    noise, secrets = [re.compile(p) for p in NOISE_LINES], [re.compile(rf"(?i)({n}){b}\S+") for n, b in SENSITIVE]

    def line(s: str):
        s = s.strip()
        if any(p.search(s) for p in noise):
            return None
        for p in secrets:
            s = p.sub(r"\1: [REDACTED]", s)
        return s

    def walk(x):
        if isinstance(x, str):
            return line(x)
        if isinstance(x, dict):
            return {k: w for k, v in x.items() if (w := walk(v)) is not None or v is None}
        return [w for v in x if (w := walk(v)) is not None] if isinstance(x, list) else x

    return _mapped(text, walk)


@F.pandas_udf(StringType())
def without_reasoning(text: pd.Series) -> pd.Series:
    """JSON without private reasoning: objects of such a type keep their type alone, values under such keys go."""

    def walk(x, depth=0):
        if depth > DEEPEST:
            return "[nested value omitted]"
        if isinstance(x, list):
            return [walk(v, depth + 1) for v in x]
        if not isinstance(x, dict):
            return x
        kind = next((x[k] for k in ("type", "kind") if isinstance(x.get(k), str) and x[k].lower() in REASONING_TYPES), None)
        if kind is not None:
            return {"type": kind, "omitted": "[private reasoning omitted]"}
        return {k: walk(v, depth + 1) for k, v in x.items() if re.sub("[^a-z0-9]+", "", k.lower()) not in REASONING_KEYS}

    return _mapped(text, walk)
