"""The focus of a conversation: compact facts that a short follow-up question is understood by.

Turns: project, seq, asked (timestamp), question, facts (array of kind, value, source, the best first). What is kept of a project is its last
intent and at most eight facts; no question and no answer is.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import intent
from tessera.functions.text import EDGE, nfkc
from tessera.operators.folds import sorted_fold

#: Facts that are kept, and for how many milliseconds.
MOST, MAX_AGE_MS = 8, 12 * 60 * 60 * 1000
FACTS = "array<struct<kind:string,value:string,source:string>>"

# What asks anew, what goes on from before, what names something said before, and what asks for the list of things to do.
FRESH = [r"\btiếp tục\b", r"\blúc nãy\b", r"\btrước đó\b", r"\btask trước\b", r"\bprevious (?:task|session|work)\b", r"\bcontinue\b", r"\bresume\b", r"\bcurrent task\b", r"\bđang làm gì\b"]
GOES_ON = [r"^(?:tại sao|vì sao|sao vậy)\b", r"^(?:why|why so|why that)\b", r"^(?:còn|thế|vậy|rồi sao|sau đó)\b", r"^(?:what about|and what|then what)\b", r"^(?:cái đó|việc đó|nó|phần đó)\b"]
POINTS_BACK = r"\b(?:nó|đó|vậy|thế|that|it|this)\b"
ASKS_TODO = [r"(?:^|\s)(?:todo|to-do)(?:\s|$)", r"(?:việc|task)\s+(?:còn lại|chưa làm|chưa xong|chưa hoàn thành)", r"(?:còn|các)\s+(?:todo|việc)\b"]
WHY = r"^(?:tại sao|vì sao|sao vậy|why|why so|why that)\b"
THEN = r"^(?:rồi sao|sau đó|tiếp thì sao|thế tiếp theo|then what|what next)\b"
#: Kinds in the order in which an answer looks for them, and how an answer calls them.
ORDER = {
    "why": ["decision", "blocker", "next_action", "task", "file"],
    "then": ["next_action", "todo", "task", "blocker", "file", "decision"],
    "other": ["task", "next_action", "file", "decision", "blocker"],
}
LABELS = {"task": "Task liên quan", "next_action": "Việc tiếp theo", "file": "File liên quan", "decision": "Quyết định liên quan", "blocker": "Blocker", "todo": "TODO"}


def _any(text: Column, patterns: list[str]) -> Column:
    """Word edges as those of ASCII words, whatever the Java version."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns).replace(r"\b", EDGE))


def plain(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkc(question)), r"(?U)\s+", " "))


def follows(question: Column) -> Column:
    """Whether a question (as from ``plain``) goes on from what was said before."""
    words = F.size(F.filter(F.split(question, " "), lambda w: w != ""))
    back = _any(question, GOES_ON) | ((words <= 5) & _any(question, [POINTS_BACK]))
    return back & ~_any(question, FRESH) & ~_any(question, ASKS_TODO)


def answer(question: Column, intents: Column, used: Column, facts: Column) -> Column:
    """What the kept facts answer to a follow-up (as from ``plain``): two of them to why, else three; null where they answer nothing."""

    def first(kind: str) -> Column:
        return F.get(F.filter(facts, lambda f: f["kind"] == kind), F.lit(0))["value"]

    def told(kinds: list[str], most: int) -> Column:
        parts = [F.concat(F.lit(f"{LABELS[k]}: "), first(k), F.lit(".")) for k in kinds]
        return F.nullif(F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, most), " "), F.lit(""))

    found = F.when(_any(question, [WHY]), told(ORDER["why"], 2)).when(_any(question, [THEN]), told(ORDER["then"], 3)).otherwise(told(ORDER["other"], 3))
    return F.when(used & (intents == "summary"), found)


def merged(facts: list[dict], most: int = MOST) -> list[dict]:
    """The first of each (kind, value), case and white space aside, at most so many."""
    seen, out = set(), []
    for f in facts:
        value = " ".join((f["value"] or "").split())
        key = (f["kind"], " ".join(unicodedata.normalize("NFKC", value).lower().split()))
        if value and key not in seen:
            seen.add(key)
            out.append({"kind": f["kind"], "value": value, "source": f["source"]})
            if len(out) == most:
                break
    return out


def turn(state: dict, row: dict, max_age_ms: int) -> tuple:
    """``used, previous_intent, prior, focus`` of a turn (``asked_ms, follows, intent, facts``); ``state`` becomes what is kept after it."""
    alive = bool(state) and row["asked_ms"] - state["asked_ms"] <= max_age_ms
    prior = state["focus"] if alive else []
    used = bool(prior) and bool(row["follows"])
    focus = merged([*(row["facts"] or []), *(prior if used else [])])
    before = state["intent"] if alive else None
    state.update(asked_ms=row["asked_ms"], intent=row["intent"], focus=focus)
    return used, before, prior, focus


TURN = f"used boolean, previous_intent string, prior {FACTS}, focus {FACTS}"


def prepared(turns: DataFrame) -> DataFrame:
    """``project, seq, asked_ms, question`` (normalised), ``follows, intent, facts``."""
    rows = turns.select("project", "seq", F.unix_millis(F.col("asked").cast("timestamp")).alias("asked_ms"), plain(F.coalesce("question", F.lit(""))).alias("question"), F.col("facts").cast(FACTS).alias("facts"))
    return rows.withColumn("follows", follows(F.col("question"))).withColumn("intent", intent(F.col("question")))


def focus(turns: DataFrame, max_age_ms: int = MAX_AGE_MS, partitions: int | None = None) -> DataFrame:
    """Every turn with ``used`` (whether it was understood by prior facts), ``previous_intent``, ``prior`` and ``focus``, the facts before and after it, and ``answer``.

    A follow-up keeps prior facts behind its own, any other question starts anew, and facts older than ``max_age_ms`` are forgotten.
    """

    def step(state: dict, row: dict) -> list:
        return [(row["project"], row["seq"], row["question"], row["intent"], *turn(state, row, max_age_ms))]

    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("project", "seq")}
    rows = prepared(turns)
    out = sorted_fold(rows, ["project"], ["asked_ms", "seq"], lambda key: {}, step, lambda key, state: [], f"project {kinds['project']}, seq {kinds['seq']}, question string, intent string, {TURN}", partitions)
    return out.withColumn("answer", answer(F.col("question"), F.col("intent"), F.col("used"), F.col("prior")))
