"""Scores and rule-based classes as column expressions. ``now`` is always a parameter."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import EDGE


# Scores, half-lives and limits in days, priorities.
BASE = {"critical": 100.0, "high": 75.0, "normal": 50.0, "temporary": 20.0}
HALF_LIFE = {"activity": 14, "summary": 30, "todo": 90, "decision": 365, "rule": 730, "code": 180}
PRIORITY = {"rule": 1.0, "decision": 0.9, "todo": 0.8, "summary": 0.6, "activity": 0.3}
STALE_CLASS = {"class:permanent": 730, "class:task": 180, "class:session": 45, "class:transient": 7}
STALE_TYPE = {"rule": 730, "decision": 365, "code": 180, "todo": 120, "summary": 45, "activity": 14}
CLASS_DELTA = {"class:permanent": 25, "class:task": 15, "class:session": 2, "class:transient": -25}
IMPORTANCE_DELTA = {"critical": 25, "high": 15, "normal": 0, "temporary": -15}
NOISE = [r"^ok(ay)?[.!]?$", r"^done[.!]?$", r"^thanks?[.!]?$", r"^test(ing)?[.!]?$", r"^npm notice\b", r"^changed [0-9]+ packages?", r"^packages? are looking for funding"]


def choose(key: Column, table: dict[str, object], default=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def first_tag(tags: Column, table: dict[str, object], default: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(F.array_contains(tags, k), F.lit(v)) if out is None else out.when(F.array_contains(tags, k), F.lit(v))
    return out.otherwise(default)


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def age_days(then: Column, now: Column) -> Column:
    """Days from ``then`` to ``now``, 0 for the future."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    return F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))


def active(expires: Column, superseded_by: Column, now: Column) -> Column:
    return (expires.isNull() | (expires > now)) & superseded_by.isNull()


def keyword_score(tokens: Column, query: list[str]) -> Column:
    """Damped term frequencies, averaged over the query's tokens (repeats count).

    The tokens are bound once: a plain column would be worked out anew for each token of the query and wherever a filter names the score.
    """
    def damped(found: Column, q: str) -> Column:
        tf = F.size(F.filter(found, lambda t: t == q))
        return F.when(tf > 0, 1 + F.log(1 + tf)).otherwise(0.0)

    return F.transform(F.array(tokens), lambda found: sum((damped(found, q) for q in query), F.lit(0.0)) / max(1, len(query)))[0]


def recency(updated: Column, created: Column, now: Column, half_life: float = 30.0) -> Column:
    then = F.coalesce(updated, created)
    return F.coalesce(F.exp(F.lit(-math.log(2)) * age_days(then, now) / half_life), F.lit(0.0))


def effective_importance(type_: Column, importance: Column, updated: Column, is_active: Column, now: Column) -> Column:
    """0 unless active; critical records don't decay, others halve over their type's half-life."""
    decayed = choose(importance, BASE) * F.pow(F.lit(0.5), age_days(updated, now) / choose(type_, HALF_LIFE, 180))
    return F.when(~is_active, 0.0).when(importance == "critical", BASE["critical"]).otherwise(decayed)


def preferred_types(query: str) -> list[str]:
    # Words of a query that ask for a type.
    asked = {
        "decision": ["quyết định", "decision", "đã chọn"],
        "todo": ["todo", "cần làm", "tiếp theo", "chưa xong"],
        "rule": ["quy tắc", "rule", "không được", "bắt buộc"],
        "summary": ["tóm tắt", "summary", "đã làm"],
    }
    return [t for t, words in asked.items() if any(w in query.lower() for w in words)]


def type_priority(type_: Column, preferred: list[str]) -> Column:
    plain = choose(type_, PRIORITY, 0.4)
    return F.when(type_.isin(preferred), F.least(F.lit(1.0), plain + 0.25)).otherwise(plain) if preferred else plain


def hybrid_score(keyword: Column, importance: Column, recent: Column, priority: Column) -> Column:
    return 0.55 * keyword + 0.20 * importance / 100 + 0.15 * recent + 0.10 * priority


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths, empty arrays and zero norms."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (both == 0), 0.0).otherwise(dot / both)


def default_expiry_days(type_: Column, importance: Column) -> Column:
    """Days until a record expires; null: never."""
    limit = F.when(importance == "temporary", 30)
    limit = F.when(type_ == "activity", F.least(F.coalesce(limit, F.lit(14)), F.lit(14))).otherwise(limit)
    return F.when(type_ == "summary", F.least(F.coalesce(limit, F.lit(30)), F.lit(30))).otherwise(limit)


def infer_importance(type_: Column, content: Column) -> Column:
    text = F.lower(content)
    return F.when(any_of(text, ["không được", "bắt buộc", "must not", "critical"]), "critical").when(type_.isin("rule", "decision"), "high").when(type_ == "todo", "normal").when(type_.isin("activity", "summary"), "temporary").otherwise("normal")


def score_importance(type_: Column, content: Column) -> Column:
    text = F.lower(content)
    return (
        F.when(any_of(text, ["không được", "tuyệt đối", "must not", "never "]), "critical").when(type_.isin("rule", "decision"), "high")
        .when(type_ == "todo", "normal").when(any_of(text, ["error", "failed", "exception"]), "normal").otherwise("temporary")
    )


def looks_like(content: Column) -> Column:
    """rule, todo, decision or null, in that order."""
    text = F.lower(content)
    rule = ["không được", "bắt buộc", "phải luôn", "tuyệt đối", "never ", "must ", "always ", "do not "]
    todo = ["todo", "cần làm", "chưa xong", "còn phải", "next:", "next step", "pending"]
    decision = ["quyết định", "chọn ", "sử dụng ", "dùng ", "decided", "decision", "we will use", "use "]
    return F.when(any_of(text, rule), "rule").when(any_of(text, todo), "todo").when(any_of(text, decision), "decision")


def quality(type_: Column, importance: Column, content: Column, tags: Column, updated: Column, sources: Column, now: Column) -> dict[str, Column]:
    """``score``, ``tier``, ``stale``, ``protected``, ``prune`` of a record."""
    trimmed = F.trim(content)
    n = F.length(trimmed)
    low = F.lower(trimmed)
    noise = (n < 8) | low.rlike("|".join(f"(?:{p})" for p in NOISE))
    stale = age_days(updated, now) >= first_tag(tags, STALE_CLASS, choose(type_, STALE_TYPE))
    score = (
        F.lit(50) + first_tag(tags, CLASS_DELTA, F.lit(0)) + choose(importance, IMPORTANCE_DELTA, 0) + F.when(type_.isin("rule", "decision"), 10).otherwise(0)
        + F.when(n < 12, -30).when(n < 30, -10).when(n <= 1200, 8).when(n > 5000, -15).otherwise(0)
        + F.when(noise, -35).otherwise(0) + F.when(sources > 1, 10).otherwise(0) + F.when(stale, -15).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    tier = F.when(score >= 80, "trusted").when(score >= 55, "useful").when(score >= 30, "weak").otherwise("noise")
    cls = first_tag(tags, {k: k for k in CLASS_DELTA}, F.lit("none"))
    protected = (cls == "class:permanent") | type_.isin("rule", "decision") | (importance == "critical")
    disposable = (importance == "temporary") | (type_ == "activity") | (cls == "class:transient")
    prune = ~protected & (((tier == "noise") & disposable) | (stale & tier.isin("noise", "weak")))
    return {"score": score, "tier": tier, "stale": stale, "protected": protected, "prune": prune}


def candidate(importance: Column, confidence: Column, kind: Column) -> dict[str, Column]:
    """``score`` and ``knowledge_class`` of an extracted fact."""
    base = choose(importance, {"critical": 1.0, "high": 0.85, "normal": 0.6, "temporary": 0.25})
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.75 * base + 0.25 * confidence))
    cls = F.when((importance == "temporary") | (confidence < 0.78), "transient").when(kind.isin("rule", "architecture"), "permanent").when(kind.isin("decision", "todo", "fix"), "task").otherwise("session")
    return {"score": score, "knowledge_class": cls}


def fact_category(text: Column) -> Column:
    """The first of some families of words that occurs, else decision; English and Vietnamese, as whole words in any case; word edges are those of ASCII words, whatever the Java version."""
    # Words of each category, in order; letters beyond ASCII need (?u) to match in any case.
    rules = [
        ("rule", r"(?i)\b(rule|policy|standard|convention|always|never|must|should|(?u:quy tắc|từ giờ|không được))\b"), ("fix", r"(?i)\b(fix|fixed|bug|issue|error|(?u:lỗi))\b"), ("blocker", r"(?i)\b(blocker|blocked|stuck|cannot|(?u:không thể))\b"),
        ("next_action", r"(?i)\b(next|todo|action|task|(?u:cần làm))\b"), ("deploy", r"(?i)\b(deploy|release|publish|ship)\b"), ("architecture", r"(?i)\b(architecture|design|structure|pattern)\b"), ("file", r"(?i)\.(ts|js|py|go|rs|java|cpp|c|h)\b"),
    ]
    # what a line must hold for a rule to be tried at all; a dotless i stands for i within (?u), so stems end before it
    stems = {
        "rule": ["rule", "policy", "standard", "convention", "always", "never", "must", "should", "quy tắc", "từ g", "không được"], "fix": ["fix", "bug", "issue", "error", "lỗ"], "blocker": ["blocke", "stuck", "cannot", "không thể"], "next_action": ["next", "todo", "action", "task", "cần làm"],
        "deploy": ["deploy", "release", "publish", "ship"], "architecture": ["architecture", "design", "structure", "pattern"], "file": [".ts", ".js", ".py", ".go", ".rs", ".java", ".c", ".h"],
    }

    def told(low: Column) -> Column:
        out = None
        for name, p in rules:
            held = reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in stems[name]])
            met = held & text.rlike(p.replace(r"\b", EDGE))
            out = F.when(met, name) if out is None else out.when(met, name)
        return out.otherwise("decision")

    return F.transform(F.array(F.lower(text)), told)[0]


def wiki_score(slug: Column, title: Column, tags: Column, summary: Column, content: Column, tokens: list[str]) -> Column:
    """Exact slug 12, exact title 10, in title 6, in slug 5, tag 5 or in a tag 3, in summary 2, in content 1, for each distinct token."""
    out = F.lit(0)
    low_title, low_summary, low_content = F.lower(title), F.lower(F.coalesce(summary, F.lit(""))), F.lower(content)
    low_tags = F.transform(tags, F.lower)
    hit = lambda c, w: F.when(c, w).otherwise(0)

    def inside(q: str) -> Column:
        return F.exists(low_tags, lambda t: F.contains(t, F.lit(q)))

    for q in dict.fromkeys(tokens):
        out = out + hit(slug == q, 12) + hit(low_title == q, 10) + hit(F.contains(low_title, F.lit(q)), 6) + hit(F.contains(slug, F.lit(q)), 5)
        out = out + F.when(F.array_contains(low_tags, q), 5).when(inside(q), 3).otherwise(0)
        out = out + hit(F.contains(low_summary, F.lit(q)), 2) + hit(F.contains(low_content, F.lit(q)), 1)
    return out


def risk_of(score: Column) -> Column:
    return F.when(score >= 30, "CRITICAL").when(score >= 16, "HIGH").when(score >= 6, "MEDIUM").otherwise("LOW")


def dead_code_score(type_: Column, outgoing: Column, path: Column, name: Column) -> Column:
    return F.lit(50) + F.when(type_.isin("function", "method"), 20).otherwise(0) - F.when(type_ == "property", 15).otherwise(0) + F.when(outgoing == 0, 10).otherwise(0) + F.when(F.contains(path, F.lit("/internal/")), 10).otherwise(0) + F.when(name.startswith("_"), 5).otherwise(0)


