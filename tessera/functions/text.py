"""Text functions as column expressions; what Spark has no primitive for is an Arrow UDF at the end."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Secret patterns, in the order in which they are applied.
SECRETS = [
    ("openai_key", r"\bsk-[A-Za-z0-9_\-]{20,}\b"),
    ("huggingface_token", r"\bhf_[A-Za-z0-9]{20,}\b"),
    ("hf_s3_access_key", r"\bHFAK[A-Za-z0-9]{8,}\b"),
    ("bearer_token", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{16,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\b"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("password_assignment", r"""(?i)\b(password|passwd|pwd)\s*[:=]\s*["']?[^"'\s]{6,}["']?"""),
    ("secret_assignment", r"""(?i)\b(secret|api[_-]?key|access[_-]?token|refresh[_-]?token)\s*[:=]\s*["']?[^"'\s]{8,}["']?"""),
    ("cookie", r"(?i)\b(cookie|set-cookie)\s*[:=]\s*[^;\n]{8,}"),
]
# Words that say nothing about a topic.
STOPWORDS = ["dùng", "sử", "dụng", "use", "using", "the", "a", "an", "cho", "và", "là", "của", "to", "for", "with", "quyết", "định"]

#: The edge of an ASCII word: between letters, digits or ``_`` and anything else, letters with accents included.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: White space of all kinds, ends of lines and the byte order mark included.
BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(BLANKS))


def tokenize(text: Column) -> Column:
    """Lower-case runs of letters, digits and ``_-./`` of more than one character; ``nfkc`` first if texts may need it."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\-./]+", " "), " "), lambda t: F.length(t) > 1)


def redact(text: Column) -> Column:
    """Every secret becomes ``[REDACTED:kind]``: all are found in the text as it is, then replaced wherever they stand, in the order of kinds."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(v.alias("v"), F.lit(f"[REDACTED:{kind}]").alias("by")))

    return F.aggregate(F.concat(*[of(k, p) for k, p in SECRETS]), text, lambda out, m: F.replace(out, m["v"], m["by"]))


def squeeze(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_key(text: Column) -> Column:
    """What two records must share to be merged: case, quotes, final punctuation and white space don't count."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), "[“”\"'`]", ""), r"[.!?]+$", ""), r"\s+", " "))


def fingerprint(*parts: Column, size: int = 64) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def slug(title: Column) -> Column:
    """ASCII slug of at most 120 characters; ``nfkd_plain`` first for accents."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 120)


def wiki_links(content: Column) -> Column:
    """Distinct slugs of ``[[links]]``."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(content, F.lit(r"\[\[([^\[\]]+)\]\]"), 1), slug), lambda s: s != ""))


def fragments(text: Column, most: int = 50) -> Column:
    """Sentences and lines, at most so many."""
    return F.slice(F.filter(F.split(text, r"\n+|(?<=[.!?])\s+"), lambda s: F.trim(s) != ""), 1, most)


def useful_fragment(text: Column) -> Column:
    """Long enough, with letters, and no address or encoded data."""
    return F.length(text).between(12, 1000) & (F.regexp_count(text, F.lit(r"\p{L}")) >= 6) & ~text.rlike(r"^https?://\S+$") & ~text.rlike(r"^[A-Za-z0-9+/=]{40,}$")


def words_for_topic(text: Column) -> Column:
    """Distinct words of more than two characters without stop words."""
    found = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_-]+", " "), r"\s+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def retrieval_terms(text: Column, most: int = 40) -> Column:
    """Distinct terms of two characters or more that aren't numbers."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_./:-]+"), 0)
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~t.rlike("^[0-9]+$"))), 1, most)


def head_and_tail(text: Column, longest: int = 1000, head: int = 350, tail: int = 150) -> Column:
    """The two ends of an overlong text around a mark."""
    return F.when(F.length(text) > longest, F.concat(F.substring(text, 1, head), F.lit("\n...\n"), F.right(text, F.lit(tail)))).otherwise(text)


def ellipsis(text: Column, most: int) -> Column:
    text = squeeze(text)
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 3.5)


def path_segment(text: Column) -> Column:
    """A name that is safe in a path."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", ""), F.lit("")), F.lit("unknown"))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkd_plain(text: pd.Series) -> pd.Series:
    """Letters without their accents."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) <= 0x36F))


@F.pandas_udf(StringType())
def stable_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys, for digests; null where the text is no JSON."""

    def one(t):
        try:
            return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(one)


# Keys (letters and digits only) whose values never leave the process; ``pwd`` as a whole.
SECRET_KEYS = ("password", "passwd", "secret", "token", "cookie", "authorization", "apikey", "accesskey", "privatekey", "clientsecret", "credential")


@F.pandas_udf(StringType())
def redact_json(text: pd.Series) -> pd.Series:
    """Values under secret keys, at any depth, become ``[REDACTED]``; secrets inside other strings are replaced as in ``redact``."""
    patterns = [(kind, re.compile(p)) for kind, p in SECRETS]

    def plain(s):
        out = s
        for kind, m in [(k, m.group(0)) for k, p in patterns for m in p.finditer(s)]:
            out = out.replace(m, f"[REDACTED:{kind}]")
        return out

    def secret(key):
        key = re.sub("[^a-z0-9]+", "", unicodedata.normalize("NFKC", key).lower())
        return key == "pwd" or any(s in key for s in SECRET_KEYS)

    def walk(x):
        if isinstance(x, str):
            return plain(x)
        if isinstance(x, dict):
            return {k: "[REDACTED]" if secret(k) else walk(v) for k, v in x.items()}
        return [walk(v) for v in x] if isinstance(x, list) else x

    def one(t):
        try:
            return None if t is None else json.dumps(walk(json.loads(t)), ensure_ascii=False)
        except ValueError:
            return t

    return text.map(one)
