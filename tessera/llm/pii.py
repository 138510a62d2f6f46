"""Personal data in texts (DataFrame functions only).

A regular expression for each kind proposes spans. A validator (digits that pass Luhn, a remainder of 1 by 97, a range of digits or of
parts) confirms them, and words near a span raise its score: a kind whose pattern alone tells little needs them to pass the
threshold. Positions come from the matches and from the gaps between them, which two passes of the same pattern give.

The patterns are written so that Java's matcher neither recurses nor goes back over a long run: a run of the characters that may begin a
match is entered at its start, or where the last match ended, and is never given back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbered

#: Characters before and after a span in which context words count.
NEAR = 40
#: What a validator and a context word add to a pattern's own score; spans of at least THRESHOLD are reported.
CONFIRMED, IN_CONTEXT, THRESHOLD = 0.4, 0.3, 0.6
#: Matches that one fold places; folds copy what they have gathered for every match.
RUN = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column, most: int = 19) -> Column:
    """Whether at most ``most`` digits pass the Luhn check."""
    padded = F.lpad(digits, most, "0")
    even, odd = ("0246813579", "0123456789")
    # from the right, every second digit is doubled and its digits are added
    doubled = F.translate(padded, odd, even)
    places = [F.substring(doubled if (most - i) % 2 == 0 else padded, i + 1, 1).cast("int") for i in range(most)]
    return reduce(lambda a, b: a + b, places) % 10 == 0


def card_number(match: Column) -> Column:
    digits = _digits(match)
    return F.when(F.length(match) <= 38, F.length(digits).between(13, 19) & luhn(F.substring(digits, 1, 19))).otherwise(False)


def ip_number(match: Column) -> Column:
    """Four parts of at most 255, leading zeros or not."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


def phone_number(match: Column) -> Column:
    return F.length(_digits(match)).between(9, 15)


def iban(match: Column) -> Column:
    """The country's part moves to the end, letters become 10 to 35, and the number leaves 1 by 97."""
    flat = F.replace(match, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(flat, 5, 30), F.substring(flat, 1, 4))
    steps = F.split(moved, "")

    def fold(rest: Column, char: Column) -> Column:
        value = F.when(char == "", F.lit(None)).when(char.between("0", "9"), F.ascii(char) - 48).otherwise(F.ascii(char) - 55)
        return F.when(value.isNull(), rest).when(value < 10, (rest * 10 + value) % 97).otherwise((rest * 100 + value) % 97)

    return F.when(F.length(flat).between(15, 34), F.aggregate(steps, F.lit(0), fold) == 1).otherwise(False)


def social_number(match: Column) -> Column:
    """No group of a social security number is all zeros, the first is neither 666 nor from 900 on."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


@dataclass
class Rule:
    """``pattern`` for Java's matcher; ``hint``: a cheaper one that every text with a match meets; ``context``: words, in lower case.

    ``apart``: what the two characters before and the two after a match must not meet.
    """

    kind: str
    pattern: str
    hint: str
    valid: Callable[[Column], Column] | None = None
    context: tuple[str, ...] = ()
    score: float = 0.4
    apart: tuple[str, str] | None = None


TELEPHONE = ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone")
#: The base kinds, in the order of reports. Pattern and validator alone pass the threshold.
BASE = [
    Rule("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", None, ("mail", "contact", "correo", "courriel"), 0.7),
    Rule("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", ip_number, ("ip", "host", "server", "address", "adresse"), 0.4),
    Rule("card", r"[0-9](?:[\x20-]?+[0-9])++", r"[0-9](?:[\x20-]?+[0-9]){12}", card_number, ("card", "visa", "credit", "carte", "karte", "tarjeta"), 0.4),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", phone_number, TELEPHONE, 0.4),
]
#: Kinds that the method adds: account numbers that mod 97 confirms, and two that need their words nearby.
ADDED = [
    Rule("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", iban, ("iban", "account", "bank", "konto", "compte", "cuenta"), 0.4, (r"[A-Za-z0-9]\z", "^[A-Za-z0-9]")),
    Rule("local_phone", r"[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[.-][0-9]{4}", "[0-9]{3}[.-][0-9]{4}", None, TELEPHONE, 0.4, (r"[0-9+(.-]\z|[0-9)]\x20\z", "^[0-9]")),
    Rule("social", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", social_number, ("ssn", "social security", "taxpayer"), 0.1, (r"[0-9-]\z", "^[0-9-]")),
]
RULES = BASE + ADDED
SPAN = "array<struct<kind:string,start:long,stop:long,score:double>>"


def near(context: tuple[str, ...], before: Column, after: Column) -> Column:
    """Whether one of the words stands, as a whole word, in what precedes or follows a span."""
    words = rf"(?iu)(?:^|[^\p{{L}}])(?:{'|'.join(context)})(?:[^\p{{L}}]|$)"
    return F.right(before, F.lit(NEAR)).rlike(words) | F.left(after, F.lit(NEAR)).rlike(words)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def _found(text: Column, rule: Rule, threshold: float) -> Column:
    """The spans of a rule: matches and gaps in step, placed by folds of ``RUN`` matches each."""
    pieces = F.arrays_zip(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)).alias("match"), F.split(text, rule.pattern, -1).alias("gap"))

    def judged(parts: Column) -> Column:
        """``gap`` and ``size`` of each match, and its score (null: not reported)."""

        def one(p: Column, i: Column) -> Column:
            after = F.coalesce(F.try_element_at(parts, i + 2)["gap"], F.lit(""))
            score = F.lit(rule.score) + (F.when(rule.valid(p["match"]), F.lit(CONFIRMED)) if rule.valid else F.lit(0.0))
            score = score + F.when(near(rule.context, p["gap"], after), F.lit(IN_CONTEXT)).otherwise(0.0) if rule.context else score
            if rule.apart:
                score = F.when(~F.right(p["gap"], F.lit(2)).rlike(rule.apart[0]) & ~F.left(after, F.lit(2)).rlike(rule.apart[1]), score)
            score = F.round(score, 2)
            return F.struct(F.length(p["gap"]).cast("long").alias("gap"), F.length(p["match"]).cast("long").alias("size"), F.when(score >= threshold, score).alias("score"))

        return F.transform(parts, one)

    def placed(run: Column, begin: Column) -> Column:
        """Of a run that begins at ``begin``: where it ends, and its spans."""

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            stop = start + F.coalesce(p["size"], F.lit(0))
            span = F.struct(F.lit(rule.kind).alias("kind"), start.alias("start"), stop.alias("stop"), p["score"].alias("score"))
            return F.struct(stop.alias("at"), F.when(p["size"].isNotNull() & p["score"].isNotNull(), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(run, F.struct(begin.alias("at"), F.array().cast(SPAN).alias("spans")), step)

    def all_runs(marks: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / RUN).cast("int")), lambda b: F.slice(marks, b * RUN + 1, RUN))

        def step(acc: Column, run: Column) -> Column:
            return _let(placed(run, acc["at"]), lambda r: F.struct(r["at"].alias("at"), F.when(F.size(r["spans"]) > 0, F.array_append(acc["spans"], r["spans"])).otherwise(acc["spans"]).alias("spans")))

        return F.flatten(F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")), step)["spans"])

    none = F.array().cast(SPAN)
    return F.when(text.rlike(rule.hint), _let(_let(pieces, judged), all_runs)).otherwise(none)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The identifier, and ``spans``: kind, start and stop (code points, stop exclusive) and score, by kind as listed, then start.

    Matches of a kind don't overlap; the leftmost is taken, and one that fails its validator is dropped. Null text counts as empty and
    has no spans; every row of ``docs`` is returned, repeated ones and null identifiers too; an empty table gives an empty result. Texts are
    read whole, in time that grows with their length and at most with the power 1.5 of the spans of a text. Other columns play no part, whatever their names.
    """
    own = Numbered(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [_found(text, r, threshold) for r in (RULES if rules is None else rules)]
    out = own.rows.select(F.col(own.of(id_col)).alias("id"), F.col(own.of(text_col)).alias("text"))
    return out.select(F.col("id").alias(id_col), F.concat(*found).alias("spans") if found else F.array().cast(SPAN).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of its texts replaced by their kind in brackets; of overlapping spans the one that starts first counts, then the longer.

    Nulls stay null. Columns keep their names and order.
    """
    own = Numbered(docs)
    text = own.of(text_col)
    rows = own.rows.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    spans = F.concat(*[_found(F.col("__text"), r, threshold) for r in (RULES if rules is None else rules)])
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col("__text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct((-s["back"]).alias("at"), F.array_append(acc["out"], piece).alias("out")))

    folded = F.aggregate(in_order, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")), step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("__text"), (acc["at"] + 1).cast("int"), 1 << 30)))
    return own.back(rows.withColumn(text, F.when(F.col(text).isNotNull(), folded)))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base kinds, and all spans as text: ``kind:start:stop``, joined by commas."""
    base = [r.kind for r in BASE]

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def count(kinds: list[str], name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("long").alias(name)

    counts = [count([k], f"n_{k}") for k in base]
    added = (F.size("spans") - count(base, "n")).cast("long").alias("n_added")
    return found.select(id_col, *counts, F.sha2(told(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), added, F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
