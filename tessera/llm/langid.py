"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte n-grams, learnt from labelled texts. A document is a mixture:
each of its n-grams comes from one of its languages, and expectation-maximisation estimates the proportions. Which
languages are in the set is decided by penalised likelihood: starting from the best single language, the
language whose addition raises the likelihood most joins as long as the gain exceeds the penalty. The likelihood is
concave in the proportions, so its slope at zero tells for which languages an addition can gain anything at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Numbered, let_go, text_slices

#: Documented bounds: labelled rows used for fitting (in expectation; sampled by language), buckets of hashed n-grams.
FIT_ROWS, BUCKETS = 40_000, 1 << 14
#: Lengths of n-grams in bytes; the shares of a letter's neighbours and of common word parts.
GRAMS = (3, 4)
SMOOTH = 0.5
STEPS, CLOSE = 60, 1e-7
#: A further language must raise the log-likelihood by so much a logarithm of the number of n-grams.
PENALTY = 2.0
#: Overlapping n-grams say the same thing several times; so many count as one.
REPEATS = 6.0
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """Rows whose label is never learnt from."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features(text: str) -> np.ndarray:
    """Buckets of the n-grams of a whole text, letters in lower case and white space as one blank."""
    data = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(data) >= n:
            h = np.full(len(data) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                h = (h ^ data[i : len(data) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            out.append(h & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a partition, a row for each language and bucket that occurs."""
    by: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in text_slices(whole, "__text"):
            for lang, text in zip(batch.column("__lang").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                if lang not in by:
                    by[lang] = np.zeros(BUCKETS, dtype=np.int64)
                by[lang] += np.bincount(features(text), minlength=BUCKETS)
    for lang, n in by.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])


class Model:
    """Languages and, by bucket, the logarithm of each one's probability."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        rates = counts + SMOOTH * (counts.sum(axis=1, keepdims=True) > 0) + (counts.sum(axis=1, keepdims=True) == 0)
        self.p = (rates / rates.sum(axis=1, keepdims=True)).T.copy()  # bucket, language
        self.log = np.log(self.p)

    def mixture(self, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions of the languages in the columns of ``p`` by expectation-maximisation, and the log-likelihood."""
        share = np.full(p.shape[1], 1.0 / p.shape[1])
        total, before = n.sum(), -np.inf
        for _ in range(STEPS):
            joint = p * share
            sums = joint.sum(axis=1)
            now = float(n @ np.log(sums))
            share = (joint / sums[:, None]).T @ n / total
            if now - before < CLOSE * abs(now):
                break
            before = now
        return share, now

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The main language, its share of the text, and all shares."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, {}
        count = np.bincount(features(text), minlength=BUCKETS)
        at = np.flatnonzero(count)
        n, p = count[at] / REPEATS, self.p[at]
        single = n @ self.log[at]
        chosen, share, best = [int(np.argmax(single))], np.ones(1), float(single.max())
        penalty = PENALTY * np.log(max(2.0, n.sum()))
        while len(chosen) < len(self.languages):
            mix = p[:, chosen] @ share
            slope = (n / mix) @ p - n.sum()  # of the log-likelihood when a language joins
            slope[chosen] = -np.inf
            new = int(np.argmax(slope))
            if slope[new] <= 0:
                break
            shares, now = self.mixture(p[:, [*chosen, new]], n)
            if now - best <= penalty:
                break
            chosen, share, best = [*chosen, new], shares, now
        top = int(np.argmax(share))
        # how sure the main language is: against the single languages when it stands alone, else its share
        score = float(share[top])
        if len(chosen) == 1:
            rest = np.exp(np.minimum(0.0, single - single.max()))
            score = float(1.0 / rest.sum())
        return self.languages[chosen[top]], min(1.0, max(0.0, score)), {self.languages[c]: float(s) for c, s in zip(chosen, share, strict=True)}


def bound(sizes: list[int], total: int) -> float:
    """The number of rows of a language from which on it is sampled, so that all languages keep about ``total`` rows."""
    left, sizes = float(total), sorted(sizes)
    for i, n in enumerate(sizes):
        if n * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= n
    return float(sizes[-1])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that are not held out: all of them, or a sample by hash of about ``fit_rows``.

    The sample has a bound for each language, so a rare one keeps all its rows and only the frequent ones are sampled. A language takes
    a row of the sample at least, so no more than ``fit_rows`` are learnt (the most frequent, should a table have more labels). The
    counts come to the driver as one row per language and bucket of the sample.
    """
    usable = docs.select(F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"), F.col(id_col).alias("__id")).where(F.col("__text").isNotNull() & F.col("__lang").isNotNull() & ~held_out(F.col("__id")))
    sizes = {r[0]: r[1] for r in usable.groupBy("__lang").count().orderBy(F.desc("count"), "__lang").limit(fit_rows).collect()}
    labels = sorted(sizes)
    if not labels:
        return Model([], np.zeros((0, BUCKETS)))
    if sum(sizes.values()) > fit_rows:
        parts, most = 1 << 30, bound(list(sizes.values()), fit_rows)
        share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(parts, int(parts * most / n)))])
        usable = usable.where(F.pmod(F.xxhash64(F.col("__id"), F.lit("fit")), F.lit(parts)) < F.try_element_at(share, F.col("__lang")))
    rows = usable.where(F.col("__lang").isin(labels)).select("__text", "__lang").mapInArrow(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(labels), BUCKETS))
    place = {x: i for i, x in enumerate(labels)}
    counts[[place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return Model(labels, counts)


def _shown(shares: dict[str, float]) -> list[tuple[str, float]]:
    return sorted(shares.items(), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "languages")) -> DataFrame:
    """``docs`` with the language, its score and the map of shares under ``names``; columns of those names are replaced.

    A null text or one without a letter is ``und`` with score 0.
    """
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast((model.languages, model.p))  # languages x buckets (16384) doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.__new__(Model)
        own.languages, own.p = held.value
        own.log = np.log(own.p) if len(own.languages) else own.p
        for whole in batches:
            for batch in text_slices(whole, text_col):
                found = [own.infer(t) for t in batch.column(text_col).to_pylist()]
                kept = [(f, batch.column(f)) for f in batch.schema.names]
                yield pa.RecordBatch.from_arrays(
                    [*[c for _, c in kept], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([_shown(x[2]) for x in found], pa.map_(pa.string(), pa.float64()))],
                    [*[f for f, _ in kept], *names],
                )
        let_go()

    plain = docs.drop(*names)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{kinds}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` map<string,double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Identifier, ``held_out``, ``lang_pred``, ``score``, ``languages`` of every row; the label is used for fitting alone.

    Repeated rows get equal results; without any labelled row every prediction is ``und``; an empty table gives an empty result.
    """
    model = fit(docs, id_col, text_col, lang_col)
    out = predict(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), model, "__text")
    return out.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "lang_pred", "score", "languages")


def drop_unknown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text has a language, with the columns of ``docs``, whatever their names; all texts with a letter when no language
    could be learnt. Null texts and texts without a letter go, repeated rows fare alike, an empty table stays empty."""
    model = fit(docs, id_col, text_col, lang_col)
    if not model.languages:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    own = Numbered(docs)
    return own.back(predict(own.rows, model, own.of(text_col), ("__lang", "__score", "__languages")).where(F.col("__lang") != UNKNOWN))
