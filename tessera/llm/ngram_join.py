"""Exact Jaccard self-join on word n-grams, filtered by prefixes under several global orders.

Two sets whose Jaccard similarity reaches t share a token among the first n - ceil(t n) + 1 tokens of each, whatever
the global order of tokens. The orders used here put rare tokens first, as a table of counters over the
whole corpus tells, and differ in how they break ties. A pair is verified only if it shares prefix tokens under all of
them. Equal sets are joined first and stand as one.

A token in few sets gives its pairs. A token in many sets would give a number of pairs that grows with
the square; there every set is compared with one pivot only, the set made of the commonest tokens. What is left
are pairs of sets that hold the same pivot's token. For these the sets are described by their differences from the
pivot. If two sets are similar and are not both linked to the pivot, their differences overlap: with d the most
that two similar sets can differ, a set's first floor(n (1-t)/t) + 1 differences in a global order must meet the
first half as many of the one with fewer differences. Differences are rare where whole tokens are common, so the join on
(pivot, difference) stays small, and no pair is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import marked_ids, summed, table_size
from tessera.llm.common import stored, text_slices, unused, whole_number
from tessera.llm.components import components
from tessera.llm.shingles import U, _mixed, shingle_sets

#: Bytes of text for each counter of the table over all tokens (about 40 tokens), and the bounds of that table, which is broadcast.
PER_COUNTER, COUNTERS_LEAST, COUNTERS_MOST = 256, 1 << 20, 1 << 24
#: A token in more sets than this has a pivot.
FEW = 16
#: Bytes of text whose sets are formed at a time.
SLICE = 1 << 18
#: Shares of all tokens at which the classes of rare tokens end.
MARKS = (0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 0.95)
ORDERS = 3
#: A set's picture has a bit for each token at least, and so many. Two sets differ by at least as many tokens as their pictures do by bits.
PICTURE_LEAST = 512
#: How common a set's tokens are is told in so many steps: sets that hardly differ still have an order, so the most typical becomes the pivot.
TYPICAL = 1 << 20
_SEEDS = [U(0x2545F4914F6CDD1D), U(0x9E6C63D0876A9A47), U(0xD1B54A32D192ED03)]


class Ranks:
    """The global orders: a class by how common a token's counter is, then a hash of the token."""

    def __init__(self, counters: np.ndarray):
        self.shift = U(64 - (len(counters) - 1).bit_length())
        by = np.sort(counters.astype(np.int32))
        below = np.cumsum(by, dtype=np.int64)
        marks = [int(by[np.searchsorted(below, q * below[-1])]) if below[-1] else 0 for q in MARKS]
        common = np.maximum(1, marks[-1])
        del by, below
        classes = np.searchsorted(marks, counters).astype(np.uint8)
        over = np.flatnonzero(counters > common)
        classes[over] = np.minimum(60, len(MARKS) + np.log2(counters[over] / common).astype(np.int64))
        self.classes = classes
        self.weight = np.minimum(255, 8 * np.log2(1 + counters, dtype=np.float32)).astype(np.uint8)

    def of(self, tokens: np.ndarray, order: int) -> np.ndarray:
        return (self.classes[tokens >> self.shift].astype(U) << U(58)) | (_mixed(tokens ^ _SEEDS[order]) >> U(6))

    def prefix(self, tokens: np.ndarray, k: int, order: int) -> np.ndarray:
        if k >= len(tokens):
            return tokens
        return tokens[np.argpartition(self.of(tokens, order), k - 1)[:k]]

    def common(self, tokens: np.ndarray) -> float:
        """How common the tokens of a set are."""
        return float(self.weight[tokens >> self.shift].mean()) if len(tokens) else 0.0


class Threshold:
    """A similarity as a fraction; what follows from it for sets of n tokens."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.folds = (-(-den // num) - 1).bit_length()

    def prefix(self, n: int) -> int:
        return n + (-self.num * n) // self.den + 1

    def differences(self, n: int, half: bool) -> int:
        """Differences of a set from its pivot that must meet another's."""
        return n * (self.den - self.num) // (self.num * (2 if half else 1)) + 1

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if self.den * small < self.num * large:
            return False
        same = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * same >= self.num * (len(a) + len(b) - same)


def _columns(*pairs: tuple[str, list, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for _, v, k in pairs], [n for n, _, _ in pairs])


def _features(held, words: int, t: Threshold):
    """``id``, ``n``, the set's digest, how common its tokens are (below ``TYPICAL``), its prefix in the first order, and its picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: Ranks = held.value
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"), words)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                prefix = [ranks.prefix(s, t.prefix(len(s)), 0).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                yield _columns(
                    ("id", batch.column("id").to_pylist(), pa.int64()), ("n", [len(s) for s in sets], pa.int64()), ("digest", digests, pa.binary()),
                    ("typical", [int(ranks.common(s) * (TYPICAL >> 8)) for s in sets], pa.int64()), ("prefix", prefix, pa.list_(pa.int64())), ("bits", [_picture(s) for s in sets], pa.list_(pa.int64())),
                )

    return run


def _picture(tokens: np.ndarray) -> np.ndarray:
    """A power of two of bits, so that a larger picture folds into a smaller one."""
    size = max(PICTURE_LEAST, 1 << max(0, len(tokens) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[_mixed(tokens ^ U(0x6C62272E07BB0142)) % U(size)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def _folded(picture: Column, size: Column, times: int) -> Column:
    """A picture in so many longs; ``times`` is how often the larger of two similar sets' pictures can be twice the other's."""
    for _ in range(times):
        half = (F.size(picture) / 2).cast("int")
        fold = F.zip_with(F.slice(picture, F.lit(1), half), F.slice(picture, half + 1, half), lambda x, y: x.bitwiseOR(y))
        picture = F.when(F.size(picture) > size, fold).otherwise(picture)
    return picture


def _other_prefixes(held, words: int, t: Threshold):
    """The prefixes in the other orders, as 32-bit hashes (a clash there lets a pair through, it loses none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: Ranks = held.value
        for whole in batches:
            for batch in text_slices(whole, "text", SLICE):
                sets = shingle_sets(batch.column("text"), words)
                more = [(f"prefix{o}", [ranks.prefix(s, t.prefix(len(s)), o).astype(np.uint32).view(np.int32) if len(s) else [] for s in sets], pa.list_(pa.int32())) for o in range(1, ORDERS)]
                yield _columns(("id", batch.column("id").to_pylist(), pa.int64()), ("text", batch.column("text").to_pylist(), pa.string()), *more)

    return run


def _sets_of(batch: pa.RecordBatch, words: int, last: dict[int, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Both sets of each pair; rows come ordered by the first, whose set is formed once."""
    second = shingle_sets(batch.column("text_b"), words)
    for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
        if a not in last:
            last.clear()
            last[a] = shingle_sets(batch.column("text_a").slice(i, 1), words)[0]
        yield a, b, last[a], second[i]


def _verify(words: int, t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in text_slices(whole, "text_b", SLICE):
                linked = [(a, b) for a, b, x, y in _sets_of(batch, words, last) if t.similar(x, y)]
                yield _columns(("a", [x[0] for x in linked], pa.int64()), ("b", [x[1] for x in linked], pa.int64()))

    return run


DIFFERENCES = "pivot long, id long, linked boolean, n long, many long, token long, place long, probe boolean"


def _differences(held, words: int, t: Threshold):
    """For each pivot (``a``) and set (``b``): are they similar, and the first differences of the set from the pivot.

    A row with a null token stands for each pair. What the pivot lacks comes before what the set lacks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks: Ranks = held.value
        last: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in text_slices(whole, "text_b", SLICE):
                out = [[] for _ in range(8)]
                for a, b, pivot, own in _sets_of(batch, words, last):
                    linked = t.similar(pivot, own)
                    extra, missing = np.setdiff1d(own, pivot, assume_unique=True), np.setdiff1d(pivot, own, assume_unique=True)
                    k, index = t.differences(len(own), False), t.differences(len(own), True)
                    first = extra[np.argsort(ranks.of(extra, 0))[:k]]
                    if len(first) < k:
                        gone = _mixed(missing ^ U(0xA24BAED4963EE407))
                        first = np.concatenate([first, np.sort(gone)[: k - len(first)]])
                    many = len(extra) + len(missing)
                    tokens = [None, *first.view(np.int64).tolist()]
                    for column, values in zip(out, ([a], [b], [linked], [len(own)], [many]), strict=False):
                        column += values * len(tokens)
                    out[5] += tokens
                    out[6] += range(-1, len(tokens) - 1)
                    out[7] += [i - 1 >= index for i in range(len(tokens))]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [x.split()[0] for x in DIFFERENCES.split(", ")])

    return run


def _length_fits(t: Threshold):
    return F.least("n_a", "n_b") * t.den >= F.greatest("n_a", "n_b") * t.num


def set_classes(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """``id``, ``n`` and ``component`` of every row: the smallest identifier that links of similarity num/den reach."""
    t = Threshold(num, den)
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    text_size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = table_size(text_size // PER_COUNTER, COUNTERS_LEAST, COUNTERS_MOST)
    shift = U(64 - (size - 1).bit_length())
    counters = summed(slim, size, ["text"], lambda batch: (np.concatenate(shingle_sets(part.column("text"), words)) >> shift for part in text_slices(batch, "text", SLICE)))
    held = spark.sparkContext.broadcast(Ranks(counters))  # two bytes a counter

    features = stored(slim.mapInArrow(_features(held, words, t), "id long, n long, digest binary, typical long, prefix array<long>, bits array<long>"), "sets")
    members = features.select("id", "n", "digest")
    # equal sets stand as one, by their smallest identifier
    # (small tables are written before they are joined: Spark can split a hot key of a join between plain exchanges only)
    first = stored(members.where("n > 0 AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "first")
    # most rows stand for themselves: only those of sets that occur again have to meet the table of representatives
    named = features.where("n > 0 AND id IS NOT NULL").select("id", "prefix", (F.col("n") * TYPICAL + F.col("typical")).alias("size"))
    again = stored(members.where("n > 0 AND id IS NOT NULL").join(first, "digest").where("id <> rep").select("id").union(members.groupBy("id").count().where("count > 1").select("id")), "again")
    copies = marked_ids(again, "id")
    single = copies.without(named, "id").unionByName(copies.within(named, "id").join(first.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"]))
    index = single.select("id", "size", F.explode("prefix").alias("token"))
    tokens = stored(index.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "tokens")
    shared = stored(index.join(tokens, "token").select("token", "id", F.shiftright("size", TYPICAL.bit_length() - 1).alias("n"), (F.col("size") % TYPICAL).alias("typical"), "sets"), "shared")

    # pairs of tokens in few sets, and each set with its tokens' pivots
    together = shared.where(F.col("sets") <= few).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x"))
    pairs = together.select(F.explode(F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, F.size("x")), lambda b: F.struct(a["id"].alias("a"), a["n"].alias("n_a"), b["id"].alias("b"), b["n"].alias("n_b"))))) ).alias("p")).select("p.*")
    pairs = pairs.where("a < b").where(_length_fits(t)).select("a", "b").distinct()
    crowded = shared.where(F.col("sets") > few)
    heads = stored(crowded.groupBy("token").agg(F.max_by("id", F.struct("typical", "id")).alias("pivot")), "heads")
    pivots = crowded.select("token", "id").join(heads, "token").where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()

    def pictured(pairs: DataFrame) -> DataFrame:
        """Pairs whose pictures don't differ by too many bits for similar sets."""
        a, b = (features.where("id IS NOT NULL").select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
        least = F.least(F.size("bits_a"), F.size("bits_b"))
        differ = F.aggregate(F.zip_with(_folded(F.col("bits_a"), least, t.folds), _folded(F.col("bits_b"), least, t.folds), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        total = F.col("n_a") + F.col("n_b")
        return pairs.join(a, "a").join(b, "b").where(_length_fits(t)).where((total - differ) * (den + num) >= total * (2 * num)).select("a", "b").distinct()

    pairs, pivots = stored(pictured(pairs), "pairs"), stored(pivots, "pivots")

    # the texts of the sets in any pair; a table of bits keeps most others out of the shuffle
    need = stored(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(pivots.select("a")).union(pivots.select("b")).distinct(), "need")
    some = marked_ids(need, "id").within(slim.where("id IS NOT NULL"), "id").join(need, "id", "left_semi").dropDuplicates(["id"])
    texts = stored(some.mapInArrow(_other_prefixes(held, words, t), "id long, text string, " + ", ".join(f"prefix{o} array<int>" for o in range(1, ORDERS))), "texts")

    def filtered(pairs: DataFrame) -> DataFrame:
        """Pairs that share prefix tokens in the other orders as well."""
        names = [f"prefix{o}" for o in range(1, ORDERS)]
        a, b = (texts.select(F.col("id").alias(x), *[F.col(p).alias(f"{p}_{x}") for p in names]) for x in "ab")
        both = pairs.join(a, "a").join(b, "b")
        for p in names:
            both = both.where(F.arrays_overlap(f"{p}_a", f"{p}_b"))
        return both.select("a", "b")

    def with_texts(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
        return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")

    near = stored(with_texts(pivots).mapInArrow(_differences(held, words, t), DIFFERENCES), "differences")
    # similar sets with the same pivot, not both linked to it, share one of their first differences
    probes = near.where("token IS NOT NULL").select("pivot", "token", F.col("id").alias("i"), F.col("n").alias("n_a"), F.col("many").alias("many_a"), F.col("place").alias("place_a"), F.col("linked").alias("linked_a"))
    fewer = near.where("token IS NOT NULL AND NOT probe").select("pivot", "token", F.col("id").alias("j"), F.col("n").alias("n_b"), F.col("many").alias("many_b"), F.col("place").alias("place_b"), F.col("linked").alias("linked_b"))
    apart = (F.col("n_a") + F.col("n_b")) * (den - num)  # (den + num) times the most that similar sets differ by
    # what two sets still can share from the first shared difference on, and what they must share
    rest = F.least(F.col("many_a") - F.col("place_a"), F.col("many_b") - F.col("place_b"))
    enough = rest * (2 * (den + num)) >= (F.col("many_a") + F.col("many_b")) * (den + num) - apart
    meet = (
        probes.join(fewer, ["pivot", "token"])
        .where((F.struct("many_b", "j") < F.struct("many_a", "i")) & ~(F.col("linked_a") & F.col("linked_b")))
        .where(((F.col("many_a") - F.col("many_b")) * (den + num) <= apart) & _length_fits(t) & enough)
        .select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    )
    checked = filtered(pairs.union(pictured(meet.distinct())).distinct())
    links = with_texts(checked).mapInArrow(_verify(words, t), "a long, b long")
    edges = stored(links.union(near.where("linked AND token IS NULL").select(F.col("pivot").alias("a"), F.col("id").alias("b"))), "links")
    found = components(edges)
    return (
        members.join(first, "digest", "left").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("id", "n", F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component"))
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``id`` (a number for each identifier), ``text`` of rows, and ``id, name``: which identifier has which number."""
    names = stored(docs.select(F.col(id_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("id", F.monotonically_increasing_id()), "names")
    return docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left").select("id", "text"), names


def classes(docs: DataFrame, words: int, num: int, den: int, id_col: str, text_col: str, few: int) -> DataFrame:
    """As ``set_classes``, with identifiers of any type: those that are no whole numbers are numbered first, and the smallest of a component is told after."""
    if whole_number(docs, id_col):
        return set_classes(docs, words, num, den, id_col, text_col, few)
    rows, names = _numbered(docs, id_col, text_col)
    out = stored(set_classes(rows, words, num, den, "id", "text", few), "classes")
    named = out.join(names, "id", "left")
    least = named.where("id IS NOT NULL").groupBy("component").agg(F.min("name").alias("least"))
    return named.join(least, "component", "left").select(F.col("name").alias("id"), "n", F.col("least").alias("component"))


def ngram_join(docs: DataFrame, words: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id", text_col: str = "text", few: int = FEW) -> DataFrame:
    """The identifier (whole numbers as long, others as they are), ``n_shingles`` and ``component_id`` of every row of ``docs``.

    A null, empty or blank text has no shingles and is its own component; a text with fewer words than a shingle has
    one, its whole sequence. Identifiers are taken to be unique but for repeated rows, which get equal results; a row without identifier
    links nothing and has no component. An empty table gives an empty result; other columns play no part.
    """
    out = classes(docs, words, num, den, id_col, text_col, few)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def drop_similar(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest identifier stays; the columns are those of ``docs``, whatever their names.

    Rows without identifier, text or words stay, and so do repeated rows of an identifier that stays. An empty table stays empty.
    """
    out = classes(docs, words, num, den, id_col, text_col, FEW)
    gone = out.where("id <> component").select("id").distinct()
    key = unused("gone", docs)
    return docs.join(gone.withColumnRenamed("id", key), (F.col(f"`{id_col}`").cast("long") if whole_number(docs, id_col) else F.col(f"`{id_col}`")) == F.col(key), "left_anti")
