"""Removal of byte strings that occur more than once, across all documents.

Every string of LENGTH bytes holds an anchor: the run of GRAM bytes in it with the smallest hash. Equal strings have
equal anchors at equal places, so strings that repeat meet at anchors that repeat, and documents meet in a shuffle by anchor.
What surrounds an anchor, as far as a string with that anchor can reach, is its context. Contexts that are equal as a
whole are repeats and are counted as one. For anchors with different contexts a suffix array decides: contexts
are cut into blocks of bytes at equal distances from the anchor, each block's content becomes a symbol, and
linear grouping sorts the suffixes of all contexts of an anchor at once. Suffixes that share enough symbols with a
neighbour are those at which a repeated string can start; there the strings are compared by a 64-bit hash of their bytes.
An anchor with very many contexts is split further, into its strings, which are counted where they are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import marked_ids
from tessera.llm.common import stored, text_slices, whole_number
from tessera.llm.shingles import U, _mixed, _powers, text_bytes
from tessera.llm.suffix_groups import common_prefixes, suffix_array

LENGTH, GRAM = 400, 128
#: Bytes of a block of a context.
BLOCK = 32
#: Contexts sorted at a time, and of an anchor before it is split into its strings.
AT_ONCE, MANY = 2_000, 5_000
#: Bytes of text hashed at a time.
STRETCH = 1 << 18

_LETTERS = _mixed(np.arange(1, 258, dtype=U) * U(0xE7037ED1A0B428DB))


class Sizes:
    def __init__(self, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK):
        self.length, self.gram, self.block = length, gram, block
        self.left = length - gram  # bytes of a string that can stand before its anchor
        self.width = self.left + length


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums whose differences, times a power, are hashes of any part of ``data``; and those powers."""
    n = len(data)
    up, down = _powers(max(n, STRETCH))
    out = np.zeros(n + 1, dtype=U)
    np.cumsum(_LETTERS[data] * up[:n], out=out[1:])
    return out, down


def _windows_least(key: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    out, span = key, 1
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, z: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: hash and place of each anchor, the hash of its context, and the bytes of that to the left and right."""
    n = len(data)
    sums, down = _sums(data)
    grams = _mixed((sums[z.gram :] - sums[: n - z.gram + 1]) * down[: n - z.gram + 1])
    bits = U(max(1, int(n).bit_length()))
    key = (grams >> bits << bits) | np.arange(len(grams), dtype=U)
    least = _windows_least(key, z.left + 1)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    at = (np.concatenate([least[:1], least[change]]) & ((U(1) << bits) - U(1))).astype(np.int64)
    left, right = np.minimum(at, z.left), np.minimum(n - at, z.length)
    context = _mixed((sums[at + right] - sums[at - left]) * down[at - left] + (left * 1000003 + right).astype(U))
    return grams[at], at, context, left, right


ANCHORS = "anchor long, context long, doc long, mark long, at int, left int, right int, times int"


def _find(z: Sizes):
    """Anchor rows of each text; contexts that repeat within a text become one row, and rows of times 0 tell what they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text", STRETCH):
                out = []
                data, ends = text_bytes(batch.column("text"))
                for doc, mark, a, b in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if b - a < z.length:
                        continue
                    anchor, at, context, left, right = anchors(data[a:b], z)
                    _, first, which, count = np.unique(anchor ^ _mixed(context), return_index=True, return_inverse=True, return_counts=True)
                    times = np.minimum(count, 2)
                    out.append((anchor[first], context[first], np.full(len(first), doc), np.full(len(first), mark), at[first], left[first], right[first], times))
                    again = np.flatnonzero(count[which] > 1)
                    if len(again):  # joined where they overlap
                        start, end = _joined(at[again] - left[again], at[again] + right[again])
                        none = np.zeros(len(start), dtype=U)
                        out.append((none, none, np.full(len(start), doc), np.full(len(start), mark), start, np.zeros_like(start), end - start, np.zeros_like(start)))
                if out:
                    cols = [np.concatenate(x) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c.view(np.int64)) for c in cols[:2]], *[pa.array(c.astype(np.int64)) for c in cols[2:4]], *[pa.array(c.astype(np.int32)) for c in cols[4:]]], [x.split()[0] for x in ANCHORS.split(", ")]
                    )

    return run


def _joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals as disjoint runs, in order; those that touch are one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.concatenate([[True], start[1:] > reach[:-1]]))
    return start[first], reach[np.concatenate([first[1:], [len(start)]]) - 1]


def repeated_starts(group: np.ndarray, contexts: np.ndarray, left: np.ndarray, right: np.ndarray, z: Sizes) -> np.ndarray:
    """Which strings of each context occur in another context of its group at the same distance from the anchor.

    ``contexts`` is a matrix of bytes aligned at the anchor (256: beyond the text). Returns a matrix of booleans, a column for
    each place from ``z.left`` bytes before the anchor to the anchor itself.
    """
    m = len(contexts)
    if m < 2:
        return np.zeros((m, z.left + 1), dtype=bool)
    blocks = z.width // z.block
    up, _ = _powers(max(z.width, STRETCH))
    sums = np.zeros((m, z.width + 1), dtype=U)
    np.cumsum(_LETTERS[contexts] * up[: z.width], axis=1, out=sums[:, 1:])
    # a symbol for the content of each block, its place and its group
    edges = np.arange(blocks + 1) * z.block
    content = _mixed((sums[:, edges[1:]] - sums[:, edges[:-1]]) ^ _mixed(group.astype(U)[:, None] * U(0x9E3779B97F4A7C15) + np.arange(blocks, dtype=U) * U(0xC2B2AE3D27D4EB4F)))
    symbols = np.ones((m, blocks + 1), dtype=np.int64)  # 1 ends each context
    symbols[:, :blocks] = np.unique(content, return_inverse=True)[1].reshape(m, blocks) + 2
    text = symbols.ravel().tolist()
    order = suffix_array(text)
    shared = np.array([*common_prefixes(text, order), 0])
    best = np.zeros(m * (blocks + 1), dtype=np.int64)
    best[order] = np.maximum(shared[:-1], shared[1:])  # what a suffix shares with its nearer neighbour
    best = best.reshape(m, blocks + 1)
    # a string that starts in the block before block j, or right at it, holds so many blocks from j on
    whole = (z.length - z.block + 1) // z.block
    starts = np.arange(z.left + 1)
    can = best[:, -(-starts // z.block)] >= whole
    can &= (starts >= z.left - left[:, None]) & (starts + z.length <= z.left + right[:, None])
    row, at = np.nonzero(can)
    string = _mixed((sums[row, at + z.length] - sums[row, at]) ^ _mixed(group[row].astype(U) * U(0x9E3779B97F4A7C15) + at.astype(U)))
    _, which, count = np.unique(string, return_inverse=True, return_counts=True)
    out = np.zeros((m, z.left + 1), dtype=bool)
    out[row, at] = count[which] > 1
    return out


CONTEXTS = "anchor long, doc long, mark long, at int, left int, right int, times long, bytes binary, crowded boolean"
SPANS = "doc long, mark long, start int, stop int"


def _cut(z: Sizes):
    """The contexts of the anchors listed with each text, and whether the anchor has too many to be sorted at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text"):
                data, ends = text_bytes(batch.column("text"))
                raw = data.tobytes()
                out = [[] for _ in range(9)]
                for doc, mark, base, listed in zip(batch.column("doc").to_pylist(), batch.column("mark").to_pylist(), ends[:-1].tolist(), batch.column("listed").to_pylist(), strict=True):
                    for x in listed:
                        at, left, right = x["at"], x["left"], x["right"]
                        for column, value in zip(out, (x["anchor"], doc, mark, at, left, right, x["times"], raw[base + at - left : base + at + right], x["crowded"]), strict=True):
                            column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], [x.split()[0] for x in CONTEXTS.split(", ")])

    return run


def _spans(doc, mark, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(mark, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], ["doc", "mark", "start", "stop"])


def _matrix(rows: list[tuple], z: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    contexts = np.full((len(rows), z.width), 256, dtype=np.int16)
    for i, (_, _, _, _, left, _, _, data) in enumerate(rows):
        contexts[i, z.left - left : z.left - left + len(data)] = np.frombuffer(data, dtype=np.uint8)
    return contexts, np.array([r[4] for r in rows]), np.array([r[5] for r in rows])


def _resolve(z: Sizes):
    """Rows come ordered by anchor; whole groups are taken together, several small ones at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        contexts, left, right = _matrix(rows, z)
        group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)[1]
        found = repeated_starts(group, contexts, left, right, z)
        hit = np.flatnonzero(found.any(axis=1) & (np.array([r[6] for r in rows]) == 1))
        low, high = found[hit].argmax(axis=1), z.left - found[hit][:, ::-1].argmax(axis=1)
        at = np.array([rows[i][3] for i in hit], dtype=np.int64)
        # all these strings hold the anchor, so together they are one run
        return _spans([rows[i][1] for i in hit], [rows[i][2] for i in hit], at - z.left + low, at - z.left + high + z.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= AT_ONCE and row[0] != rows[-1][0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    return run


def _strings(z: Sizes):
    """Every string of a context that can have this anchor, as two hashes, with its document and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                rows = list(zip(*(c.to_pylist() for c in whole.slice(i, 500).columns), strict=True))
                contexts, left, right = _matrix(rows, z)
                up, _ = _powers(max(z.width, STRETCH))
                starts = np.arange(z.left + 1)
                row, at = np.nonzero((starts >= z.left - left[:, None]) & (starts + z.length <= z.left + right[:, None]))
                hashes = []
                for salt in (U(0), U(0x5851F42D4C957F2D)):
                    sums = np.zeros((len(rows), z.width + 1), dtype=U)
                    np.cumsum(_mixed(_LETTERS[contexts] ^ salt) * up[: z.width], axis=1, out=sums[:, 1:])
                    anchor = np.array([r[0] for r in rows], dtype=np.int64).view(U)
                    hashes.append(_mixed((sums[row, at + z.length] - sums[row, at]) ^ _mixed(anchor[row] + at.astype(U))).view(np.int64))
                doc, mark, place, times = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3, 6))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[0]), pa.array(hashes[1]), pa.array(doc[row]), pa.array(mark[row]), pa.array((place[row] - z.left + at).astype(np.int32)), pa.array(times[row])], ["h1", "h2", "doc", "mark", "start", "times"])

    return run


def keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text``, and ``doc`` and ``mark``, which name the row: its identifier (a hash of it if it is no whole number, of the text where there is none) and a hash of its text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.col(id_col).cast("long") if whole_number(docs, id_col) else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(own, F.xxhash64(text)).alias("doc"), F.xxhash64(F.lit("mark"), text).alias("mark"))


def repeated_spans(rows: DataFrame, z: Sizes, many: int = MANY) -> DataFrame:
    """``doc``, ``mark``, ``start``, ``stop`` of parts of the texts of ``rows`` (from ``keys``) that are covered by repeated strings; they may overlap."""
    found = stored(rows.select("doc", "mark", "text").where(F.octet_length("text") >= z.length).mapInArrow(_find(z), ANCHORS), "anchors")
    here = found.where("times = 0").select("doc", "mark", F.col("at").alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    single = found.where("times > 0")
    # written before it is joined: Spark can split a hot anchor of a join between plain exchanges only
    more = stored(single.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor"), "repeated")
    shared = stored(single.join(more, "anchor"), "shared")
    contexts = stored(shared.groupBy("anchor", "context").agg(F.sum("times").cast("long").alias("times"), F.min(F.struct("doc", "mark", "at", "left", "right")).alias("first")), "contexts")
    whole = shared.join(contexts.where("times > 1").select("anchor", "context"), ["anchor", "context"]).select("doc", "mark", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("stop"))
    several = stored(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1"), "several")
    # one place of each context whose anchor has others
    listed = contexts.join(several, "anchor").select("anchor", "times", (F.col("contexts") > many).alias("crowded"), "first.*")
    by = stored(listed.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "at", "left", "right", "times", "crowded")).alias("listed")), "listed")
    texts = marked_ids(by, "doc").within(rows.select("doc", "mark", "text"), "doc").join(by, ["doc", "mark"]).dropDuplicates(["doc", "mark"])
    cut = stored(texts.mapInArrow(_cut(z), CONTEXTS), "cut")
    small, crowded = (cut.where(c).drop("crowded") for c in ("NOT crowded", "crowded"))
    # a real exchange: right after a join by anchor Spark would leave it out, and could have split a hot anchor's rows over tasks
    solved = small.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_resolve(z), SPANS)
    out = here.unionByName(whole).unionByName(solved)
    if not crowded.isEmpty():
        strings = stored(crowded.mapInArrow(_strings(z), "h1 long, h2 long, doc long, mark long, start int, times long"), "strings")
        again = strings.groupBy("h1", "h2").agg(F.sum("times").alias("n")).where("n > 1").select("h1", "h2")
        out = out.unionByName(strings.where("times = 1").join(again, ["h1", "h2"]).groupBy("doc", "mark", "start").agg(F.max(F.col("start") + z.length).alias("stop")).select("doc", "mark", "start", "stop"))
    return out


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept bytes of each text, and the runs taken out."""
    for whole in batches:
        for batch in text_slices(whole, "text"):
            kept, runs = [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                start, stop = _joined(np.array([x["start"] for x in spans]), np.array([x["stop"] for x in spans]))
                edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                runs.append([{"start": a, "stop": b} for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
            removed = pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.int64()), pa.array(kept, pa.binary()), removed], ["id", "n_bytes", "kept", "removed"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """The identifier, ``n_bytes``, ``kept`` (binary) and ``removed`` (array of start and stop) of every row.

    Each byte that a string of ``length`` bytes covers which also starts anywhere else goes; strings are those of the input. A null text
    is empty; a text shorter than ``length`` stays; of repeated rows all go, with or without identifier; rows that share an identifier
    but not the text are rows of their own. Identifiers may be of any type. An empty table gives an empty result; other columns play no part.
    """
    z = Sizes(length, gram, block)
    rows = keys(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    # pieces of runs are joined per document; a document has no more of them than bytes
    spans = stored(repeated_spans(rows, z, many).groupBy("doc", "mark").agg(F.collect_set(F.struct("start", "stop")).alias("spans")), "spans")
    touched = marked_ids(spans, "doc")

    removed = "array<struct<start:int,stop:int>>"
    maybe = touched.within(rows, "doc").join(spans, ["doc", "mark"], "left")
    changed = maybe.where("spans IS NOT NULL").select("id", "text", "spans").mapInArrow(_remove, f"id {kind}, n_bytes long, kept binary, removed {removed}")
    same = touched.without(rows, "doc").select("id", "text").union(maybe.where("spans IS NULL").select("id", "text"))
    same = same.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").cast("binary").alias("kept"), F.array().cast(removed).alias("removed"))
    return changed.unionByName(same).withColumnRenamed("id", id_col)
