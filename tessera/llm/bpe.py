"""Byte-level BPE encoding and decoding of whole texts, in overlapping chunks.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own, in parallel, from a place that need
not be a true pre-token boundary. Pre-tokenisation has no memory: two runs that agree on one boundary agree on all
that follow. So where the tail of one chunk and the head of the next share a boundary, the next chunk takes over,
and each chunk encodes just the pieces between its own two such places. Concatenated in order these ids are those
of the whole text. Texts of one chunk need no stitching and no shuffle. If two chunks share no boundary in their
overlap (one pre-token longer than the overlap), that text alone is pre-tokenised in one go.
Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import let_go, text_slices

#: Characters of a chunk, and of the part that it shares with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: The longest look-ahead of the pattern: a boundary this near to the end of a chunk may move.
MARGIN = 4
#: A worker forgets its pieces beyond so many.
PIECES = 200_000
VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern_text() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class _Pieces(dict):
    """Ids (as bytes of 32-bit numbers) by pre-token; what is missing is encoded."""

    def __init__(self, core):
        self.core = core

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = np.array(self.core.encode_single_piece(piece.encode("utf-8", "surrogatepass")), dtype="<i4").tobytes()
        return ids


#: The letters, digits and white space among the first 256 characters.
_LETTERS, _DIGITS, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"


class Coder:
    """What a worker keeps: the ranks, the pattern, and the pieces seen so far."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = pattern_text()
        core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.pieces = _Pieces(core)
        # The two libraries may know different versions of Unicode. Letters and digits that only the newer one
        # knows are taken out of the classes here, so that both split alike.
        single = {bytes([i]): i for i in range(256)}
        for name in ("L", "N"):
            other = tiktoken.Encoding("class", pat_str=rf"\p{{{name}}}", mergeable_ranks=single, special_tokens={})
            known = regex.findall(rf"\p{{{name}}}", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000)))))
            extra = [c for c in known if not other.encode_ordinary(c)]
            pattern = _without(pattern, name, extra)
        self.any = regex.compile(pattern, regex.V1)
        # texts of the first 256 characters, most of them, take the same pattern with its classes written out
        narrow = pattern_text().replace(r"[^\s\p{L}\p{N}]", f"[^{_SPACE}{_LETTERS}{_DIGITS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_DIGITS}]").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.narrow = re.compile(narrow)

    def splitter(self, text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any
        return self.narrow

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.splitter(text).findall(text)))

    def rest(self, over: bool = False) -> None:
        if over or len(self.pieces) > PIECES:
            self.pieces.clear()
        if over:
            let_go()


def _without(pattern: str, name: str, extra: list[str]) -> str:
    if not extra:
        return pattern
    spans, start = [], ord(extra[0])
    for a, b in zip(extra, [*extra[1:], None], strict=True):
        if b is None or ord(b) != ord(a) + 1:
            spans.append((start, ord(a)))
            start = ord(b) if b else 0
    gone = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--[{gone}]]")


class Tokens:
    """The bytes of every id; all that decoding needs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes_of = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = self.starts[ids] - (ends - lengths)
        return self.bytes_of[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, lengths)]


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def _lists(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), dtype=kind.to_pandas_dtype(), count=int(ends[-1])), type=kind))


def _id_lists(rows: list[bytes]) -> pa.ListArray:
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(x) // 4 for x in rows], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))


def _encoder(path: str, text_col: str):
    """Replaces the text of each row (from ``__from`` to ``__to``, if there) by ``__ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            for batch in text_slices(whole, text_col):
                names = batch.schema.names
                texts = batch.column(text_col).to_pylist()
                if "__from" in names:
                    a, b = batch.column("__from").to_pylist(), batch.column("__to").to_pylist()
                    texts = [t[i:j] for t, i, j in zip(texts, a, b, strict=True)]
                ids = _id_lists([own.encode(t or "") for t in texts])
                own.rest()
                keep = [n for n in names if n not in (text_col, "__from", "__to")]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], ids], [*keep, "__ids"])
        own.rest(over=True)

    return run


def boundaries(own: Coder, text: str, last: bool) -> list[int]:
    """Offsets where a pre-token starts, as far as no text beyond the chunk can move them."""
    limit = len(text) if last else len(text) - MARGIN
    return [m.start() for m in own.splitter(text).finditer(text) if m.start() <= limit]


def _marker(path: str, chunk: int, overlap: int):
    """Adds ``__head`` and ``__tail``: boundaries in the part shared with the chunk before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for whole in batches:
            for batch in text_slices(whole, "__text"):
                heads, tails = [], []
                for t, k, n in zip(*(batch.column(c).to_pylist() for c in ("__text", "__chunk", "__chunks")), strict=True):
                    found = boundaries(own, t, k == n - 1)
                    heads.append([k * chunk + x for x in found if x < overlap])
                    tails.append([k * chunk + x for x in found if chunk <= x < chunk + overlap])
                yield pa.RecordBatch.from_arrays([*batch.columns, _lists(heads, pa.int64()), _lists(tails, pa.int64())], [*batch.schema.names, "__head", "__tail"])

    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """The identifier, ``n_chunks`` and ``token_ids`` (array of int) of every row of ``docs``.

    With ``decode`` also ``decoded``, what the ids decode to; texts of one chunk are decoded by the worker that encoded them.
    A null text counts as empty and has no ids; repeated rows give repeated results; an empty table gives an empty
    result; other columns play no part, whatever their names.
    """
    path = path or vocabulary_path()
    slim = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kind = slim.schema["__id"].dataType.simpleString()
    long = F.length("__text") > chunk
    encoder, decoder = _encoder(path, "__text"), _decoder(path, "__ids")
    more = ["decoded"] * decode
    short = slim.where(~long).mapInArrow((lambda batches: decoder(encoder(batches))) if decode else encoder, f"__id {kind}, __ids array<int>" + ", decoded binary" * decode).select("__id", F.lit(1).alias("__chunks"), "__ids", *more)

    # the few long texts: repeated rows are worked on once
    texts = slim.where(long).groupBy("__id", "__text").agg(F.count(F.lit(1)).alias("__times"))
    count = F.ceil(F.length("__text") / chunk).cast("int")
    cut = texts.withColumn("__chunks", count).withColumn("__key", F.xxhash64("__text")).withColumn("__parts", F.expr(f"transform(sequence(0, __chunks - 1), i -> substring(__text, i * {chunk} + 1, {chunk + overlap}))"))
    parts = cut.select("__id", "__key", "__times", "__chunks", F.posexplode("__parts").alias("__chunk", "__text"))
    marked = parts.mapInArrow(_marker(path, chunk, overlap), f"__id {kind}, __key bigint, __times bigint, __chunks int, __chunk int, __text string, __head array<bigint>, __tail array<bigint>")
    by = Window.partitionBy("__id", "__key").orderBy("__chunk")
    joined = marked.withColumn("__own", F.when(F.col("__chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("__head", F.lag("__tail").over(by)))))
    placed = joined.withColumn("__next", F.when(F.col("__chunk") == F.col("__chunks") - 1, F.lit(-1)).otherwise(F.lead("__own").over(by))).withColumn("__broken", F.max(F.col("__own").isNull()).over(Window.partitionBy("__id", "__key")))
    start = F.col("__chunk") * chunk
    whole = placed.where(~F.col("__broken")).select(
        "__id", "__key", "__times", "__chunks", "__chunk", "__text", (F.col("__own") - start).cast("int").alias("__from"), F.when(F.col("__next") < 0, F.length("__text")).otherwise((F.col("__next") - start).cast("int")).alias("__to")
    )
    # no shared boundary: put the text together again and take it in one go
    again = (
        placed.where("__broken").groupBy("__id", "__key", "__times", "__chunks").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", F.substring("__text", 1, chunk).alias("t")))), lambda x: x["t"]), "").alias("__text"))
        .select("__id", "__key", "__times", "__chunks", F.lit(0).alias("__chunk"), "__text", F.lit(0).alias("__from"), F.length("__text").alias("__to"))
    )
    pieces = whole.unionByName(again).mapInArrow(_encoder(path, "__text"), f"__id {kind}, __key bigint, __times bigint, __chunks int, __chunk int, __ids array<int>")
    ids = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__ids"))), lambda x: x["__ids"]))
    stitched = pieces.groupBy("__id", "__key", "__times", "__chunks").agg(ids.alias("__ids"))
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__times")))
    if decode:
        stitched = decode_ids(stitched, "__ids", path)
    stitched = stitched.withColumn("__k", times).select("__id", "__chunks", "__ids", *more)
    return short.unionByName(stitched).select(F.col("__id").alias(id_col), F.col("__chunks").alias("n_chunks"), F.col("__ids").alias("token_ids"), *more)


def _decoder(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                texts = [own.decode(x.values.to_numpy()).tobytes() if x.is_valid else None for x in batch.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, "decoded"])
        let_go()

    return run


def decode_ids(encoded: DataFrame, ids_col: str = "token_ids", path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of the ids, one after the other; null for null ids."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return encoded.drop("decoded").mapInArrow(_decoder(path or vocabulary_path(), ids_col), f"{kinds}, decoded binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Encode, decode, and show both as digests (with ``keep_ids`` beside the ids)."""
    out = encode_documents(docs, id_col, text_col, path, decode=True)
    shown = [id_col, F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_chunks"]
    return out.select(*shown, *["token_ids"] * keep_ids)
