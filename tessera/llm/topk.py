"""Exact top-k by inner product, with sequential access only.

The vectors are dealt into blocks by a hash of their identifier. Within a block every component has a list of the
vectors sorted by it, built once. For a query the lists are read in step, from the end that adds most. Every vector
has a lower bound (what has been read of it, and the least that each unread component can add) and an upper bound (that,
and for each unread component the value at which its list stands). When no vector outside the k best can qualify any
more, bounds are no longer kept; reading goes on until the scores of those left are complete. No vector is ever fetched:
scores are sums of what the lists have told. The block's winners of each query meet in one small ranking per query.
The queries are a stated set (identifiers divisible by a number). They are packed into blocks as well, and each
block of queries meets each block of vectors once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block, and queries of a block.
BLOCK, QUERIES = 4096, 2048
SCALE = 1024


@dataclass
class Reads:
    """What a search has cost: entries read of all lists together, how deep the lists stood when outsiders were out, and who was left."""

    entries: int = 0
    depth: int = 0
    left: int = 0


class Lists:
    """The vectors of a block as one sorted list for each component; nothing else of them is kept."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        vectors = vectors[order]
        self.n, self.d = vectors.shape
        up = np.argsort(vectors, axis=0, kind="stable").T
        self.order = np.stack([up, up[:, ::-1]])  # ascending, descending; component; place in the list
        self.values = np.stack([np.take_along_axis(vectors.T, o, axis=1) for o in self.order]).astype(np.float64)
        # which entry of a list has been read is told by its place; this never gives a value
        self.place = np.empty((self.n, self.d), dtype=np.int32)
        self.place[up, np.arange(self.d)[:, None]] = np.arange(self.n, dtype=np.int32)

    def top(self, query: np.ndarray, own_id: int, k: int, reads: Reads | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and scores of the best k, without the query's own row; ties to the smaller identifier."""
        n, used, reads = self.n, np.flatnonzero(query), reads or Reads()
        can = self.ids != own_id
        score = np.zeros(n)
        if len(used) and can.any():
            # a list is read from the end that adds most: from the top where the query's component is positive
            end = (query[used] > 0).astype(np.int64)
            place = self.place if len(used) == self.d else self.place[:, used]
            at, to, q = 0, max(1, n // 16), query[used].astype(np.float64)[:, None]
            least = self.values[end, used, n - 1][:, None] * q  # what an unread component adds at the very least
            slack = 1e-4 * np.abs(self.values[end, used, 0][:, None] * q).sum() + 1  # covers the rounding of the products below
            open_ = can.sum() > k
            while at < n:
                adds = self.values[end, used, at:to] * q
                score += np.bincount(self.order[end, used, at:to].ravel(), weights=adds.ravel(), minlength=n)
                reads.entries += adds.size
                if open_ and to < n:
                    unread = np.where(end == 1, place < n - to, place >= to).astype(np.float32)
                    bounds = unread @ np.hstack([least, adds[:, -1:]]).astype(np.float32)
                    low, high = score + bounds[:, 0] - slack, score + bounds[:, 1] + slack
                    can &= high >= np.partition(low[can], -k)[-k]
                    open_ = can.sum() > k
                    reads.depth = to
                if not open_:  # outsiders are out: read on until those left are complete
                    deepest = np.where(end == 1, n - place[can], place[can] + 1).max()
                    if deepest <= to:
                        break
                # twice as deep each time; beyond the middle half of what is left, since bounds of many dense components decide late
                rest = n - to
                at, to = to, 2 * to if 2 * to < rest else n if rest <= n // 64 else n - rest // 2
            reads.depth = reads.depth if not open_ else n
        left = np.flatnonzero(can)
        reads.left = len(left)
        exact = score[left].astype(np.int64)
        best = np.lexsort((self.ids[left], -exact))[:k]
        return left[best], exact[best]


def _stack(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _searcher(k: int):
    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(vectors) and len(queries):
            width = max(max(map(len, vectors["v"])), max(map(len, queries["v"])))
            lists = Lists(vectors["id"].to_numpy(np.int64), _stack(vectors["v"], width))
            for own, q in zip(queries["id"].to_numpy(np.int64), _stack(queries["v"], width), strict=True):
                at, scores = lists.top(q, own, k)
                found.append((np.full(len(at), own), lists.ids[at], scores))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return search


def scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v`` (array of long): floor(1024 x) of each component; vectors with a component that is null or not finite go."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for each row whose identifier is divisible by ``every``.

    Components are scaled to integers, so scores are exact as long as they fit 2**53. Candidates are all rows but those with the
    query's own identifier; ties go to the smaller identifier. Vectors that are null or hold null or
    non-finite components take no part, neither do null identifiers; a shorter vector counts as padded with zeros; repeated rows are repeated
    candidates, but one query. Fewer than k candidates are all returned; an empty table gives an empty result.
    """
    rows = scaled(vectors, id_col, vector_col)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id"])
    n = vectors.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // (every * query_block)))
    # each block of queries meets each block of vectors: vectors are copied once per block of queries, and back
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    sets = asked.withColumn("q", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = dealt.groupBy("b", "q").cogroup(sets.groupBy("b", "q")).applyInPandas(_searcher(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
