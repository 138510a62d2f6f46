"""Whitening of embeddings by the leading components of their covariance.

Entries are scaled to integers. One pass adds up count and sums, exactly; a second adds up products of centred entries,
one d x d matrix for each partition, whose rows Spark sums by key. The matrix of the whole table, of d * d doubles whatever
the number of rows, is solved on the driver (``tridiagonal``). Mean and components are broadcast, a third pass measures the
covariance of the projections, and a last one returns them. Nothing but matrices of the dimension leaves the partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbered, let_go
from tessera.llm.tridiagonal import EPS, leading

SCALE, SHIFT = 64, 1_000_000
#: Vectors of more entries are refused: the driver holds a few square matrices of that size.
MOST_DIMENSIONS = 2048
#: Rows that a task turns into numbers at a time.
ROWS = 2048
LONG = 1 << 63


def integers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that take part, and their scaled entries, ``width`` of each (None: as many as the longest has).

    A vector that is null or holds an entry that is null, not finite, or 2**56 and more in size takes no part; a shorter one counts
    as padded with zeros.
    """
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), dtype=np.float64)[offsets[0] : offsets[-1]]
    with np.errstate(invalid="ignore"):
        bad = np.concatenate([[0], np.cumsum(~(np.abs(flat) < 2.0**56))])
    at = offsets - offsets[0]
    kept = np.flatnonzero(np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]]))
    sizes, begin = sizes[kept], at[:-1][kept]
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.full((len(kept), width), SHIFT, dtype=np.int64)
    row = np.repeat(np.arange(len(kept)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] += np.floor(SCALE * flat[np.repeat(begin, sizes) + place]).astype(np.int64)
    return kept, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def totals(vectors: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums of the scaled entries; ``vectors`` has the one column ``v``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(0, dtype=object)
        for batch in _slices(batches):
            kept, x = integers(batch.column("v"))
            if x.shape[1] > MOST_DIMENSIONS:
                raise ValueError(f"a vector of {x.shape[1]} entries; at most {MOST_DIMENSIONS} are supported")
            n += len(kept)
            own = x - SHIFT
            # a sum of so many longs may leave the range of one
            own = own.sum(axis=0) if np.abs(own).max(initial=0) < LONG // (2 * ROWS) else own.astype(object).sum(axis=0)
            if len(own) > len(sums):
                sums = np.concatenate([sums, np.zeros(len(own) - len(sums), dtype=object)])
            sums[: len(own)] += own.astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(sums))], pa.int32()), pa.array([str(n), *map(str, sums)])], ["dim", "total"])

    found = vectors.mapInArrow(count, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    by = {r["dim"]: int(r["total"]) for r in found}
    n = by.pop(-1, 0)
    return n, [by.get(i, 0) + n * SHIFT for i in range(max(by, default=-1) + 1)]


def gram(vectors: DataFrame, width: int, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all rows of the products of each two of the ``width`` columns that ``rows_of`` makes of a batch."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((width, width)), False
        for batch in _slices(batches):
            y = rows_of(batch)
            if len(y):
                total += y.T @ y
                seen = True
        let_go()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([total[i, i:] for i in range(width)], pa.list_(pa.float64()))], ["i", "products"])

    rows = vectors.mapInArrow(products, "i int, products array<double>").select("i", F.posexplode("products").alias("j", "p"))
    found = rows.groupBy("i", "j").agg(F.sum("p").alias("p")).toArrow()
    i, j, p = (found.column(c).to_numpy() for c in ("i", "j", "p"))
    out = np.zeros((width, width))
    out[i, i + j] = p
    out[i + j, i] = p
    return out


@dataclass
class Whitening:
    """A fitted model. Entries ``x`` less ``nearest`` are exact; less ``rest`` as well they are centred."""

    n: int
    sums: list[int]
    nearest: np.ndarray
    rest: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.nearest).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of ``n * x - sum``, exactly; None beyond the range of a long."""
        far = int(np.abs(x - self.nearest).max(initial=0)) + 1
        if (far * self.n) ** 2 * max(1, self.width) < LONG:
            own = self.n * (x - self.nearest) - np.array([s - self.n * int(m) for s, m in zip(self.sums, self.nearest, strict=True)], dtype=np.int64)
            return (own**2).sum(axis=1).tolist()
        out = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [v if v < LONG else None for v in out]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of the component's variance; NaN where a component has none."""
        root = np.sqrt(np.where(self.values > EPS * self.width * self.values.max(initial=0), self.values, np.nan))
        return self.centred(x) @ self.components.T / root


def fit(vectors: DataFrame, k: int = 32) -> Whitening:
    """The model of all vectors in the one column ``v`` of ``vectors``."""
    n, sums = totals(vectors)
    nearest = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, nearest, strict=True)])
    model = Whitening(n, sums, nearest, rest, np.zeros((0, len(sums))), np.zeros(0), 0.0)
    if n and sums:
        covariance = gram(vectors, len(sums), lambda batch: model.centred(integers(batch.column("v"), len(sums))[1])) / n
        model.values, model.components = leading(covariance, k)
        model.values, model.trace = np.maximum(model.values, 0.0), float(np.trace(covariance))
    return model


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry, in size, of the covariance of the whitened vectors less the identity."""
    live = np.flatnonzero(model.values > EPS * model.width * model.values.max(initial=0))
    if not model.n or not len(live):
        return None
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> np.ndarray:
        z = held.value.whitened(integers(batch.column("v"), held.value.width)[1])[:, live]
        return np.hstack([z, np.ones((len(z), 1))])

    both = gram(vectors, len(live) + 1, rows) / model.n
    # the projections are of centred vectors: what is left of their mean is rounding
    mean = both[-1, :-1]
    return float(np.abs(both[:-1, :-1] - np.outer(mean, mean) - np.eye(len(live))).max())


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each of the ``k`` leading components (all, if the dimension is less).

    Columns: the identifier, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``. The model is fitted on
    all vectors. Vectors that are null or hold an entry that is null, not finite, or 2**56 and more in size take no part; a shorter vector counts as padded with
    zeros; repeated rows and null identifiers take part and are returned, an empty table gives an empty result. A
    component without variance (vectors in fewer directions than entries, a single vector, all alike) has a null ``whitened`` and plays no part in
    ``identity_error``; without any variance ``explained`` and ``identity_error`` are null. ``deviation`` is null beyond the range of a long.
    Other columns play no part, whatever their names. More than ``MOST_DIMENSIONS`` entries are an error.
    """
    own = Numbered(vectors)
    rows = own.rows.select(F.col(own.of(id_col)).alias("id"), F.col(own.of(vector_col)).cast("array<double>").alias("v"))
    model = fit(rows.select("v"), k)
    error = identity_error(rows.select("v"), model)
    held = vectors.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        width = len(m.values)
        explained = m.values / m.trace if m.trace > 0 else np.full(width, np.nan)
        for batch in _slices(batches):
            kept, x = integers(batch.column("v"), m.width)
            many = len(kept) * width
            if many:
                z = m.whitened(x).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(np.repeat(kept, width))), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(kept))), pa.array(np.full(many, m.n, dtype=np.int64)),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(kept)), width))), pa.array(z, mask=np.isnan(z)),
                        pa.array(np.tile(explained, len(kept)), mask=np.tile(np.isnan(explained), len(kept))), pa.array([error] * many, pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        let_go()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double").withColumnRenamed("id", id_col)
