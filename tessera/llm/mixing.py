"""Mixing sources to target weights by Poisson replication (DataFrame operations only).

Every source (or the pool of all sources without a weight of their own) gets a mean repetition rate: its target
share of the output bytes over its share of the input bytes. A document's count is the inverse of the Poisson
distribution with that mean at a number in [0, 1) hashed from the seed and the document's identifier. The document
is exploded by its count, and the copies are shuffled globally by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbered

#: Target shares for the registered query and the pipeline; every other source belongs to REST.
WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05, "src4": 0.05}
REST = 0.50
#: Bytes of the output over bytes of the input.
SCALE = 1.0
SEED = 20240501
#: Uniform numbers have so many bits.
BITS = 52
#: Copies of one row that one task makes.
AT_ONCE = 1024


def uniform_bits(*parts: Column) -> Column:
    """A long in [0, 2**52) hashed from the parts."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("long")


def poisson_steps(rate: float) -> tuple[int, list[float]]:
    """The first count that a number of 52 bits can draw (0 aside), and the distribution function from there on until it can't be told from 1.

    Together they hold every value that the inverse can return, so nothing is cut off; their number grows with the
    root of the rate, not with the rate.
    """
    first = max(0, int(rate - 40 * math.sqrt(rate))) if rate > 100 else 0
    low, top = 2.0 ** -(BITS + 1), 1.0 - 2.0 ** -(BITS + 1)
    steps, total, k = [], 0.0, first
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        if total >= top or (k > rate and len(steps) > 1 and total == steps[-1]):
            return first, steps
        if total < low:
            first = k + 1
        else:
            steps.append(total)
        k += 1


def rates(docs: DataFrame, weights: dict[str, float], rest: float, scale: float, source_col: str, text_col: str) -> dict[str | None, float]:
    """Mean repetition rate by source; the key None stands for all sources without a weight.

    One row per weight comes to the driver, however many sources the documents have.
    """
    pool = F.when(F.col(source_col).isin(list(weights)), F.col(source_col)) if weights else F.lit(None).cast("string")
    sizes = {r["s"]: int(r["b"] or 0) for r in docs.groupBy(pool.alias("s")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).alias("b")).collect()}
    total, all_weights = sum(sizes.values()), sum(w for s, w in [*weights.items(), (None, rest)] if sizes.get(s))
    out = {}
    for s, w in [*weights.items(), (None, rest)]:
        size = sizes.get(s, 0)
        out[s] = scale * (w / all_weights) * total / size if size and all_weights > 0 else 0.0
    return out


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float] = WEIGHTS,
    rest: float = REST,
    scale: float = SCALE,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with each row repeated by its Poisson count, in a globally shuffled order.

    Adds ``__rate``, ``__copies``, ``__copy`` (from 1) and ``__order`` (the key of the shuffle); columns of these names are replaced. A null
    or unlisted source belongs to the pool of the rest; null and empty texts weigh nothing but are drawn like others; a source whose
    texts are all empty has rate 0; rows with the same identifier draw the same count; very long texts are rows like any other; an
    empty table stays empty.
    """
    by = rates(docs, weights, rest, scale, source_col, text_col)
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = uniform_bits(F.lit(str(seed)), ident) / F.lit(float(2**BITS))

    def pick(value) -> Column:
        out = None
        for s in weights:
            test = F.col(source_col) == s
            out = F.when(test, value(by[s])) if out is None else out.when(test, value(by[s]))
        return value(by[None]) if out is None else out.otherwise(value(by[None]))

    def count(rate: float) -> Column:
        first, steps = poisson_steps(rate)
        above = F.size(F.filter(F.array(*[F.lit(x) for x in steps]).cast("array<double>"), lambda x: x <= F.col("__u")))
        return F.when(F.col("__u") > 0, above + first).otherwise(0) if first else above

    drawn = docs.withColumn("__u", u).withColumn("__copies", pick(count)).withColumn("__rate", pick(F.lit)).drop("__u").where("__copies > 0")
    most = max(first + len(steps) for first, steps in map(poisson_steps, by.values()))
    if most > AT_ONCE:  # rows with very many copies are dealt out in parts, so that no task makes them all
        drawn = drawn.withColumn("__part", F.explode(F.sequence(F.lit(0), F.floor((F.col("__copies") - 1) / AT_ONCE).cast("int")))).repartition(F.xxhash64(ident, "__part"))
        numbers = F.sequence(F.col("__part") * AT_ONCE + 1, F.least(F.col("__copies"), (F.col("__part") + 1) * AT_ONCE))
    else:
        numbers = F.sequence(F.lit(1), F.col("__copies"))
    each = drawn.withColumn("__copy", F.explode(numbers)).drop("__part")
    order = uniform_bits(F.lit("order"), F.lit(str(seed)), ident, F.col("__copy").cast("string"))
    return each.withColumn("__order", order).repartitionByRange("__order").sortWithinPartitions("__order")


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The mixed documents with the columns of ``docs``, whatever their names; nulls, ties and empty tables as in ``poisson_mix``."""
    own = Numbered(docs)
    return own.back(poisson_mix(own.rows, id_col=own.of(id_col), source_col=own.of(source_col), text_col=own.of(text_col), **how))
