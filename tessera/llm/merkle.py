"""A Merkle tree over a dataset: a leaf for each row, a tree for each group of rows, and a tree over the groups.

Rows are numbered within their group by a range sort of digests, so that no group is gathered anywhere. Each level is one aggregation by
(group, number / fanout): conditional aggregates spread the children of a parent into ``fanout`` columns. Concatenated, the columns hash to
the parent; concatenated without the own column they are a child's siblings. Proofs are handed down: each level of parents meets what
its own parents carry and deals it out to the children, so a row's path is put together once for the ``fanout`` rows that share it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import Numbered, ascii_lower, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:binary,right:binary>>"


def digest(*parts: Column) -> Column:
    """SHA-256 of the concatenation of strings, as 32 bytes."""
    return F.unhex(F.sha2(F.concat_ws("", *parts), 256))


def shown(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(*values: Column) -> Column:
    """Each value as ``-`` if null, else as its number of UTF-8 bytes, a colon and the value."""
    told = [F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (x.cast("string") for x in values)]
    return digest(*told)


def fold(path: Column, first: Column) -> Column:
    """The digest (hex) at the upper end of a path, from ``first`` (bytes) at its lower end."""
    return F.aggregate(path, shown(first), lambda h, p: F.sha2(F.concat(shown(p["left"]), h, shown(p["right"])), 256))


def proof(path: Column) -> Column:
    """SHA-256 (hex) of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(shown(p["left"]), shown(p["right"]))), ""), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``i`` (from 0, by ``order`` within ``group``) and ``n``, the size of the group.

    A range sort cuts groups anywhere; identifiers that grow along a sorted partition give the place within it, and a table
    with a row for each partition and group says where a partition begins within the group.
    """
    placed = stored(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at", F.monotonically_increasing_id()), name).withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = stored(runs.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy(group)).alias("n")), f"{name}-runs")
    return placed.join(runs, [group, "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


@dataclass
class Levels:
    """Parents of every level, stored: ``g``, ``i``, ``n`` (children of the group on that level), ``s0`` and so on, ``d`` (the parent's digest)."""

    parents: list[DataFrame]
    fanout: int

    def tops(self) -> DataFrame:
        """``g``, ``d`` and ``level`` of the last parent of each group."""
        ended = [p.where(F.col("n") <= self.fanout).select("g", "d", F.lit(k).alias("level")) for k, p in enumerate(self.parents)]
        out = ended[0]
        for e in ended[1:]:
            out = out.unionByName(e)
        return out


def climb(nodes: DataFrame, name: str, fanout: int = FANOUT) -> Levels:
    """The levels above ``nodes``: ``g``, ``i``, ``n``, ``d`` and whatever else, which the first level keeps in its slots.

    A lone node of a group is its own top, without being hashed again.
    """
    largest = nodes.agg(F.max("n")).first()[0]
    parents: list[DataFrame] = []
    while not parents or largest > 1:
        items = [c for c in nodes.columns if c not in ("g", "i", "n")]
        slot = F.pmod("i", F.lit(fanout))
        slots = [F.first(F.when(slot == j, F.struct(*items)), ignorenulls=True).alias(f"s{j}") for j in range(fanout)]
        spread = nodes.groupBy("g", F.floor(F.col("i") / fanout).cast("long").alias("i")).agg(F.first("n").alias("n"), *slots)
        whole = digest(*[shown(F.col(f"s{j}.d")) for j in range(fanout)])
        level = stored(spread.withColumn("d", F.when(F.col("n") == 1, F.col("s0.d")).otherwise(whole)), f"{name}-{len(parents)}")
        parents.append(level)
        largest = -(-largest // fanout)
        nodes = level.where(F.col("n") > fanout).select("g", "i", F.ceil(F.col("n") / fanout).alias("n"), "d")
    return Levels(parents, fanout)


def descend(levels: Levels, tops: DataFrame) -> DataFrame:
    """What the first level's slots hold, with ``path``: from the node up to where ``tops`` (``g``, ``level``, ``path`` and other columns) goes on."""
    given = [c for c in tops.columns if c not in ("g", "level")]
    others = [c for c in given if c != "path"]
    carried: DataFrame | None = None
    empty = F.unhex(F.lit(""))
    for k in range(len(levels.parents) - 1, -1, -1):
        seeds = tops.where(F.col("level") == k).select("g", F.lit(0).cast("long").alias("i"), *given)
        carried = seeds if carried is None else carried.select("g", "i", *given).unionByName(seeds)
        met = levels.parents[k].drop("d").join(carried, ["g", "i"])
        children = []
        for j in range(levels.fanout):
            side = [F.concat(*[F.coalesce(F.col(f"s{x}.d"), empty) for x in r], empty) for r in (range(j), range(j + 1, levels.fanout))]
            step = F.array(F.struct(side[0].alias("left"), side[1].alias("right"))).cast(PATH)
            path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(step, F.col("path")))
            children.append(F.when(F.col(f"s{j}").isNotNull(), F.struct((F.col("i") * levels.fanout + j).alias("i"), F.col(f"s{j}").alias("item"), path.alias("path"))))
        each = met.select("g", *others, F.explode(F.array_compact(F.array(*children))).alias("child"))
        carried = each.select("g", *others, "child.i", "child.item", "child.path")
    return carried


@dataclass
class Tree:
    """``groups``: levels within groups; ``over``: levels over the groups' roots, None for an empty table."""

    groups: Levels | None
    over: Levels | None

    def proofs(self) -> DataFrame:
        """A row for each leaf: ``item`` (its digest ``d``, ``id`` and the columns that ``build`` was given), ``path`` up to ``root``, and ``subroot``."""
        root = self.over.tops().select("g", F.col("d").alias("root"), F.col("level"), F.array().cast(PATH).alias("path"))
        subroots = descend(self.over, root).select(F.col("item.group").alias("g"), F.col("item.d").alias("subroot"), "root", "path")
        tops = stored(self.groups.tops().select("g", "level").join(subroots, "g"), "merkle-tops")
        return descend(self.groups, tops)


def build(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, keep: dict[str, Callable[[dict[str, Column]], Column]] | None = None) -> Tree:
    """The tree of ``docs``. ``keep``: further columns of the leaves, each made from the columns of ``fields`` by name.

    Leaves ascend by identifier within a group, null first, and by digest where it repeats; groups by their bytes, null first. Repeated rows
    are leaves of their own.
    """
    own = Numbered(docs)
    at = {f: F.col(own.of(f)) for f in {*fields, id_col, group_col}}
    group = F.when(at[group_col].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), at[group_col].cast("string")))
    kept = [make(at).alias(c) for c, make in (keep or {}).items()]
    # a salt parts rows that are equal in everything; which of them comes first changes no digest
    rows = own.rows.select(group.alias("g"), at[id_col].alias("id"), leaf(*[at[f] for f in fields]).alias("d"), *kept, F.monotonically_increasing_id().alias("salt"))
    nodes = numbered(stored(rows, "merkle-leaves"), "g", ["id", "d", "salt"], "merkle-sorted").drop("salt")
    if nodes.isEmpty():
        return Tree(None, None)
    groups = climb(nodes, "merkle-level", fanout)
    subroots = groups.tops().select(F.lit("").alias("g"), F.col("g").alias("group"), "d")
    return Tree(groups, climb(numbered(subroots, "g", ["group"], "merkle-groups"), "merkle-over", fanout))


def verified(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = FIELDS, tampered: Callable[[Column], Column] | None = None, fanout: int = FANOUT) -> DataFrame:
    """Every row's leaf, subroot, root and proof, and whether the row, after tampering, still folds to the root.

    ``tampered`` says of the identifier whether a row's text is changed (A-Z in lower case) before it is checked; by default nothing is.
    Null texts stay null, other nulls are leaves' values as ``-``; repeated rows and repeated or null identifiers keep rows of their own; an empty table
    gives an empty result. Other columns play no part, whatever their names. Digests are lower-case hex.
    """

    def changed(at: dict[str, Column]) -> Column:
        if tampered is None:
            return F.lit(None).cast("binary")
        return F.when(tampered(at[id_col]), leaf(*[ascii_lower(at[f]) if f == text_col else at[f] for f in fields]))

    tree = build(docs, id_col, group_col, fields, fanout, {"changed": changed})
    if tree.groups is None:
        kind = docs.select(id_col).schema[0].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    folded = fold(F.col("path"), F.coalesce("item.changed", "item.d"))
    out = tree.proofs().select(F.col("item.id").alias(id_col), shown(F.col("item.d")).alias("leaf"), shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"), proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
