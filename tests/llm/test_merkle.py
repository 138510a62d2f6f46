"""The manifest against a plain version."""

import hashlib
import zlib

from pyspark.sql import functions as F

from tessera.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, d string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, lower=False):
    text = r[1] if not lower or r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def steps(nodes, fanout):
    """Levels of digests up to the last, and for each node its siblings."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for x, i in enumerate(at):
            run = i // fanout * fanout
            paths[x].append((nodes[run:i], nodes[i + 1 : run + fanout]))
        at = [i // fanout for i in at]
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain(rows, fanout=8, tampered=lambda i: zlib.crc32(str(i).encode()) % 3 == 0):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, bytes.fromhex(leaf(r))))
        trees.append((own, *steps([leaf(r) for r in own], fanout)))
    root, above = steps([t[1] for t in trees], fanout)
    out = []
    for (own, subroot, paths), over in zip(trees, above, strict=True):
        for r, path in zip(own, paths, strict=True):
            path = path + over
            up = leaf(r, r[0] is not None and tampered(r[0]))
            for left, right in path:
                up = h(*left, up, *right)
            out.append((r[0], leaf(r), subroot, root, h(*[x for a, b in path for x in a + b]), up, up == root))
    return sorted(map(str, out))


def crc(c):
    return F.crc32(c.cast("string")) % 3 == 0


def check(spark, rows, fanout=8, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    got = merkle.verified(df, tampered=crc, fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows, fanout)


def test_against_a_plain_version(spark):
    rows = [(i, f"Text {i} É\n" * (i % 4), ["en", "de", None, "", "EN", "éa", "zz"][min(i % 23, 6)], [None, "s"][i % 2], i if i % 5 else None) for i in range(700)]
    rows += [(3, "again", "en", "s", 1), (3, "again", "en", "s", 1), (None, "No id", "en", None, None), (None, None, "fr", None, None), (5000, "X" * 100_000, "long", "s", 5)]
    check(spark, rows)


def test_sizes_around_the_fanout(spark):
    for fanout in (2, 8):
        rows, k = [], 0
        for g, n in enumerate([1, 2, fanout, fanout + 1, fanout**2, fanout**2 + 1, 2 * fanout**2 + 1]):
            for _ in range(n):
                rows.append((k, f"T{k}", f"l{g:02}", "s", 1))
                k += 7
        check(spark, rows, fanout)
    check(spark, [(1, "A", "x", "s", 1)])
    check(spark, [(i, "A", f"l{i:03}", "s", 1) for i in range(70)])


def test_untouched_rows_fold_to_the_root_and_no_rows_give_none(spark):
    rows = [(i, f"Up {i}", "en", "s", 1, "x", "y", "z") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert merkle.verified(df).where("NOT verified").count() == 0
    none = merkle.verified(df.limit(0), tampered=crc)
    assert none.count() == 0 and none.columns == merkle.verified(df, tampered=crc).columns and dict(none.dtypes) == dict(merkle.verified(df, tampered=crc).dtypes)


def test_equal_rows_by_the_thousand(spark):
    check(spark, [(7, "Same", "en", "s", 1)] * 1500 + [(i, "T", "en", "s", 1) for i in range(20)], parts=5)
