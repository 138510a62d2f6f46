"""Edges of an incremental index: bits keep out of the shuffle what belongs to neither side, and lose nothing."""

from tessera.operators import capture as K


def test_bits_lose_nothing_and_keep_most_others_out(spark):
    ids = spark.range(0, 4000, 4).selectExpr("concat('v', id) AS id")
    rows = spark.range(4000).selectExpr("concat('v', id) AS src", "id AS n")
    got = {r.n for r in K.perhaps(rows, "src", K.id_bits(ids)).collect()}
    assert set(range(0, 4000, 4)) <= got
    assert len(got) < 1800
    assert K.perhaps(rows, "src", K.id_bits(ids.limit(0))).count() == 0


def side(spark, hashes, vertices, edges):
    return {
        "manifest": spark.createDataFrame(hashes, "path string, hash string"), "vertices": spark.createDataFrame(vertices, "id string, file string"),
        "edges": spark.createDataFrame(edges, "src string, dst string, type string"),
    }


def test_edges_with_and_without_identifiers_on_both_sides(spark):
    old = side(spark, [("a", "1"), ("b", "1"), ("c", "1")], [("x", "a"), ("y", "a"), ("z", "b"), ("w", "c")], [("x", "y", "CALLS"), ("x", "y", "CALLS"), ("x", "z", "CALLS"), ("z", "x", "CALLS"), ("w", "x", "CALLS"), ("x", "gone", "CALLS")])
    edges = [("z", "x", "USES"), ("z", "x", "USES"), ("n", "gone", "CALLS"), ("x", "y", "CALLS"), ("y", "y", "CALLS")]
    got = K.incremental_index(old, side(spark, [("a", "1"), ("b", "2"), ("d", "1")], [("x", "a"), ("y", "a"), ("z", "b"), ("n", "d")], edges))
    assert sorted(tuple(r) for r in got["edges"].collect()) == [("n", "gone", "CALLS"), ("x", "y", "CALLS"), ("z", "x", "USES")]
    # x is in an unchanged file of the old side and in an added one of the new: its edge is on both, and there once
    moved = K.incremental_index(old, side(spark, [("a", "1"), ("d", "1")], [("y", "a"), ("x", "d")], edges))
    assert sorted(tuple(r) for r in moved["edges"].collect()) == [("x", "y", "CALLS")]
