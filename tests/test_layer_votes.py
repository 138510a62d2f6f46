from tessera.plans import code_queries
from tessera.plans import inputs as I


def votes(spark, monkeypatch, files):
    v = spark.createDataFrame([(k, k, "function", f, 1, 2) for k, f in files.items()], "id string, name string, type string, file string, start_line long, end_line long")
    e = spark.createDataFrame([(x, y, "CALLS", 1) for x, y in ("ab", "bc", "cd", "de")], "src string, dst string, type string, ord long")
    monkeypatch.setattr(I, "vertices", lambda s, d: v)
    monkeypatch.setattr(I, "edges", lambda s, d: e)
    return {r.file: (r.layer, r.confidence) for r in code_queries.layer_votes(spark, "").collect()}


def test_votes_reach_files_in_order_in_one_pass(spark, monkeypatch):
    got = votes(spark, monkeypatch, {"a": "src/core/a.ts", "b": "lib/b.ts", "c": "lib/c.ts", "d": "lib/d.ts", "e": "lib/e.ts"})
    assert got == {"src/core/a.ts": ("domain", 0.9), **{f"lib/{x}.ts": ("domain", 0.65) for x in "bcde"}}


def test_votes_against_the_order_go_one_file_a_pass(spark, monkeypatch):
    got = votes(spark, monkeypatch, {"a": "src/core/a.ts", "b": "lib/4.ts", "c": "lib/3.ts", "d": "lib/2.ts", "e": "lib/1.ts"})
    assert got == {"src/core/a.ts": ("domain", 0.9), **{f"lib/{x}.ts": ("domain", 0.65) for x in "234"}, "lib/1.ts": ("unknown", 0.35)}
