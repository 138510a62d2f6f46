import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators import memory as M
from tessera.sources import files


def test_files_and_manifest(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    for name, text in (("src/a.ts", "one"), ("src/b.ts", "two"), ("node_modules/c.ts", "x"), ("src/.env", "k=1"), ("readme.md", "r")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    old = spark.createDataFrame(files.source_files(spark, str(root)).select("path", "hash").collect(), "path string, hash string")
    assert sorted(r.path.rsplit("/", 1)[1] for r in old.collect()) == ["a.ts", "b.ts"]
    (root / "src/a.ts").write_text("changed")
    (root / "src/b.ts").unlink()
    (root / "src/d.ts").write_text("new")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in G.manifest_diff(old, files.source_files(spark, str(root)).select("path", "hash")).collect()}
    assert got == {"a.ts": "modified", "b.ts": "deleted", "d.ts": "added"}


def test_json_lines_and_journal(spark):
    root = Path(tempfile.mkdtemp(prefix="spark-"))
    (root / "log.jsonl").write_text('{"type": "user", "text": "hi"}\nnot json\n\n{"type": "tool", "text": "x"}\n')
    rows = files.json_lines(spark, str(root / "log.jsonl"), "type string, text string").collect()
    assert sorted((r.kind, r.raw) for r in rows) == [("custom", "not json"), ("tool", None), ("user", None)]
    j = root / "journal"
    j.mkdir()
    (j / "1.json").write_text(json.dumps({"version": 1, "observations": [{"id": "a", "kind": "task"}, {"id": "b", "kind": "goal"}]}))
    (j / "2.json").write_text("{broken")
    (j / "3.json").write_text(json.dumps({"version": 2, "observations": [{"id": "c", "kind": "task"}]}))
    assert sorted(r.id for r in files.journal(spark, str(j), "id: string, kind: string").collect()) == ["a", "b"]


def test_hunks(spark):
    diff = "--- a\n+++ b\n@@ -1,2 +3,4 @@ f\n x\n@@ -9 +12 @@\n@@ -20,3 +25,0 @@"
    df = spark.createDataFrame([("f.ts", diff)], "file string, diff string")
    assert sorted(tuple(r) for r in files.hunks(df).collect()) == [("f.ts", 3, 6), ("f.ts", 12, 12), ("f.ts", 25, 25)]


def test_assets_are_written_once(spark):
    path = f"{tempfile.mkdtemp(prefix='spark-')}/assets"
    a = spark.createDataFrame([("d1", "x"), ("d2", "y"), ("d2", "y")], "digest string, body string")
    files.write_assets(a, path)
    files.write_assets(a.union(spark.createDataFrame([("d3", "z")], a.schema)), path)
    assert sorted(r.digest for r in spark.read.parquet(path).collect()) == ["d1", "d2", "d3"]


def test_maintenance_of_small_tables(spark):
    from tessera.plans import inputs

    m = inputs.memories(spark, "/root/testdata/sf0.001")
    assert M.maintain(m.limit(0), inputs.now()).count() == 0
    twice = M.upsert(m, m.withColumn("source", F.lit("new")))
    assert twice.count() == m.count() and twice.where("source = 'new'").count() == m.count()


def test_snapshots(spark):
    import datetime

    from tessera.sources import snapshots

    root = tempfile.mkdtemp(prefix="spark-")
    assert snapshots.listed(spark, root).count() == 0
    for i in range(3):
        snapshots.create({"a": spark.range(i + 1), "b": spark.range(2)}, root, f"s{i}", datetime.datetime(2024, 1, 1 + i))
    assert [(r.snapshot, r.tables, r.rows) for r in snapshots.listed(spark, root).collect()] == [("s2", 2, 5), ("s1", 2, 4), ("s0", 2, 3)]
    back = snapshots.restore(spark, root, "s1")
    assert sorted(back) == ["a", "b"] and back["a"].count() == 2
    assert [r.snapshot for r in snapshots.outdated(spark, root, 2).collect()] == ["s0"]
