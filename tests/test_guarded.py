"""Writers that meet, objects that are written twice, and lines whose scope is folded by hand."""

import hashlib
import random
import tempfile
import threading

from tessera.operators import extraction as X
from tessera.sources import files as S
from tessera.sources import revisions as R


def test_two_writers_one_conflict_no_lost_row(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/wiki"
    change = lambda rows: spark.createDataFrame(rows, "key string, base long, content string")
    assert R.current(spark, path) is None
    number, conflicts = R.commit(change([("a", 0, "A1"), ("b", 0, "B1"), ("b", 0, "B1 twice"), ("c", 3, "C?")]), path)
    assert number == 0 and sorted((r.key, r.content, r.last) for r in conflicts.collect()) == [("b", "B1 twice", 0), ("c", "C?", 0)]
    ends = {}

    def write(name, rows):
        ends[name] = [(r.key, r.content, r.last) for r in R.commit(change(rows), path)[1].collect()]

    writers = [threading.Thread(target=write, args=(n, [("a", 1, f"A2 by {n}"), (f"own-{n}", 0, n)])) for n in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    lost = [c for x in ends.values() for c in x]
    assert len(lost) == 1 and lost[0][0] == "a" and lost[0][2] == 2
    winner = "x" if "by y" in lost[0][1] else "y"
    assert sorted((r.key, r.revision, r.content) for r in R.current(spark, path).collect()) == [("a", 2, f"A2 by {winner}"), ("b", 1, "B1"), ("own-x", 1, "x"), ("own-y", 1, "y")]
    assert sorted((r.key, r.revision) for r in R.history(spark, path).collect()) == [("a", 1), ("a", 2), ("b", 1), ("own-x", 1), ("own-y", 1)]
    assert [c["rows"] for c in R.commits(spark, path)][0] == 2 and len(R.commits(spark, path)) == 3


def test_chunks_by_lines_and_bytes(spark):
    rng = random.Random(3)
    rows = [(s, i, rng.choice("aé") * rng.randint(0, 40)) for s, n in ((1, 300), (2, 1), (3, 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "session long, seq long, line string")
    files = S.chunk_files(S.bounded_chunks(df, 7, 120, partitions=4))
    want = set()
    for s in (1, 2, 3):
        chunk, size = [], 0
        for row in [r for r in rows if r[0] == s] + [None]:
            more = len(row[2].encode()) + 1 if row else 0
            if chunk and (row is None or len(chunk) >= 7 or size + more > 120):
                content = "".join(f"{r[2]}\n" for r in chunk)
                want.add((s, f"{chunk[0][1]:012}-{chunk[-1][1]:012}-{hashlib.sha256(content.encode()).hexdigest()[:16]}.jsonl", content))
                chunk, size = [], 0
            if row:
                chunk.append(row)
                size += more
    assert {tuple(r) for r in files.collect()} == want
    assert {(r.session, r.seq) for r in S.pending(df, files.where("session = 3").union(files.where("session = 1 AND key < '000000000100'"))).collect() if r.session == 3} == set()


TEXT = """Mission: build it
Phase 2 - Storage
Objective: keep rows
Why - because
Acceptance criteria:
- rows survive
* rows   are FOUND
1) fast

- no longer an item
Depends on: phase one
- the schema
other text
- neither
Task 7: write
Objective: one file
Constraint: no locks
- 3 retries
Definition of done
- tests pass
- rows survive
Rationale:
"""


def test_scopes_and_lists(spark):
    df = spark.createDataFrame([("p", "e1", 0, TEXT), ("p", "e1", 1, "Objective: alone\r\nconstraint: no locks"), ("p", "e2", 0, None)], "project string, id string, block int, text string")
    got = [(r.kind, r.value, r.scope_key, r.confidence) for r in X.semantic_lines(df).orderBy("id", "block", "pos").collect()]
    assert got == [
        ("mission", "build it", None, 0.99), ("phase_objective", "keep rows", "phase:2", 0.98), ("phase_why", "- because", "phase:2", 0.98), ("acceptance_criterion", "rows survive", "phase:2", 0.96), ("acceptance_criterion", "rows are FOUND", "phase:2", 0.96), ("acceptance_criterion", "fast", "phase:2", 0.96),
        ("dependency", "phase one", "phase:2", 0.97), ("dependency", "the schema", "phase:2", 0.96), ("objective", "one file", "task:7", 0.98), ("constraint", "no locks", "task:7", 0.97), ("constraint", "3 retries", "task:7", 0.96), ("acceptance_criterion", "tests pass", "task:7", 0.96),
        ("acceptance_criterion", "rows survive", "task:7", 0.96), ("objective", "alone", None, 0.98), ("constraint", "no locks", None, 0.97),
    ]
