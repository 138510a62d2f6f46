"""A growing log: partial last lines, truncation, restarts, cut ranges."""

import json
import os
import random
import tempfile

import pyarrow.fs as pafs

from tessera.sources import tail


def write(path, data, mode="ab"):
    with open(path, mode) as f:
        f.write(data)


class Consumer:
    def __init__(self, spark, folder, check, **options):
        self.spark, self.folder, self.check, self.options = spark, folder, check, options

    def new(self):
        got = []
        query = tail.line_stream(self.spark, self.folder, **self.options).writeStream.foreachBatch(lambda df, _: got.extend((os.path.basename(r.path), r.offset, r.reset, r.line) for r in df.collect())).option("checkpointLocation", self.check).trigger(once=True).start()
        query.awaitTermination(60)
        if query.exception():
            raise query.exception()
        return sorted(got)


def test_lines_once_partial_ones_later_and_anew_after_truncation(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    log = f"{root}/log/t.jsonl"
    os.mkdir(f"{root}/log")
    write(log, b'{"role":"user","content":"hello"}\n{"role":"assistant"')
    consumer = Consumer(spark, f"{root}/log", f"{root}/check")
    assert consumer.new() == [("t.jsonl", 0, False, '{"role":"user","content":"hello"}')]
    assert consumer.new() == []
    write(log, b',"content":"hi"}\n\n{"role"')
    assert consumer.new() == [("t.jsonl", 34, False, '{"role":"assistant","content":"hi"}')]
    write(log, ':"é"}\n'.encode())
    write(f"{root}/log/b.jsonl", b"second file\n")
    assert consumer.new() == [("b.jsonl", 0, False, "second file"), ("t.jsonl", 71, False, '{"role":"é"}')]
    write(log, b"rewritten\npart", "wb")
    assert consumer.new() == [("t.jsonl", 0, True, "rewritten")]
    write(log, b"ial\n")
    assert consumer.new() == [("t.jsonl", 10, False, "partial")]
    write(log, b"no end", "wb")
    assert consumer.new() == []
    write(log, b" yet\n")
    assert consumer.new() == [("t.jsonl", 0, False, "no end yet")]


def test_every_line_once_however_ranges_are_cut(spark):
    rng = random.Random(3)
    root = tempfile.mkdtemp(prefix="spark-")
    data = "".join(rng.choice(["a", "é", "x\r"]) * rng.randint(0, 30) + "\n" for _ in range(300)).encode() + b"left over"
    write(f"{root}/x.log", data)
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want += [(at, line)] if line else []
        at += len(line) + 1
    system = pafs.LocalFileSystem()
    for block in (1, 7, 4096):
        assert tail.complete(system, f"{root}/x.log", len(data), block) == at
    for size in (1, 3, 10, 64, 10_000):
        for block in (5, 4096):
            got = [x for p in tail.parts_between({}, {f"{root}/x.log": at}, size) for x in tail.lines_of(system, p, block)]
            assert got == want
    assert sorted((r.offset, r.line.encode()) for r in tail.lines(spark, f"file://{root}", partBytes="100").collect()) == want
    assert tail.lines(spark, f"{root}/none").count() == 0


def test_events_of_a_transcript(spark):
    given = {
        '{"role":"user","content":"hello"}': ("user_prompt", "user"), '{"type":"MODEL_turn"}': ("assistant_message", None), '{"type":"x","toolCall":{"a":1}}': ("tool_call", None), '{"type":"Tool"}': ("tool_call", None),
        '{"type":"fatal_error"}': ("error", None), '{"a":1}': ("message", None), "not json": ("custom", None), "[1,2]": ("message", None), '"text"': ("message", None), '{"role":5,"type":null}': ("message", None), "{": ("custom", None),
    }
    rows = [("p", i * 100, False, line) for i, line in enumerate(given)]
    got = {r.seq: r for r in tail.transcript_events(spark.createDataFrame(rows, tail.SCHEMA)).collect()}
    for i, (line, want) in enumerate(given.items()):
        r = got[i * 100]
        assert (r.type, r.role) == want and r.source_event == f"transcript:{i * 100}", line
        data = json.loads(r.data)
        assert data == ({"format": "raw-line", "content": line} if want[0] == "custom" else json.loads(line) if line.startswith("{") else {"value": json.loads(line)})
    times = {'{"timestamp":"2026-08-13T01:00:00Z"}': 1786582800, '{"createdAt":1786582800}': 1786582800, '{"time":1786582800000}': 1786582800, '{"timestamp":"never","created_at":5}': 5, '{"a":1}': None}
    df = tail.transcript_events(spark.createDataFrame([("p", i, False, t) for i, t in enumerate(times)], tail.SCHEMA)).selectExpr("seq", "unix_seconds(ts) AS s")
    assert {r.seq: r.s for r in df.collect()} == dict(enumerate(times.values()))
