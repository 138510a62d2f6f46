"""Follow-ups, kept facts and their end, in a batch and as a stream."""

import datetime as dt
import random
import tempfile
import time

from pyspark.sql import functions as F

from tessera.operators import conversation as C
from tessera.streaming.focus import conversation_focus

SCHEMA = "project string, seq long, asked timestamp, question string, facts array<struct<kind:string,value:string,source:string>>"
T0 = dt.datetime(2026, 8, 13, 1, 0)
LOGIN = [("task", "Google Login", "work"), ("file", "Auth.tsx", "work"), ("decision", "use PKCE", "work")]

#: Worked out by hand: word edges are those of ASCII words, so a word that ends in a Vietnamese vowel has none before a blank.
FOLLOWS = {
    "Tiếp tục task trước, đang làm gì?": False, "Tại sao?": True, "why so": True, "What about the build of the package": True, "còn TODO nào": False, "nó ở đâu": False, "list all files": False, "then  what": True, "is it done": True,
    "This is a long question about something else entirely": False, "resume that work": False, "vậy thì sao": True, "thế còn file nào": False, "": False, "WHY THAT": True, "các việc nào chưa xong": False, "Sao vậy?": True,
}


def test_what_goes_on_from_before(spark):
    df = spark.createDataFrame([(q,) for q in FOLLOWS], "q string")
    assert {r.q: r.f for r in df.select("q", C.follows(C.plain(F.col("q"))).alias("f")).collect()} == FOLLOWS


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_follow_up_reset_and_expiry(spark):
    rows = [
        ("a", 1, at(0), "Tiếp tục task trước, đang làm gì và ở file nào?", LOGIN), ("a", 2, at(1), "Tại sao?", []), ("a", 3, at(2), "then what", [("next_action", "write tests", "w"), ("task", "google  LOGIN", "w")]),
        ("a", 4, at(3), "list all files", [("file", "b.ts", "w")]), ("a", 5, at(3 + 12 * 60), "why", []), ("a", 6, at(4 + 25 * 60), "why", []), ("b", 1, at(0), "why", None), ("b", 2, at(1), "Sao vậy?", [("task", " ", "w")]),
    ]
    got = {(r.project, r.seq): r for r in C.focus(spark.createDataFrame(rows, SCHEMA)).collect()}
    values = lambda p, s: [f.value for f in got[p, s].focus]
    assert not got["a", 1].used and values("a", 1) == ["Google Login", "Auth.tsx", "use PKCE"] and got["a", 1].answer is None
    assert got["a", 2].used and values("a", 2) == values("a", 1) and got["a", 2].answer == "Quyết định liên quan: use PKCE. Task liên quan: Google Login."
    assert values("a", 3) == ["write tests", "google LOGIN", "Auth.tsx", "use PKCE"] and got["a", 3].previous_intent == got["a", 2].intent
    assert not got["a", 4].used and values("a", 4) == ["b.ts"]
    assert got["a", 5].used and got["a", 5].answer == "File liên quan: b.ts."
    assert not got["a", 6].used and got["a", 6].prior == [] and got["a", 6].previous_intent is None
    assert not got["b", 1].used and not got["b", 2].used and values("b", 2) == []
    short = {(r.project, r.seq): r for r in C.focus(spark.createDataFrame(rows, SCHEMA), max_age_ms=60_000).collect()}
    assert short["a", 2].used and not short["a", 5].used


def test_at_most_eight_facts_against_a_loop(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 4 else f"p{i % 3}", i, at(i), rng.choice(["why", "list all files", "then what"]), [(rng.choice("ab"), f"V {rng.randint(0, 12)}", "s") for _ in range(rng.randint(0, 4))]) for i in range(400)]
    got = {(r.project, r.seq): [(f.kind, f.value) for f in r.focus] for r in C.focus(spark.createDataFrame(rows, SCHEMA), partitions=5).collect()}
    state = {}
    for p, s, _, q, facts in rows:
        merged = list(dict.fromkeys([(k, v) for k, v, _ in facts] + (state.get(p, []) if q != "list all files" else [])))[:8]
        state[p] = merged
        assert got[p, s] == merged


def write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(turns, take, check, done, **how):
    """A stream with such a timer runs batches for ever, so it is stopped when what it should give is there."""
    query = conversation_focus(turns, **how).writeStream.foreachBatch(take).option("checkpointLocation", check).outputMode("append").trigger(processingTime="1 second").start()
    end = time.time() + 60
    while time.time() < end and not done() and query.isActive:
        time.sleep(0.3)
    query.stop()


def test_stream_keeps_state_over_batches_and_a_timer_ends_it(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    got = []

    def take(df, _):
        got.extend(df.collect())

    write(spark, [("a", 1, at(0), "list all files", LOGIN), ("b", 1, at(0), "why", LOGIN)], f"{root}/in")
    turns = spark.readStream.schema(SCHEMA).parquet(f"{root}/in")
    run(turns, take, f"{root}/c", lambda: len(got) == 2)
    write(spark, [("a", 2, at(1), "Tại sao?", []), ("a", 3, at(13 * 60), "why", [])], f"{root}/in")
    run(turns, take, f"{root}/c", lambda: len(got) == 4)
    by = {(r.project, r.seq): r for r in got}
    assert by["a", 2].used and by["a", 2].answer == "Quyết định liên quan: use PKCE. Task liên quan: Google Login." and not by["a", 3].used and not any(r.expired for r in got)

    got.clear()
    write(spark, [("c", 1, at(0), "list all files", LOGIN)], f"{root}/in2")
    short = spark.readStream.schema(SCHEMA).parquet(f"{root}/in2")
    run(short, take, f"{root}/c2", lambda: any(r.expired for r in got), max_age_ms=1000)
    gone = [r for r in got if r.expired]
    assert len(gone) == 1 and gone[0].project == "c" and [f.value for f in gone[0].prior] == ["Google Login", "Auth.tsx", "use PKCE"]
