import hashlib

from tessera.llm import warc
from tessera.llm.common import scratch

BODIES = [None, "", "<p>a</p>", "x" * 1500, "x" * 1500, "é\r\n\r\nWARC/1.1\r\n" * 200, "é\r\n\r\nWARC/1.1\r\n" * 200, "\n" * 1200, "\r\n" * 700, "\r" * 1300, "y" * 999, "y" * 999, "tail\r\n", "\r", "w\rv" * 700 + "\r", "é\r\n\r\nWARC/1.1\r\n" * 200]


def pages(spark, bodies):
    rows = [(i, None if i == 3 else f"http://a/{i}\r\nX: y", b, "clash") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest string")


def brute(bodies):
    out = []
    for i, b in enumerate(bodies):
        data = (b or "").encode()
        last = max(j for j, x in enumerate(bodies) if (x or "") == (b or ""))
        again = len(data) >= 1000 and last != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    return out


def test_round_trip(spark):
    for chunk in (warc.CHUNK, 100, 7):
        got = sorted(tuple(r)[:5] for r in warc.round_trip(pages(spark, BODIES), chunk=chunk).collect())
        assert got == brute(BODIES)


def test_chunks_carry_running_digests(spark):
    path = scratch(spark, "archives")
    warc.write_archives(warc.chunk_table(pages(spark, BODIES[5:6]), chunk=100), path)
    rows = sorted(warc.read_chunks(spark, path).collect(), key=lambda r: r.chunk_no)
    data = BODIES[5]
    assert len(rows) == -(-len(data) // 100) and [r.last for r in rows] == [False] * (len(rows) - 1) + [True]
    for r in rows:
        so_far = data[: 100 * (r.chunk_no + 1)].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(so_far), hashlib.sha1(so_far).hexdigest())


def test_repeated_rows_and_none(spark):
    df = pages(spark, BODIES).where("page_id in (3, 4)")
    rows = warc.round_trip(df.union(df)).collect()
    assert sorted((r.page_id, r.record_type) for r in rows) == [(3, "revisit")] * 2 + [(4, "response")] * 2
    assert warc.round_trip(df.limit(0)).count() == 0
