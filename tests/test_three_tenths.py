"""A sign exactly at seven tenths of what is left: not in the last three tenths, at any length."""

import duckdb

from tessera.plans import code_queries as Q


def _conversations(budget):
    """Two turns each: the first leaves so many tokens that the second is cut at 3.5 times as many characters; signs lie at seven tenths of these and beside them."""
    rows = []
    for left in (52, 94, 97, 100, 186, 194, 200, 206):
        chars = left * 7 // 2
        for k, at in enumerate((chars * 7 // 10 - 1, chars * 7 // 10, chars * 7 // 10 + 1)):
            for sign in (".", "\n"):
                key = len(rows) // 2
                rows += [(key, 0, "user", "w" * int((budget - left - 6) * 3.5)), (key, 1, "user", "a" * at + sign + "b" * chars)]
    return rows


def _both(spark, monkeypatch, name, budget):
    rows = _conversations(budget)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(Q.I, "table", lambda *_: df)
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return sorted(map(tuple, getattr(Q, name)(spark, "").collect())), sorted(con.sql(Q.SQL[name]).fetchall())


def test_contexts_cut_at_seven_tenths(spark, monkeypatch):
    got, want = _both(spark, monkeypatch, "token_contexts", 400)
    assert len(want) == 48 and got == want


def test_sections_cut_at_seven_tenths(spark, monkeypatch):
    got, want = _both(spark, monkeypatch, "token_sections", 300)
    assert len(want) == 96 and got == want
