"""Equal titles in a group, signs of several code points, and folds that see all rows."""

import duckdb

from tessera.operators import extraction as X
from tessera.operators import state as ST
from tessera.plans.code_queries import SQL


def test_sections_of_equal_titles_and_ends_of_lines(spark):
    rows = [(1, 0, "user", "b" * 400), (1, 0, "user", "a" * 500), (1, 0, "user", "c" * 700), (2, 0, "user", "w" * 900 + "\r\n" + "x" * 300), (3, 0, "user", "w" * 1000 + "." + "é" * 200), (4, 0, "user", None), (4, 0, "user", "")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = X.section_budget(c.selectExpr("conv_id AS query_id", "-turn AS priority", "role AS title", "coalesce(text, '') AS content"), 300).select("query_id", "priority", "given", "cut", "trimmed", "text")
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(SQL["token_sections"]).fetchall())


def test_semantic_state_folds_every_observation(spark, monkeypatch):
    folded = []
    plain = ST.sorted_fold
    monkeypatch.setattr(ST, "sorted_fold", lambda rows, *a: folded.append(rows.count()) or plain(rows, *a))
    rows = [("p", "s", "k", f"v{i}", i // 4, i, i % 3, 0.1 * (i % 7)) for i in range(40)]
    df = spark.createDataFrame(rows, "project string, scope string, kind string, text string, ts long, seq long, session long, confidence double")
    assert [r.seen for r in ST.semantic_state(df).collect()] == [40]
    assert folded == [40]
