"""Word edges of ASCII words next to Vietnamese letters, and white space of all kinds."""

from pyspark.sql import functions as F

from tessera.functions.scoring import fact_category
from tessera.functions.text import trimmed
from tessera.functions.transcript import is_noise, kept_line


def test_edges_and_blanks(spark):
    words = {"từ giờ làm thế": "decision", "không thể làm được": "decision", "lỗi gì": "fix", "cần làm ngay": "next_action", "quy tắc này": "rule", "must do": "rule", "a.ts file": "file", "fix it": "fix", "prefix it": "decision"}
    df = spark.createDataFrame([(w,) for w in words], "t string")
    assert {r.t: r.c for r in df.select("t", fact_category(F.col("t")).alias("c")).collect()} == words
    lines = {"\tnpm notice x": True, " npm WARN y\r": True, " \t ": True, "": True, "kept \t": False, "an npm notice": False, "42.5% done": True}
    df = spark.createDataFrame([(w,) for w in lines], "t string")
    assert {r.t: r.n for r in df.select("t", is_noise(F.col("t")).alias("n")).collect()} == lines
    assert df.where("t = 'kept \\t'").select(kept_line(F.col("t"))).first()[0] == "kept" and df.select(trimmed(F.lit("﻿ a b　\n")).alias("x")).first().x == "a b"
