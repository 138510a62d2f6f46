"""Queries that classify or compare texts use the whole of them."""

from pyspark.sql import functions as F

from tessera.plans import inputs as I
from tessera.plans import log_queries, record_queries


def test_category_by_words_far_into_a_text(spark, monkeypatch):
    filler = "plain words " * 50
    rows = [(1, filler + "and we deploy"), (2, filler + "\nthe bug at the end"), (3, filler)]
    monkeypatch.setattr(I, "memories", lambda s, d: s.createDataFrame(rows, "id long, content string"))
    assert {tuple(r) for r in record_queries.fact_category(spark, "").collect()} == {(1, "deploy"), (2, "fix"), (3, "decision")}


def test_facts_that_agree_in_thirty_characters(spark, monkeypatch):
    same = "the same thirty characters and more, "
    rows = [("p", 5, same + "then one", 0.5), ("p", 10, same + "then two", 0.5)]
    frame = spark.createDataFrame(rows, "project string, seq long, text string, confidence double")
    monkeypatch.setattr(I, "observations", lambda s, d: frame)
    assert {r.place for r in log_queries.intent_facts(spark, "").collect()} == {5, 10}
    (scene,) = log_queries.scenes(spark, "").select(F.split("summary", r" \| ").alias("texts")).collect()
    assert sorted(scene.texts) == [r[2] for r in rows]
