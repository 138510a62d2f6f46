from pyspark.sql import functions as F

from tessera.llm import langid

SF = "/root/testdata/sf0.01"


def test_bound_of_a_language():
    assert langid.bound([5, 5], 20) == 5 and langid.bound([1, 9, 90], 30) == 20 and langid.bound([50, 50], 30) == 15


def test_rare_language_is_learnt_from_a_sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("lang IN ('en', 'de') AND text IS NOT NULL")
    german = docs.where(F.col("lang") == "de").where(~langid.held_out(F.col("doc_id"))).orderBy("doc_id").limit(2)
    few = docs.where("lang = 'en'").unionByName(german)
    for rows in (2, 10):
        assert langid.fit(few, fit_rows=100 * rows).languages == ["de", "en"]
    model = langid.fit(few, fit_rows=40)
    assert model.languages == ["de", "en"]
    whole = langid.fit(german)
    assert (model.log[:, 0] == whole.log[:, 0]).all()  # every row of the rare language, though not of the other


def test_texts_stay_when_no_language_was_learnt(spark):
    rows = [(1, None), (2, ""), (3, "12 + 3 !!"), (4, "the thing"), (5, "9 ß"), (6, "語")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    kept = langid.drop_unknown(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}
