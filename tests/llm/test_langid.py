from pyspark.sql import functions as F

from tessera.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.98 * got.count() > 0
    assert got.where("score < 0 or score > 1").count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    other = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(df).collect())
    assert key(docs) == key(other)


def test_mixture_of_two_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    en, de = (docs.where(f"lang = '{x}' and n_chars between 1500 and 4000").orderBy("doc_id").first().text for x in ("en", "de"))
    lang, score, shares = model.infer(en + " " + de[:700])
    assert lang == "en" and set(shares) == {"en", "de"} and 0.5 < shares["en"] < 0.95
    assert abs(sum(shares.values()) - 1) < 1e-6 and abs(score - shares["en"]) < 1e-9


def test_no_letters_nulls_clashing_columns_and_no_labels(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 + 3 !!", "en"), (4, "the thing and the other", "en"), (4, "the thing and the other", "en"), (None, "die und der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit(9))
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "en")} <= got
    kept = langid.drop_unknown(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
