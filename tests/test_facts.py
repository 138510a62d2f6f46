"""Categories and importance of facts in English and Vietnamese."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import session as E


@pytest.fixture(scope="module")
def importance(spark):
    def of(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
        return {r.id: r.importance for r in E.facts(rows, importance=0.0).collect()}

    return of


def test_vietnamese_categories(spark):
    """Edges are those of ASCII words: a word that ends in an accented vowel has none before a blank or the end, as in the rules that these are taken from."""
    want = {
        "Quy tắc của dự án": "rule", "QUY TẮC chung": "rule", "từ giờ viết bằng tay": "decision", "Từ giờ": "decision", "không được xóa": "rule", "Lỗi ở dòng ba": "fix", "không thể mở tệp": "decision", "Không thể": "decision", "việc CẦN LÀM hôm nay": "next_action",
        "chuyện bình thường": "decision",
    }
    got = spark.createDataFrame([(t,) for t in want], "t string").select("t", S.fact_category(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == want


def test_vietnamese_words_raise_importance(importance):
    plain = "chuyện bình thường hôm nay"
    got = importance(plain, *[f"{plain} {w}" for w in ("Nhớ", "luôn luôn", "quy tắc", "từ giờ", "không được")])
    assert got == {0: 0.65, 1: 0.8, 2: 0.8, 3: 0.85, 4: 0.8, 5: 0.85}


def test_noise_lowers_importance(spark, importance):
    noise = ["npm WARN some words about it", "see: 12 packages in 3 s or so", "we found 7 vulnerabilities here", "the tree is up to date with it", "it has added 31 packages to it"]
    got = importance(*noise, "added 31 packages, up to date now", "nothing in this line is of note")
    assert got == dict.fromkeys(range(5), 0.25) | {5: 0.0, 6: 0.65}
    texts = spark.createDataFrame([(1, "\n".join([*noise, "nothing in this line is of note"]))], "id long, text string")
    assert [r.pos for r in E.facts(texts).collect()] == [5]


def test_sql_has_the_rule_of_the_query(spark):
    """The whole text counts, and so do Vietnamese words."""
    import duckdb

    from tessera.plans.record_queries import CATEGORY

    texts = ["x " * 300 + "never", "x " * 190 + "a policy", "việc này bị lỗi", "QUY TẮC chung", "việc CẦN LÀM hôm nay", "không thể mở tệp", "a" * 396 + " rule", "plain"]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(S.fact_category(F.col("t"))).collect()]
    assert [duckdb.sql(f"SELECT {CATEGORY} FROM (SELECT '{t}' AS content)").fetchall()[0][0] for t in texts] == want
