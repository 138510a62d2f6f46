from pyspark.sql import functions as F

from tessera.functions import paths as P
from tessera.functions import scoring as S
from tessera.functions import text as T


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()[0]


def test_tokens_and_unicode(spark):
    assert one(spark, T.tokenize(F.col("t")), t="Hello, World-2 a é/x!") == ["hello", "world-2", "é/x"]
    assert one(spark, T.nfkc(F.col("t")), t="ﬁ①") == "fi1"
    assert one(spark, T.slug(T.nfkd_plain(F.col("t"))), t="  Café Über!! ") == "cafe-uber"
    assert one(spark, T.wiki_links(F.col("t")), t="see [[A page]] and [[a Page]] or [[B]]") == ["a-page", "b"]


def test_redaction(spark):
    text = "key sk-abcdefghijklmnopqrstuvwx and password = hunter22 Bearer abcdefghijklmnop1234"
    got = one(spark, T.redact(F.col("t")), t=text)
    assert "hunter22" not in got and "[REDACTED:openai_key]" in got and "[REDACTED:bearer_token]" in got
    assert one(spark, T.redact_json(F.col("t")), t='{"a": {"api_key": "x", "b": [1]}}') == '{"a": {"api_key": "[REDACTED]", "b": [1]}}'
    assert one(spark, T.stable_json(F.col("t")), t='{"b": 1, "a": [2]}') == '{"a":[2],"b":1}'
    assert one(spark, T.stable_json(F.col("t")), t="{") is None


def test_fragments(spark):
    assert one(spark, T.fragments(F.col("t")), t="One is here. Two!\nThree") == ["One is here.", "Two!", "Three"]
    assert one(spark, T.useful_fragment(F.col("t")), t="https://example.org/some/path") is False
    assert one(spark, T.useful_fragment(F.col("t")), t="this says something") is True
    assert one(spark, T.ellipsis(F.col("t"), 5), t="a  b c d e f") == "a b…"


def test_paths(spark):
    assert [one(spark, P.is_test(F.col("t")), t=t) for t in ("tests/a.ts", "src/a.spec.ts", "src/test.ts")] == [True, True, False]
    assert [one(spark, P.is_source(F.col("t")), t=t) for t in ("src/a.ts", "node_modules/a.ts", "src/.env", "src/key.pem", "a.py")] == [True, False, False, False, False]
    assert [one(spark, P.is_sensitive(F.col("t")), t=t) for t in ("x/.ENV", "a/b.Key", "a/b.ts")] == [True, True, False]
    assert [one(spark, P.contains_path(F.col("a"), F.col("b")), a=a, b=b) for a, b in (("/a", "/a/b"), ("/a/b", "/a"), ("/a", "/ab"))] == [True, True, False]
    assert [one(spark, P.dangerous_command(F.col("t")), t=t) for t in ("sudo chown -R root /", "rm -rf ~/x", "TRUNCATE TABLE t", "git push --force")] == [None, "home deletion", "loss of data", None]
    assert [one(spark, P.dangerous_path(F.col("t")), t=t) for t in ("/etc/x", "/a/.env.local", "src/prod/x", "/A/Credentials", "src/x.ts")] == ["system configuration", "environment file", "production path", "sensitive file", None]
    assert [one(spark, P.subsystem(F.col("t")), t=t) for t in ("src/core/a.ts", "packages/x/src/a.ts", "src/a.spec.ts", "tests/a.ts", "a.ts", "")] == ["src/core", "packages/x", "src/a.spec.ts", "tests", "a.ts", "root"]
    assert [one(spark, P.layer(F.col("t"))["layer"], t=t) for t in ("bin/a.ts", "x/bin/a.ts", "cli/a.ts", "src/cli/a.ts")] == ["interface", "unknown", "unknown", "interface"]


def test_scores(spark):
    assert one(spark, S.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0)))) == 0.0
    assert one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(2.0), F.lit(1.0)))) == 0.0
    assert S.preferred_types("which Decision and TODO") == ["decision", "todo"]
    assert [one(spark, S.risk_of(F.lit(x))) for x in (30, 16, 6, 5)] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    assert one(spark, S.fact_category(F.col("t")), t="We never merge on Friday, fix later") == "rule"


def test_lifecycle_cases(spark):
    rows = [("rule", "critical", "Always keep the storage project-scoped and never share it.", ["class:permanent"], "2020-01-01"), ("summary", "temporary", "done", ["class:transient"], "2026-08-10"), ("summary", "temporary", "Some words about the session that ended.", ["class:session"], "2025-01-01")]
    df = spark.createDataFrame(rows, "type string, importance string, content string, tags array<string>, updated string").withColumn("updated", F.to_timestamp("updated"))
    q = S.quality(F.col("type"), F.col("importance"), F.col("content"), F.col("tags"), F.col("updated"), F.lit(1), F.to_timestamp(F.lit("2026-08-13")))
    got = df.select(q["score"], q["tier"], q["stale"], q["protected"], q["prune"]).collect()
    assert tuple(got[0]) == (100, "trusted", True, True, False)
    assert tuple(got[1]) == (0, "noise", False, False, True)
    assert got[2][2] and got[2][4]
