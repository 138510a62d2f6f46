"""What is costly is told once for each row."""

from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import capture as K
from tessera.operators import extraction as X


def test_hook_reads_each_key_once(spark):
    rows = spark.createDataFrame([('{"hook_event_name":"PostToolUse","tool_name":"Edit","session_id":" s ","tool_input":{"file_path":"a.ts"}}',), ('{"session_id":"s"}',), ("no json",), (None,)], "data string")
    df = rows.select(K.hook_event(F.col("data"), "hook").alias("h"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("get_json_object(") == 5
    assert [r.h and tuple(r.h) for r in df.collect()] == [("file_edit", "hook:s:PostToolUse::a.ts:file"), None, None, None]


def test_categories_try_patterns_only_where_their_words_are(spark):
    words = ["RULE", "rules", "Policy", "quy TẮC", "từ gıờ", "TỪ GİỜ", "không ĐƯỢC", "fixed", "LỖI", "lỗı", "blocked", "KHÔNG THỂ", "x todo", "todos", "CẦN LÀM", "ship", "shipping", "pattern", "a.TS", "b.java", "c.cs", "d.h", "", "plain"]
    rows = spark.createDataFrame([(w,) for w in words] + [(None,)], "line string")
    # the patterns alone, tried on every line
    edge = S.EDGE
    plain = [("rule", r"(?i)\b(rule|policy|standard|convention|always|never|must|should|(?u:quy tắc|từ giờ|không được))\b"), ("fix", r"(?i)\b(fix|fixed|bug|issue|error|(?u:lỗi))\b"), ("blocker", r"(?i)\b(blocker|blocked|stuck|cannot|(?u:không thể))\b"), ("next_action", r"(?i)\b(next|todo|action|task|(?u:cần làm))\b"), ("deploy", r"(?i)\b(deploy|release|publish|ship)\b"), ("architecture", r"(?i)\b(architecture|design|structure|pattern)\b"), ("file", r"(?i)\.(ts|js|py|go|rs|java|cpp|c|h)\b")]
    want = F.coalesce(*[F.when(F.col("line").rlike(p.replace(r"\b", edge)), n) for n, p in plain], F.lit("decision"))
    df = rows.select("line", S.fact_category(F.col("line")).alias("got"), want.alias("want"))
    assert [r for r in df.collect() if r.got != r.want] == []
    assert len({r.got for r in df.collect()}) == 8
    assert "contains" in rows.select(S.fact_category(F.col("line")))._jdf.queryExecution().optimizedPlan().toString().lower()


def test_lines_are_squeezed_once(spark):
    rows = spark.createDataFrame([(1, "  goal:  ship it \nPHASE  3 done\nok\ngiai đoạn 2 next\n- [x] item"), (2, None)], "id long, text string")
    df = X.line_observations(rows)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
    assert [tuple(r)[:4] for r in df.orderBy("pos").collect()] == [(1, 0, "goal", "ship it"), (1, 1, "phase", "Phase 3"), (1, 3, "phase", "Phase 2"), (1, 4, "todo", "item")]
