"""Exact dedup, mixing, token counts and chat formatting on small tables."""

import base64
import hashlib
import math
from collections import Counter

import numpy as np
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, mixing, token_counts
from tessera.llm.exact_dedup import drop_copies, exact_dedup
from tessera.llm.langid import drop_unknown
from tessera.llm.ngram_join import drop_similar

DOCS = "doc_id long, text string, source string, kept string"


def test_exact_dedup_with_and_without_hot_texts(spark):
    rows = [(i, t, "s", "x") for i, t in enumerate(["Ab", "aB", None, "", "É", "é", "ab", "x" * 5000, "X" * 5000, " ab"])] + [(100 + i, "hot One", "s", "x") for i in range(60)] + [(6, "ab", "s", "x"), (None, "only", "s", "x"), (None, "é", "s", "x")]
    docs = spark.createDataFrame(rows, DOCS)
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(low(t), []).append(i)
    for least in (256, 7):
        got = exact_dedup(docs, least_hot=least).collect()
        assert len(got) == len(rows)
        by = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in got:
            ids = by[r.text_sha256]
            assert r.group_size == len(ids) and r.doc_id in ids and r.keep_id == max((i for i in ids if i is not None), default=None)
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter(list(by))
    assert exact_dedup(docs.limit(0)).count() == 0
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    smallest = {r.text_sha256: r.keep_id for r in exact_dedup(docs, keep="smallest").collect()}
    assert smallest[hashlib.sha256(b"ab").hexdigest()] == 0


def test_poisson_inverse():
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0, 1e6):
        first, steps = mixing.poisson_steps(rate)
        assert all(a <= b for a, b in zip(steps, steps[1:], strict=False)) and (not steps or steps[-1] < 1)
        assert first + len(steps) >= rate and len(steps) < 40 + 20 * rate**0.5 and (first == 0 or steps[0] < 1e-15)
        u = (np.arange(20000) + 0.5) / 20000
        assert math.isclose((first + np.searchsorted(steps, u, side="right")).mean(), rate, rel_tol=2e-3, abs_tol=2e-3)


def test_mixing_with_a_very_high_rate(spark):
    rows = [(i, "y" * 1000, "big", "k") for i in range(40)] + [(100, "x", "tiny", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.poisson_mix(docs, {"tiny": 0.999999}, 0.000001)
    got = out.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("__copy").alias("d"), F.min("__copy").alias("a"), F.max("__copy").alias("b")).where("source = 'tiny'").first()
    assert abs(got.n - 40_001) < 1200 and got.n == got.d == got.b and got.a == 1


def test_stages_keep_columns_of_any_name(spark):
    names = ["__n", "__gone", "__copy", "__lang", "__u", "__h", "__part", "c0", "__keep", "__rate"]
    rows = [(1, "Good day to you", "src0", *names), (2, "good day to you", "src1", *names), (3, None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for out, ids in ((drop_copies(docs), {2, 3}), (mixing.mixed(docs, scale=4.0), {1, 2, 3}), (drop_similar(docs, 2, 4, 5), {1, 3}), (drop_unknown(docs, lang_col="__lang"), {1, 2})):
        got = out.collect()
        assert out.columns == docs.columns and {r.doc_id for r in got} <= ids and all(tuple(r)[3:] == tuple(names) for r in got) and got


def test_mixing_meets_its_weights_and_repeats(spark):
    rows = [(i, "x" * 10, f"s{i % 4}", "k") for i in range(8000)] + [(9000, None, None, "k"), (9001, "", "s0", "k"), (0, "x" * 10, "s0", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    out = mixing.poisson_mix(docs, {"s0": 0.5, "s1": 0.1, "gone": 0.2}, 0.4, 2.0)
    got = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    total = 2 * 8001
    for s, share in (("s0", 0.5), ("s1", 0.1), ("s2", 0.2), ("s3", 0.2)):
        assert abs(got[s] / total - share) < 0.02
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.poisson_mix(docs.repartition(7), {"s0": 0.5, "s1": 0.1, "gone": 0.2}, 0.4, 2.0).collect()))
    order = [r[0] for r in out.select("__order").collect()]
    assert order == sorted(order)
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mixed(docs).columns == docs.columns
    assert mixing.poisson_mix(docs, {}, 1.0).count() > 0


def test_histogram_answers(spark):
    texts = [None, "", "a", "a b", "a b c", "one two three four", "x y " * 700, "x y " * 700, "é" * 50]
    docs = spark.createDataFrame([(i, t, "s", "k") for i, t in enumerate(texts)], DOCS)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=bpe.pattern_text(), mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(plain.encode_ordinary(t or "")) for t in texts)
    for span in (1024, 3):
        sums = token_counts.suffix_sums(token_counts.length_histogram(docs), span)
        for r in sums.collect():
            n = r.n_tokens
            assert (r.docs, r.docs_from, r.tokens_from) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
            assert r.truncated_tokens == sum(min(x, n) for x in lengths) and r.lost_tokens == sum(max(0, x - n) for x in lengths)
            assert math.isclose(r.share_within, sum(x <= n for x in lengths) / len(lengths))
        for r in token_counts.at_limits(sums, [0, 1, 2, 100, 10**6]).collect():
            assert (r.docs_longer, r.truncated_tokens) == (sum(x > r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
        got = {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
        assert got == {p: lengths[math.ceil(p * len(lengths)) - 1] for p in (0.1, 0.5, 1.0)}
    assert token_counts.suffix_sums(token_counts.length_histogram(docs.limit(0))).count() == 0


def test_rotation(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, None, "alone"), (None, 5, "ann", "?"), (1, 3, "ann", "bye"), (1, None, "bob", "late")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    for part in (256, 2):
        got = chat.rotate(df, part=part).collect()
        for r in sorted({(r.conv_id, r.speaker) for r in got}, key=str):
            mine = sorted((x for x in got if (x.conv_id, x.speaker) == r), key=lambda x: (x.part, x.piece))
            text = "".join(x.text for x in mine)
            said = "".join(x.text[m.start : m.stop] for x in mine for m in x.mask)
            own = sorted((m for m in rows if m[0] == r[0]), key=lambda m: (m[1] is None, m[1], m[2] or "unknown", m[3] or ""))
            assert text == "".join((f"<|assistant|>\n" if (m[2] or "unknown") == r[1] else f"<|user:{m[2] or 'unknown'}|>\n") + (m[3] or "") + "<|end|>\n" for m in own)
            assert said == "".join((m[3] or "") + "<|end|>\n" for m in own if (m[2] or "unknown") == r[1])
            assert [x.starts_at for x in mine] == [sum(len(y.text) for y in mine[:i]) for i in range(len(mine))]
        assert {(r.conv_id, r.speaker) for r in got} == {(1, "system"), (1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_of_crowded_parts(spark):
    rng = np.random.default_rng(6)
    rows = [(None if i % 3 else 7, None if i % 2 else int(rng.integers(0, 4)), ["ann", "bob", None][i % 3], f"t{int(rng.integers(0, 5))}") for i in range(300)]
    got = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), part=8).collect()
    assert max(x.n_messages for x in got) <= 8
    for conv in (None, 7):
        own = sorted((m for m in rows if m[0] == conv), key=lambda m: (m[1] is None, m[1] or 0, m[2] or "unknown", m[3]))
        for speaker in {m[2] or "unknown" for m in own}:
            mine = sorted((x for x in got if (x.conv_id, x.speaker) == (conv, speaker)), key=lambda x: (x.part, x.piece))
            assert "".join(x.text for x in mine) == "".join(("<|assistant|>\n" if (m[2] or "unknown") == speaker else f"<|user:{m[2] or 'unknown'}|>\n") + m[3] + "<|end|>\n" for m in own)
            assert [x.starts_at for x in mine] == [sum(len(y.text) for y in mine[:i]) for i in range(len(mine))]
