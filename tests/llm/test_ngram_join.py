import random
import re

import pytest

from tessera.llm.ngram_join import drop_similar, ngram_join

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, words=3, num=9, den=10):
    sets = {}
    for i, t in rows:
        w = SPACE.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if den * same >= num * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def corpus(seed):
    """Families of near copies around the threshold, exact copies, short texts, common passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, bases = [], [[rng.choice(words) for _ in range(rng.choice([4, 12, 60, 150]))] for _ in range(12)]
    for i in range(260):
        text = list(bases[min(int(rng.expovariate(0.5)), 11)])
        for _ in range(rng.randrange(0, 1 + max(1, len(text) // 20))):
            p = rng.randrange(len(text))
            if rng.random() < 0.6:
                text[p] = rng.choice(words)
            elif rng.random() < 0.5:
                text.insert(p, rng.choice(words))
            elif len(text) > 2:
                del text[p]
        rows.append((i, " ".join(text)))
    return [*rows, (900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "ONE  TWO"), (907, "é É x y"), (908, "é é x y"), (909, "A b c"), (910, "a B c")]


@pytest.mark.parametrize(("few", "words", "num", "den"), [(8, 3, 9, 10), (1, 3, 9, 10), (2, 2, 4, 5)])
def test_against_brute_force(spark, few, words, num, den):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, token string, n int").repartition(5)
        got = sorted(tuple(r) for r in ngram_join(docs, words, num, den, few=few).collect())
        assert got == brute(rows, words, num, den)


def test_repeated_rows_nulls_and_none(spark):
    text = "a b c d e f"
    docs = spark.createDataFrame([(2, text), (2, text), (None, text), (5, text)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join(docs).collect()), key=str)
    assert got == [(2, 4, 2), (2, 4, 2), (5, 4, 2), (None, 4, None)]
    assert ngram_join(docs.limit(0)).count() == 0
    assert sorted((r.doc_id or 0) for r in drop_similar(docs).collect()) == [0, 2, 2]


def test_long_texts_wide_thresholds_and_clashing_columns(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10_000)}" for _ in range(60_000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-500], "x", *long[-500:]])), (3, " ".join(long[:45_000])), (4, " ".join(reversed(long))), (5, "a b c d e f g"), (6, "a b c")]
    docs = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, gone long, __gone string")
    assert sorted(map(tuple, ngram_join(docs).collect())) == brute(rows)
    assert sorted(map(tuple, ngram_join(docs, 3, 2, 5).collect())) == brute(rows, 3, 2, 5)
    kept = drop_similar(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[0::2] for r in kept.collect()) == [(i, i) for i in (1, 3, 4, 5, 6)]
