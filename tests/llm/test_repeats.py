import random

import pytest

from tessera.llm import repeats
from tessera.llm.suffix_groups import common_prefixes, suffix_array


def brute_of(rows, length):
    seen = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [set() for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i].update(range(p, p + length))
    out = []
    for (doc, t), g in zip(rows, gone, strict=True):
        b = (t or "").encode()
        runs = sum(1 for x in g if x - 1 not in g)
        out.append((doc, len(b), len(g), runs, bytes(x for j, x in enumerate(b) if j not in g)))
    return out


def brute(rows, length):
    return sorted(brute_of(rows, length))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 6)))
    passages = [" ".join(word() for _ in range(n)) for n in (4, 8, 9, 10, 12, 30)]
    rows = []
    for i in range(70):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 12))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randrange(1, 6))]
        text = " ".join(parts)
        if rng.random() < 0.3 and rows:
            text = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("abcd")
            text = "".join(text)
        rows.append((i, text))
    return [*rows, (100, None), (101, ""), (102, "z" * 200), (103, "xy" * 90), (104, "q" * 39), (105, "q" * 40), (106, "w" * 40), (107, "w" * 41), (108, passages[5]), (109, passages[5])]


@pytest.mark.parametrize(("length", "gram", "block", "many"), [(40, 13, 4, 20_000), (40, 8, 8, 2), (40, 20, 4, 2), (24, 5, 3, 20_000)])
def test_against_brute_force(spark, length, gram, block, many):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, doc int, removed string").repartition(4)
        got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs, length, gram, block, many=many).collect())
        assert got == brute(rows, length)


def test_repeated_rows_and_none(spark):
    docs = spark.createDataFrame([(1, "a" * 30 + "b" * 30), (1, "a" * 30 + "b" * 30), (None, "c" * 20)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.kept)) for r in repeats.remove_repeats(docs, 40, 13, 4).collect()) == [(0, 20), (1, 0), (1, 0)]
    assert repeats.remove_repeats(docs.limit(0), 40, 13, 4).count() == 0


def test_rows_that_share_an_identifier_and_long_texts(spark):
    rng = random.Random(5)
    passage, own = "".join(rng.choice("abcdefgh") for _ in range(80)), lambda n: "".join(rng.choice("ijklmn") for _ in range(n))
    rows = [(1, passage + own(30)), (1, own(10) + passage), (1, own(90)), (2, own(300_000) + passage + own(5)), (3, None), (None, passage), (None, passage), (None, own(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or -1, r.n_bytes, len(r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs, 40, 13, 4).collect())
    assert got == sorted((i or -1, n, runs, kept) for i, n, _, runs, kept in brute_of(rows, 40))


def test_a_hot_anchor_stays_together_when_joins_are_split(spark):
    rng = random.Random(8)
    own = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    crowded, passages = own(26), [own(26) for _ in range(6)]
    endings = [own(14) for _ in range(90)]
    rows = [(i, own(rng.randrange(20, 40)) + crowded + own(40)) for i in range(400)] + [(1000 + i, own(rng.randrange(20, 40)) + passages[i % 6] + endings[i % 89] + own(20)) for i in range(1068)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1b", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        got = sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), bytes(r.kept)) for r in repeats.remove_repeats(docs, 40, 13, 4, many=300).collect())
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == brute(rows, 40)


def test_suffix_array_against_sorting():
    rng = random.Random(3)
    for _ in range(1500):
        n, k = rng.randrange(0, 40), rng.choice([1, 2, 3, 9])
        s = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3:
            s = s[:5] * rng.randrange(1, 6)
        got = suffix_array(s)
        assert got == sorted(range(len(s)), key=lambda i: s[i:])
        for r, x in enumerate(common_prefixes(s, got)):
            a, b = s[got[r] :], s[got[r - 1] :] if r else []
            assert x == next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
