"""Words of records are told once, and only those of the side with few records are ranked."""

import random

from tessera.operators import memory as M

COLUMNS = "id long, project string, type string, topic string, tags array<string>, content string, superseded_by long"


def brute(rows, least=0.6):
    out = {}
    for n in rows:
        for o in rows:
            if n[0] == o[0] or n[1:3] != o[1:3] or n[2] not in ("rule", "decision"):
                continue
            a, b = set(n[5].split()), set(o[5].split())
            if (n[3] is not None and n[3] == o[3]) or set(n[4]) & set(o[4]) or (a and b and len(a & b) / len(a | b) >= least):
                out[o[0]] = max(out.get(o[0], -1), n[0])
    return out


def test_superseded_equals_all_pairs_and_ranks_few_words(spark, monkeypatch):
    rng, rows, plain = random.Random(5), {}, M.stored

    def counted(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(M, "stored", counted)
    data = []
    for i in range(160):
        words = [f"word{rng.randrange(30)}" for _ in range(rng.randrange(0, 9))] if i % 3 else data[rng.randrange(len(data))][5].split()[:-1] if data else []
        tags = [] if i % 8 == 0 else [f"t{rng.randrange(3)}"] if i < 150 else [f"u{i}"]
        data.append((i, f"p{i % 2}", rng.choice(["rule", "decision", "todo"]), f"x{rng.randrange(6)}" if i % 16 == 8 else None, tags, " ".join(words), None))
    df = spark.createDataFrame(data, COLUMNS)
    assert {r.old_id: r.new_id for r in M.superseded(df, df).collect()} == brute(data)
    assert "new" not in rows and rows["words"] < sum(len(set(r[5].split())) for r in data)
