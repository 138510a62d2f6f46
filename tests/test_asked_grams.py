"""Words and symbols meet by the letters that words ask for; nothing else is written."""

from tessera.operators import handoff as H


def test_only_letters_that_words_ask_for_are_written(spark, monkeypatch):
    rows, plain = {}, H.stored

    def counted(df, name):
        out = plain(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(H, "stored", counted)
    names = [(f"s{i}", f"handlerOfRequests{i % 9}", f"Class{i % 9}.handlerOfRequests{i % 9}", "src/lib/a.ts") for i in range(300)] + [("t1", "Login", "Auth.Login", "src/web/b.ts"), ("t2", "logout", "Auth.logout", "src/web/b.ts"), ("t3", None, None, "src/none.ts"), ("t4", "x", "x", None)]
    symbols = spark.createDataFrame(names, "id string, name string, qualified string, file string")
    asked = ["LOGIN", "web/", "Auth.login\nsrc/web", "REQUESTS4", "b.ts", "none.", "lib/a"]
    got = {r.asked: (r.id, r.rank) for r in H.resolved_symbols(spark.createDataFrame([(a,) for a in asked], "asked string"), symbols).collect()}
    assert got == {"LOGIN": ("t1", 2), "web/": ("t1", 2), "Auth.login\nsrc/web": ("t1", 2), "REQUESTS4": ("s103", 2), "b.ts": ("t1", 2), "none.": ("t3", 2), "lib/a": ("s0", 2)}
    assert rows["grams"] < 150
