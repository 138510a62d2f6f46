import base64
import hashlib
import random

import numpy as np
import tiktoken

from tessera.llm import bpe

TEXTS = [None, "", "a", "Hello  world,\n\n it's 12 o'clock 'll", "x" * 500, " \t\n" * 90 + "end", "ab 12 é中文 \u0007 " * 60, "a" * 30 + " " + "b" * 200 + " c d e " * 20, "'" * 99 + "ll've" * 20]


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.vocabulary_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.pattern_text(), mergeable_ranks=ranks, special_tokens={})


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, token_ids string")


def test_chunks_of_any_size_give_the_ids_of_the_whole_text(spark):
    enc = reference()
    docs = rows(spark, TEXTS).union(rows(spark, TEXTS).where("doc_id = 6"))
    want = sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)] + [(6, enc.encode_ordinary(TEXTS[6]))])
    for chunk, overlap in ((1 << 16, 1 << 10), (64, 24), (16, 8)):
        got = sorted((r.doc_id, list(r.token_ids)) for r in bpe.encode_documents(docs, chunk=chunk, overlap=overlap).collect())
        assert got == want


def test_digests_and_round_trip(spark):
    enc = reference()
    for r in bpe.digests(rows(spark, TEXTS)).collect():
        text = TEXTS[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    assert bpe.digests(rows(spark, [])).count() == 0


def test_both_libraries_split_every_character_alike():
    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own, enc = bpe.coder(bpe.vocabulary_path()), reference()
    assert np.frombuffer(own.encode(text), dtype="<i4").tolist() == enc.encode_ordinary(text)
    rng = random.Random(1)
    for letters in (list(map(chr, range(256))), ["a", " ", "'ll", "'s", "9", "é", "\u0558", "中", "\x1c", "\t", "²"]):
        for _ in range(2000):
            text = "".join(rng.choice(letters) for _ in range(60))
            assert np.frombuffer(own.encode(text), dtype="<i4").tolist() == enc.encode_ordinary(text)
