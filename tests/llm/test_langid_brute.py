"""The mixture against a plain one: every set of languages, expectation-maximisation item by item, penalised likelihood."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np

from tessera.llm import langid


def plain(counts: dict[int, float], p: list[list[float]], rounds: int = 400):
    """The shares of the best set: the likelihood less a penalty for each language after the first."""
    total, best = sum(counts.values()), None
    for size in range(1, len(p) + 1):
        for chosen in combinations(range(len(p)), size):
            share = [1 / size] * size
            for _ in range(rounds if size > 1 else 0):
                gained = [0.0] * size
                for bucket, n in counts.items():
                    parts = [s * p[c][bucket] for s, c in zip(share, chosen, strict=True)]
                    for i, x in enumerate(parts):
                        gained[i] += n * x / sum(parts)
                share = [g / total for g in gained]
            fit = sum(n * math.log(sum(s * p[c][bucket] for s, c in zip(share, chosen, strict=True))) for bucket, n in counts.items())
            value = fit - langid.PENALTY * math.log(max(2.0, total)) * (size - 1)
            if best is None or value > best[0] + 1e-9:
                best = (value, chosen, share)
    return {c: s for c, s in zip(best[1], best[2], strict=True)}


def test_against_every_set_of_languages():
    rng = random.Random(11)
    alphabets = ["abcdefgh", "efghijkl", "mnopqrst", "aeimquwx"]
    words = [["".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(60)] for a in alphabets]
    counts = np.zeros((4, langid.BUCKETS))
    for i, own in enumerate(words):
        counts[i] = np.bincount(langid.features(" ".join(rng.choice(own) for _ in range(4000))), minlength=langid.BUCKETS)
    model = langid.Model(["k", "l", "m", "n"], counts)
    for mix in ([1, 0, 0, 0], [0, 0, 1, 0], [0.6, 0.4, 0, 0], [0.3, 0, 0.7, 0], [0.4, 0.3, 0.3, 0], [0, 0.5, 0, 0.5]):
        picks = rng.choices(range(4), mix, k=150)
        text = " ".join(rng.choice(words[i]) for i in sorted(picks))
        lang, score, shares = model.infer(text)
        seen = {b: n / langid.REPEATS for b, n in Counter(langid.features(text).tolist()).items()}
        want = plain(seen, [[row[i] for row in model.p] for i in range(4)])
        assert set(shares) == {model.languages[c] for c in want} and all(abs(shares[model.languages[c]] - s) < 2e-3 for c, s in want.items())
        assert lang == model.languages[max(want, key=want.get)] and 0 <= score <= 1
        assert all(abs(shares.get(x, 0) - picks.count(i) / 150) < 0.12 for i, x in enumerate(model.languages))
