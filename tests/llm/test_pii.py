"""Personal data against a plain version with Python's own expressions."""

import hashlib
import random
import re

from tessera.llm import pii

SCHEMA = "doc_id long, text string, spans string, id string, c0 string"
WORDS = "phone call tel mobile telefon teléfono téléphone".split()
#: Kind, expression, own score, words, what may not stand before and after.
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.7, "mail contact correo courriel".split(), None),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.8, "ip host server address adresse".split(), None),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0.8, "card visa credit carte karte tarjeta".split(), None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.8, WORDS, None),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?", 0.8, "iban account bank konto compte cuenta".split(), (r"[A-Za-z0-9]\Z", r"[A-Za-z0-9]")),
    ("local_phone", r"[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[.-][0-9]{4}", 0.4, WORDS, (r"[0-9+(.-]\Z|[0-9)]\x20\Z", "[0-9]")),
    ("social", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.5, ["ssn", "social security", "taxpayer"], (r"[0-9-]\Z", "[0-9-]")),
]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "iban":
        flat = m.replace(" ", "")
        return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1
    if kind == "social":
        return not re.search("^(?:000|666|9)|-00-|-0000$", m)
    return True


def plain(text, kinds=KINDS):
    out = []
    for kind, pattern, score, words, apart in kinds:
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
            if not valid(kind, m[0]) or apart and (re.search(apart[0], before[-2:]) or re.match(apart[1], after[:2])):
                continue
            near = rf"(?i)(?:^|[\W\d_])(?:{'|'.join(words)})(?:[\W\d_]|\Z)"
            total = round(score + 0.3 * bool(re.search(near, before[-40:]) or re.search(near, after[:40])), 2)
            if total >= 0.6:
                out.append((kind, m.start(), m.end(), total))
    return out


def texts():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@x.de", ".", "-", "%+", " ", "  ", "1", "23", "255", "256", "007", "+1", "+", "(", ")", "4111111111111111", "4111-1111 1111-1111", "é", "ſ", "K", "🦆", "\n", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "ES91 2100 0418 4502 0005 1332 BIC", "phone ", "Tel: ", "TELÉFONO ", "555-123-4567", "(555) 123-4567", "SSN ", "123-45-6789", "000-12-3456", "ip", "10.0.0.1", "1.2.3.4.5"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(1500)]


def test_against_a_plain_version(spark):
    given = [None, "", " ", "x@y.z", "a@b.c%d@e.f", "a@b.c.", "+1 (487) 555-7209", "Mail a.b@c.d now", *texts()]
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(given)] + [(None, "x@y.z", "x", "y", "z"), (3, "x@y.z", "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    seen = set()
    for r in got:
        want = plain(given[r.doc_id] or "") if r.doc_id is not None else plain("x@y.z")
        assert [(s.kind, s.start, s.stop, s.score) for s in r.spans] == want
        seen |= {s[0] for s in want}
    assert seen == {k[0] for k in KINDS}
    for r in pii.report(pii.find_personal_data(docs)).collect():
        want = plain((given[r.doc_id] if r.doc_id is not None else "x@y.z") or "")
        base = [s for s in want if s[0] in ("email", "ip", "card", "phone")]
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))
        assert r.spans == told(want) and r.base_sha256 == hashlib.sha256(told(base).encode()).hexdigest() and r.n_added == len(want) - len(base)
    assert pii.find_personal_data(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).columns == docs.columns


def test_very_long_texts(spark):
    n = 100_000
    long = ["1" * n, "a" * n, "1 " * n, "a.b@c.d " * 20_000, "a@b" + ".c" * n, "1." * n, "+1" + "(" * n, "+1" * n, "4111111111111111, " * 5_000, "DE89 3704 0044 0532 0130 00, " * 2_000, "1-" * n, "é 10.0.0.1" * 5_000]
    got = {r.doc_id: r for r in pii.report(pii.find_personal_data(spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(long)], SCHEMA))).collect()}
    for i, t in enumerate(long):
        # Python's expression for mail needs the square of the length of a run of the characters before the sign
        want = [] if i in (0, 1) else plain(t, KINDS[1:] if "@" not in t else KINDS)
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in want)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, +1 (487) 555-7209, 4111111111111111.", "s", "i", "c"), (2, None, "s", "i", "c"), (3, "clean", "s", "i", "c"), (4, "", None, None, None)], SCHEMA)
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert pii.redact(docs).columns == docs.columns
    assert [got[i].text for i in (1, 2, 3, 4)] == ["é [email], [phone], [card].", None, "clean", ""] and got[1].spans == "s"
    only = pii.redact(docs, rules=pii.BASE[:1]).where("doc_id = 1").first()
    assert only.text == "é [email], +1 (487) 555-7209, 4111111111111111."
