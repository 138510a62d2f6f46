"""The registered queries of this folder, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, langid, merkle, mixing, pii, token_counts, warc
from tessera.llm.common import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.mixing import poisson_mix
from tessera.llm.ngram_join import ngram_join
from tessera.llm.repeats import remove_repeats
from tessera.llm.topk import exact_top_k
from tessera.llm.whitening import whiten


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = poisson_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("__copies").alias("copies"), F.col("__copy").alias("copy_no"), F.col("__order").alias("shuffle_key"), "text")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return out.select("conv_id", "speaker", F.col("part").cast("long").alias("part"), "piece", F.col("starts_at").cast("long").alias("starts_at"), F.col("n_messages").cast("long").alias("n_messages"), "text", mask.alias("mask"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.size("languages").alias("n_languages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("removed") > 0).alias("has_repeats"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"), tampered=lambda doc_id: F.crc32(doc_id.cast("string")) % 3 == 0)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_personal_data(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_warc": op3_warc,
    "op4_langid": op4_langid,
    "op5_ngram_join": op5_ngram_join,
    "op6_repeats": op6_repeats,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_topk": op9_topk,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_manifest": op12_manifest,
    "op13_pii": op13_pii,
}


def _mixing_sql() -> str:
    listed = ", ".join(f"('{s}', {w!r}::double)" for s, w in mixing.WEIGHTS.items())
    return f"""
WITH RECURSIVE weights(s, w) AS (SELECT * FROM (VALUES {listed}, ('(rest)', {mixing.REST!r}::double)) v(s, w)),
pooled AS (SELECT d.*, coalesce((SELECT w.s FROM weights w WHERE w.s = d.source), '(rest)') AS pool FROM documents d),
sizes AS (SELECT pool, sum(strlen(coalesce(text, '')))::bigint AS b FROM pooled GROUP BY pool),
used AS (SELECT s, w, b FROM weights JOIN sizes ON s = pool WHERE b > 0),
rates AS (SELECT s, {mixing.SCALE!r} * (w / (SELECT sum(w) FROM used)) * (SELECT sum(b) FROM sizes)::double / b::double AS rate FROM used),
steps(s, rate, k, c) AS (
  SELECT s, rate, 0, exp(-rate) FROM rates
  UNION ALL
  SELECT s, rate, k + 1, c + exp((k + 1) * ln(rate) - rate - lgamma((k + 2)::double)) FROM steps WHERE c < 1 - 1.1102230246251565e-16 AND k < 200
),
drawn AS (
  SELECT *, ('0x' || substr(sha256('{mixing.SEED}:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / {float(2**mixing.BITS)!r} AS u FROM pooled
),
counted AS (SELECT d.*, (SELECT count(*) FROM steps t WHERE t.s = d.pool AND t.c <= d.u AND t.c < 1 - 5e-17) AS copies FROM drawn d)
SELECT doc_id, source, copies::int AS copies, k::int AS copy_no,
  ('0x' || substr(sha256('order:{mixing.SEED}:' || coalesce(doc_id::varchar, '') || ':' || k::varchar), 1, 13))::bigint AS shuffle_key, text
FROM (SELECT *, unnest(generate_series(1, copies)) AS k FROM counted WHERE copies > 0)
"""


def _pii_sql() -> str:
    words = "phone|call|tel|mobile|telefon|teléfono|téléphone"
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::int ELSE (c::int * 2) // 10 + (c::int * 2) % 10 END)) % 10 = 0"
    moved = "substr(replace(match, ' ', ''), 5) || substr(replace(match, ' ', ''), 1, 4)"
    remainder = f"list_reduce(list_transform(string_split({moved}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda r, v: (r * (CASE WHEN v < 10 THEN 10 ELSE 100 END) + v) % 97, 0)"
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", "mail|contact|correo|courriel", 0.7, "", ""),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(match, '.'), lambda p: p::hugeint > 255)) = 0", "ip|host|server|address|adresse", 0.8, "", ""),
        "card": (r"[0-9]([\x20-]?[0-9])+", f"length({digits}) BETWEEN 13 AND 19 AND {luhn}", "card|visa|credit|carte|karte|tarjeta", 0.8, "", ""),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 9 AND 15", words, 0.8, "", ""),
        "iban": (r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?", f"length(replace(match, ' ', '')) BETWEEN 15 AND 34 AND {remainder} = 1", "iban|account|bank|konto|compte|cuenta", 0.8, r"[A-Za-z0-9]\z", "^[A-Za-z0-9]"),
        "local_phone": (r"[(]?[0-9]{3}[)]?[\x20.-]?[0-9]{3}[.-][0-9]{4}", "true", words, 0.4, r"[0-9+(.-]\z|[0-9)]\x20\z", "^[0-9]"),
        "social": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "NOT regexp_matches(match, '^(000|666|9)|-00-|-0000$')", "ssn|social security|taxpayer", 0.5, r"[0-9-]\z", "^[0-9-]"),
    }
    found = " UNION ALL ".join(
        f"SELECT rid, {i} AS no, '{k}' AS kind, start, stop, {score} + CASE WHEN regexp_matches(right(before, 40), '(?i)(^|[^\\p{{L}}])({context})([^\\p{{L}}]|$)') OR regexp_matches(left(after, 40), '(?i)(^|[^\\p{{L}}])({context})([^\\p{{L}}]|$)') THEN 0.3 ELSE 0 END AS score "
        f"FROM placed WHERE no = {i} AND {valid}" + (f" AND NOT regexp_matches(right(before, 2), '{left}') AND NOT regexp_matches(left(after, 2), '{behind}')" if left else "")
        for i, (k, (_, valid, context, score, left, behind)) in enumerate(kinds.items())
    )
    pieces = " UNION ALL ".join(f"SELECT rid, {i} AS no, regexp_extract_all(x, '{p}') AS ms, regexp_split_to_array(x, '{p}') AS gs FROM t" for i, (p, *_) in enumerate(kinds.values()))
    told = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) {}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in list(kinds)[:4])
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents),
pieces AS ({pieces}),
each AS (SELECT rid, no, i, ms[i] AS match, gs[i] AS before, gs[i + 1] AS after FROM (SELECT *, unnest(generate_series(1, len(ms))) AS i FROM pieces WHERE len(ms) > 0)),
placed AS (SELECT *, stop - length(match) AS start FROM (SELECT *, (sum(length(before) + length(match)) OVER (PARTITION BY rid, no ORDER BY i))::bigint AS stop FROM each)),
found AS (SELECT * FROM ({found}) WHERE score >= 0.6)
SELECT doc_id, {counts}, sha256({told.format('FILTER (no < 4)')}) AS base_sha256, {told.format('')} AS spans, count(*) FILTER (no >= 4) AS n_added, round(coalesce(max(score), 0), 2)::double AS top_score
FROM t LEFT JOIN found USING (rid) GROUP BY rid, doc_id
"""


def _manifest_sql(levels: int = 7, over: int = 3) -> str:
    """Trees of at most ``8 ** levels`` documents a language, and of at most ``8 ** over`` languages."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::varchar) || ':' || {v}::varchar END" for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    byte = "list_reduce(list_concat([xor(c, b) & 255], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda k: ascii(k)::bigint)), lambda c, b: xor(c >> 8, {byte})), 4294967295)"

    def tree(name: str, first: str, depth: int) -> list[str]:
        """Levels of (g, i, n, d), each node with its siblings on either side."""
        out, below = [], first
        for k in range(depth + 1):
            around = "string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN {})"
            out.append(f"{name}{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce({around.format('UNBOUNDED PRECEDING AND 1 PRECEDING')}, '') ELSE '' END AS l, CASE WHEN n > 1 THEN coalesce({around.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')}, '') ELSE '' END AS r FROM ({below}))")
            below = f"SELECT g, i // 8 AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}{k} GROUP BY g, i // 8, n"
        return out

    nodes = "SELECT g, i, n, leaf AS d FROM p"
    ctes = [
        f"p AS (SELECT *, coalesce('=' || lang, '') AS g, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::bigint AS i, (count(*) OVER (PARTITION BY lang))::bigint AS n, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS folded FROM documents)",
        *tree("a", nodes, levels),
        f"q AS (SELECT g, (row_number() OVER (ORDER BY encode(g)) - 1)::bigint AS i, (count(*) OVER ())::bigint AS n, d FROM a{levels})",
        *tree("b", "SELECT '' AS g, i, n, d FROM q", over),
    ]
    ctes.append(f"w0 AS (SELECT doc_id, leaf, folded, p.i, q.i AS j, q.d AS subroot, b{over}.d AS root, p.g, '' AS proof FROM p JOIN q ON p.g = q.g CROSS JOIN b{over})")
    for k in range(levels + over):
        node, g, i = (f"a{k}", "w.g", f"w.i >> {3 * k}") if k < levels else (f"b{k - levels}", "''", f"w.j >> {3 * (k - levels)}")
        ctes.append(f"w{k + 1} AS (SELECT w.* REPLACE (CASE WHEN x.n = 1 THEN folded ELSE sha256(x.l || folded || x.r) END AS folded, proof || x.l || x.r AS proof) FROM w{k} w JOIN {node} x ON x.g = {g} AND x.i = {i})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM w{levels + over}"


SQL: dict[str, str] = {
    "op12_manifest": _manifest_sql(),
    "op13_pii": _pii_sql(),
    "op1_mixing": _mixing_sql(),
    "op2_chat": f"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '{chat.NOBODY}') AS role, coalesce(text, '') AS said, coalesce((turn // {chat.PART})::bigint, 1::bigint << 62) AS part FROM conversations),
e AS (
  SELECT m.*, s.role AS speaker, row_number() OVER w AS k,
    CASE WHEN m.role = s.role THEN '<|assistant|>' || chr(10) ELSE '<|user:' || m.role || '|>' || chr(10) END AS head, said || '<|end|>' || chr(10) AS body
  FROM m JOIN (SELECT DISTINCT conv_id, role FROM m) s ON m.conv_id IS NOT DISTINCT FROM s.conv_id
  WINDOW w AS (PARTITION BY m.conv_id, s.role, part ORDER BY turn NULLS LAST, m.role, said)
),
o AS (SELECT *, (k - 1) // {chat.PART} AS piece, (sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part, (k - 1) // {chat.PART} ORDER BY k))::bigint AS stop FROM e),
p AS (
  SELECT conv_id, speaker, part, piece, count(*) AS n_messages, string_agg(head || body, '' ORDER BY k) AS text,
    coalesce(string_agg((stop - length(body))::varchar || '-' || stop::varchar, ',' ORDER BY k) FILTER (role = speaker), '') AS mask
  FROM o GROUP BY conv_id, speaker, part, piece
)
SELECT conv_id, speaker, part, piece, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS starts_at, n_messages, text, mask FROM p
""",
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
s AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY body) END AS stored_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN stored_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN stored_id <> page_id THEN stored_id END AS refers_to,
  CASE WHEN stored_id <> page_id THEN 1 ELSE greatest(1, ceil(length(body) / {float(warc.CHUNK)}))::int END AS chunks
FROM s
""",
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
""",
    "op9_topk": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint AS score
  FROM x q JOIN x c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::int AS rank, vec_id, score FROM r WHERE rank <= 10
""",
}
