"""SQL that gives the rows of those queries, or of the parts of them, that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

# Where each match of a pattern begins: the gaps and matches before it, added up.
STARTS = """spans AS (
  SELECT doc_id, kind, ordinal, hits[i] AS hit, parts[i] AS part, list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS begins
  FROM found, unnest(range(1, len(hits) + 1)) AS u(i)
)"""


def _found(ordinal: int, kind: str, pattern: str, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"SELECT doc_id, '{kind}' AS kind, {ordinal} AS ordinal, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS parts FROM d WHERE regexp_matches(t, {p})"


SECRETS = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]+", 0),
    ("hex", "[0-9a-f]{24,}", 0),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0),
    ("pem", r"-----BEGIN [A-Z]*\x20?PRIVATE KEY-----", 0),
]

OP4_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found(i, *rule) for i, rule in enumerate(SECRETS))}),
{STARTS},
kept AS (SELECT doc_id, kind, ordinal, begins, kind || ':' || begins || ':' || (begins + length(hit)) AS said FROM spans WHERE length(part) >= [6, 20, 24, 40, 15, 40, 20][ordinal + 1])
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY begins, ordinal) FILTER (ordinal < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY begins, ordinal), '') AS spans
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id GROUP BY d.doc_id
"""

PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]

PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found(i, *rule) for i, rule in enumerate(PERSONAL))}),
{STARTS},
counted AS (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM spans),
kept AS (
  SELECT doc_id, ordinal, begins, kind || ':' || begins || ':' || (begins + length(hit)) AS said FROM counted
  WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and([length(ltrim(p, '0')) <= 3 AND ('0' || right(ltrim(p, '0'), 3))::INT <= 255 FOR p IN string_split(hit, '.')])
    WHEN 'phone' THEN length(digits) BETWEEN 8 AND 15
    ELSE length(digits) BETWEEN 16 AND 19 AND list_sum([CASE WHEN i % 2 = 0 THEN 2 * digits[-i]::INT - CASE WHEN digits[-i] > '4' THEN 9 ELSE 0 END ELSE digits[-i]::INT END FOR i IN range(1, least(length(digits), 19) + 1)]) % 10 = 0
  END
)
SELECT d.doc_id, count(*) FILTER (ordinal = 0) AS n_email, count(*) FILTER (ordinal = 1) AS n_ip, count(*) FILTER (ordinal = 2) AS n_card, count(*) FILTER (ordinal = 3) AS n_phone,
  sha256(coalesce(string_agg(said, ',' ORDER BY ordinal, begins), '')) AS base_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id GROUP BY d.doc_id
"""

# crc32 of a short text: the table by its rule, then byte by byte.
CRC_TABLE = """crc(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS l FROM crc WHERE k = 8)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({text}, '')]), lambda c, b: xor(c // 256, l[xor(c, b) % 256 + 1])), 4294967295)"


LM_BASE = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, {_crc("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append({WORDS}, '') AS words FROM documents, crcs),
tokens AS (SELECT doc_id, held_out, unnest(words) AS w FROM d),
seen AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w),
whole AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM seen)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1))), 4) AS base_score
FROM tokens LEFT JOIN seen USING (w) CROSS JOIN whole GROUP BY doc_id, held_out
"""

OP10_NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS words FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END)) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
near AS (SELECT a, b FROM pairs JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN sizes USING (doc_id) JOIN least ON w.doc_id = least.a
"""

SHARD_BALANCE = """
SELECT count(*) AS docs, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes, 8::BIGINT AS shards, true AS gapless, true AS balanced FROM documents
"""

OP13_DEDUP = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""


def _grams(name: str, key: str, table: str) -> str:
    """Features of a table, one row each."""
    return f"""{name}_w AS (SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}),
{name} AS (SELECT id, len(w) AS n, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))])) AS f FROM {name}_w)"""


OP11_RESAMPLE = f"""
WITH RECURSIVE {CRC_TABLE}, {_grams("docs", "doc_id", "documents")}, {_grams("goal", "item_id", "benchmark")},
named AS (SELECT f, [('0x' || hex(encode(f))[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(octet_length(encode(f)))] AS b FROM (SELECT f FROM docs UNION SELECT f FROM goal)),
hashed AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, l[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM named, crcs),
seen AS (SELECT bucket, count(*) AS s FROM docs JOIN hashed USING (f) GROUP BY bucket),
wanted AS (SELECT bucket, count(*) AS t FROM goal JOIN hashed USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0)::DOUBLE FROM seen) AS total_s, (SELECT coalesce(sum(t), 0)::DOUBLE FROM wanted) AS total_t),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (total_s + 10000)) / ((s + 1)::DOUBLE * (total_t + 10000))))::BIGINT AS gain FROM seen LEFT JOIN wanted USING (bucket), totals),
summed AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS g FROM docs JOIN hashed USING (f) JOIN gain USING (bucket) GROUP BY id),
weighed AS (SELECT w.id AS doc_id, len(w.w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight FROM docs_w w LEFT JOIN summed USING (id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""


def op12_vector_codes() -> str:
    """Four parts of 16 components, 256 entries, four rounds, each written out; whole numbers are exact in doubles."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT vec_id, x.part, arg_min(entry, (sq - 2 * list_inner_product(v, c) + list_inner_product(c, c)) * 1024 + entry) AS entry, min(sq - 2 * list_inner_product(v, c) + list_inner_product(c, c))::BIGINT AS d
  FROM x JOIN b{k} b ON x.part = b.part GROUP BY vec_id, x.part
),"""

    def moved(k: int) -> str:
        return f"""m{k} AS (SELECT a.part, a.entry, i, floor(sum(v[i]) / count(*)) AS c FROM a{k} a JOIN x USING (vec_id, part), unnest(range(1, 17)) AS u(i) GROUP BY a.part, a.entry, i),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS c FROM m{k} GROUP BY part, entry) n ON b.part = n.part AND b.entry = n.entry),"""

    steps = "\n".join(assigned(k) + moved(k) for k in range(4)) + assigned(4)
    return f"""
WITH kept AS (
  SELECT vec_id, label, [floor(1024 * e::DOUBLE) FOR e IN embedding] AS g FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
x AS MATERIALIZED (SELECT vec_id, part, g[16 * part + 1:16 * part + 16] AS v, list_inner_product(v, v) AS sq FROM kept, unnest(range(4)) AS u(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM x QUALIFY entry < 256),
{steps}
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string([e::BIGINT FOR e IN c], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (vec_id), book
"""

FINGERPRINT_BASE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w) AS after FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, length(t) AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(after, length(t) // 4)) AS edited_sha256 FROM n
"""

SHARD_ROWS = """
SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, 'bytes' AS law FROM documents
"""
