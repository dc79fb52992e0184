"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import centroids, licenses

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
         length(regexp_replace(text, '(<turn |<part>|</turn>)', '\\\1', 'g')) AS size
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(size + CASE WHEN opens THEN length('<turn ' || role || '>') + 1 + length('</turn>') + 2 ELSE length('<part>') + 2 END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

# Base32 of the hexadecimal digest: character i takes five bits from hexadecimal digits 5i/4 and the one after.
WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) || '0' AS h FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((
           (instr('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 1 AS INT), 1)) - 1) * 16 + instr('0123456789abcdef', substr(h, CAST(i * 5 // 4 + 2 AS INT), 1)) - 1)
           >> CAST(3 - (i * 5) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM d WINDOW w AS (PARTITION BY payload_digest)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: q.x[i] * v.x[i])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM both_ JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents AS d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS m ON m.a = d.doc_id
"""


LICENSES = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         coalesce(text, '') AS text FROM documents),
p AS (SELECT unnest([['gnu', 'general', 'public', 'license'], ['apache', 'license'], ['cc', 'by'], ['mit', 'license']]) AS p, unnest(['gpl', 'apache', 'cc-by', 'mit']) AS label),
hits AS (SELECT doc_id, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1] = p[1] AND w[i + 1 : i + len(p)] = p)) AS k FROM w, p WHERE list_contains(w, p[1])),
base AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {templates}) AS v(label, words, least, width)),
held AS (SELECT doc_id, text, w, t.* FROM w, t WHERE len(list_intersect(list_distinct(w), words)) >= least),
lines AS (
  SELECT doc_id, label, words, least, list_distinct(regexp_extract_all(translate(unnest(string_split(text, chr(10))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM held),
windows AS (SELECT doc_id, label, words, least, unnest(list_transform(range(0, len(w)), lambda i: len(list_intersect(list_distinct(w[i + 1 : i + width]), words)))) AS n FROM held),
blocks AS (SELECT doc_id, label, words, least, len(list_intersect(b, words)) AS n FROM lines UNION ALL SELECT doc_id, label, words, least, n FROM windows),
found AS (SELECT doc_id, label, max(n / len(words)) AS share FROM blocks WHERE n >= least GROUP BY ALL),
names AS (SELECT DISTINCT doc_id, label FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM found)),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM names GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN shares USING (doc_id)
"""


def license_sql() -> str:
    """LICENSES with the templates' distinct words, the least number of them, and the width of a window."""
    index = licenses.Index(licenses.TEMPLATES, {}, licenses.THRESHOLD)
    row = lambda k: f"('{index.labels[k]}', [{', '.join(repr(w.decode()) for w in sorted(index.sets[k]))}], {index.least[k]}, {index.width[k]})"
    return LICENSES.replace("{templates}", ", ".join(map(row, range(len(index.sets)))))


LINES = r"""
WITH l AS (
  SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, s.first IS NOT NULL AND s.first <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# The checksum of each different word is the fold of its bytes over crc32's table of 256 values, which is made by its rule.
RESAMPLING = r"""
WITH w AS MATERIALIZED (
  SELECT 's' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL SELECT 't', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
u AS MATERIALIZED (SELECT side, id, unnest(w) AS word FROM w),
table_ AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, step: xor(c >> 1, (c & 1) * 3988292384), i)) AS t),
crc AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2))::BIGINT), lambda c, b: xor(c >> 8, t[CAST(1 + (xor(c, b) & 255) AS INT)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM u), table_),
f AS MATERIALIZED (SELECT side, id, bucket FROM u JOIN crc USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f GROUP BY bucket),
total AS (SELECT count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(n.t + 1 AS DOUBLE) * (total.s + 10000) / (CAST(n.s + 1 AS DOUBLE) * (total.t + 10000)))) AS BIGINT) AS gain FROM n, total),
d AS (SELECT id AS doc_id, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY id),
x AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x WHERE n_features >= 20)
SELECT x.*, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)
"""

START = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT * FROM (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS k, x FROM v) WHERE k < {count})"""
ASSIGN = """,
a{i} AS MATERIALIZED (
  SELECT vec_id, x, k, d FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM (
      SELECT v.vec_id, v.x, c.k, CAST(list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT) AS d FROM v, c{i} AS c)) WHERE r = 1)"""
MOVE = """,
m{j} AS (SELECT k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(x) AS y FROM a{i}) GROUP BY k, i),
c{j} AS MATERIALIZED (
  SELECT k, coalesce(n.x, c{i}.x) AS x FROM c{i} LEFT JOIN (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM m{j} GROUP BY k) AS n USING (k))"""
END = """
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{i} JOIN c{i} AS c USING (k)"""


def centroid_sql() -> str:
    """All rounds, one after the other."""
    text = START.format(scale=centroids.SCALE, seed=centroids.SEED, count=centroids.CENTROIDS)
    for i in range(centroids.ROUNDS):
        text += ASSIGN.format(i=i) + MOVE.format(i=i, j=i + 1)
    return text + ASSIGN.format(i=centroids.ROUNDS) + END.format(i=centroids.ROUNDS)


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_formatting": CHAT, "op3_warc": WARC, "op6_top_k": TOP_K, "op8_license_scan": license_sql(), "op9_ngram_jaccard": JACCARD, "op11_line_dedup": LINES, "op12_importance_resampling": RESAMPLING, "op13_centroids": centroid_sql()}
