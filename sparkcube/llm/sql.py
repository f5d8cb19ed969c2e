"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS gram
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), hits AS (SELECT r, i, dw.k, item FROM dw JOIN bw USING (k, gram)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hits)) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM g) WHERE c > 1) GROUP BY r
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN l USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words OR 3 * n_dup_lines > n_lines
         OR CAST(word_chars AS DOUBLE) / greatest(n_words, 1) NOT BETWEEN 2.0 AND 15.0 AS failed
  FROM f
), h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(failed AS INT)) AS DOUBLE) AS k FROM j GROUP BY source),
a AS (SELECT sum(n) AS docs, sum(k) AS fails, count(*) AS hosts, sum(k * k / n) AS sq FROM h),
m AS (SELECT fails / docs AS m, sq / docs - (fails / docs) * (fails / docs) AS spread, (fails / docs) * (1 - fails / docs) * hosts / docs AS noise FROM a),
pr AS (SELECT m, CASE WHEN spread > noise THEN least(greatest(m * (1 - m) / (spread - noise) - 1, 1.0), 10000.0) ELSE 10000.0 END AS wt FROM m),
v AS (SELECT source, (k + m * wt) / (n + wt) AS rate FROM h, pr)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT failed AND rate <= 0.5 AS kept, failed AS rule_failed, round(rate, 6) AS host_rate
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8 = f"""
WITH s AS (
  SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN {_LOWER.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")} ELSE '' END AS host,
         CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages
), r(rule, verdict, rhost, rpath) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), b AS (
  SELECT *, (SELECT max_by((rule, r.verdict), length(rule)) FROM r WHERE (s.host = rhost OR s.host LIKE '%.' || rhost) AND starts_with(s.path, rpath)) AS best FROM s
), c AS (
  SELECT *, CASE WHEN coalesce(url, '') NOT LIKE '%://%' THEN coalesce(url, '') ELSE
    {_LOWER.format("regexp_extract(url, '^((?s:.*?))://', 1)")} || '://' ||
    regexp_replace(rtrim(regexp_replace(regexp_replace(host, '^.*@', ''), CASE {_LOWER.format("regexp_extract(url, '^((?s:.*?))://', 1)")} WHEN 'http' THEN ':80$' WHEN 'https' THEN ':443$' ELSE '$.' END, ''), '.'), '^www[.]', '') ||
    CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN regexp_matches(url, '^(?s:.*?)://[^#]*[?][^#]') THEN '?' || regexp_extract(url, '^(?s:.*?)://[^#?]*[?]([^#]*)', 1) ELSE '' END END AS canon FROM b
)
SELECT page_id, host, path, best[1] AS rule,
       coalesce(best[2], CASE WHEN canon GLOB '*://*cheap-pills.*' OR canon GLOB '*://*spam-farm.*' OR canon GLOB '*://*casino*' OR canon GLOB '*://*/wp-login*'
         OR canon GLOB '*://*/cgi-bin/*' OR canon GLOB '*://*adult-*' OR canon GLOB '*://*.onion/*' THEN 'block' ELSE 'allow' END) AS verdict
FROM c
"""

OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
t AS (SELECT DISTINCT a AS root, a AS x FROM l UNION SELECT t.root, l.b FROM t JOIN l ON l.a = t.x),
c AS (SELECT x AS doc_id, min(root) AS m FROM t GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, d.doc_id = coalesce(m, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, i, x[i] AS t, regexp_extract_all(x[i], '[^\x20\x09-\x0D]+') AS w, array_to_string(w, ' ') AS g
  FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d)
), e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS nth FROM l WHERE len(w) > 0),
k AS (SELECT g, any_value(w) AS w, min((doc_id, i)) AS o, min(doc_id) AS first FROM e GROUP BY g),
v AS (
  SELECT g, o, -1 AS p, g AS v FROM k WHERE len(w) >= 8
  UNION ALL SELECT g, o, p, array_to_string(list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, len(w))), ' ') FROM (SELECT g, o, w, unnest(range(1, len(w) + 1)) AS p FROM k WHERE len(w) >= 8)
), near AS (
  SELECT DISTINCT b.g FROM v a JOIN v b ON a.v = b.v AND a.g <> b.g AND a.o < b.o AND ((a.p = b.p) OR (a.p = -1) OR (b.p = -1))
), f AS (
  SELECT e.doc_id, e.i, nth = 1 AND near.g IS NOT NULL AS near, nth > 1 OR (near.g IS NULL AND first < e.doc_id) AS equal
  FROM e JOIN k USING (g) LEFT JOIN near USING (g)
), o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (equal) AS n_equal, count(*) FILTER (near) AS n_near,
         coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT coalesce(equal OR near, false)), '') AS text
  FROM l LEFT JOIN f USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_equal, 0) AS BIGINT) AS n_equal, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, md5(o.text) AS text_md5
FROM documents LEFT JOIN o USING (doc_id)
"""

_CRC = [0] * 256
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = _c >> 1 ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c

# CRC-32 byte by byte over the hexadecimal digits; a group's middle, or a record's, in whole numbers
OP4 = f"""
WITH t AS (SELECT {_CRC} :: BIGINT[] AS crc),
r AS (SELECT doc_id, encode(coalesce(text, '')) AS b, md5(coalesce(text, '')) AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
s AS (
  SELECT doc_id, k, d, CAST(octet_length(b) + 1 AS BIGINT) AS size,
         xor(4294967295 :: BIGINT, list_reduce(list_prepend(4294967295 :: BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, crc[CAST(xor(c & 255, x) AS INT) + 1]))) AS text_crc32
  FROM r, t
), o AS (
  SELECT *, sum(size) OVER (ORDER BY k, d, size ROWS UNBOUNDED PRECEDING) - size AS own, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k) AS bytes FROM s
), g AS (SELECT *, min(own) OVER (PARTITION BY k) AS start FROM o),
h AS (SELECT *, CAST(least(15, floor((CASE WHEN bytes * 16 <= 0.05 * total THEN 2 * start + bytes ELSE 2 * own + size END) * 16 / (2.0 * total))) AS INT) AS shard FROM g)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY k, d, size) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM h
"""

ORACLE: dict[str, str] = {"op2_quality_rules": OP2, "op3_decontamination": OP3, "op4_sharding": OP4, "op8_url_filters": OP8, "op9_near_dedup": OP9, "op10_line_dedup": OP10}
