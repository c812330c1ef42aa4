"""DuckDB SQL for the queries of this folder, where SQL can express them."""


def _shingles(source: str) -> str:
    """Five-word shingles of a table (id, text); short texts are one shingle."""
    return r"""
SELECT DISTINCT id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS s
FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i
      FROM (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM SOURCE))
""".replace("SOURCE", source)


ORACLE = {
    "op3_decontamination": f"""
WITH d AS ({_shingles("(SELECT doc_id AS id, text FROM documents)")}),
b AS ({_shingles("(SELECT item_id AS id, text FROM benchmark)")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(n.n) AS n_shingles, count(*) AS n_found
FROM d JOIN b ON d.s = b.s JOIN n ON n.id = b.id
GROUP BY d.id, b.id
HAVING count(*) >= ceil(0.8 * any_value(n.n) - 1e-9)
""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(trim(line, e' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
g AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, (g.k IS NOT NULL AND l.doc_id <> g.keeper) AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op9_warc_roundtrip": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
""",
    "op2_url_reputation": r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
      FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
names AS (
  SELECT host, n, bad, name, string_split(name, '.') AS l, regexp_matches(name, '^[0-9.]+$|:') AS address
  FROM (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(bad), 0) AS bad,
               regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
        FROM h LEFT JOIN o USING (page_id) GROUP BY host)),
deep AS (
  SELECT *, CASE WHEN len(l) > 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS d
  FROM names),
hosts AS (
  SELECT host, n, bad,
         CASE WHEN address THEN '' ELSE array_to_string(list_slice(l, greatest(len(l) - d + 1, 1), len(l)), '.') END AS suffix,
         CASE WHEN address THEN name ELSE array_to_string(list_slice(l, greatest(len(l) - d, 1), len(l)), '.') END AS domain
  FROM deep),
dom AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suf AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dom GROUP BY ALL),
top AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) AS m FROM suf),
sk AS (SELECT sum(excess) AS excess, sum(room) AS room FROM (
  SELECT sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - (count(*) - 1) AS excess, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room
  FROM suf, top WHERE n > 0)),
ss AS (SELECT CASE WHEN room IS NULL OR room <= 0 THEN 10.0::DOUBLE WHEN excess <= 0 THEN 10000.0::DOUBLE
                   ELSE least(10000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - least(1, excess / room)) / least(1, excess / room))) END AS k FROM sk),
sm AS (SELECT suffix, (m * k + bad) / (n + k) AS m FROM suf, top, ss),
dk AS (SELECT sum(excess) AS excess, sum(room) AS room FROM (
  SELECT suffix, sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - (count(*) - 1) AS excess, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room
  FROM dom JOIN sm USING (suffix) WHERE n > 0 GROUP BY suffix)),
ds AS (SELECT CASE WHEN room IS NULL OR room <= 0 THEN 10.0::DOUBLE WHEN excess <= 0 THEN 10000.0::DOUBLE
                   ELSE least(10000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - least(1, excess / room)) / least(1, excess / room))) END AS k FROM dk),
dm AS (SELECT suffix, domain, (m * k + bad) / (n + k) AS m FROM dom JOIN sm USING (suffix), ds),
hk AS (SELECT sum(excess) AS excess, sum(room) AS room FROM (
  SELECT suffix, domain, sum(n * (bad / n - m) ** 2 / (m * (1 - m))) - (count(*) - 1) AS excess, sum(n) - sum(n::DOUBLE * n) / sum(n) - (count(*) - 1) AS room
  FROM hosts JOIN dm USING (suffix, domain) WHERE n > 0 GROUP BY suffix, domain)),
hs AS (SELECT CASE WHEN room IS NULL OR room <= 0 THEN 10.0::DOUBLE WHEN excess <= 0 THEN 10000.0::DOUBLE
                   ELSE least(10000.0::DOUBLE, greatest(1.0::DOUBLE, (1 - least(1, excess / room)) / least(1, excess / room))) END AS k FROM hk),
hm AS (SELECT host, n, bad, k, (m * k + bad) / (n + k) AS rate FROM hosts JOIN dm USING (suffix, domain), hs),
rep AS (SELECT host, n AS n_labelled, bad AS n_bad, rate, rate - 1.645::DOUBLE * sqrt(rate * (1 - rate) / (n + k + 1)) AS low FROM hm),
r AS (
  SELECT h.*, rep.* EXCLUDE (host), CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM h JOIN rep USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN low > 0.3 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_labelled AS BIGINT) AS n_labelled, CAST(n_bad AS BIGINT) AS n_bad, round(rate, 4) AS bad_rate, round(low, 4) AS bad_low
FROM r
""",
    "op5_jaccard_join": f"""
WITH RECURSIVE d AS ({_shingles("(SELECT doc_id AS id, text FROM documents)")}),
n AS (SELECT id, count(*) AS n FROM d GROUP BY id),
c AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM d a JOIN d b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT x, y FROM c JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE c >= ceil(0.8 / 1.8 * (p.n + q.n) - 1e-9)),
r(id, root) AS (SELECT x, x FROM l UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.id),
k AS (SELECT id, min(root) AS root FROM r GROUP BY id),
m AS (SELECT x AS id, count(*) AS m FROM l GROUP BY x)
SELECT doc_id, coalesce(k.root, doc_id) AS class_id, coalesce(m.m, 0) AS n_links
FROM documents LEFT JOIN k ON k.id = doc_id LEFT JOIN m ON m.id = doc_id
""",
    "op12_periodic_runs": r"""
WITH RECURSIVE
bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
docs AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc(rid, s, k, c) AS (
  SELECT rid, CAST(doc_id AS VARCHAR), 1, 4294967295 FROM docs WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT rid, s, crc.k + 1, xor(crc.c // 256, bits.c)
  FROM crc JOIN bits ON bits.k = 8 AND bits.i = xor(crc.c % 256, ascii(substr(s, crc.k, 1))) WHERE crc.k <= length(s)),
plan AS (
  SELECT docs.rid, w, len(w) AS n, h % 10 = 0 AS planted, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS r
  FROM docs LEFT JOIN (SELECT rid, xor(c, 4294967295) AS h FROM crc WHERE k = length(s) + 1) USING (rid)),
words AS (
  SELECT rid, n, i AS pos, w[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + r)) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM plan)),
level(size, rid, n, pos, name) AS (
  SELECT 1, rid, n, pos, hash(word) FROM words
  UNION ALL
  SELECT size * 2, rid, n, pos, hash(name, half)
  FROM (SELECT *, lead(name, size) OVER (PARTITION BY rid ORDER BY pos) AS half FROM level)
  WHERE half IS NOT NULL AND n >= 4 * (size + 1)),
next AS (SELECT size, rid, pos, lead(pos) OVER (PARTITION BY size, rid, name ORDER BY pos) - pos AS period FROM level),
steps AS (
  SELECT *, pos - row_number() OVER (PARTITION BY rid, period ORDER BY pos) AS island
  FROM next WHERE 2 * period > size AND period <= size),
runs AS (
  SELECT rid, period, min(pos) AS start, max(pos) - min(pos) + any_value(size) + period AS length
  FROM steps GROUP BY rid, period, island
  HAVING max(pos) - min(pos) + any_value(size) + period >= greatest(6, 4 * period)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY length::DOUBLE / period DESC, start, period) AS place FROM runs) WHERE place = 1),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS line FROM runs GROUP BY rid),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY pos) AS text FROM words
  WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.rid = words.rid AND words.pos >= r.start + r.period AND words.pos < r.start + r.length) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
""",
    "op13_hard_negatives": """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) for x in embedding] AS v
  FROM (SELECT DISTINCT vec_id, label, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS place
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
""",
}
