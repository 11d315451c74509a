"""SQL for the operators that it can express, as DuckDB runs it over the same tables."""

from __future__ import annotations

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: each document word covered by a window of ten item words (or by a whole shorter item)
OP1 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  i AS (SELECT item_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
  g AS (SELECT DISTINCT item_id, m, array_to_string(w[k + 1 : k + m], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT m FROM g),
  h AS (SELECT doc_id, m, k, array_to_string(w[k + 1 : k + m], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(greatest(len(w) - m + 1, 0))) AS k FROM d, sizes)),
  f AS (SELECT h.doc_id, h.m, h.k, g.item_id FROM h JOIN g ON g.m = h.m AND g.s = h.s),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS p FROM f) GROUP BY 1),
  it AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM f GROUP BY 1)
  SELECT d.doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: shingle sets, pairs of nine tenths in common, and the smallest id reachable
OP4 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 2), lambda k: array_to_string(w[k + 1 : k + 3], ' ')) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
  ab AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
  r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, ab.y FROM r JOIN ab ON ab.x = r.b)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1, 2"""

#: bytes covered by a 400-byte string that starts twice (as hexadecimal digits), and passages of 50 words that start twice
OP5 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  b AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(greatest(length(h) // 2 - 399, 0))) AS i FROM d)),
  bt AS (SELECT r, i FROM b WHERE k IN (SELECT k FROM b GROUP BY k HAVING count(*) > 1)),
  bi AS (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS n FROM bt)),
  bs AS (SELECT r, min(i) AS a, max(i) + 400 AS z FROM bi GROUP BY r, g),
  bg AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS z0 FROM bs),
  bk AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, string_agg(substr(h, 2 * z0 + 1, 2 * (a - z0)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM bg JOIN d USING (r) GROUP BY r),
  p AS (SELECT r, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS k FROM (SELECT r, w, unnest(range(greatest(len(w) - 49, 0))) AS i FROM d)),
  pt AS (SELECT r, i FROM p WHERE k IN (SELECT k FROM p GROUP BY k HAVING count(*) > 1)),
  pi AS (SELECT r, i, sum(n) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS n FROM pt)),
  ps AS (SELECT r, count(*) AS n, sum(z - a) AS m FROM (SELECT r, min(i) AS a, max(i) + 50 AS z FROM pi GROUP BY r, g) GROUP BY r)
  SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256, coalesce(ps.n, 0) AS n_passages, coalesce(ps.m, 0)::BIGINT AS n_passage_words
  FROM d LEFT JOIN bk USING (r) LEFT JOIN ps USING (r)"""

#: hashed unigrams and bigrams, their gains, and the highest scores; crc32 by its table over the distinct features' bytes
OP12 = rf"""WITH w AS (SELECT 0 AS src, row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    UNION ALL SELECT 1, row_number() OVER (), NULL, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
  f AS (SELECT src, r, f, count(*) AS n FROM (SELECT src, r, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM w WHERE len(w) > 0) GROUP BY 1, 2, 3),
  tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT)) AS t),
  x AS (SELECT DISTINCT f FROM f),
  b AS (SELECT f, xor(list_reduce(list_transform(range(length(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT), lambda c, y: xor(t[xor(c % 256, y) + 1], c // 256), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM x, tab),
  c AS (SELECT b, coalesce(sum(n) FILTER (src = 0), 0) AS s, coalesce(sum(n) FILTER (src = 1), 0) AS t FROM f JOIN b USING (f) GROUP BY 1),
  g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM c),
  m AS (SELECT r, sum(n) AS n, sum(n * g) AS g FROM f JOIN b USING (f) JOIN g USING (b) WHERE src = 0 GROUP BY 1),
  d AS (SELECT doc_id, r, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g::DOUBLE / n), 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (r) WHERE src = 0),
  e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
  o AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS k, count_if(words >= 20) OVER () AS total FROM e)
  SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 25 * total // 100 THEN k END AS rank FROM o"""

#: targets by the level at which weights stop at three times a source, and a copy for each whole number crossed
OP13 = rf"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
  s AS (SELECT k, sum(size)::BIGINT AS source_size, ([5, 2, 1])[(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS weight FROM d GROUP BY 1),
  o AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, k) AS i, sum(source_size) OVER () AS total FROM s),
  l AS (SELECT *, ((total - coalesce(sum(3 * source_size) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lv FROM o),
  t AS (SELECT k, source_size, least(3.0::DOUBLE * source_size, weight * (SELECT coalesce(arg_min(lv, i), 0.0) FROM l WHERE weight * lv <= 3 * source_size)) AS target, ('0x' || substr(sha256('13:' || k), 1, 8))::BIGINT AS shift FROM s),
  q AS (SELECT *, least(floor(coalesce(target / nullif(source_size, 0), 0.0) * 4294967296)::BIGINT, 3 * 4294967296) AS q FROM t),
  p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY size, ('0x' || substr(sha256('13:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id NULLS FIRST) AS n FROM d)
  SELECT doc_id, size, source_size, target, size * ((shift + n * q) // 4294967296 - (shift + (n - 1) * q) // 4294967296) AS taken FROM p JOIN q USING (k)"""

#: registered where the whole small tables take seconds
SQL = {"op1_winnowing": OP1, "op4_jaccard_join": OP4, "op5_suffix_array": OP5, "op12_importance_resampling": OP12, "op13_systematic_mixing": OP13}
