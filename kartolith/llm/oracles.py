"""DuckDB SQL equivalent to the corpus queries; patterns are POSIX-free so both engines agree on white space."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"
_WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, k, md5(array_to_string(w[k:k+49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d WHERE len(w) >= 50)
),
least AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT win.doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN least USING (h) WHERE first_doc < win.doc_id)
  GROUP BY doc_id
)
SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN w ELSE
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

LINE_DEDUP = f"""
WITH l AS (
  SELECT doc_id, n, line, translate(regexp_replace(regexp_replace(line, '^{_WS}+', ''), '{_WS}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
),
h AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (holder <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN h USING (k) GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH t AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (
  SELECT DISTINCT side, id, array_to_string(w[k:k+4], ' ') AS sh
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)
),
n AS (SELECT id AS item_id, count(*) AS m FROM s WHERE side = 'i' GROUP BY id),
p AS (
  SELECT d.id AS doc_id, item_id, count(*) AS shared, any_value(m) AS m
  FROM s d JOIN s i USING (sh) JOIN n ON n.item_id = i.id WHERE d.side = 'd' AND i.side = 'i' GROUP BY d.id, item_id
),
f AS (
  SELECT doc_id, count(*) AS n_items, string_agg(cast(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, max(shared / m) AS containment
  FROM p WHERE 100 * shared >= 70 * m GROUP BY doc_id
)
SELECT doc_id, coalesce(n_items, 0) > 0 AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(item_ids, '') AS item_ids, coalesce(containment, 0.0) AS containment
FROM documents LEFT JOIN f USING (doc_id)
"""

WARC_FIXITY = """
SELECT page_id, url, cast(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS payload_sha256,
  substr(md5(concat(coalesce(cast(page_id AS VARCHAR), ''), ' ', coalesce(url, ''))), 1, 2) <> '00' AS intact
FROM pages
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS (SELECT doc_id, j, h[400*j+1:400*j+600] AS piece FROM (SELECT doc_id, h, unnest(range(0, cast(length(h) // 400 + 1 AS BIGINT))) AS j FROM d WHERE length(h) >= 200)),
s AS (SELECT doc_id, k, b FROM (SELECT doc_id, 200 * j + i AS k, piece[2*i+1:2*i+200] AS b FROM (SELECT *, unnest(range(0, 200)) AS i FROM c)) WHERE length(b) = 200),
dup AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY md5(b) ORDER BY doc_id, k) AS n FROM s) WHERE n > 1),
i AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100 THEN 0 ELSE 1 END AS fresh FROM dup)),
r AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS z FROM i GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY a) UNION ALL SELECT doc_id, max(z), 1000000000 FROM r GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(h[2*a+1:2*z], '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, cast(length(d.h) // 2 AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k+4], ' ')) AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 70 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.id = doc_id
"""
