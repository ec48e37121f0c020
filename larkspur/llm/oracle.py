"""SQL of the queries that SQL can express: plain, quadratic forms of what the operators do."""

from __future__ import annotations

from larkspur.llm.history import TRACKING

_PAIRS = """WITH RECURSIVE w AS (SELECT id, list_distinct(regexp_extract_all(lower(nfc_normalize(coalesce(title, '') || ' ' || coalesce(lede, ''))), '[\\p{L}\\p{N}]+')) AS ws FROM raw_articles),
t AS (SELECT id, unnest(ws) AS x FROM w), n AS (SELECT id, len(ws) AS n FROM w WHERE len(ws) > 0),
s AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM t a JOIN t b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a AS id_a, b AS id_b FROM s JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 20 * k >= 13 * (x.n + y.n - k))
"""
_GROUPS = """, e AS (SELECT id_a AS u, id_b AS v FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
r AS (SELECT DISTINCT u AS id, u AS g FROM e UNION SELECT e.v, r.g FROM r JOIN e ON e.u = r.id AND r.g < e.v), grp AS (SELECT id, min(g) AS group_id FROM r GROUP BY id)
"""
_REST = "regexp_replace(regexp_replace(regexp_replace(url, '^\\s+|\\s+$', '', 'g'), '#.*$', '', 's'), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//', '')"

P2_FOUND = _PAIRS + "SELECT id_a, id_b FROM pairs"

P2_CLASSES = _PAIRS + """, c AS (SELECT w.id, list_sort(ws) AS ws FROM w WHERE len(ws) > 0), k AS (SELECT ws, min(id) AS class_id, count(*) AS size FROM c GROUP BY ws), m AS (SELECT id, class_id, size FROM c JOIN k USING (ws)),
l AS (SELECT x.class_id AS p, count(DISTINCT y.class_id) AS links FROM (SELECT id_a AS i, id_b AS j FROM pairs UNION ALL SELECT id_b, id_a FROM pairs) JOIN m x ON x.id = i JOIN m y ON y.id = j WHERE x.class_id <> y.class_id GROUP BY 1)
SELECT id, class_id, size, coalesce(links, 0) AS links FROM m LEFT JOIN l ON p = class_id"""

P4_FOUND = _PAIRS + f""", u AS (SELECT id, batch_no, lower(regexp_extract(regexp_replace(url, '^\\s+', ''), '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) AS scheme, {_REST} AS rest FROM raw_articles WHERE trim(coalesce(url, '')) <> ''),
p AS (SELECT id, batch_no, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), CASE scheme WHEN 'https' THEN ':443$' WHEN 'http' THEN ':80$' ELSE ':(?:80|443)$' END, ''), '^www\\.', '') || chr(10) || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') || chr(10)
  || array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT list_contains({TRACKING!r}, lower(split_part(x, '=', 1))))), '&') AS k FROM u),
f AS (SELECT id, batch_no, lower(trim(simhash)) AS k FROM raw_articles WHERE trim(coalesce(simhash, '')) <> '' AND lower(trim(simhash)) <> repeat(substr(lower(trim(simhash)), 1, 1), length(trim(simhash)))),
b AS (SELECT id, batch_no FROM raw_articles)
SELECT DISTINCT id FROM (
  SELECT y.id FROM pairs JOIN b x ON x.id = id_a JOIN b y ON y.id = id_b WHERE x.batch_no < y.batch_no UNION ALL SELECT x.id FROM pairs JOIN b x ON x.id = id_a JOIN b y ON y.id = id_b WHERE y.batch_no < x.batch_no
  UNION ALL SELECT id FROM p JOIN (SELECT k, min(batch_no) AS first FROM p GROUP BY k) USING (k) WHERE first < batch_no UNION ALL SELECT id FROM f JOIN (SELECT k, min(batch_no) AS first FROM f GROUP BY k) USING (k) WHERE first < batch_no)"""

P5_FOUND = _PAIRS + _GROUPS + """, src AS (SELECT form, arg_min(t, source_id) AS trust FROM (SELECT source_id, coalesce(trust_score, 0.0) AS t, lower(trim(unnest(list_concat([name], aliases)))) AS form FROM news_sources) WHERE form <> '' GROUP BY form),
a AS (SELECT group_id, r.id, r.received_at AS late, coalesce(trust, 0.0) AS trust, [{'f': 'title', 'n': length(regexp_replace(coalesce(title, ''), '^\\s+|\\s+$', '', 'g'))}, {'f': 'lede', 'n': length(regexp_replace(coalesce(lede, ''), '^\\s+|\\s+$', '', 'g'))}, {'f': 'source', 'n': CASE WHEN trust IS NULL THEN 0 ELSE 1 END},
  {'f': 'entities', 'n': coalesce(len(list_distinct(list_filter(list_transform(entities, lambda e: lower(trim(e))), lambda e: e <> ''))), 0)}] AS v FROM raw_articles r JOIN grp USING (id) LEFT JOIN src ON form = lower(trim(source))),
x AS (SELECT group_id, id, late, trust, unnest(v) AS v FROM a), y AS (SELECT group_id, id, late, trust, v.f AS field_name, v.n AS n FROM x WHERE v.n > 0),
m AS (SELECT *, max(n) OVER q AS mn, max(late) OVER q AS ml, max(trust) OVER q AS mt FROM y WINDOW q AS (PARTITION BY group_id, field_name))
SELECT group_id, field_name, min(id) AS id FROM m WHERE n = mn AND late = ml AND trust = mt GROUP BY 1, 2"""

ORACLE = {"p2_found": P2_FOUND, "p2_classes": P2_CLASSES, "p4_found": P4_FOUND, "p5_found": P5_FOUND}
