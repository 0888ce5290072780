"""The queries of this subpackage that SQL can say, for DuckDB: plain set logic, another way round than the operators."""

from __future__ import annotations

from tallywise.llm.common import LOWER, UPPER

BLANK = r"[^\x20\x09-\x0D]+"
SIGNS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    text = f"translate({text}, '{UPPER}', '{LOWER}')" if lower else text
    return f"regexp_extract_all({text}, '{pattern}')"


def _reached(nodes: str, links: str) -> str:
    """``reached(s, t)``: every node from every node; ``links`` has both directions."""
    return f"""reached(s, t) AS (SELECT id, id FROM {nodes} UNION SELECT r.s, l.y FROM reached r JOIN {links} l ON r.t = l.x)"""


JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(BLANK, True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [w]
  ELSE list_transform(range(greatest(len(w) - 4, 0)), lambda i: w[i + 1:i + 5]) END) AS k FROM d),
n AS (SELECT d.doc_id AS id, count(k) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n u ON u.id = x JOIN n v ON v.id = y WHERE 100 * c >= 75 * (u.n + v.n - c)),
{_reached('n', 'l')}
SELECT id AS doc_id, n AS n_shingles, (SELECT min(t) FROM reached WHERE s = id) AS component_id FROM n"""

VECTORS = f"""WITH RECURSIVE e AS (SELECT vec_id AS id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
l AS (SELECT a.id AS x, b.id AS y FROM e a JOIN e b ON a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{_reached('e', 'l')},
c AS (SELECT id, (SELECT min(t) FROM reached WHERE s = id) AS component_id, (SELECT count(*) FROM l WHERE x = id) AS n FROM e)
SELECT id AS vec_id, n AS n_links, component_id, id = component_id AS kept FROM c"""

SUBSTRINGS = f"""WITH d AS (SELECT doc_id, {_words(BLANK, False)} AS w FROM documents),
k AS (SELECT doc_id, p, w[p + 1:p + 20] AS k FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 19, 0))) AS p FROM d)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM f WHERE r > 1),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS q FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t FROM w ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)"""

CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words(SIGNS, True)} AS w FROM documents),
b AS (SELECT item_id, {_words(SIGNS, True)} AS w, least(13, len(w))::INTEGER AS n FROM benchmark),
bk AS (SELECT DISTINCT item_id, n, w[p + 1:p + n] AS k FROM (SELECT item_id, n, w, unnest(range(len(w) - n + 1)) AS p FROM b WHERE n > 0)),
dk AS (SELECT doc_id, n, p, w[p + 1:p + n] AS k FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS p
  FROM d, (SELECT DISTINCT n FROM bk))),
hit AS (SELECT doc_id, p, n, item_id FROM dk JOIN bk USING (n, k)),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id),
bt AS (SELECT row_number() OVER () AS item, item_id, greatest(30, len(w)) AS size, list_distinct(w) AS terms
  FROM (SELECT DISTINCT item_id, w FROM b WHERE len(w) > 0)),
bw AS (SELECT item, unnest(terms) AS t FROM bt),
dw AS (SELECT doc_id, unnest(w) AS t, unnest(range(len(w))) AS q FROM d),
occ AS (SELECT doc_id, item, q, t FROM dw JOIN bw USING (t)),
enough AS (SELECT doc_id, item, item_id, size, greatest(ceil(0.8 * len(terms)), 1) AS least
  FROM (SELECT doc_id, item, count(DISTINCT t) AS k FROM occ GROUP BY ALL) JOIN bt USING (item) WHERE k >= ceil(0.8 * len(terms))),
near AS (SELECT doc_id, item_id, a.q, count(DISTINCT o.t) AS k FROM enough JOIN occ a USING (doc_id, item) JOIN occ o USING (doc_id, item)
  WHERE o.q BETWEEN a.q AND a.q + size - 1 GROUP BY doc_id, item, item_id, a.q, least HAVING count(DISTINCT o.t) >= least),
close AS (SELECT doc_id, count(*) AS n_near, string_agg(x, ',' ORDER BY x) AS x
  FROM (SELECT doc_id, concat_ws(':', item_id, q, k) AS x FROM near) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(x, '')) AS near_sha256
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id) LEFT JOIN close USING (doc_id)"""

LINES = """WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
u AS (SELECT doc_id, unnest(a) AS l, unnest(range(len(a))) AS i FROM t),
y AS (SELECT (doc_id, i) AS plc, l, string_split(l, ' ') AS w FROM u WHERE l <> ''),
copied AS (SELECT l, min(plc) AS lo FROM y GROUP BY l),
x AS (SELECT plc, w FROM y WHERE len(w) >= 5),
v AS (SELECT plc, p, list_concat(w[1:p], w[p + 2:len(w)]) AS v FROM (SELECT plc, w, unnest(range(len(w))) AS p FROM x)),
whole AS (SELECT w AS v, min(plc) AS lo FROM x GROUP BY w),
part AS (SELECT v, p, min(plc) AS lo FROM v GROUP BY v, p),
any_part AS (SELECT v, min(plc) AS lo FROM v GROUP BY v),
gone AS (SELECT y.plc FROM y JOIN copied USING (l) WHERE lo < y.plc
  UNION SELECT v.plc FROM v JOIN part ON part.v = v.v AND part.p = v.p AND part.lo < v.plc
  UNION SELECT v.plc FROM v JOIN whole ON whole.v = v.v AND whole.lo < v.plc
  UNION SELECT x.plc FROM x JOIN any_part a ON a.v = x.w AND a.lo < x.plc),
m AS (SELECT u.*, (doc_id, i) IN (SELECT plc FROM gone) AS g FROM u)
SELECT doc_id, count(*) FILTER (g) AS n_removed, coalesce(string_agg(i::VARCHAR, ',' ORDER BY i) FILTER (g), '') AS removed_lines,
  sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT g), '')) AS text_sha256 FROM m GROUP BY doc_id"""

HARD_NEGATIVES = """WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label = b.label AS same, b.id AS id, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor, id, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
  s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) <= 10"""

ORACLE_SQL = {
    "op2_jaccard_join": JACCARD, "op4_line_dedup": LINES, "op6_covertree": VECTORS, "op7_substrings": SUBSTRINGS,
    "op8_decontamination": CONTAMINATION, "op13_hard_negatives": HARD_NEGATIVES,
}
