"""SQL of the queries that SQL can express on whole tables."""

from . import jaccard, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {jaccard.WORDS} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {jaccard.WORDS - 2}), lambda i: array_to_string(w[i:i + {jaccard.WORDS - 1}], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM b JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * shared >= {jaccard.PERCENT} * (p.n + q.n - shared)),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM w UNION SELECT c.doc_id, l.b FROM c JOIN l ON c.reached = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)"""


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _spans(kind: int, pattern: str, least: int, group: int = 0) -> str:
    return f"""SELECT doc_id, source, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'e': CAST(list_sum(list_transform(p[1:i], lambda g: length(g))) + list_sum(list_transform(m[1:i], lambda g: length(g))) AS BIGINT), 'm': m[i], 'v': v[i]}}), recursive := true)
FROM (SELECT doc_id, source, regexp_extract_all(text, '{_q(pattern)}', 0) AS m, regexp_extract_all(text, '{_q(pattern)}', {group}) AS v, string_split_regex(text, '{_q(pattern)}') AS p FROM d) WHERE len(m) > 0"""


#: The base patterns, written as the contract has them.
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS, _HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
_RUN = "[A-Za-z0-9_+/-]{24,}"
SECRETS = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
f0 AS ({_spans(0, _ASSIGN, 8, 2)} UNION ALL {_spans(1, _ACCESS, 16)} UNION ALL {_spans(2, _HEX, 32)} UNION ALL {_spans(3, _RUN, 24)}),
f AS (SELECT doc_id, source, kind, e - length(m) AS s, e, v FROM f0 WHERE CASE kind WHEN 0 THEN length(v) >= 8 WHEN 1 THEN length(m) >= 16 WHEN 2 THEN length(m) >= 32 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE TRUE END),
o AS (SELECT v, count(DISTINCT coalesce(source, '')) AS owners FROM f GROUP BY v),
k AS (SELECT doc_id, kind, s, e, owners <= {secrets.MAX_OWNERS} AS live, ['{"', '".join(secrets.KINDS)}'][kind + 1] || ':' || s || ':' || e AS span FROM f JOIN o USING (v) WHERE kind < 3 OR owners <= {secrets.MAX_OWNERS}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(span, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_examples FROM k GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM d LEFT JOIN g USING (doc_id)"""
