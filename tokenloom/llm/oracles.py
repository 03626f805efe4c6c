"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tokenloom.llm import secrets
from tokenloom.llm.packing import CHUNK_ROWS, EXACT
from tokenloom.llm.quality import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _broken() -> str:
    ratio = {
        "n_words": "n_words",
        "mean_word_length": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "stop_ratio": "n_stop_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    tests = []
    for r in RULES:
        ok = [f"{ratio[r.measure]} >= {r.low}"] * (r.low is not None) + [f"{ratio[r.measure]} <= {r.high}"] * (r.high is not None)
        tests.append(f"CASE WHEN NOT ({' AND '.join(ok)}) THEN '{r.name}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(kind: str, order: int, pattern: str, where: str, base: bool) -> str:
    """The places of the matches of a pattern in the texts t of d, from the parts between them."""
    p = _quoted(pattern)
    return f"""
  SELECT rid, {order} AS o, '{kind}' AS kind, {base} AS base, s AS start, s + length(m) AS stop, m FROM (
    SELECT rid, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)::BIGINT)) AS s
    FROM (SELECT rid, regexp_extract_all(t, {p}) AS ms, string_split_regex(t, {p}) AS ps FROM d)
  ) WHERE {where}"""


def _pii_base() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    doubled = f"list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)"
    octets = "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(try_cast(ltrim(x, '0') AS INT), 0) > 255)) = 0"
    parts = [
        _matches("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "TRUE", True),
        _matches("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", octets, True),
        _matches("card", 2, r"[0-9](?:[\x20-]?[0-9])+", f"length({digits}) BETWEEN 16 AND 19 AND list_sum({doubled}) % 10 = 0", True),
        _matches("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({digits}) BETWEEN 8 AND 15", True),
    ]
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("email", "ip", "card", "phone"))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT rid, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS b FROM s GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in ('email', 'ip', 'card', 'phone'))}, sha256(coalesce(b, '')) AS base_sha256 FROM d LEFT JOIN g USING (rid)
"""


def _secrets() -> str:
    """Spans from split parts and matches; entropies directly from each window, not incrementally."""
    matches = _matches
    parts = [
        matches("assign", 0, secrets.ASSIGN, f"length(regexp_extract(m, {_quoted(secrets.ASSIGN)}, 2)) >= 6", True),
        matches("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20", True),
        matches("hex", 2, "[0-9a-f]+", "length(m) >= 24", True),
    ]
    for k, c in enumerate(secrets.CLASSES, 3):
        tests = [f"length(x) >= {c.window}", *(f"regexp_matches(x, {_quoted(n)})" for n in c.needs)]
        w = f"list_max(list_transform(range(1, length(x) - {c.window} + 2), lambda i: list_aggregate(string_split(substr(x, i, {c.window}), ''), 'entropy')))"
        tests.append(f"round({w}, 9) >= {c.bits}")
        pieces = f"string_split_regex(m, {_quoted('|'.join(secrets.ALLOWED))})"
        parts.append(matches(c.name, k, c.pattern, f"len(list_filter({pieces}, lambda x: {' AND '.join(tests)})) > 0", False))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(parts)}),
f AS (SELECT * FROM s WHERE base OR NOT EXISTS (SELECT 1 FROM s AS b WHERE b.base AND b.rid = s.rid AND b.start < s.stop AND s.start < b.stop)),
g AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) FILTER (base), '') AS b,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS spans
  FROM f GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


def _packing(buckets: int = 16, budget: int = 65_536) -> str:
    """Boundaries by the same dynamic programme as a recursion over the number of buckets; places by plain ranks."""
    cost = "b.top * (b.rows - a.rows_before) - (b.tokens - a.tokens_before)"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS n FROM documents),
h AS (SELECT CASE WHEN n <= {EXACT} THEN n ELSE {EXACT} + 64 * (length(bin(n)) - 1) + (n >> (length(bin(n)) - 7)) END AS bin, max(n) AS top, count(*) AS c, sum(n)::BIGINT AS s FROM d GROUP BY 1),
t AS (SELECT row_number() OVER o AS i, top, sum(c) OVER o - c AS rows_before, sum(c) OVER o AS rows, sum(s) OVER o - s AS tokens_before, sum(s) OVER o AS tokens FROM h WINDOW o AS (ORDER BY top)),
cost AS MATERIALIZED (SELECT a.i AS i, b.i AS j, {cost} AS x FROM t a JOIN t b ON a.i <= b.i),
best AS (
  SELECT 1 AS k, j, x AS v, i FROM cost WHERE i = 1
  UNION ALL
  SELECT k, j, m.v, m.i FROM (SELECT best.k + 1 AS k, cost.j, min(struct_pack(v := best.v + cost.x, i := cost.i)) AS m FROM best JOIN cost ON cost.i = best.j + 1 WHERE best.k < {buckets} GROUP BY best.k, cost.j)
),
least AS (SELECT k, j, i FROM best WHERE j = (SELECT max(i) FROM t) ORDER BY v, k LIMIT 1),
back AS (SELECT k, j, i FROM least UNION ALL SELECT best.k, best.j, best.i FROM back JOIN best ON best.k = back.k - 1 AND best.j = back.i - 1),
edges AS (SELECT row_number() OVER (ORDER BY top) - 1 AS bucket, top, coalesce(lag(top) OVER (ORDER BY top), -1) AS under FROM back JOIN t ON t.i = back.j),
size AS (SELECT greatest(6, ceil(log2(greatest(1.0, count(*) / {CHUNK_ROWS}.0))))::INT AS bits FROM d),
p AS (
  SELECT doc_id, n, bucket, top, row_number() OVER (PARTITION BY bucket ORDER BY chunk, doc_id NULLS FIRST, n) - 1 AS place
  FROM (SELECT *, ('0x' || substr(md5(concat_ws(':', doc_id, n)), 1, 7))::BIGINT % (1 << bits) AS chunk FROM d, size) JOIN edges ON n > under AND n <= top
), z AS (SELECT *, greatest(1, {budget} // greatest(top, 1)) AS rows FROM p)
SELECT doc_id, n AS n_tokens, bucket::INT AS bucket, top AS bucket_len, (place // rows)::BIGINT AS batch, (place % rows)::BIGINT AS slot, top - n AS padding FROM z
"""


def _near_duplicates(percent: int = 80) -> str:
    """All pairs by their shared shingles, and the links' transitive closure."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS s FROM d),
s AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM e),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= {percent} * b.n AND 100 * b.n >= {percent} * a.n GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c WHERE 100 * shared >= {percent} * (n + m - shared)),
e2 AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e2 UNION SELECT r.a, e2.b FROM r JOIN e2 ON r.b = e2.a),
g AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept FROM e LEFT JOIN g USING (doc_id)
"""


def _audit() -> str:
    """Flags from lists of words; every order and step by its own sums over all documents of a part."""
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, FALSE) AS e FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
  map {{'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': e}} AS fails FROM d LEFT JOIN l USING (doc_id)),
n AS (SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x]) AS failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, k AS step, filter_order[k] AS own, string_split(filter_order[:k - 1], '') AS before FROM o, (SELECT unnest(range(1, 6))::INT AS k)),
r AS (SELECT part, filter_order, step, own,
  sum(n) FILTER (NOT list_has_any(failed, before) AND NOT list_contains(failed, own)) AS kept, sum(n) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS removed,
  sum(n) FILTER (list_contains(failed, own) AND list_has_any(failed, before)) AS redundant, sum(n) FILTER (failed = [own]) AS unique_fails,
  sum(good) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS good_lost, sum(toxic) FILTER (list_contains(failed, own) AND NOT list_has_any(failed, before)) AS toxic_lost
  FROM n, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, {', '.join(f'coalesce({c}, 0)::BIGINT AS {c}' for c in ('kept', 'removed', 'redundant', 'unique_fails', 'good_lost', 'toxic_lost'))},
  coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r
"""


#: Vectors without null or non-finite components.
_FIT = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
#: All pairs of a label by cosine, and the links' transitive closure.
_NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FIT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a), g AS (SELECT a AS vec_id, min(b) AS low FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, coalesce(vec_id <= coalesce(low, vec_id), TRUE) AS kept FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN g USING (vec_id)
"""

#: Every anchor against every row, by whole numbers.
_HARD_NEGATIVES = f"""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FIT}),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, (row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b))::INT AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10
"""

#: Every query against every row. The stopping test of the search may miss a neighbour; at this size it ends no search early.
_NEIGHBOURS = f"""
WITH v AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_FIT} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0 GROUP BY a.vec_id, b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

ORACLES = {
    "pii_base": _pii_base(),
    "op6_neighbours": _NEIGHBOURS,
    "op13_hardneg": _HARD_NEGATIVES,
    "op12_covertree": _NEAR_VECTORS,
    "op11_audit": _audit(),
    "op1_packing": _packing(),
    "op8_minhash": _near_duplicates(),
    "op4_secrets": _secrets(),
    "op10_quality": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l
  FROM documents
), win AS (
  SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)
), rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
cov AS (
  SELECT rid, sum(least(8, p - coalesce(q, p - 8)))::BIGINT AS n
  FROM (SELECT rid, p, lag(p) OVER (PARTITION BY rid ORDER BY p) AS q FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP})))::BIGINT AS n_stop_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN cov USING (rid)
), v AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, {_broken()} AS broken_rules FROM m)
SELECT *, (NOT base_failed AND len(broken_rules) = 0) AS kept FROM v
""",
}
