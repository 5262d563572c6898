"""DuckDB SQL of the operators that SQL can express, over whole tables."""

OP1 = """
WITH z AS (
  SELECT vec_id, min(v) AS v FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  GROUP BY vec_id),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM z q, z d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r, vec_id, score FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

#: The exponent is the largest on the grid of 1/1024 that keeps the entropy.
OP2 = """
WITH d AS (
  SELECT doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens) AS total, count(*) FILTER (tokens > 0) AS live FROM s),
grid AS (SELECT i, i / 1024.0::DOUBLE AS x FROM range(0, 1025) g(i)),
raw AS (SELECT i, source, pow(tokens / total::DOUBLE, x) AS r FROM grid, s, t WHERE tokens > 0),
w AS (SELECT i, source, r / sum(r) OVER (PARTITION BY i) AS w FROM raw),
best AS (
  SELECT CASE WHEN (SELECT live FROM t) < 2 THEN 1024 ELSE max(i) END AS i FROM (
    SELECT i FROM w GROUP BY i HAVING round(-sum(w * ln(w)) / ln((SELECT live FROM t)), 9) >= 0.97 OR i = 0)),
p AS (
  SELECT s.source, tokens,
    CAST(floor(round(coalesce(w.w, 0), 9) * (SELECT total FROM t)) AS BIGINT) AS quota,
    greatest(1, CAST(ceil(tokens / 65536.0) AS BIGINT)) AS n_blocks
  FROM s LEFT JOIN (SELECT w.* FROM w JOIN best USING (i)) w ON s.source IS NOT DISTINCT FROM w.source),
e AS (
  SELECT source, n_blocks, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS epochs,
    CASE WHEN tokens > 0 THEN quota % tokens ELSE 0 END AS rest FROM p),
k AS (
  SELECT d.doc_id, d.source, n_tokens, epochs, rest, coalesce('=' || d.source, 'null') AS k,
    CAST('0x' || substr(md5('mix:' || coalesce(doc_id, -1)), 1, 8) AS BIGINT) % n_blocks AS b,
    CAST('0x' || substr(md5('mix:d:' || coalesce(doc_id, -1)), 1, 8) AS BIGINT) AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
o AS (SELECT *, CAST('0x' || substr(md5('mix:b:' || k || ':' || b), 1, 8) AS BIGINT) AS ord FROM k),
r AS (
  SELECT *, CASE WHEN sum(n_tokens) OVER (PARTITION BY k ORDER BY ord, b) <= rest THEN 1
    WHEN sum(n_tokens) OVER (PARTITION BY k ORDER BY ord, b, place, doc_id, n_tokens) <= rest THEN 1 ELSE 0 END AS more
  FROM o)
SELECT doc_id, source, n_tokens, CAST(epochs + more AS BIGINT) AS copies, ord AS block, place FROM r WHERE epochs + more > 0
"""

OP3 = """
WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, ''), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT conv_id, role || chr(10) || text AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM t) WHERE rn = 1),
n AS (SELECT conv_id, k, row_number() OVER w AS rn, lead(conv_id) OVER w AS nxt
  FROM o WINDOW w AS (PARTITION BY k, CAST(floor(conv_id / 4096) AS BIGINT) ORDER BY conv_id)),
f AS (SELECT conv_id, row_number() OVER w AS rn, lead(conv_id) OVER w AS nxt
  FROM n WHERE rn % 2 = 1 AND nxt IS NULL WINDOW w AS (PARTITION BY k ORDER BY conv_id)),
p AS (SELECT conv_id AS pair_id, conv_id AS chosen_id, nxt AS rejected_id FROM n WHERE rn % 2 = 1 AND nxt IS NOT NULL
  UNION ALL SELECT conv_id, conv_id, nxt FROM f WHERE rn % 2 = 1),
r AS (SELECT pair_id, rejected_id IS NULL AS alone, 0 AS side, t.turn, t.role, t.text FROM p JOIN t ON t.conv_id = chosen_id
  UNION ALL SELECT pair_id, false, 1, t.turn, t.role, t.text FROM p JOIN t ON t.conv_id = rejected_id),
a AS (SELECT pair_id, min(turn) AS first FROM r WHERE alone OR NOT EXISTS (
  SELECT 1 FROM r x WHERE x.pair_id = r.pair_id AND x.side <> r.side AND x.turn = r.turn AND x.role = r.role AND x.text = r.text)
  GROUP BY pair_id),
s AS (SELECT r.*, coalesce(turn < first, true) AS common, first IS NULL AS identical,
    '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS seg
  FROM r LEFT JOIN a USING (pair_id)),
c AS (SELECT *, coalesce(sum(length(seg)) OVER (PARTITION BY pair_id, side, common ORDER BY turn, role, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(role) + 13 AS start FROM s),
g AS (SELECT pair_id, any_value(alone) AS alone, any_value(identical) AS identical,
    count(DISTINCT turn) FILTER (common AND side = 0) AS n_prefix_turns,
    coalesce(string_agg(seg, '' ORDER BY turn, role, text) FILTER (common AND side = 0), '') AS prompt,
    coalesce(string_agg(seg, '' ORDER BY turn, role, text) FILTER (NOT common AND side = 0), '') AS chosen,
    coalesce(string_agg(seg, '' ORDER BY turn, role, text) FILTER (NOT common AND side = 1), '') AS rejected,
    coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) AS BIGINT), ',' ORDER BY turn, role, text)
      FILTER (NOT common AND side = 0 AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(text) AS BIGINT), ',' ORDER BY turn, role, text)
      FILTER (NOT common AND side = 1 AND role = 'assistant'), '') AS rejected_mask
  FROM c GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, n_prefix_turns, prompt, chosen, CASE WHEN NOT alone THEN rejected END AS rejected,
  chosen_mask, CASE WHEN NOT alone THEN rejected_mask END AS rejected_mask, identical
FROM g JOIN p USING (pair_id)
"""

#: Forms of n words, 10 at least, link within t = least(4, greatest(1, n // 30)) edits of words. Such forms share a run of 5 words.
#: The distance is taken in a band of 9 diagonals: r holds those of a row, and each word c of the longer form makes the next.
OP4 = """
WITH RECURSIVE s AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, no, lower(trim(x[no + 1], ' ' || chr(9) || chr(13) || chr(12) || chr(11))) AS f
  FROM (SELECT doc_id, x, unnest(range(0, len(x))) AS no FROM s)),
o AS (SELECT * FROM l WHERE f <> ''),
n AS (SELECT f, string_split_regex(f, '[\\x20\\x09-\\x0D]+') AS w FROM (SELECT DISTINCT f FROM o)),
g AS (SELECT f, len(w) AS n, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM n WHERE len(w) >= 10),
c AS (SELECT DISTINCT a.f AS x, b.f AS y, least(4, greatest(1, a.n // 30)) AS t FROM g a JOIN g b ON a.s = b.s
  AND b.n - a.n BETWEEN 0 AND least(4, greatest(1, a.n // 30)) AND (a.n < b.n OR a.f < b.f)),
q AS (SELECT x, y, t, a.w AS xw, b.w AS yw, len(a.w) AS m, len(b.w) AS n FROM c JOIN n a ON a.f = x JOIN n b ON b.f = y),
d AS (SELECT x, y, t, m, n, list_reduce(list_prepend(
    {'i': 0::BIGINT, 'm': m, 'c': '', 'a': CAST([] AS VARCHAR[]), 'r': list_transform(range(0, 9), lambda k: CASE WHEN k < 4 THEN 99 ELSE k - 4 END)},
    list_transform(range(1, n + 1), lambda i: {'i': i, 'm': m, 'c': yw[i], 'a': list_transform(range(i - 4, i + 5), lambda j: CASE WHEN j BETWEEN 1 AND m THEN xw[j] END),
      'r': CAST([] AS BIGINT[])})),
    lambda p, z: {'i': z.i, 'm': z.m, 'c': z.c, 'a': z.a, 'r': list_transform([list_transform(range(1, 10), lambda k:
        CASE WHEN z.i + k - 5 = 0 THEN z.i WHEN z.i + k - 5 < 0 OR z.i + k - 5 > z.m THEN 99
        ELSE least(coalesce(p.r[k + 1], 99) + 1, p.r[k] + CASE WHEN z.a[k] = z.c THEN 0 ELSE 1 END) END)],
      lambda u: list_transform(range(1, 10), lambda k: list_min(list_transform(range(1, k + 1), lambda h: u[h] + k - h))))[1]}) AS e FROM q),
e AS (SELECT x, y FROM d WHERE e.r[m - n + 5] <= t),
links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach(x, y) AS (SELECT f, f FROM n UNION SELECT r.x, q.y FROM reach r JOIN links q ON r.y = q.x),
classes AS (SELECT x AS f, min(y) AS class FROM reach GROUP BY x),
r AS (SELECT doc_id, no, row_number() OVER (PARTITION BY class ORDER BY doc_id, no) AS rn FROM o JOIN classes USING (f)),
k AS (SELECT doc_id, count(*) AS n, string_agg(no, ',' ORDER BY no) AS removed FROM r WHERE rn > 1 GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents t LEFT JOIN k ON t.doc_id = k.doc_id
"""

OP8 = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> '') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}\\p{M}]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT least(len(w), 5) AS k FROM i WHERE len(w) > 0)),
s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' ')) END) AS s FROM i),
n AS (SELECT item_id, count(*) AS n_shingles FROM s GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 80 * n_shingles
"""

#: Pairs of distinct shingle sets; classes by a recursive walk over the links.
OP6 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s
  FROM w),
n AS (SELECT md5(array_to_string(s, chr(10))) AS node, any_value(s) AS s, len(any_value(s)) AS n, min(doc_id) AS d
  FROM s WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT node, n, unnest(s) AS t FROM n),
links AS (
  SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.t = b.t AND a.node <> b.node
    AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(x, y) AS (SELECT node, node FROM n UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
c AS (SELECT x AS node, min(d) AS component_id FROM reach JOIN n ON n.node = reach.y GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON s.doc_id IS NOT NULL AND md5(array_to_string(s.s, chr(10))) = c.node AND len(s.s) > 0
"""


def _spans(kind: str, number: int, regex: str, least: int) -> str:
    """(doc_id, start, number, tag) of a kind's matches that pass."""
    return f"""
  SELECT doc_id, rid, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: len(x))), 0)
      - coalesce(list_sum(list_transform(range(0, (i - 1) // 3), lambda j: len(p[3 * j + 3]))), 0) AS BIGINT) AS start,
    {number} AS kind_no, '{kind}' AS kind, len(p[i + 1]) AS n
  FROM (
    SELECT doc_id, rid, p, unnest(range(1, len(p), 3)) AS i FROM (
      SELECT doc_id, rid, string_split(regexp_replace(t, '{regex}', '\\ue000\\1\\ue000\\2\\ue000', 'g'), chr(57344)) AS p FROM d))
  WHERE len(p[i + 2]) >= {least}"""


def _op9() -> str:
    from .secrets import BASE, EXTRA

    mark = chr(0xE000)
    parts = [_spans(r.kind, i, r.regex.replace("'", "''"), r.least).replace("\\ue000", mark) for i, r in enumerate(BASE + EXTRA)]
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, replace(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
g AS (
  SELECT rid, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, kind_no) FILTER (kind_no < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, kind_no) AS spans
  FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
"""


OP9 = _op9()
