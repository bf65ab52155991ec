"""DuckDB SQL for the corpus operators that SQL can express."""

_W = r"[^ \t\n\x0B\f\r]+"

HOST_RULES = rf"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, host, length(t) AS chars, regexp_extract_all(t, '{_W}') AS w, string_split(t, chr(10)) AS l,
  len(regexp_extract_all(t, '[#$%&*{{}}<>|~^!]')) AS symbols, len(regexp_extract_all(t, '[A-Z]')) AS capitals, len(regexp_extract_all(t, '[0-9]')) AS digits FROM t),
f AS (SELECT doc_id, host,
  (len(w) < 5)::INT AS r1, (chars > 15 * len(w) AND len(w) > 0)::INT AS r2, (symbols > 0.10 * chars)::INT AS r3, (capitals > 0.50 * chars)::INT AS r4,
  (digits > 0.30 * chars)::INT AS r5, (len(l) >= 4 AND 10 * len(list_distinct(l)) < 7 * len(l))::INT AS r6, (len(w) >= 50 AND 5 * len(list_distinct(w)) < len(w))::INT AS r7,
  (len(w) >= 10 AND 5 * len(list_filter(w, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) > len(w))::INT AS r8 FROM m),
u AS (SELECT doc_id, host, r, v FROM (UNPIVOT f ON r1, r2, r3, r4, r5, r6, r7, r8 INTO NAME r VALUE v)),
h AS (SELECT host, r, count(*) AS n, sum(v)::DOUBLE AS k FROM u GROUP BY host, r),
s AS (SELECT r, avg(k / n) AS m, var_pop(k / n) AS v FROM h GROUP BY r),
p AS (SELECT r, m, CASE WHEN v > 1e-12 THEN least(greatest(m * (1 - m) / greatest(v, 1e-12) - 1, 1.0), 10000.0) ELSE 10000.0 END AS w FROM s),
q AS (SELECT host, m, n + w AS t, (k + m * w) / (n + w) AS rate FROM h JOIN p USING (r)),
g AS (SELECT host, round(max(rate), 6) AS host_rate, max(rate - 3 * sqrt(rate * (1 - rate) / (t + 1))) AS bottom, bool_or(rate - 3 * sqrt(rate * (1 - rate) / (t + 1)) > m) AS worse FROM q GROUP BY host),
x AS (SELECT host, host_rate, CASE WHEN bottom > 0.5 THEN 'blocked' WHEN worse THEN 'strict' ELSE 'open' END AS host_verdict FROM g)
SELECT doc_id, host, r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 AS n_failed, host_rate, host_verdict,
  CASE host_verdict WHEN 'blocked' THEN false WHEN 'strict' THEN r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 = 0 ELSE r3 + r4 + r6 + r7 + r8 = 0 AND r1 + r2 + r3 + r4 + r5 + r6 + r7 + r8 < 2 END AS keep
FROM f JOIN x USING (host)
"""

#: Fingerprints by MD5 of the distinct words, all pairs of them, and the closure of near ones.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS w FROM documents),
u AS (SELECT w, md5(w) AS h FROM (SELECT DISTINCT w FROM w)),
b AS (SELECT w, i::INT AS i, (instr('0123456789abcdef', h[i // 4 + 1]) - 1) >> (3 - i % 4)::INT & 1 AS bit FROM u, range(128) AS r(i)),
s AS (SELECT doc_id, i, 2 * sum(bit) > count(*) AS v FROM w JOIN b USING (w) GROUP BY doc_id, i),
f AS MATERIALIZED (SELECT doc_id, string_agg(CASE WHEN v THEN '1' ELSE '0' END, '' ORDER BY i)::BIT AS f FROM s GROUP BY doc_id),
e AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM f x JOIN f y ON x.doc_id <> y.doc_id AND bit_count(xor(x.f, y.f)) <= 22),
c AS (SELECT doc_id AS a, doc_id AS root FROM f UNION SELECT e.b, c.root FROM c JOIN e USING (a)),
g AS (SELECT a AS doc_id, min(root) AS group_id FROM c GROUP BY a)
SELECT d.doc_id, group_id, coalesce(group_id = d.doc_id, true) AS kept FROM documents d LEFT JOIN g USING (doc_id)
"""

#: Layer k of the dynamic program has the least padding of the first j distinct lengths in k buckets and, for
#: the way back, the edges chosen so far; equal costs take the smaller edge before.
LENGTH_BUCKETS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::INT AS n_tokens FROM documents),
h AS (SELECT n_tokens AS len, count(*)::BIGINT AS n FROM d WHERE n_tokens > 0 GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY len) AS j, len, sum(n) OVER (ORDER BY len)::BIGINT AS cn, sum(n * len) OVER (ORDER BY len)::BIGINT AS cs FROM h),
z AS (SELECT 0 AS j, 0 AS len, 0::BIGINT AS cn, 0::BIGINT AS cs UNION ALL SELECT * FROM c),
dp AS (
  SELECT 1 AS k, j, len * cn - cs AS cost, [len] AS edges FROM c
  UNION ALL
  SELECT k, j, best.cost, list_append(best.edges, len) FROM (
    SELECT dp.k + 1 AS k, b.j, b.len, min(struct_pack(cost := dp.cost + b.len * (b.cn - a.cn) - (b.cs - a.cs), i := a.j, edges := dp.edges)) AS best
    FROM dp JOIN z a ON a.j = dp.j JOIN c b ON b.j > a.j WHERE dp.k < 16 GROUP BY dp.k, b.j, b.len)
),
e AS (SELECT edges FROM dp WHERE j = (SELECT max(j) FROM c) ORDER BY k DESC LIMIT 1),
b AS (SELECT d.*, len(list_filter(e.edges, lambda x: x < d.n_tokens))::INT AS bucket, e.edges FROM d, e WHERE d.n_tokens > 0),
r AS (SELECT doc_id, n_tokens, bucket, edges[bucket + 1]::INT AS pad_to, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS LAST, n_tokens) - 1 AS rk FROM b)
SELECT doc_id, n_tokens, bucket, pad_to, (rk // greatest(65536 // pad_to, 1))::BIGINT AS batch, (rk % greatest(65536 // pad_to, 1))::BIGINT AS slot FROM r
UNION ALL SELECT doc_id, n_tokens, NULL, NULL, NULL, NULL FROM d WHERE n_tokens = 0
"""

DUPLICATE_SPANS = rf"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, regexp_extract_all(text, '{_W}') AS w FROM d),
g AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS s, w FROM w WHERE len(w) >= 50),
k AS (SELECT doc_id, s, md5(array_to_string(w[s + 1:s + 50], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS ref FROM k GROUP BY h),
x AS (SELECT k.doc_id, s, ref FROM k JOIN f USING (h) WHERE ref < k.doc_id),
n AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS new FROM x),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS grp FROM n)
SELECT doc_id, min(s)::INT AS start, (max(s) + 50)::INT AS stop, arg_min(ref, s) AS ref_doc_id FROM i GROUP BY doc_id, grp
"""
