"""DuckDB SQL of the queries of this subpackage that SQL can express."""

METRIC = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM e
  WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u) WHERE list_inner_product(a.u, b.u) >= 0.98),
r(id, to_id) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.to_id),
c AS (SELECT id, min(to_id) AS component FROM r GROUP BY id), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, coalesce(component, e.vec_id) AS component_id, e.vec_id = coalesce(component, e.vec_id) AS kept FROM e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

NGRAMS = (
    """
WITH RECURSIVE w AS (SELECT doc_id, """
    + WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    + """ AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM w),
k AS MATERIALIZED (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), '|')) AS h, s FROM s WHERE len(s) > 0),
f AS MATERIALIZED (SELECT h, min(doc_id) AS rep, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY h),
x AS MATERIALIZED (SELECT rep, n, unnest(s) AS t FROM f),
p AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM x a JOIN x b ON a.t = b.t AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * both_ >= 85 * (na + nb - both_)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l), r(id, to_id) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.to_id),
c AS (SELECT id, min(to_id) AS component FROM r GROUP BY id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component, f.rep, s.doc_id) AS component_id FROM s LEFT JOIN k ON k.doc_id = s.doc_id LEFT JOIN f ON f.h = k.h LEFT JOIN c ON c.id = f.rep"""
)

BASE = (
    """
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, """
    + WORDS.format(text="coalesce(text, '')")
    + r""" AS w FROM documents),
t AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) u),
m AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
a AS (SELECT doc_id, count(DISTINCT j) AS again FROM (SELECT doc_id, i + k AS j FROM m, range(0, 3) s(k)) q GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) y WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words,
  len(w) < 50 OR 100 * coalesce(again, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN l ON l.doc_id = w.doc_id"""
)

LINES = """
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM t),
h AS (SELECT key, max(doc_id) AS last FROM (SELECT doc_id, unnest(ks) AS key FROM k) WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(ks) AS key, unnest(range(len(ls))) AS i FROM k),
j AS (SELECT l.*, coalesce(l.doc_id < h.last, false) AS gone FROM l LEFT JOIN h ON h.key = l.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

SPREAD = """
WITH x AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(64 * c)::BIGINT + 1000000) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
e AS (SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS d FROM x), s AS (SELECT d, count(*) AS n, sum(x) AS s FROM e GROUP BY d)
SELECT vec_id, n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM e JOIN s ON s.d = e.d GROUP BY vec_id, n"""


def clusters(k: int = 40, rounds: int = 5) -> str:
    """Rounds of nearest centroids written one after the other; distances are sums of squares of whole numbers."""
    sql = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(256 * c)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
e AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range(64)) AS d FROM v),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INTEGER AS c, v FROM v QUALIFY c < %d)""" % k
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT vec_id, c, list_sum(list_transform(list_zip(v.v, c{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS far FROM v, c{n}) q GROUP BY vec_id)"""
        if n < rounds:
            sql += f""",
m{n} AS (SELECT c, d, sum(x) AS s, count(*) AS n FROM e JOIN a{n} ON a{n}.vec_id = e.vec_id GROUP BY c, d),
n{n} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY d) AS v FROM m{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c{n}.c, coalesce(n{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN n{n} ON n{n}.c = c{n}.c)"""
    return sql + f"""
SELECT vec_id, a{rounds}.c AS cluster, far AS distance, (sum(far) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = a{rounds}.c"""
