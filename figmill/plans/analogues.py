"""Queries over the star-schema tables: relational shapes of the figure audits, with the SQL that checks them.

Testdata has no figures, so these run the same operators on other rows; they are analogues, not audits.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.operators import asof, coverage, graph, histogram, intervals, series
from figmill.plans.registry import query, table

SMALL = 8 << 20

@query("""
SELECT l_orderkey, count(*) AS n_lines, max(l_linenumber) AS last_line, count(DISTINCT l_linenumber) AS n_distinct,
  NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)) AS has_gap,
  count(*) - count(DISTINCT l_linenumber) AS n_repeated
FROM lineitem GROUP BY l_orderkey""")
def sequence_gaps(spark, sf_dir):
    """Which orders' line numbers aren't 1..max, each once."""
    return coverage.sequence_gaps(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber").select("l_orderkey", F.col("n").alias("n_lines"), F.col("last").alias("last_line"), "n_distinct", "has_gap", "n_repeated")


@query("""
SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role,
  coalesce(lead(turn) OVER w <> turn + 1, false) AS gap, coalesce(lead(role) OVER w = role, false) AS same_role
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""")
def turn_continuity(spark, sf_dir):
    """Each message against the next one of its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nxt, role = F.lead("turn").over(w), F.lead("role").over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", nxt.alias("next_turn"), role.alias("next_role"), F.coalesce(nxt != F.col("turn") + 1, F.lit(False)).alias("gap"), F.coalesce(role == F.col("role"), F.lit(False)).alias("same_role"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left only' ELSE 'right only' END AS side
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL""")
def coverage_anti(spark, sf_dir):
    """Documents without a label, and labels without a document."""
    return coverage.two_way(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("""
SELECT o_custkey FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def foreign_key_anti(spark, sf_dir):
    """Distinct customers of large orders that the customers with money don't have."""
    good = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return coverage.missing(table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), good, ["o_custkey"])


@query("""
WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, cast(island AS BIGINT) AS island, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, island""")
def islands(spark, sf_dir):
    """Runs of a user's events that are at most 30 minutes apart."""
    e = intervals.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], lambda now, before: now > before + F.expr("INTERVAL 30 MINUTES"))
    return e.groupBy("user_id", "island").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM events""")
def moving_avg(spark, sf_dir):
    """Centred moving average that shrinks at the ends."""
    e = series.moving_average_wide(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], F.date_trunc("hour", F.col("ts").cast("timestamp")), "value", 4)
    return e.select("event_id", "event_type", F.round("smooth", 6).alias("smooth"))


DAILY = "SELECT cast(l_shipdate AS DATE) AS day, sum(cast(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) AS v FROM lineitem GROUP BY 1"


@query(f"""
WITH d AS (SELECT day, cast(v AS BIGINT) AS v FROM ({DAILY})),
p AS (SELECT *, lag(v) OVER (ORDER BY day) AS b, lead(v) OVER (ORDER BY day) AS a,
  v - greatest(min(v) OVER (ORDER BY day ROWS BETWEEN 15 PRECEDING AND CURRENT ROW), min(v) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)) AS prominence FROM d)
SELECT cast(day AS VARCHAR) AS day, v AS cents, prominence FROM p WHERE v >= b AND v > a AND prominence > 0""")
def peaks(spark, sf_dir):
    """Local maxima of daily revenue with their prominence (a row a day is left for the window)."""
    cents = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum(cents).alias("cents"))
    return series.peaks(d, [], ["day"], "cents", 15).filter("prominence > 0").select(F.col("day").cast("string").alias("day"), "cents", "prominence")


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS h, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'purchase') AS b FROM events GROUP BY 1),
g AS (SELECT t AS h, row_number() OVER (ORDER BY t) - 1 AS x FROM (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS t FROM h)),
j AS (SELECT x, a, b FROM g LEFT JOIN h USING (h)),
w AS (SELECT x,
  last_value(a IGNORE NULLS) OVER p AS a0, last_value(CASE WHEN a IS NOT NULL THEN x END IGNORE NULLS) OVER p AS ax0, first_value(a IGNORE NULLS) OVER f AS a1, first_value(CASE WHEN a IS NOT NULL THEN x END IGNORE NULLS) OVER f AS ax1,
  last_value(b IGNORE NULLS) OVER p AS b0, last_value(CASE WHEN b IS NOT NULL THEN x END IGNORE NULLS) OVER p AS bx0, first_value(b IGNORE NULLS) OVER f AS b1, first_value(CASE WHEN b IS NOT NULL THEN x END IGNORE NULLS) OVER f AS bx1
  FROM j WINDOW p AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT CASE WHEN a0 IS NULL THEN a1 WHEN a1 IS NULL THEN a0 WHEN ax1 = ax0 THEN a0 ELSE a0 + (a1 - a0) * (x - ax0) / (ax1 - ax0) END AS a,
  CASE WHEN b0 IS NULL THEN b1 WHEN b1 IS NULL THEN b0 WHEN bx1 = bx0 THEN b0 ELSE b0 + (b1 - b0) * (x - bx0) / (bx1 - bx0) END AS b FROM w)
SELECT count(*) AS n, round(avg(abs(a - b)), 6) AS mae FROM v""")
def mae_aligned(spark, sf_dir):
    """Two hourly series brought onto one grid by linear interpolation, and their mean absolute difference."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").groupBy(hour.alias("h")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("b"))
    g = e.agg(F.min("h").alias("lo"), F.max("h").alias("hi")).select(F.posexplode(F.expr("sequence(lo, hi, INTERVAL 1 HOUR)")).alias("x", "h"))
    j = g.join(e, "h", "left")
    j = series.interpolate(series.interpolate(j, [], "x", "a"), [], "x", "b")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"))


@query("""
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
h AS (SELECT cast(least(255, floor((l_extendedprice - lo) / (hi - lo) * 256)) AS BIGINT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1),
c AS (SELECT bin, n, sum(n) OVER w AS n0, sum(n * bin) OVER w AS s0, sum(n) OVER () AS nt, sum(n * bin) OVER () AS st FROM h WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
v AS (SELECT bin, n0, CASE WHEN nt = n0 THEN 0 ELSE cast(n0 AS DOUBLE) * cast(nt - n0 AS DOUBLE) * pow(cast(s0 AS DOUBLE) / n0 - cast(st - s0 AS DOUBLE) / (nt - n0), 2) END AS between FROM c)
SELECT bin AS threshold, cast(n0 AS BIGINT) AS n_below FROM v ORDER BY between DESC, bin LIMIT 1""")
def otsu(spark, sf_dir):
    """The histogram bin that best parts prices in two."""
    return histogram.otsu(histogram.binned(table(spark, sf_dir, "lineitem"), "l_extendedprice", 256))


@query("""
WITH g AS (SELECT l_returnflag, median(l_quantity) AS median, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1)
SELECT l_returnflag, median, least, most, round((most - least) / median, 6) AS spread, round(median / (SELECT median FROM g WHERE l_returnflag = 'N'), 6) AS ratio FROM g""")
def role_spread(spark, sf_dir):
    """Median, spread, and ratio to the baseline group."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    base = g.filter("l_returnflag = 'N'").select(F.col("median").alias("base"))
    return g.join(base, how="left").select("l_returnflag", "median", "least", "most", F.round((F.col("most") - F.col("least")) / F.col("median"), 6).alias("spread"), F.round(F.col("median") / F.col("base"), 6).alias("ratio"))


@query("""
SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9) - quantile_cont(o_totalprice, 0.1), 4) AS spread, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def pct_spread(spark, sf_dir):
    """Spread between percentiles, exact, from counted values."""
    o = table(spark, sf_dir, "orders")
    p = histogram.percentiles(o, ["o_orderstatus"], "o_totalprice", [0.1, 0.9, 0.95])
    most = o.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("most"))
    return p.join(most, "o_orderstatus").select("o_orderstatus", F.round(F.col("p1") - F.col("p0"), 4).alias("spread"), F.round("p2", 4).alias("p95"), "most")


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, round(abs(a.p_retailprice - b.p_retailprice), 4) AS apart FROM part a JOIN part b
ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) <= 50""")
def near_dup_pairs(spark, sf_dir):
    """Parts of one brand and type whose prices are within 50."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return intervals.band_pairs(p, ["p_brand", "p_type"], "p_partkey", "p_retailprice", 50.0, places=4)


@query("""
SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id
AND (a.ts < b.ts OR a.ts = b.ts AND a.event_id < b.event_id) AND b.ts < a.ts + INTERVAL 10 MINUTE""")
def overlap_pairs(spark, sf_dir):
    """Pairs of a user's events whose 10-minute intervals overlap."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("end", F.expr("ts + INTERVAL 10 MINUTES"))
    return intervals.overlapping(e, ["user_id"], "event_id", "ts", "end", "hour")


@query("""
WITH m AS (SELECT user_id, ts, event_id, ts + INTERVAL 30 MINUTE AS e, max(ts + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM m),
u AS (SELECT user_id, island, min(ts) AS s, max(e) AS e FROM i GROUP BY 1, 2)
SELECT user_id, count(*) AS n_runs, cast(sum(date_sub('microsecond', s, e)) AS BIGINT) AS covered_us FROM u GROUP BY 1""")
def rect_union(spark, sf_dir):
    """Length of the union of a user's 30-minute intervals."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts").withColumn("end", F.expr("ts + INTERVAL 30 MINUTES"))
    runs = intervals.union_runs(e, ["user_id"], "ts", "end", "event_id")
    return runs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum(F.expr("timestampdiff(MICROSECOND, start, end)")).alias("covered_us"))


@query("""
SELECT b.item_id, d.doc_id, cast((length(d.text) - length(replace(d.text, b.text, ''))) / length(b.text) AS BIGINT) AS n
FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0""")
def text_occurrences(spark, sf_dir):
    """Whole benchmark passages in documents, and how often."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")).filter("length(passage) > 0")
    return T.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), b, "text", "passage").select("item_id", "doc_id", "n")


FLAGS = {"digits": "[0-9]{3,}", "marks": "[#*$%&]{3}", "shouting": "[A-Z]{4,}", "bars": "[|]", "address": "[A-Za-z0-9_.]+@[A-Za-z0-9.]+", "placeholder": "(?i)lorem ipsum|TODO|XXXX"}


@query("SELECT lang, count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS {k}" for k, p in FLAGS.items()) + " FROM documents GROUP BY lang")
def text_flags(spark, sf_dir):
    """Documents of each language that some patterns find."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("text").rlike(p)).alias(k) for k, p in FLAGS.items()))


TAGS = {"paragraphs": "<p[ >]", "links": "<a[ >]", "scripts": "<script[ >]", "items": "<li[ >]"}


@query("SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '{p}')) AS {k}" for k, p in TAGS.items()) + " FROM pages")
def html_counts(spark, sf_dir):
    """Opening tags by pattern; scripts aren't set apart, as documents.html() does."""
    return table(spark, sf_dir, "pages").select("page_id", *(F.regexp_count("html", F.lit(p)).cast("long").alias(k) for k, p in TAGS.items()))


@query("""
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label AS c, i, avg(v) AS m FROM x WHERE label IS NOT NULL GROUP BY 1, 2),
d AS (SELECT vec_id, c, sum((v - m) * (v - m)) AS d FROM x JOIN c USING (i) GROUP BY 1, 2)
SELECT vec_id, c AS nearest FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), c) AS r FROM d) WHERE r = 1""")
def nearest_centroid(spark, sf_dir):
    """Each vector's nearest label mean.  The means go to the vectors as one array, if they are measured to be small; else both are joined."""
    e = table(spark, sf_dir, "embeddings")
    m = e.filter("label is not null").select("label", F.posexplode("embedding")).groupBy("label", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
    c = graph.cut(m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("p")).select("label", F.col("p.m").alias("m")))
    size = c.agg(F.sum(F.size("m") * 8)).first()[0] or 0
    apart = lambda mean: F.round(F.aggregate(F.zip_with("embedding", mean, lambda v, w: (v.cast("double") - w) * (v.cast("double") - w)), F.lit(0.0), lambda a, v: a + v), 9)
    if size <= SMALL:
        one = F.broadcast(c.agg(F.collect_list(F.struct("label", "m")).alias("all")))
        best = F.array_min(F.transform("all", lambda k: F.struct(apart(k["m"]).alias("d"), k["label"].alias("label"))))
        return e.select("vec_id", "embedding").join(one).select("vec_id", best["label"].alias("nearest"))
    return e.select("vec_id", "embedding").join(c).groupBy("vec_id").agg(F.min(F.struct(apart(F.col("m")).alias("d"), "label")).alias("b")).select("vec_id", F.col("b.label").alias("nearest"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def hash_binding(spark, sf_dir):
    """Documents of one digest."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


NORMAL = "trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\r]+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY {NORMAL}")
def dedup_norm(spark, sf_dir):
    """First document of each normalised text."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2(T.normalised("text"), 256).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("k")


@query("""
SELECT o_orderpriority, r AS place, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10""")
def topk(spark, sf_dir):
    """The ten dearest orders of each priority."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10")


@query("""
WITH c AS (SELECT 'sequence' AS name, true AS required, count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING NOT (min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber)))
UNION ALL SELECT 'labels', false, count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'customers', true, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))
SELECT name, required, n, CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS status, (SELECT bool_and(n = 0) FROM c WHERE required) AS passed FROM c""")
def status_rollup(spark, sf_dir):
    """Checks with their violations, and one verdict over the required ones."""
    from figmill.plans import rollup

    gaps = sequence_gaps(spark, sf_dir).filter("has_gap")
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    customers = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return rollup.statuses({"sequence": (gaps, True), "labels": (labels, False), "customers": (customers, True)})


@query("""
WITH s AS (SELECT DISTINCT event_type, user_id FROM events), n AS (SELECT event_type, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS n_both FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2)
SELECT x.event_type AS a, y.event_type AS b, coalesce(n_both, 0) AS n_both, x.n + y.n - coalesce(n_both, 0) AS n_either, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS iou
FROM n x JOIN n y ON x.event_type < y.event_type LEFT JOIN i ON i.a = x.event_type AND i.b = y.event_type""")
def mask_iou(spark, sf_dir):
    """Intersection over union of the users of each two event types."""
    from figmill.operators import masks

    return masks.set_iou(table(spark, sf_dir, "events"), "event_type", "user_id").withColumn("iou", F.round("iou", 6))


@query("""
SELECT w.word, count(*) AS n FROM (SELECT DISTINCT substring(p_name, 1, 3 + p_size % 6) AS word FROM part) w JOIN part p ON starts_with(p.p_name, w.word) GROUP BY 1""")
def prefix_join(spark, sf_dir):
    """Names that begin with prefixes taken from other names; a name's own prefixes are the keys, so the join is by equality."""
    p = table(spark, sf_dir, "part")
    words = p.select(F.expr("substring(p_name, 1, cast(3 + p_size % 6 as int))").alias("word")).distinct()
    own = p.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("p_name"), F.lit(8))), lambda k: F.substring("p_name", F.lit(1), k))).alias("word"))
    return own.join(words, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p.event_id, p.user_id, c.event_id AS click_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def as_of(spark, sf_dir):
    """Each purchase with the user's latest click up to it."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return asof.backward(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"), ["user_id"], "ts", {"event_id": "click_id", "ts": "click_ts"}).select("event_id", "user_id", "click_id", "click_ts")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def lsq(spark, sf_dir):
    """A line through price and quantity for each flag."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS a, 1000 + n_regionkey AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, to_id) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_id = u.a)
SELECT id, min(to_id) AS component FROM r GROUP BY 1""")
def region_components(spark, sf_dir):
    """Connected components of nations with suppliers and their regions."""
    n = table(spark, sf_dir, "nation")
    e = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("a"), (F.col("n_regionkey") + 1000).alias("b")).distinct()
    return graph.components(e)


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS a, CASE WHEN c_custkey % 5 = 0 THEN c_custkey ELSE c_custkey + 7 END AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, to_id) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.to_id = u.a) SELECT id, min(to_id) AS component FROM r GROUP BY 1""")
def components(spark, sf_dir):
    """Connected components of chains of customers."""
    c = F.col("c_custkey")
    return graph.components(table(spark, sf_dir, "customer").select(c.alias("a"), F.when(c % 5 == 0, c).otherwise(c + 7).alias("b")))
