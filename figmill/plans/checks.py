"""Audits and their parts over tables derived from the data set, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from figmill.functions import numeric as N
from figmill.functions import text as T
from figmill.operators import coverage, fields, flood, graph, intervals, masks, patterns, scenes, series
from figmill.plans import clearance, connectors, curves, editability, grammar, images, manifest, rollup, routes, structure, texts, typography
from figmill.plans.registry import derived, query, table
from figmill.sources import vectors

# Line segments of routes: orders are routes, lines are legs, with gaps, turns and points among them.
LEGS = """
SELECT concat('f', CAST(l_orderkey % 40 AS STRING)) AS file, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord,
  concat('Flow_r', CAST(l_orderkey AS STRING), '-segment-', CAST(l_linenumber + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS STRING)) AS name,
  l_orderkey AS k, l_linenumber + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS n,
  CASE WHEN l_partkey % 17 = 0 THEN 'rect' ELSE 'line' END AS geometry,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN (l_linenumber - 1) * 5 ELSE l_linenumber * 5 END AS DOUBLE) AS x,
  CAST(CASE WHEN l_linenumber % 2 = 1 THEN (l_linenumber - 1) * 5 ELSE (l_linenumber - 2) * 5 END AS DOUBLE) + CASE WHEN l_quantity > 47 THEN 2e-1 ELSE 0e0 END AS y,
  CASE WHEN l_quantity < 3 THEN 0e0 WHEN l_discount > 9e-2 OR l_linenumber % 2 = 1 THEN 1e1 ELSE 0e0 END AS w,
  CASE WHEN l_quantity < 3 THEN 0e0 WHEN l_discount > 9e-2 OR l_linenumber % 2 = 0 THEN 1e1 ELSE 0e0 END AS h,
  CASE WHEN l_tax > 7e-2 THEN 9e1 ELSE 3.6e2 END AS rotation
FROM {lineitem}"""


ONE = "SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag FROM {lineitem} GROUP BY l_orderkey, l_linenumber"


def legs(spark, sf_dir):
    return derived(spark, sf_dir, LEGS).withColumn("bbox", F.array("x", "y", "w", "h"))


@query(
    """
WITH l AS (SELECT *, lower(regexp_extract(name, '(?i)^(.+?)[-_]segment(?:[-_])?([0-9]+)$', 1)) AS route, x + w AS x1, y + h AS y1 FROM {legs} WHERE geometry = 'line'),
g AS (SELECT file, route, min(n) AS lo, max(n) AS hi, count(*) AS c, count(DISTINCT n) AS d FROM l GROUP BY file, route),
o AS (SELECT *, row_number() OVER (PARTITION BY file, route, n ORDER BY ord, name, x, y, x1, y1) AS r FROM l),
s AS (SELECT *, lead(x) OVER w AS a, lead(y) OVER w AS b, lead(x1) OVER w AS c, lead(y1) OVER w AS d FROM o WHERE r = 1 WINDOW w AS (PARTITION BY file, route ORDER BY n))
SELECT file, 'zero-length line' AS rule, name AS subject FROM l WHERE w = 0 AND h = 0
UNION ALL SELECT file, 'diagonal line', name FROM l WHERE w > 0 AND h > 0
UNION ALL SELECT file, 'rotated line', name FROM l WHERE rotation = 90
UNION ALL SELECT file, 'numbering gap', route FROM g WHERE NOT (lo = 1 AND hi = d)
UNION ALL SELECT file, 'repeated index', route FROM g WHERE c > d
UNION ALL SELECT file, 'disconnected', name FROM s WHERE a IS NOT NULL AND least(greatest(abs(x-a),abs(y-b)),greatest(abs(x-c),abs(y-d)),greatest(abs(x1-a),abs(y1-b)),greatest(abs(x1-c),abs(y1-d))) > 0.05""",
    legs=LEGS,
)
def route_issues(spark, sf_dir):
    """Issues of routes: shape, numbering, continuity."""
    return routes.audit(legs(spark, sf_dir))


BUSES = """
SELECT concat('f', CAST(o_custkey % 9 AS STRING)) AS file, o_orderkey AS ord,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('link-b', CAST(o_custkey AS STRING), '-bus-', CAST(o_orderkey AS STRING))
    ELSE concat('link-b', CAST(o_custkey AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '_' ELSE '-' END, 'leg', CAST(o_orderkey AS STRING), '-segment-1') END AS name,
  o_orderkey % 3 = 0 AS is_bus, concat('link-b', CAST(o_custkey AS STRING)) AS bus,
  CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE CAST(o_orderkey % 40 AS DOUBLE) END AS x,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) * 4e-1 ELSE 0e0 END AS y,
  CASE WHEN o_orderkey % 3 = 0 THEN 2e1 ELSE 0e0 END AS w, CASE WHEN o_orderkey % 3 = 0 THEN 0e0 ELSE CAST(o_orderkey % 4 AS DOUBLE) * 4e-1 + 1e-1 END AS h
FROM {orders}"""


@query(
    """
WITH l AS (SELECT * FROM {buses}),
b AS (SELECT * FROM l WHERE is_bus), r AS (SELECT *, lower(regexp_extract(name, '^(.+?)-segment', 1)) AS route FROM l WHERE NOT is_bus),
k AS (SELECT DISTINCT r.file, r.route, b.bus FROM r JOIN b ON r.file = b.file AND (starts_with(r.route, b.bus || '-') OR starts_with(r.route, b.bus || '_'))),
t AS (SELECT DISTINCT r.file, r.route FROM r JOIN b ON r.file = b.file AND r.bus = b.bus AND r.x <= 20.05 AND (abs(r.y - b.y) <= 0.05 OR abs(r.y + r.h - b.y) <= 0.05))
SELECT file, 'misses bus' AS rule, route AS subject FROM k WHERE (file, route) NOT IN (SELECT (file, route) FROM t)
UNION ALL SELECT p.file, CASE WHEN abs(p.y - q.y) > 0.05 THEN 'misaligned parallel bus' ELSE 'duplicate bus' END, q.name FROM b p JOIN b q ON p.file = q.file AND p.bus = q.bus AND p.ord < q.ord WHERE abs(p.y - q.y) <= 1.0""",
    buses=BUSES,
)
def bus_issues(spark, sf_dir):
    """Branches that miss their bus, and buses that run side by side or on top of each other."""
    d = derived(spark, sf_dir, BUSES).select("file", "ord", "name", F.lit("line").alias("geometry"), F.array("x", "y", "w", "h").alias("bbox"), F.lit(0.0).alias("rotation"))
    return routes.audit(d).filter("rule in ('misses bus', 'misaligned parallel bus', 'duplicate bus')")


SIZES = "SELECT concat(p_brand, '-', CAST(p_partkey AS STRING)) AS name, p_name AS text, CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE CAST(10 + p_size % 3 AS DOUBLE) * CASE WHEN p_brand = 'Brand#11' THEN 2 ELSE 1 END END AS size FROM {part}"
ROLES = "SELECT concat('role', p_brand) AS role, concat('^', p_brand, '-') AS pattern, CASE WHEN p_brand = 'Brand#11' THEN 2e0 ELSE 1e0 END AS target_ratio, 5e-2 AS tolerance, true AS required FROM (SELECT DISTINCT p_brand FROM {part}) t"


@query(
    """
WITH e AS (SELECT *, regexp_extract(name, '^(.*)-[0-9]+$', 1) AS brand FROM {sizes}), g AS (SELECT 'role' || brand AS role, median(size) AS m, min(size) AS lo, max(size) AS hi FROM e WHERE size IS NOT NULL GROUP BY brand),
b AS (SELECT m FROM g WHERE role = (SELECT min(role) FROM g))
SELECT 'no size' AS rule, name AS subject FROM e WHERE size IS NULL
UNION ALL SELECT 'sizes spread', role FROM g WHERE (hi - lo) / m > 0.15 + 1e-9
UNION ALL SELECT 'wrong ratio', g.role FROM g, b, {roles} r WHERE r.role = g.role AND (g.m / b.m < target_ratio * 0.95 - 1e-9 OR g.m / b.m > target_ratio * 1.05 + 1e-9)""",
    sizes=SIZES,
    roles=ROLES,
)
def typography_issues(spark, sf_dir):
    """Sizes by role: spread, and ratio to the first role."""
    roles = derived(spark, sf_dir, ROLES)
    first = typography.role_sizes(derived(spark, sf_dir, SIZES), roles).agg(F.min("role")).first()[0]
    return typography.audit(derived(spark, sf_dir, SIZES), roles, first, spread=0.15)


@query("SELECT name, (max(CASE WHEN NOT ex THEN run END) - min(CASE WHEN NOT ex THEN run END)) / any_value(size) AS spread, count(*) FILTER (WHERE ex) AS exempt FROM (SELECT l_orderkey AS name, 2e1 AS size, l_quantity AS run, l_discount > 5e-2 AND l_quantity <= 20 AS ex FROM lineitem) t GROUP BY name HAVING count(*) FILTER (WHERE NOT ex) > 0")
def run_spreads(spark, sf_dir):
    """Spread of runs without the raised ones that are not larger than their text."""
    l = table(spark, sf_dir, "lineitem")
    e = l.groupBy(F.col("l_orderkey").alias("name")).agg(F.lit(20.0).alias("size"), F.collect_list(F.struct(F.lit("x").alias("text"), F.col("l_quantity").alias("size"), F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0).alias("baseline"))).alias("runs"))
    keep = l.filter("not (l_discount > 0.05 and l_quantity <= 20)").select(F.col("l_orderkey").alias("name")).distinct()
    return typography.run_spread(e).join(keep, "name", "left_semi")


@query("SELECT p_partkey, (s = 5)::INT + (s2 = '5')::INT AS n FROM (SELECT p_partkey, p_size AS s, CAST(p_size * 10 + 5 AS VARCHAR) AS t, CAST(p_partkey % 10 AS VARCHAR) AS s2 FROM part)")
def token_counts(spark, sf_dir):
    """How often N=5 stands alone: not in N=55, N=5.5, N=5,3 or x_N=5."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_size").cast("string")
    t = F.concat(F.lit("N="), s, F.lit(" (N="), (F.col("p_size") * 10 + 5).cast("string"), F.lit(") N=5.5 N=5,3 x_N=5 n N  =\n"), (F.col("p_partkey") % 10).cast("string"), F.lit("."))
    return p.select("p_partkey", T.token_count(t, F.lit(" N = 5")).cast("int").alias("n"))


BOXES = "SELECT l_orderkey % 300 AS slide, l_orderkey * 8 + l_linenumber AS ord, concat('b', CAST(l_partkey % 400 AS STRING)) AS name, CAST((l_partkey * 37) % 2000 AS DOUBLE) AS x, CAST((l_suppkey * 91 + l_linenumber * 13) % 1500 AS DOUBLE) AS y, l_quantity * 4 AS w, CAST(5 + l_linenumber * 10 AS DOUBLE) AS h FROM {lineitem}"


@query("SELECT p.slide, p.name AS a, q.name AS b FROM {boxes} p JOIN {boxes} q ON p.slide = q.slide AND p.ord < q.ord WHERE least(p.x+p.w+2, q.x+q.w+2) > greatest(p.x,q.x) + 1e-7 AND least(p.y+p.h+2, q.y+q.h+2) > greatest(p.y,q.y) + 1e-7", boxes=BOXES)
def box_collisions(spark, sf_dir):
    """Boxes of a slide that are less than two apart."""
    return clearance.box_pairs(derived(spark, sf_dir, BOXES), 2.0)


@query(
    """SELECT slide, name, path FROM (SELECT p.slide, p.ord, p.name, concat('p', CAST(s_suppkey AS STRING)) AS path FROM {boxes} p JOIN (SELECT *, s_suppkey % 300 AS slide, CAST(s_suppkey * 53 % 2000 AS DOUBLE) AS pos FROM supplier) s ON s.slide = p.slide
WHERE pos BETWEEN x - 1.5 AND x + w + 1.5 AND 100 <= y + h + 1.5 AND 900 >= y - 1.5) t GROUP BY slide, name, path""",
    boxes=BOXES,
)
def path_collisions(spark, sf_dir):
    """Boxes that upright lines, two wide, come within half a unit of."""
    s = table(spark, sf_dir, "supplier")
    at = (F.col("s_suppkey") * 53 % 2000).cast("double")
    paths = s.select((F.col("s_suppkey") % 300).alias("slide"), F.concat(F.lit("p"), "s_suppkey").alias("name"), F.lit(False).alias("closed"), F.lit(2.0).alias("width"), F.array(F.struct(at.alias("x"), F.lit(100.0).alias("y")), F.struct(at.alias("x"), F.lit(900.0).alias("y"))).alias("points"))
    return clearance.path_hits(derived(spark, sf_dir, BOXES), paths, 0.5)


@query("SELECT l_orderkey AS edge, coalesce(bool_or(sqrt((nx - x1)*(nx - x1) + (ny - y1)*(ny - y1)) > 0.3), false) AS broken FROM (SELECT *, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM (SELECT l_orderkey, l_linenumber, l_linenumber + l_tax AS x0, l_discount AS y0, l_linenumber + 1 AS x1, l_tax AS y1 FROM lineitem) t WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) u GROUP BY l_orderkey")
def directed_continuity(spark, sf_dir):
    """Orders whose lines, as directed legs, don't join."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_linenumber").alias("ord"), (F.col("l_linenumber") + F.col("l_tax")).alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_linenumber") + 1).cast("double").alias("x1"), F.col("l_tax").alias("y1"))
    return grammar.continuity(l, 0.3)


GRAMMAR = "SELECT concat('n', CAST(c_custkey % 900 AS STRING)) AS name, CASE c_nationkey % 3 WHEN 0 THEN 'rect' WHEN 1 THEN 'ellipse' ELSE 'line' END AS geometry FROM {customer}"


@query(
    """WITH c AS (SELECT name, count(*) AS n, bool_or(geometry <> 'rect') AS bad FROM {elements} GROUP BY name), o AS (SELECT DISTINCT 'n' || CAST(s_suppkey * 13 % 1200 AS VARCHAR) AS name, 'role' || CAST(s_suppkey AS VARCHAR) AS role FROM supplier),
j AS (SELECT role || '/' || o.name AS subject, n, bad FROM o LEFT JOIN c ON c.name = o.name)
SELECT 'missing object' AS rule, subject FROM j WHERE n IS NULL UNION ALL SELECT 'object is not unique', subject FROM j WHERE n > 1 UNION ALL SELECT 'geometry not allowed', subject FROM j WHERE bad""",
    elements=GRAMMAR,
)
def grammar_nodes(spark, sf_dir):
    """Outputs that are missing, not unique, or of a geometry that their role doesn't allow."""
    out = table(spark, sf_dir, "supplier").select(F.concat(F.lit("role"), "s_suppkey").alias("role"), F.concat(F.lit("n"), F.col("s_suppkey") * 13 % 1200).alias("name"), F.array(F.lit("rect")).alias("allowed"))
    return grammar.nodes(derived(spark, sf_dir, GRAMMAR), out)


@query("SELECT edge, coalesce(sum(l), 0) AS n_lines, coalesce(sum(n - l), 0) AS n_others FROM (SELECT 'e' || CAST(r_regionkey AS VARCHAR) AS edge, '^n' || CAST(r_regionkey * 2 AS VARCHAR) AS pattern FROM region) r LEFT JOIN (SELECT name, count(*) AS n, count(*) FILTER (WHERE geometry = 'line') AS l FROM {elements} GROUP BY name) e ON regexp_matches(e.name, pattern) GROUP BY edge", elements=GRAMMAR)
def grammar_edges(spark, sf_dir):
    """Lines and other objects that each edge role's pattern finds."""
    roles = table(spark, sf_dir, "region").select(F.concat(F.lit("e"), "r_regionkey").alias("edge"), F.concat(F.lit("^n"), (F.col("r_regionkey") * 2).cast("string")).alias("pattern"))
    return grammar.edges(derived(spark, sf_dir, GRAMMAR), roles).select("edge", "n_lines", "n_others")


EDGES = """SELECT o_orderkey AS k, concat('e', CAST(o_orderkey AS STRING)) AS name, concat('a', CAST(o_orderkey AS STRING)) AS source, concat('z', CAST(o_orderkey AS STRING)) AS target, CAST(o_orderkey % 7 AS DOUBLE) AS x0, CAST(10 + o_custkey % 3 AS DOUBLE) AS x1, o_custkey % 5 AS kind FROM {orders}"""


@query("SELECT name AS edge, CASE WHEN kind = 0 THEN 'NOT_VERIFIED' WHEN kind = 1 THEN 'PASS' WHEN kind = 2 THEN 'FAIL' WHEN x0 > 4 THEN 'FAIL' WHEN x1 < 10 OR x1 > 14 THEN 'FAIL' WHEN NOT (x0 = 0 OR x0 = 4) THEN 'FAIL' WHEN NOT (x1 = 10) THEN 'FAIL' ELSE 'PASS' END AS state FROM {edges}", edges=EDGES)
def edge_evidence(spark, sf_dir):
    """What is known of each edge's ends: nothing, a binding, a wrong binding, or directed points on two boxes."""
    e = derived(spark, sf_dir, EDGES)
    none, no_box = F.lit(None).cast("string"), F.lit(None).cast("array<double>")
    points = F.when(F.col("kind") >= 3, F.array(F.array("x0", F.lit(1.0)), F.array("x1", F.lit(1.0))))
    line = e.select("name", F.lit("line").alias("geometry"), no_box.alias("bbox"), points.alias("endpoints"), F.when(F.col("kind").isin(1, 2), F.col("source")).alias("source_name"), F.when(F.col("kind") == 1, F.col("target")).when(F.col("kind") == 2, F.col("source")).alias("target_name"))
    box = lambda c, x: e.select(F.col(c).alias("name"), F.lit("rect").alias("geometry"), F.array(F.lit(x), F.lit(0.0), F.lit(4.0), F.lit(2.0)).alias("bbox"), F.lit(None).cast("array<array<double>>").alias("endpoints"), none.alias("source_name"), none.alias("target_name"))
    roles = e.select(F.col("name").alias("edge"), F.concat(F.lit("^"), "name", F.lit("$")).alias("pattern"), "source", "target", F.when(F.col("kind") != 0, F.array("name")).alias("ordered"))
    return grammar.evidence(line.unionByName(box("source", 0.0)).unionByName(box("target", 10.0)), roles).select("edge", "state")


PATTERNS = """SELECT CASE s_suppkey % 5 WHEN 0 THEN concat('^part.?', CAST(s_suppkey AS STRING)) WHEN 1 THEN concat(CAST(s_suppkey AS STRING), '$') WHEN 2 THEN concat('#', CAST(s_suppkey * 3 AS STRING), '-(small|', s_name, ')') WHEN 3 THEN concat('[a-z]+#', CAST(s_suppkey AS STRING), '[0-9]-') ELSE concat('-size', CAST(s_suppkey % 50 AS STRING), '$') END AS pattern FROM {supplier}
UNION ALL SELECT concat('^part#', CAST(p_partkey AS STRING), '-') FROM {part} UNION ALL SELECT '[^0-9a-z#-]' UNION ALL SELECT '(1|2)+7$'"""
NAMES = "SELECT concat('part#', CAST(p_partkey AS STRING), '-', CASE WHEN p_size < 20 THEN 'small' ELSE 'large' END, '-size', CAST(p_size AS STRING)) AS name FROM {part}"


@query("SELECT DISTINCT pattern, name FROM {n} n JOIN {p} p ON regexp_matches(n.name, p.pattern)", n=NAMES, p=PATTERNS)
def pattern_matches(spark, sf_dir):
    """Names that each of many patterns finds: prefixes, ends, alternatives, classes, and two without a literal."""
    return patterns.matches(derived(spark, sf_dir, NAMES), derived(spark, sf_dir, PATTERNS))


# Orders as rows of pixels in fine colours, so that ways to both sides hardly ever have one highest step (one side has it for every marker beyond the first); every 37th pixel is a marker.
STRIPS = """SELECT CAST(o_orderkey % 50 AS BIGINT) AS image_id, CAST(0 AS INT) AS y, CAST(floor(o_orderkey / 50e0) AS INT) AS x, CAST(floor(o_totalprice * 100) AS INT) AS r, CAST(o_custkey AS INT) AS g, 7 AS b FROM {orders}"""


@query(
    """WITH p AS (SELECT *, x % 37 = 5 AS seed FROM {p}), s AS (SELECT *, coalesce(greatest(abs(r - lag(r) OVER w), abs(g - lag(g) OVER w)), 0) AS d FROM p WINDOW w AS (PARTITION BY image_id ORDER BY x)),
c AS (SELECT a.image_id, a.x, b.x AS mark, CASE WHEN a.x = b.x THEN 0 ELSE (SELECT max(m.d) FROM s m WHERE m.image_id = a.image_id AND m.x > least(a.x, b.x) AND m.x <= greatest(a.x, b.x)) END AS high FROM s a JOIN p b ON b.image_id = a.image_id AND b.seed)
SELECT image_id, x, min(high)::BIGINT AS step, arg_min(mark, (high, abs(x - mark))) AS owner FROM c GROUP BY image_id, x""",
    p=STRIPS,
)
def marker_steps(spark, sf_dir):
    """The marker that reaches each pixel over the least highest step, and that step."""
    p = derived(spark, sf_dir, STRIPS)
    seeds = p.filter("x % 37 = 5").select("image_id", F.col("x").alias("ord"), F.col("x").alias("owner"), "y", "x")
    return flood.partition(p, seeds, "image_id").select("image_id", "x", "step", "owner")


FIELD = """SELECT CAST(floor(p_partkey / 2000e0) * 5 + p_partkey % 5 AS BIGINT) AS image_id, CAST(floor(p_partkey / 5e0) % 4 AS INT) AS y, CAST(floor(p_partkey % 2000 / 20e0) AS INT) AS x, CAST(floor(p_partkey % 2000 / 20e0) * 2 + 20 AS INT) AS r, CAST(p_partkey % 5 * 9 AS INT) AS g, 100 AS b, 255 AS a FROM {part}"""


@query(
    """WITH p AS (SELECT *, max(x) OVER (PARTITION BY image_id) + 1 AS w FROM {p}), s AS (SELECT image_id, count(*) AS n, w, regr_slope(r, (x + 0.5) / w) AS k, regr_intercept(r, (x + 0.5) / w) AS c, any_value(g) AS g FROM p GROUP BY image_id, w)
SELECT image_id, 2 AS count, CAST(round_even(greatest(0, c), 0) AS INT) AS r0, CAST(round_even(least(255, c + k), 0) AS INT) AS r1, CAST(g AS INT) AS g0, 1.0::DOUBLE AS alpha FROM s""",
    p=FIELD,
)
def field_stops(spark, sf_dir):
    """The two stops of images that rise evenly from left to right: those of the straight line through their pixels."""
    p = derived(spark, sf_dir, FIELD)
    boxes = p.groupBy("image_id").agg(F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"), (F.max("x") + 1.0).alias("bw"), F.lit(4.0).alias("bh"))
    got = fields.field(p, boxes, "linear", counts=(2, 3))
    first, last = F.get("stops", F.lit(0)), F.element_at("stops", -1)
    turned = F.col("angle") > 90
    return got.select("image_id", "count", F.when(turned, last["r"]).otherwise(first["r"]).alias("r0"), F.when(turned, first["r"]).otherwise(last["r"]).alias("r1"), first["g"].alias("g0"), first["alpha"].alias("alpha"))


@query("SELECT p_partkey, k, round((1-t)*(1-t)*(1-t)*0 + 3*(1-t)*(1-t)*t*p_size + 3*(1-t)*t*t*2*p_size + t*t*t*p_retailprice, 9) AS x FROM part, (SELECT i AS k, i / 16.0 AS t FROM generate_series(1, 16) s(i)) s")
def bezier_samples(spark, sf_dir):
    """Sixteen points of a cubic curve for each part."""
    c = lambda v: (v, v)
    size = F.col("p_size").cast("double")
    d = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(curves.bezier([c(F.lit(0.0)), c(size), c(2 * size), c(F.col("p_retailprice"))])).alias("k", "p"))
    return d.select("p_partkey", (F.col("k") + 1).alias("k"), F.round("p.x", 9).alias("x"))


@query("SELECT s_suppkey, i, round(CASE WHEN i <= p THEN a + (1 - a) * i / CAST(p AS DOUBLE) ELSE 1 - (1 - b) * (i - p) / CAST(200 - p AS DOUBLE) END, 9) AS y, 'supported' AS status FROM (SELECT s_suppkey, 20 + s_suppkey % 150 AS p, 2e-1 AS a, 1e-1 AS b FROM supplier) s, generate_series(0, 200) g(i)")
def upper_envelopes(spark, sf_dir):
    """The upper outline of a filled shape with one peak for each supplier."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((20 + F.col("s_suppkey") % 150) / 200).alias("p"))
    edge = lambda x0, y0, x1, y1: F.struct(*(v.cast("double").alias(n) for v, n in zip((x0, y0, x1, y1), ("x0", "y0", "x1", "y1"), strict=True)))
    at = [F.lit(v) for v in (0.0, 0.8, 0.9, 1.0)]
    e = s.select("s_suppkey", F.inline(F.array(edge(at[0], at[1], F.col("p"), at[0]), edge(F.col("p"), at[0], at[3], at[2]), edge(at[3], at[2], at[3], at[3]), edge(at[3], at[3], at[0], at[3]), edge(at[0], at[3], at[0], at[1]))))
    return curves.envelope(e, ["s_suppkey"]).select("s_suppkey", "i", F.round("y", 9).alias("y"), "status")


SERIES = "SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS i, o_totalprice AS v, o_orderkey % 3 <> 0 AS seen FROM {orders}"


@query("SELECT k, bool_and(v >= p) OR bool_and(v <= p) AS monotone FROM (SELECT k, v, coalesce(lag(v) OVER (PARTITION BY k ORDER BY i), v) AS p FROM {s}) t GROUP BY k", s=SERIES)
def monotone_series(spark, sf_dir):
    """Customers whose order totals only rise or only fall."""
    return series.monotone(derived(spark, sf_dir, SERIES), ["k"], ["i"], "v")


@query("SELECT k, max(c) AS longest FROM (SELECT k, s, count(*) FILTER (WHERE NOT seen) AS c FROM (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY i) AS s FROM {s}) t GROUP BY k, s) u GROUP BY k", s=SERIES)
def longest_gaps(spark, sf_dir):
    """The longest run of a customer's orders that aren't seen."""
    return intervals.longest_missing(derived(spark, sf_dir, SERIES), ["k"], "i", "seen")


@query("SELECT k, i, round(CASE WHEN a IS NULL THEN w WHEN b IS NULL THEN u WHEN a = b THEN u ELSE u + (w - u) * (i - a) / (b - a) END, 4) AS v FROM (SELECT k, i, max(CASE WHEN seen THEN i END) OVER p AS a, min(CASE WHEN seen THEN i END) OVER f AS b, last_value(CASE WHEN seen THEN v END IGNORE NULLS) OVER p AS u, first_value(CASE WHEN seen THEN v END IGNORE NULLS) OVER f AS w FROM {s} WINDOW p AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) t", s=SERIES)
def filled_series(spark, sf_dir):
    """Totals that aren't seen, on the line between their neighbours."""
    d = derived(spark, sf_dir, SERIES).select("k", "i", F.when(F.col("seen"), F.col("v")).alias("v"))
    return series.interpolate(d, ["k"], "i", "v").select("k", "i", F.round("v", 4).alias("v"))


GRID = "SELECT o_custkey AS k, CAST(o_orderkey % 101 AS DOUBLE) / 1e2 AS x, o_totalprice AS y FROM {orders}"


@query(
    """WITH p AS (SELECT k, x, min(y) AS y FROM {g} GROUP BY k, x), q AS (SELECT k, i, i / 100.0::DOUBLE AS x FROM (SELECT DISTINCT k FROM p) t, generate_series(0, 100) s(i)),
b AS (SELECT q.k, i, q.x, max(p.x) FILTER (WHERE p.x <= q.x + 1e-12) AS a, min(p.x) FILTER (WHERE p.x >= q.x - 1e-12) AS z FROM q JOIN p ON p.k = q.k GROUP BY q.k, i, q.x)
SELECT b.k, i, round(CASE WHEN a IS NULL THEN r.y WHEN z IS NULL OR a = z THEN l.y ELSE l.y + (r.y - l.y) * (b.x - a) / (z - a) END, 7) AS y FROM b LEFT JOIN p l ON l.k = b.k AND l.x = a LEFT JOIN p r ON r.k = b.k AND r.x = z""",
    g=GRID,
)
def resampled(spark, sf_dir):
    """Each customer's totals on 101 even steps; of equal positions the least counts."""
    return series.resample(derived(spark, sf_dir, GRID), ["k"], 101).select("k", "i", F.round("y", 7).alias("y"))


PIXELS = """SELECT CAST(floor(l_orderkey / 400e0) AS INT) AS image_id, CAST((l_partkey * 7 + l_linenumber) % 24 AS INT) AS y, CAST((l_suppkey * 5 + l_orderkey) % 32 AS INT) AS x,
  CAST(min(floor(l_quantity) * 5) AS INT) AS r, CAST(max(l_partkey * 3 % 256) AS INT) AS g, CAST(min(l_suppkey * 7 % 256) AS INT) AS b, CAST(CASE WHEN max(l_linenumber) > 5 THEN 128 ELSE 255 END AS INT) AS a
FROM {lineitem} GROUP BY floor(l_orderkey / 400e0), (l_partkey * 7 + l_linenumber) % 24, (l_suppkey * 5 + l_orderkey) % 32"""


def pixels(spark, sf_dir, where="true"):
    return derived(spark, sf_dir, PIXELS).filter(where)


@query("SELECT image_id, y, x FROM (SELECT *, round_even((r * a + 255 * (255 - a)) / 255.0, 0) AS r1, round_even((g * a + 255 * (255 - a)) / 255.0, 0) AS g1, round_even((b * a + 255 * (255 - a)) / 255.0, 0) AS b1 FROM {p}) t WHERE r1 BETWEEN 20 AND 200 AND g1 BETWEEN 0 AND 255 AND b1 BETWEEN 30 AND 255 AND r1 - g1 BETWEEN -100 AND 100", p=PIXELS)
def selected_pixels(spark, sf_dir):
    """Pixels over white within channel ranges and a channel difference."""
    return masks.select(pixels(spark, sf_dir), {"r": (20, 200), "g": (0, 255), "b": (30, 255)}, [("r", "g", -100, 100)])


@query("WITH m AS (SELECT image_id, y, x FROM {p} WHERE r > 60) SELECT m.* FROM m WHERE (SELECT count(*) FROM m n WHERE n.image_id = m.image_id AND abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4", p=PIXELS)
def mask_boundary(spark, sf_dir):
    """Pixels that lack a neighbour."""
    return masks.boundary(pixels(spark, sf_dir, "r > 60"))


NEAR = "WITH a AS (SELECT image_id, y, x FROM {p} WHERE r > 150), b AS (SELECT image_id, y, x FROM {p} WHERE g > 150) SELECT a.image_id, a.y, a.x, sqrt(min((a.y-b.y)*(a.y-b.y) + (a.x-b.x)*(a.x-b.x))) AS distance FROM a JOIN b ON a.image_id = b.image_id GROUP BY a.image_id, a.y, a.x"


@query(NEAR, p=PIXELS)
def nearest_pixels(spark, sf_dir):
    """The exact distance of each pixel of one mask from another mask."""
    return structure.nearest(pixels(spark, sf_dir, "r > 150"), pixels(spark, sf_dir, "g > 150"), cell=4)


@query("SELECT image_id, max(distance) AS most, quantile_cont(distance, 0.95) AS p95 FROM (" + NEAR + ") t GROUP BY image_id", p=PIXELS)
def distance_figures(spark, sf_dir):
    """The greatest distance and the 95th percentile."""
    d = structure.nearest(pixels(spark, sf_dir, "r > 150"), pixels(spark, sf_dir, "g > 150"))
    return d.groupBy("image_id").agg(F.max("distance").alias("most"), F.percentile("distance", 0.95).alias("p95"))


@query("SELECT image_id, min(x) FILTER (WHERE m) AS mx0, min(y) FILTER (WHERE m) AS my0, max(x) FILTER (WHERE m) + 1 AS mx1, min(x) FILTER (WHERE e) AS ex0, max(y) FILTER (WHERE e) + 1 AS ey1 FROM (SELECT image_id, y, x, r > 150 AND NOT g > 150 AS m, g > 150 AND NOT r > 150 AS e FROM {p} WHERE r > 150 OR g > 150) t GROUP BY image_id", p=PIXELS)
def differing_boxes(spark, sf_dir):
    """Boxes of missing and extra pixels."""
    d = structure.differing_boxes(pixels(spark, sf_dir, "r > 150"), pixels(spark, sf_dir, "g > 150"))
    return d.select("image_id", F.col("missing_box.x0").alias("mx0"), F.col("missing_box.y0").alias("my0"), F.col("missing_box.x1").alias("mx1"), F.col("extra_box.x0").alias("ex0"), F.col("extra_box.y1").alias("ey1"))


@query("SELECT image_id, label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, bool_or(x = 0 OR y = 0 OR x = 31 OR y = 23) AS touches_border FROM (SELECT *, r % 5 AS label FROM {p}) t GROUP BY image_id, label", p=PIXELS)
def label_stats(spark, sf_dir):
    """Area, box and border contact of labelled pixels."""
    return masks.region_stats(pixels(spark, sf_dir).withColumn("label", F.col("r") % 5), 24, 32)


@query("SELECT image_id, label, count(*) AS n FROM (SELECT *, r % 5 AS label FROM {p}) t WHERE g > 150 GROUP BY image_id, label", p=PIXELS)
def label_counts(spark, sf_dir):
    """How many of a mask's pixels each label has."""
    p = pixels(spark, sf_dir)
    return structure.region_counts(p.select("image_id", "y", "x", (F.col("r") % 5).alias("label")), p.filter("g > 150"))


@query("SELECT i AS image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT image_id AS i FROM {p} WHERE g > 150) t, generate_series(0, 23) a(y), generate_series(0, 31) b(x) EXCEPT SELECT image_id, y, x FROM {p} WHERE g > 150", p=PIXELS)
def mask_complement(spark, sf_dir):
    """Pixels of the frame that a mask lacks."""
    return masks.complement(pixels(spark, sf_dir, "g > 150"), 24, 32)


@query("SELECT image_id, y, x, min(c) AS label, count(DISTINCT c % 2) > 1 AS conflict FROM (SELECT image_id, y, x, r % 4 AS c FROM {p} UNION ALL SELECT image_id, y, x, 2 + g % 2 FROM {p} WHERE b > 100) t GROUP BY image_id, y, x", p=PIXELS)
def merged_marks(spark, sf_dir):
    """Marks of two annotators: the hardest wins, opposite classes conflict."""
    p = pixels(spark, sf_dir)
    at = ["image_id", "y", "x"]
    return manifest.merged_marks(p.select(*at, (F.col("r") % 4).alias("code")).unionByName(p.filter("b > 100").select(*at, (2 + F.col("g") % 2).alias("code"))))


@query("SELECT image_id, r, CAST(NULL AS INT) AS dummy, n FROM (SELECT image_id, r - r % 50 AS r, count(*) AS n FROM {p} GROUP BY image_id, r - r % 50) t", p=PIXELS)
def palettes(spark, sf_dir):
    """Distinct colours with counts."""
    p = pixels(spark, sf_dir).select("image_id", (F.col("r") - F.col("r") % 50).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"), F.lit(255).alias("a"))
    return images.palette(p).select("image_id", "r", F.lit(None).cast("int").alias("dummy"), "n")


@query("SELECT image_id, CASE WHEN count(*) FILTER (WHERE a > 200) = 0 THEN NULL ELSE min(x) FILTER (WHERE a > 200) END AS x0, max(y) FILTER (WHERE a > 200) + 1 AS y1, count(*) FILTER (WHERE a > 200) AS visible FROM {p} GROUP BY image_id", p=PIXELS)
def asset_figures(spark, sf_dir):
    """Visible boxes and pixels of images."""
    p = pixels(spark, sf_dir)
    sizes = p.select("image_id").distinct().select("image_id", F.lit(32).alias("width"), F.lit(24).alias("height"))
    return images.asset(p, sizes, threshold=200).select("image_id", "x0", "y1", "visible")


@query("SELECT image_id AS patch, count(*) AS n, CASE WHEN min(a) = 255 THEN CAST(round_even(median(r), 0) AS INT) END AS r, CASE WHEN min(a) = 255 THEN CAST(round_even(median(g), 0) AS INT) END AS g FROM {p} WHERE x BETWEEN 3 AND 10 AND y BETWEEN 2 AND 6 GROUP BY image_id", p=PIXELS)
def patch_medians(spark, sf_dir):
    """Median colours of patches, half to even."""
    p = pixels(spark, sf_dir)
    patch = p.select("image_id").distinct().select(F.col("image_id").alias("patch"), "image_id", F.lit(3).alias("x"), F.lit(2).alias("y"), F.lit(8).alias("w"), F.lit(5).alias("h"))
    return images.patch_colours(p, patch).select("patch", "n", "r", "g")


@query("SELECT image_id AS probe, 0 AS sample, count(*) AS n, round(median(v), 9) AS median, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 9) AS spread FROM (SELECT *, floor((r * 19595 + g * 38470 + b * 7471 + 32768) / 65536.0) / 255 AS v FROM {p} WHERE a = 255) t WHERE x < 20 GROUP BY image_id", p=PIXELS)
def luma_probes(spark, sf_dir):
    """Median and spread of luminance in samples."""
    p = pixels(spark, sf_dir, "a = 255")
    s = p.select("image_id").distinct().select(F.col("image_id").alias("probe"), F.lit(0).alias("sample"), "image_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(20).alias("w"), F.lit(24).alias("h"))
    return images.probes(p, s).select("probe", "sample", "n", F.round("median", 9).alias("median"), F.round("spread", 9).alias("spread"))


@query("SELECT image_id, round(avg((abs(r - g) + abs(g - b) + abs(b - r)) / 3.0 / 255), 9) AS mean_difference, round(1 - avg((abs(r - g) + abs(g - b) + abs(b - r)) / 3.0 / 255), 9) AS similarity FROM {p} GROUP BY image_id", p=PIXELS)
def image_differences(spark, sf_dir):
    """Mean difference of images from their channels turned round."""
    p = pixels(spark, sf_dir)
    turned = p.select("image_id", "y", "x", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"))
    return images.differences(p, turned).select("image_id", F.round("mean_difference", 9).alias("mean_difference"), F.round("similarity", 9).alias("similarity"))


@query("SELECT p.image_id, p.y, p.x, CAST(CASE WHEN p.y = 0 OR p.x = 0 OR p.y = 23 OR p.x = 31 THEN any_value(p.r) ELSE greatest(0, least(255, 9 * any_value(p.r) - sum(q.r))) END AS INT) AS v FROM {p} p JOIN {p} q ON p.image_id = q.image_id AND abs(p.y - q.y) <= 1 AND abs(p.x - q.x) <= 1 GROUP BY p.image_id, p.y, p.x", p=PIXELS)
def edge_filter(spark, sf_dir):
    """Each pixel against its eight neighbours."""
    return images.edges(pixels(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("v")), 24, 32)


@query("SELECT image_id, arg_min(y, (-t, y, x)) AS y, arg_min(x, (-t, y, x)) AS x, max(t) AS total FROM (SELECT image_id, CAST(y - i AS INT) AS y, CAST(x - j AS INT) AS x, sum(r) AS t FROM {p}, generate_series(0, 3) a(i), generate_series(0, 3) b(j) WHERE y >= i AND x >= j GROUP BY 1, 2, 3) t GROUP BY image_id", p=PIXELS)
def worst_windows(spark, sf_dir):
    """The window of four by four pixels with the greatest sum."""
    return images.worst_window(pixels(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("v")), 4).withColumn("total", F.col("total").cast("decimal(38,0)"))


@query("SELECT image_id, y, x, CASE WHEN m THEN r ELSE 0 END AS r, CASE WHEN m THEN a ELSE 0 END AS a FROM (SELECT *, g > 100 AS m FROM {p}) t WHERE image_id % 3 <> 0", p=PIXELS)
def masked_paint(spark, sf_dir):
    """Pixels outside a mask without colour; images whose mask isn't 0 or 255 are left out."""
    p = pixels(spark, sf_dir)
    m = p.select("image_id", "y", "x", F.when((F.col("image_id") % 3 == 0) & (F.col("y") == 0), 7).when(F.col("g") > 100, 255).otherwise(0).alias("v"))
    return images.masked(p, m).select("image_id", "y", "x", "r", "a")


@query(
    """WITH h AS (SELECT image_id, r AS v, count(*) AS n FROM {p} GROUP BY image_id, r), c AS (SELECT image_id, v, sum(n) OVER w AS a, sum(n * v) OVER w AS sa, sum(n) OVER t AS t, sum(n * v) OVER t AS st FROM h WINDOW w AS (PARTITION BY image_id ORDER BY v), t AS (PARTITION BY image_id)),
b AS (SELECT image_id, v, abs(sa / a - (st - sa) / nullif(t - a, 0)) AS d, coalesce(a::DOUBLE * (t - a) * d * d, 0) AS q FROM c)
SELECT image_id, arg_min(v, (-round(q, 3), v)) AS threshold, round(arg_min(d, (-round(q, 3), v)), 6) AS separation FROM b GROUP BY image_id""",
    p=PIXELS,
)
def gray_thresholds(spark, sf_dir):
    """The level that parts the pixels of each image best."""
    return texts.thresholds(pixels(spark, sf_dir).select("image_id", "y", "x", F.col("r").alias("v"))).select("image_id", "threshold", F.round("separation", 6).alias("separation"))


@query("WITH m AS (SELECT DISTINCT image_id, y FROM {p} WHERE r > 240), i AS (SELECT *, sum(CASE WHEN d > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY y) AS k FROM (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY image_id ORDER BY y), 0) AS d FROM m) t) SELECT i.image_id, min(i.y) AS y0, max(i.y) + 1 AS y1, min(p.x) AS x0, max(p.x) + 1 AS x1 FROM i JOIN {p} p ON p.image_id = i.image_id AND p.y = i.y AND p.r > 240 GROUP BY i.image_id, k", p=PIXELS)
def ink_bands(spark, sf_dir):
    """Boxes of the ink in each run of rows, one empty row bridged."""
    return texts.bands(pixels(spark, sf_dir, "r > 240").select("image_id", "y", "x"), gap=1)


@query("SELECT c_custkey AS id, abs(px) + abs(py) <= 50 AS inside FROM (SELECT c_custkey, CAST(c_custkey * 7 % 140 - 70 AS DOUBLE) AS px, CAST(c_custkey * 11 % 140 - 70 AS DOUBLE) AS py FROM customer) t")
def points_in_polygon(spark, sf_dir):
    """Points in or on a diamond."""
    c = table(spark, sf_dir, "customer")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7 % 140 - 70).cast("double").alias("px"), (F.col("c_custkey") * 11 % 140 - 70).cast("double").alias("py"))
    corner = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((50.0, 0.0), (0.0, 50.0), (-50.0, 0.0), (0.0, -50.0))]
    return images.to_polygon(p, c.select(F.col("c_custkey").alias("id"), F.array(*corner).alias("points"))).select("id", "inside")


RINGS = """SELECT o_custkey AS id, o_orderkey AS k, CAST(o_orderkey % 97 AS DOUBLE) AS px, CAST(o_totalprice % 89 AS DOUBLE) AS py FROM {orders}"""


@query(
    """WITH c AS (SELECT c_custkey AS id, 20 + c_custkey % 60 AS s FROM customer), v AS (SELECT id, unnest([0, s, s, 2 * s, 2 * s, 0]) AS x, unnest([0, 0, s, s, 80, 80]) AS y, unnest(range(6)) AS i FROM c),
e AS (SELECT a.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM v a JOIN v b ON a.id = b.id AND b.i = (a.i + 1) % 6),
d AS (SELECT p.id, k, px, py, x0, y0, x1, y1, greatest(0, least(1, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / nullif(((x1 - x0) ** 2 + (y1 - y0) ** 2)::DOUBLE, 0))) AS t FROM {p} p JOIN e ON e.id = p.id),
g AS (SELECT id, k, min(sqrt((px - x0 - t * (x1 - x0)) ** 2 + (py - y0 - t * (y1 - y0)) ** 2)) AS far, count(*) FILTER (WHERE (y0 > py) <> (y1 > py) AND px < (x1 - x0) * (py - y0) / nullif((y1 - y0)::DOUBLE, 0) + x0) AS n FROM d GROUP BY id, k)
SELECT id, k, round(far, 6) AS distance, far < 1e-7 OR n % 2 = 1 AS inside FROM g""",
    p=RINGS,
)
def polygon_distances(spark, sf_dir):
    """Points of each customer's orders against a stepped outline of the customer's own."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (20 + F.col("c_custkey") % 60).cast("double").alias("s"))
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    s, o, top = F.col("s"), F.lit(0), F.lit(80)
    ring = c.select("id", F.array(corner(o, o), corner(s, o), corner(s, s), corner(2 * s, s), corner(2 * s, top), corner(o, top)).alias("points"))
    return images.to_polygon(derived(spark, sf_dir, RINGS), ring).select("id", "k", F.round("distance", 6).alias("distance"), "inside")


@query("SELECT c_custkey AS id, round(sqrt(dx * dx + dy * dy), 9) AS distance FROM (SELECT c_custkey, greatest(0, -px, px - 30) AS dx, abs(py) AS dy FROM (SELECT c_custkey, CAST(c_custkey * 7 % 140 - 70 AS DOUBLE) AS px, CAST(c_custkey * 11 % 140 - 70 AS DOUBLE) AS py FROM customer) t) u")
def segment_distances(spark, sf_dir):
    """Distances of points from a segment."""
    px, py = ((F.col("c_custkey") * k % 140 - 70).cast("double") for k in (7, 11))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(N.point_segment(px, py, *map(F.lit, (0.0, 0.0, 30.0, 0.0))), 9).alias("distance"))


@query("SELECT CAST(o_custkey AS BIGINT) AS id, count(p_partkey) AS n, coalesce(array_to_string(any_value(l)[1:3], ','), '') AS numbers FROM (SELECT o_custkey, min(o_orderkey) % 50 AS s FROM orders GROUP BY o_custkey) o LEFT JOIN part ON p_size = s LEFT JOIN (SELECT p_size AS z, list(CAST(p_partkey AS INT) ORDER BY p_partkey) AS l FROM part GROUP BY p_size) t ON z = s GROUP BY o_custkey")
def box_candidates(spark, sf_dir):
    """Operations with the same box as an image, the first three by number."""
    i = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.min("o_orderkey") % 50).cast("double").alias("v")).select("id", F.array("v").alias("box"))
    ops = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("seq"), F.array(F.col("p_size").cast("double") + 1e-6).alias("box"))
    return images.candidates(i, ops, 3).select("id", "n", F.array_join("numbers", ",").alias("numbers"))


@query("SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 7 <> 0 AND NOT (o_orderkey % 7 = 1 AND (o_orderkey - 1) % 2 = 0 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders))")
def unresolved_operations(spark, sf_dir):
    """Operations without a record; a combined record also stands for the stroke after it."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    ops = o.withColumn("kind", F.lit("stroke-path"))
    rec = o.filter("seq % 7 = 0").withColumn("type", F.when(F.col("seq") % 2 == 0, "fs").otherwise("f"))
    return images.unresolved(ops, rec).select("seq")


OBJECTS = """SELECT CAST(l_orderkey % 200 AS STRING) AS part, l_orderkey * 8 + l_linenumber AS ord, concat('o', CAST(l_partkey AS STRING)) AS name, CASE l_linenumber % 3 WHEN 0 THEN 'pic' ELSE 'sp' END AS kind, 0 AS depth,
  CAST(floor(l_quantity) * 200000 - 100000 AS BIGINT) AS x_emu, CAST(l_suppkey % 60 * 100000 AS BIGINT) AS y_emu, CAST(l_linenumber * 400000 AS BIGINT) AS w_emu, CAST(600000 AS BIGINT) AS h_emu,
  CAST(CASE WHEN l_partkey % 4 = 0 THEN 90 ELSE 0 END AS DOUBLE) AS rotation_deg, CAST(9144000 AS BIGINT) AS width, CAST(6858000 AS BIGINT) AS height, CAST(CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 12700 END AS BIGINT) AS line_width, concat('c', CAST(l_partkey % 2 AS STRING)) AS line_color FROM {lineitem}"""
TURNED = "(SELECT *, CASE WHEN rotation_deg = 90 THEN x_emu + (w_emu - h_emu) / 2.0 ELSE x_emu END AS bx, CASE WHEN rotation_deg = 90 THEN y_emu + (h_emu - w_emu) / 2.0 ELSE y_emu END AS by_, CASE WHEN rotation_deg = 90 THEN h_emu ELSE w_emu END AS bw, CASE WHEN rotation_deg = 90 THEN w_emu ELSE h_emu END AS bh FROM {o})"


@query("SELECT part, ord, name FROM " + TURNED + " t WHERE bx < -12700 OR by_ < -12700 OR bx + bw > width + 12700 OR by_ + bh > height + 12700", o=OBJECTS)
def out_of_bounds(spark, sf_dir):
    """Objects that reach beyond their slide, turned ones by their upright boxes."""
    return editability.out_of_bounds(derived(spark, sf_dir, OBJECTS)).select("part", "ord", "name")


@query("SELECT p.part, p.name AS a, q.name AS b FROM " + TURNED + " p JOIN " + TURNED + " q ON p.part = q.part AND p.ord < q.ord AND p.line_width = q.line_width AND p.line_color = q.line_color WHERE abs(p.bx - q.bx) <= 250000 AND abs(p.by_ - q.by_) <= 250000 AND abs(p.bw - q.bw) <= 250000 AND abs(p.bh - q.bh) <= 250000", o=OBJECTS)
def duplicate_borders(spark, sf_dir):
    """Pairs of one outline and nearly one box."""
    return editability.duplicate_borders(derived(spark, sf_dir, OBJECTS), ["part"], 250000)


@query("SELECT part, ord, round(w_emu * h_emu / CAST(width * height AS DOUBLE), 6) AS share, round(w_emu * h_emu / CAST(width * height AS DOUBLE), 6) >= 0.02 AS large FROM {o} WHERE kind = 'pic'", o=OBJECTS)
def large_pictures(spark, sf_dir):
    """Top-level pictures and their share of the slide."""
    return editability.large_pictures(derived(spark, sf_dir, OBJECTS), 0.02).select("part", "ord", "share", "large")


@query("SELECT part, CASE WHEN c THEN 'raster-dominant-risk' WHEN p > 0 AND n = 0 THEN 'raster-only' WHEN p > 0 THEN 'mixed' WHEN n > 0 THEN 'native-only' ELSE 'empty-or-unsupported' END AS classification FROM (SELECT part, bool_or(w_emu >= 2800000) AS c, count(*) FILTER (WHERE kind = 'pic') AS p, count(*) FILTER (WHERE kind = 'sp') AS n FROM {o} GROUP BY part) t", o=OBJECTS)
def slide_classes(spark, sf_dir):
    """What each slide is."""
    g = derived(spark, sf_dir, OBJECTS).groupBy("part").agg(F.bool_or(F.col("w_emu") >= 2800000).alias("c"), F.count_if(F.col("kind") == "pic").alias("p"), F.count_if(F.col("kind") == "sp").alias("n"))
    return g.select("part", editability.classify(F.col("c"), F.col("p"), F.col("n")).alias("classification"))


@query("SELECT doc_id, 'placeholder' AS rule FROM documents WHERE regexp_matches(trim(text), '(?i)^(?:todo|tbd|replace with|placeholder)(?:\\b|\\s|:)') OR regexp_matches(trim(text), '(?i)^lorem ipsum\\b') OR regexp_matches(trim(text), '(?i)^click to add(?: title| text| subtitle)?$') OR regexp_matches(trim(text), '(?i)^slide number$') UNION ALL SELECT doc_id, 'mojibake' FROM documents WHERE contains(text, 'Ã') OR contains(text, 'Â') OR contains(text, 'â€') OR contains(text, chr(65533)) UNION ALL SELECT doc_id, 'no East Asian font' FROM documents WHERE regexp_matches(text, '[一-鿿]') OR doc_id = 3")
def text_findings(spark, sf_dir):
    """Unfilled and wrongly decoded texts (none of the documents is East Asian; one row is added that is)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") == 3, F.concat("text", F.lit("漢"))).otherwise(F.col("text")).alias("text"), F.lit(False).alias("east_asian"))
    return editability.text_findings(d, ["doc_id"]).select("doc_id", "rule")


@query("SELECT p_partkey AS id, count(*) FILTER (WHERE s_name IS NOT NULL) AS observed, coalesce(1 + p_size % 2, 1) AS required, count(*) FILTER (WHERE s_name IS NOT NULL) >= 1 + p_size % 2 AS valid FROM (SELECT p_partkey, p_size, p_partkey % 100 AS n FROM part) p LEFT JOIN supplier ON s_suppkey % 100 = n AND (p_partkey % 3 = 0 OR s_nationkey = p_size % 25) GROUP BY p_partkey, p_size")
def text_inventory(spark, sf_dir):
    """Declared texts with and without a slide, counted among objects."""
    i = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("tok "), F.col("p_partkey") % 100).alias("text"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") % 25).alias("slide"), F.concat(F.lit("n"), F.col("p_partkey") % 100).alias("name"), F.lit(None).cast("string").alias("shape_id"), (1 + F.col("p_size") % 2).alias("required"))
    o = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slide"), F.concat(F.lit("n"), F.col("s_suppkey") % 100).alias("name"), F.lit("1").alias("shape_id"), F.concat(F.lit("a tok  "), F.col("s_suppkey") % 100, F.lit(" z")).alias("text"))
    return editability.inventory(i, o)


@query("SELECT o_orderkey AS id, CASE WHEN dpi < 100 THEN 'resolution too low' ELSE 'fine' END AS rule FROM (SELECT o_orderkey, 800 / (2.0 + o_custkey % 12) AS dpi FROM orders) t")
def placed_resolution(spark, sf_dir):
    """Pictures of 800 by 600 pixels placed 2 to 13 inches wide."""
    w = (2.0 + F.col("o_custkey") % 12).cast("double")
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("i").alias("image"), F.array(w, F.lit(0.0), F.lit(0.0), w * 0.75, F.lit(0.0), F.lit(0.0)).alias("matrix"), F.array(*[F.lit(0.0)] * 4).alias("crop"))
    i = spark.range(1).select(F.lit("i").alias("image"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.lit(10).alias("x0"), F.lit(10).alias("y0"), F.lit(700).alias("x1"), F.lit(500).alias("y1"))
    return editability.placements(p, i, 100, 100).select("id", F.coalesce(F.get("rules", F.lit(0)), F.lit("fine")).alias("rule"))


ITEMS = """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('i', CAST(o_orderkey % 5000 AS STRING)) END AS id, concat('m', CAST(o_custkey % 90 AS STRING)) AS module, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'icon' WHEN 2 THEN 'oval' ELSE 'chart' END AS role,
  CASE WHEN o_orderkey % 8 = 0 THEN ' ' ELSE 'x' END AS text, CASE o_custkey % 3 WHEN 0 THEN 'source_crop' WHEN 1 THEN 'native_primitive' ELSE 'sketch' END AS representation, CAST(o_orderkey % 100 AS DOUBLE) - 2e0 AS x, CAST(o_custkey % 7 AS DOUBLE) * 1e1 AS w, CAST(o_orderkey % 5 AS INT) AS output_slide, CASE WHEN o_custkey % 2 = 0 THEN concat('x', CAST(o_custkey % 40 AS STRING)) END AS raster_exception FROM {orders}"""


@query(
    """WITH i AS (SELECT *, CAST(ord AS VARCHAR) AS s FROM {items})
SELECT 'id missing' AS rule, s AS subject FROM i WHERE id = '' UNION ALL SELECT 'id repeated', s FROM (SELECT s, id, ord, min(ord) OVER (PARTITION BY id) AS f FROM i) t WHERE id <> '' AND (ord > f OR id IN (SELECT 'm' || CAST(c_custkey * 2 AS VARCHAR) FROM customer))
UNION ALL SELECT 'unknown module', s FROM i WHERE module NOT IN (SELECT 'm' || CAST(c_custkey * 2 AS VARCHAR) FROM customer)
UNION ALL SELECT 'unknown role', s FROM i WHERE role = 'oval' UNION ALL SELECT 'unknown representation', s FROM i WHERE representation = 'sketch' UNION ALL SELECT 'slide not positive', s FROM i WHERE output_slide < 1
UNION ALL SELECT 'text missing', s FROM i WHERE role = 'text' AND text = ' ' UNION ALL SELECT 'invalid box', s FROM i WHERE w <= 0 OR x < 0 UNION ALL SELECT 'box beyond the canvas', s FROM i WHERE w > 0 AND x >= 0 AND x + w > 100 + 1e-6
UNION ALL SELECT 'no raster exception', s FROM i WHERE representation = 'source_crop' AND raster_exception IS NULL UNION ALL SELECT 'unknown raster exception', s FROM i WHERE representation = 'source_crop' AND raster_exception IS NOT NULL AND raster_exception NOT IN (SELECT 'x' || CAST(n_nationkey AS VARCHAR) FROM nation)
UNION ALL SELECT 'module without items', m FROM (SELECT 'm' || CAST(c_custkey * 2 AS VARCHAR) AS m FROM customer) t WHERE m NOT IN (SELECT module FROM i)""",
    items=ITEMS,
)
def manifest_items(spark, sf_dir):
    """Violations of an inventory of items."""
    i = derived(spark, sf_dir, ITEMS).withColumn("bbox", F.array("x", F.lit(0.0), "w", F.lit(5.0))).withColumn("required_count", F.lit(1))
    m = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), F.col("c_custkey") * 2).alias("id"))
    return manifest.items(i, m, table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), "n_nationkey").alias("id")), 100.0, 100.0, dense=True)


@query(
    """WITH c AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 700 AS b, o_orderkey AS id FROM orders), n AS (SELECT c_custkey * 2 AS id, c_custkey % 400 AS out FROM customer), e AS (SELECT DISTINCT o_orderkey + o_custkey % 3 * 7 AS id FROM orders)
SELECT 'module without node role' AS rule, CAST(id AS VARCHAR) AS subject FROM (SELECT a AS id FROM c UNION SELECT b FROM c) t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT 'edge role without connection', CAST(id AS VARCHAR) FROM e WHERE id NOT IN (SELECT id FROM c)
UNION ALL SELECT 'connection without edge role', CAST(id AS VARCHAR) FROM c WHERE id NOT IN (SELECT id FROM e) UNION ALL SELECT 'output of several roles', 'o' || CAST(out AS VARCHAR) FROM n GROUP BY out HAVING count(*) > 1"""
)
def manifest_grammar(spark, sf_dir):
    """Node and edge roles against connections, both ways."""
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 700).alias("target"))
    n = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("id"), F.array(F.concat(F.lit("o"), F.col("c_custkey") % 400)).alias("output_names"))
    return manifest.grammar(c, n, o.select((F.col("o_orderkey") + F.col("o_custkey") % 3 * 7).alias("id")))


@query("SELECT l_orderkey * 8 + l_linenumber AS ord, CAST(round_even(l_quantity * 1.5, 0) AS BIGINT) AS x0, CASE WHEN l_linenumber = 7 THEN 'no name' WHEN round_even(l_tax * 100, 0) <= 0 THEN 'no size or negative origin' WHEN round_even(l_quantity * 1.5, 0) + round_even(l_tax * 100, 0) > 70 THEN 'beyond the canvas' END AS rule FROM lineitem")
def region_list(spark, sf_dir):
    """Named regions with whole corners, and what is wrong with them."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_linenumber") != 7, "r").otherwise(" ").alias("name"), F.array(F.col("l_quantity") * 1.5, F.lit(0.0), F.col("l_tax") * 100, F.lit(10.0)).alias("bbox"))
    return manifest.regions(d, 70, 100).select("ord", "x0", "rule")


@query("SELECT l_partkey, list_sort(list(DISTINCT l_returnflag)) AS groups FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) > 1")
def shared_members(spark, sf_dir):
    """Parts that more than one return flag has."""
    return manifest.disjoint(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_partkey")


@query("SELECT c.c_custkey AS id, n.n_regionkey AS asset, r.r_name AS path, CASE WHEN n.n_nationkey IS NULL THEN 'unknown instance' WHEN r.r_regionkey IS NULL THEN 'unknown asset' END AS rule FROM (SELECT c_custkey, c_nationkey + 3 AS k FROM customer) c LEFT JOIN nation n ON n.n_nationkey = k LEFT JOIN region r ON r.r_regionkey = n.n_regionkey AND r.r_regionkey <> 2")
def recipes(spark, sf_dir):
    """Items to instances to assets, with the first missing link."""
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 3).alias("instance"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("asset"))
    return manifest.recipe(i, n, table(spark, sf_dir, "region").filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("path"))).drop("instance")


@query("SELECT o_orderkey AS ord, o_custkey AS left_key, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END END AS right_key, o_orderkey % 10 <> 0 AND o_orderkey % 7 <> 0 AS agrees FROM orders")
def zipped_lists(spark, sf_dir):
    """Two lists side by side by an explicit order."""
    o = table(spark, sf_dir, "orders")
    right = o.filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("ord"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0)).alias("key"))
    return manifest.zipped(o.select(F.col("o_orderkey").alias("ord"), F.col("o_custkey").alias("key")), right, "ord", "key")


NODES = "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'container' ELSE 'shape' END AS role, CASE WHEN c_custkey % 3 = 0 THEN c_custkey - c_custkey % 20 END AS parent, CAST(c_custkey % 20 AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y, CASE WHEN c_custkey % 20 = 0 THEN 1.5e1 ELSE 5e0 END AS w, 3e0 AS h FROM {customer}"


@query("SELECT c.id, CASE WHEN p.role IS DISTINCT FROM 'container' THEN 'parent is no container' ELSE 'outside its container' END AS rule FROM {n} c LEFT JOIN {n} p ON p.id = c.parent WHERE c.parent IS NOT NULL AND (p.role IS DISTINCT FROM 'container' OR c.x < p.x OR c.y < p.y OR c.x + c.w > p.x + p.w + 1e-8 OR c.y + c.h > p.y + p.h + 1e-8)", n=NODES)
def containment(spark, sf_dir):
    """Nodes that their parents don't hold."""
    return manifest.contained(derived(spark, sf_dir, NODES))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN 'unknown kind' WHEN p_size % 6 = 1 AND p_partkey % 2 = 0 THEN 'invalid colour' WHEN p_size % 6 = 2 AND p_partkey % 3 = 0 THEN 'stops don''t rise from 0 to 1' WHEN p_size % 6 = 2 AND p_retailprice > 1500 THEN 'invalid angle' END AS rule FROM part WHERE (p_size % 6 = 0) OR (p_size % 6 = 1 AND p_partkey % 2 = 0) OR (p_size % 6 = 2 AND (p_partkey % 3 = 0 OR p_retailprice > 1500))")
def paint_issues(spark, sf_dir):
    """What is wrong with paints."""
    p = table(spark, sf_dir, "part")
    kind = F.element_at(F.array(*map(F.lit, ("plaid", "solid", "linear", "path", "none", "group"))), (F.col("p_size") % 6 + 1).cast("int"))
    stop = lambda at: F.struct(at.alias("position"), F.lit("00ff00").alias("color"), F.lit(1.0).alias("alpha"))
    stops = F.array(stop(F.lit(0.0)), stop(F.when((F.col("p_size") % 6 == 2) & (F.col("p_partkey") % 3 == 0), 0.9).otherwise(1.0)))
    return manifest.paint_issues(p.select(F.col("p_partkey").alias("id"), kind.alias("kind"), F.when(F.col("p_partkey") % 2 == 0, "12345").otherwise("#123456").alias("color"), F.lit(1.0).alias("alpha"), F.when(F.col("p_retailprice") > 1500, 400.0).otherwise(90.0).alias("angle"), F.array(F.lit(0.5), F.lit(0.5)).alias("focus"), stops.alias("stops")))


@query("SELECT c_custkey AS id, 'text' AS role, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_name END AS text FROM customer")
def revised_texts(spark, sf_dir):
    """Texts after a revision without violations."""
    i = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("text").alias("role"), F.col("c_name").alias("text"))
    return manifest.revise(i, i.filter("id % 10 = 0").select("id", F.col("text").alias("before"), F.lit("new").alias("after")))[0]


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_name END AS path, p_partkey % 5 = 0 AS replaced FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def replaced_assets(spark, sf_dir):
    """Assets in use, some of them replaced."""
    a = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("path"))
    return manifest.replace_assets(a, table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("asset")), a.filter("id % 5 = 0").select("id", F.lit("new").alias("path")))


@query("SELECT id, CASE WHEN a IS NULL THEN 'lost' WHEN b IS NULL THEN 'new' ELSE 'changed' END AS rule FROM (SELECT coalesce(x.c_custkey, y.c_custkey) AS id, x.h AS b, y.h AS a FROM (SELECT c_custkey, c_name AS h FROM customer WHERE c_custkey % 6 <> 0) x FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 8 = 0 THEN 'z' ELSE c_name END AS h FROM customer WHERE c_custkey % 5 <> 0) y ON x.c_custkey = y.c_custkey) t WHERE a IS NULL OR b IS NULL OR a <> b")
def receipt_changes(spark, sf_dir):
    """Receipts that are lost, new or changed."""
    c = table(spark, sf_dir, "customer")
    r = lambda d, h: d.select(F.col("c_custkey").alias("id"), F.lit("r").alias("role"), h.alias("sha256"))
    return manifest.frozen(r(c.filter("c_custkey % 6 <> 0"), F.col("c_name")), r(c.filter("c_custkey % 5 <> 0"), F.when(F.col("c_custkey") % 8 == 0, "z").otherwise(F.col("c_name")))).select("id", "rule")


@query("WITH RECURSIVE l AS (SELECT c_custkey AS a, c_custkey * 2 AS b FROM customer UNION SELECT c_custkey, c_custkey * 3 + 1 FROM customer), r(id) AS (SELECT CAST(1 AS BIGINT) UNION SELECT l.b FROM l JOIN r ON l.a = r.id) SELECT id FROM r")
def reachable_links(spark, sf_dir):
    """Everything that links reach from 1."""
    c = table(spark, sf_dir, "customer")
    links = c.select(F.col("c_custkey").alias("a"), F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 3 + 1)).alias("b"))
    return manifest.reachable(links, spark.range(1, 2))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem WHERE l_tax > 2e-2) t WHERE n <= 2")
def first_errors(spark, sf_dir):
    """The first two taxed lines of each order."""
    return manifest.first_errors(table(spark, sf_dir, "lineitem").filter("l_tax > 2e-2").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", 2)


@query("SELECT c_custkey, n AS matches FROM (SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AS n FROM customer) t WHERE n <> 1")
def exactly_one(spark, sf_dir):
    """Customers without exactly one large order."""
    o = table(spark, sf_dir, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return coverage.exactly_one(table(spark, sf_dir, "customer").select("c_custkey"), o, ["c_custkey"])


@query("SELECT n_name, n_regionkey, 'removed' AS side FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT n_name, n_regionkey + 1, 'added' FROM nation WHERE n_nationkey % 4 = 0")
def changed_rows(spark, sf_dir):
    """Rows that differ before and after."""
    n = table(spark, sf_dir, "nation")
    after = n.select("n_name", (F.col("n_regionkey") + F.when(F.col("n_nationkey") % 4 == 0, 1).otherwise(0)).alias("n_regionkey"))
    return coverage.changed(n.select("n_name", "n_regionkey"), after)


@query("SELECT k, min(p) AS start, max(p) + 1 AS end_ FROM (SELECT k, p, sum(CASE WHEN d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT k, p, coalesce(p - lag(p) OVER (PARTITION BY k ORDER BY p), 0) AS d FROM (SELECT DISTINCT o_custkey AS k, CAST(o_orderkey % 60 AS INT) AS p FROM orders) a) b) c GROUP BY k, r")
def occupied_runs(spark, sf_dir):
    """Runs of positions, gaps of two bridged."""
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 60).cast("int").alias("p"))
    return intervals.occupied_runs(d, ["k"], "p", 2).select("k", "start", F.col("end").alias("end_"))


@query("WITH b AS (SELECT o_custkey % 60 AS g, o_orderkey % 40 AS x, o_custkey % 30 AS y, 1 + o_orderkey % 5 AS w, 1 + o_custkey % 4 AS h FROM orders) SELECT g, count(*) AS area FROM (SELECT DISTINCT g, x + i AS px, y + j AS py FROM b, generate_series(0, 4) s(i), generate_series(0, 3) t(j) WHERE i < w AND j < h) u GROUP BY g")
def rectangle_areas(spark, sf_dir):
    """Exact area of unions of boxes; on whole numbers, the number of unit squares."""
    o = table(spark, sf_dir, "orders")
    d = o.select((F.col("o_custkey") % 60).alias("g"), *(c.alias(n) for c, n in zip((F.col("o_orderkey") % 40, F.col("o_custkey") % 30, 1 + F.col("o_orderkey") % 5, 1 + F.col("o_custkey") % 4), "xywh", strict=True)))
    return intervals.rectangle_union(d, ["g"]).withColumn("area", F.col("area").cast("long"))


@query('SELECT k, "group", count(*) AS members, min(p) AS first, max(p) - min(p) + 1 = count(*) AS contiguous FROM (SELECT l_orderkey AS k, l_returnflag AS "group", row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS p FROM {one}) t GROUP BY k, "group"', one=ONE)
def group_contiguity(spark, sf_dir):
    """Whether each return flag's lines are a run of the order by quantity."""
    lines = table(spark, sf_dir, "lineitem")
    one = spark.sql(ONE, lineitem=lines.repartition(graph.tasks(lines.count(), scenes.MEMBERS_A_TASK), "l_orderkey"))
    l = graph.cut(one.select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("group"), F.col("l_linenumber").alias("id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber")).alias("position")))
    return scenes.contiguous(l.select("k", "group", "id"), l.select("k", "id", "position"), "k")


@query("SELECT k, ord, (SELECT max(o.ord) FROM (SELECT l_orderkey AS k, l_linenumber AS ord, CAST(floor(l_quantity) AS INT) % 4 AS level FROM {one}) o WHERE o.k = t.k AND o.ord < t.ord AND o.level < t.level AND NOT EXISTS (SELECT 1 FROM (SELECT l_orderkey AS k, l_linenumber AS ord, CAST(floor(l_quantity) AS INT) % 4 AS level FROM {one}) m WHERE m.k = t.k AND m.ord > o.ord AND m.ord < t.ord AND m.level <= o.level)) AS parent FROM (SELECT l_orderkey AS k, l_linenumber AS ord, CAST(floor(l_quantity) AS INT) % 4 AS level FROM {one}) t", one=ONE)
def enclosing_scopes(spark, sf_dir):
    """The innermost open scope of each line, by nesting level."""
    l = derived(spark, sf_dir, ONE).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ord"), (F.floor("l_quantity").cast("int") % 4).alias("level"), F.lit(True).alias("opens"))
    return scenes.enclosing(l, "k").select("k", "ord", "parent")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'NOT_APPLICABLE' WHEN o_orderkey % 3 = 0 THEN 'NOT_VERIFIED' WHEN o_totalprice > 150000 THEN 'FAIL' ELSE 'PASS' END AS state FROM orders")
def check_states(spark, sf_dir):
    """Four states of a check."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rollup.state(F.col("o_orderkey") % 5 != 0, F.when(F.col("o_orderkey") % 3 != 0, True), F.col("o_totalprice") > 150000).alias("state"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n|\r|\x0b', chr(10), 'g'), '\n+', ' | ', 'g') AS t FROM documents")
def line_breaks(spark, sf_dir):
    """Texts with one kind of line break."""
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(T.line_breaks(F.col("text")), "\n+", " | ").alias("t"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) + CASE WHEN p_size % 4 = 2 THEN 0.5 ELSE 0 END END * CASE WHEN p_size % 4 = 3 THEN -1 ELSE 1 END AS n FROM part")
def number_prefixes(spark, sf_dir):
    """Numbers that texts begin with; a plus sign isn't one's beginning."""
    s = F.col("p_size").cast("string")
    t = F.element_at(F.array(F.concat(F.lit("+"), s), F.concat(F.lit(" "), s, F.lit("px")), F.concat(s, F.lit(".5e3em")), F.concat(F.lit("-"), s, F.lit("%"))), (F.col("p_size") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.number_prefix(t).alias("n"))


@query("SELECT page_id, starts_with(lower(trim(url)), 'http://') OR starts_with(lower(trim(url)), 'https://') OR starts_with(lower(trim(url)), '//') AS outside FROM pages WHERE url IS NOT NULL")
def external_urls(spark, sf_dir):
    """Whether urls lead outside."""
    return table(spark, sf_dir, "pages").filter("url is not null").select("page_id", T.is_external(F.col("url")).alias("outside"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS edges, p_size % 5 = 0 AS no_header FROM part")
def mermaid_texts(spark, sf_dir):
    """Headers and edges of small graph texts; what follows %% doesn't count."""
    t = F.concat(F.when(F.col("p_size") % 5 == 0, "graf x\n").otherwise("%% a --> b\n  Flowchart TD\n"), F.lit("a --> b %% c --> d\n"), F.when(F.col("p_size") % 3 == 0, "c ==> d").otherwise(""))
    m = T.mermaid(t)
    return table(spark, sf_dir, "part").select("p_partkey", m["edges"].alias("edges"), (F.size(m["headers"]) == 0).alias("no_header"))


@query("SELECT p_partkey, 1 + p_size % 3 AS edges, p_size % 7 <> 0 AS balanced, p_size % 2 = 0 AS declared FROM part")
def graphviz_texts(spark, sf_dir):
    """Declarations, braces and edges of small graph texts; comments don't count."""
    t = F.concat(F.when(F.col("p_size") % 2 == 0, "strict digraph g {").otherwise("strict dograph {"), F.lit("/* x -> y { */ a -> b;"), F.repeat(F.lit("c -- d;"), (F.col("p_size") % 3).cast("int")), F.when(F.col("p_size") % 7 != 0, "}").otherwise(""))
    g = T.graphviz(t)
    return table(spark, sf_dir, "part").select("p_partkey", g["edges"].alias("edges"), g["balanced"].alias("balanced"), g["declared"].alias("declared"))


@query("SELECT s_suppkey, concat('{\"a\":', CAST(s_nationkey AS VARCHAR), ',\"b\":[true,null],\"name\":\"', s_name, '\"}') AS j FROM supplier")
def canonical_rows(spark, sf_dir):
    """Rows as compact JSON with sorted keys."""
    s = table(spark, sf_dir, "supplier")
    t = F.concat(F.lit('{ "name" : "'), "s_name", F.lit('", "b": [true , null], "a": '), F.col("s_nationkey").cast("string"), F.lit("}"))
    return s.select("s_suppkey", T.canonical_json("compact")(t).alias("j"))


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, regexp_replace(nfc_normalize(text), '\\s+', '', 'g') AS k FROM documents) t WHERE k <> '' GROUP BY k")
def distinct_texts(spark, sf_dir):
    """The first document of each text, white space and composition apart."""
    d = table(spark, sf_dir, "documents").withColumn("k", T.match_key(F.col("text"))).filter("k <> ''")
    return d.groupBy(F.sha2("k", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).drop("h")


@query("SELECT doc_id, text, row_number() OVER (ORDER BY CAST(regexp_extract(text, '[0-9]+') AS BIGINT)) AS place FROM (SELECT n_nationkey AS doc_id, 'part' || CAST((n_nationkey * 7) % 25 + 1 AS VARCHAR) || '.xml' AS text FROM nation) t")
def natural_order(spark, sf_dir):
    """Names in the order of the numbers in them."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.concat(F.lit("part"), (F.col("n_nationkey") * 7 % 25 + 1).cast("string"), F.lit(".xml")).alias("text"))
    return n.select("doc_id", "text", F.row_number().over(Window.orderBy(T.natural_key(F.col("text")))).alias("place"))  # a sort of 25 names


@query("SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_quantity > 40 THEN 'NOT_VERIFIED' WHEN l_linenumber <> 2 OR l_tax > 5e-2 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN l_quantity <= 40 THEN round(greatest(l_tax * 100 - 4, 0), 3) END AS overflow FROM {one}", one=ONE)
def text_layouts(spark, sf_dir):
    """Texts of two lines: line counts and overflow of their frames."""
    l = derived(spark, sf_dir, ONE).withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    key = [F.lit(1).alias("slide"), F.col("id").cast("string").alias("name"), F.lit("7").alias("shape_id")]
    items = l.select("id", *key, F.lit("a\rb").alias("text"))
    box = lambda w: F.array(F.lit(0.0), F.lit(0.0), w, F.lit(5.0))
    frames = l.select(*key, box(F.lit(4.0)).alias("box"), F.lit(0.0).alias("rotation"))
    bounds = l.select(*key, box(F.greatest(F.col("l_tax") * 100, F.lit(1.0))).alias("box"), F.when(F.col("l_quantity") > 40, 3.0).otherwise(0.0).alias("rotation"), F.lit("a\u000bb").alias("text"), F.col("l_linenumber").cast("int").alias("line_count"))
    return texts.layout(items, frames, bounds).select("id", "status", "overflow")


@query("SELECT l_orderkey AS id, CASE WHEN max(v) / min(v) > 1.18 THEN 'scales_disagree' ELSE 'ADVISORY_ESTIMATE' END AS status, CASE WHEN max(v) / min(v) <= 1.18 THEN round(median(v), 2) END AS size FROM (SELECT l_orderkey, l_quantity + 100 AS v FROM lineitem UNION ALL SELECT l_orderkey, 120 + l_linenumber FROM lineitem) t GROUP BY l_orderkey")
def font_sizes(spark, sf_dir):
    """Font sizes that widths and heights of lines imply."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_quantity") + 100).alias("width"), (120 + F.col("l_linenumber")).cast("double").alias("height"), *(F.lit(10.0).alias(c) for c in ("ref_width", "ref_height", "ref_size")))
    return texts.font_size(l)


@query("SELECT s_suppkey AS id, round(a, 6) AS a, round(e, 6) AS e FROM (SELECT s_suppkey, 2.0 * s_nationkey AS a, 2.0 * s_acctbal + 3.0 AS e FROM supplier) t")
def affine_products(spark, sf_dir):
    """The product of two affine maps."""
    d = lambda *v: F.array(*(x.cast("double") if not isinstance(x, (int, float)) else F.lit(float(x)) for x in v))
    m = N.affine(d(2, 0, 0, 2, 3, 0), d(F.col("s_nationkey"), 0, 0, 1, F.col("s_acctbal"), 0))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.round(F.get(m, F.lit(0)), 6).alias("a"), F.round(F.get(m, F.lit(4)), 6).alias("e"))


@query("SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_quantity + l_linenumber <= 50 + 1e-8 THEN round(10 + l_quantity * 2, 6) END AS x, CASE WHEN l_quantity + l_linenumber <= 50 + 1e-8 THEN round(50 + 2.0, 6) END AS y FROM lineitem")
def frame_places(spark, sf_dir):
    """Boxes of a 50 by 50 source in a 100 by 200 viewport."""
    f = lambda *v: [F.lit(float(x)) for x in v]
    p = N.place(*f(0, 0, 50, 50, 10, 0, 100, 200), F.col("l_quantity"), F.lit(1.0), F.col("l_linenumber"), F.lit(1.0))
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("SELECT p_partkey AS id, CASE WHEN v < -0.5000001/a OR v > 255 + 0.5000001/a THEN NULL ELSE round_even(greatest(0.0, least(255.0, v)), 0) END AS value FROM (SELECT p_partkey, (p_size * 5 - (1 - a) * 40) / a AS v, a FROM (SELECT *, 0.25 + (p_partkey % 4) * 0.25 AS a FROM part) s) t")
def unmixed(spark, sf_dir):
    """Colours before they were painted over a ground."""
    a = 0.25 + (F.col("p_partkey") % 4) * 0.25
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.unmix((F.col("p_size") * 5).cast("double"), a.cast("double"), F.lit(40.0))["value"].alias("value"))


@query("SELECT p_partkey AS id, round((0.3 * r + 0.59 * g + 0.11 * b) / 255, 9) AS v FROM (SELECT p_partkey, p_size * 5 AS r, p_partkey % 256 AS g, 7 AS b FROM part) t")
def mask_samples(spark, sf_dir):
    """Mask samples of RGB luminosity."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(N.decode_mask("luminosity", "DeviceRGB", F.col("p_size") * 5, F.col("p_partkey") % 256, F.lit(7)), 9).alias("v"))


@query("SELECT p_partkey AS id, round(greatest(0, least(1, x / 50.0)), 9) AS along, round(least(1, sqrt((x - 25) * (x - 25) + (y - 25) * (y - 25)) / sqrt(1250)), 9) AS away FROM (SELECT p_partkey, p_size AS x, p_partkey % 50 AS y FROM part) t")
def profile_coordinates(spark, sf_dir):
    """Positions along a direction and away from a centre."""
    box = [F.lit(float(v)) for v in (0, 0, 50, 50)]
    x, y = F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(N.linear_coordinate(x, y, *box, F.lit(0.0)), 9).alias("along"), F.round(N.radial_coordinate(x, y, *box), 9).alias("away"))


@query("SELECT p_partkey AS id, round(CASE WHEN t < 0.25 THEN 10 + 40 * t / 0.25 ELSE 50 - 50 * (t - 0.25) / 0.75 END, 6) AS v FROM (SELECT p_partkey, (p_size - 1) / 49.0 AS t FROM part) s")
def gradients(spark, sf_dir):
    """Values between stops."""
    stops = F.array(*(F.struct(F.lit(p).alias("position"), F.lit(v).alias("v")) for p, v in ((0.0, 10.0), (0.25, 50.0), (1.0, 0.0))))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(N.gradient((F.col("p_size") - 1) / 49.0, stops, "v"), 6).alias("v"))


@query("SELECT p_partkey AS id, printf('%02X%02X%02X', CAST(round_even(0.5 * (m * 128 / 255.0) + 0.5 * 128, 0) AS INT), CAST(round_even(0.5 * (m * 64 / 255.0) + 0.5 * 64, 0) AS INT), CAST(round_even(0.5 * (m * 255 / 255.0) + 0.5 * 255, 0) AS INT)) AS colour FROM (SELECT p_partkey, p_size AS m FROM part) t")
def composites(spark, sf_dir):
    """Grays multiplied onto a ground at half strength."""
    h = F.lpad(F.hex("p_size"), 2, "0")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.composite("multiply", F.concat(h, h, h), F.lit("8040FF"), F.lit(0.5)).alias("colour"))


@query("SELECT p_partkey AS id, '<a:solidFill><a:srgbClr val=\"00FF00\"><a:alpha val=\"' || CAST(p_size * 2000 AS VARCHAR) || '\"/></a:srgbClr></a:solidFill>' AS xml FROM part")
def paint_texts(spark, sf_dir):
    """Solid fills as drawing XML."""
    none = F.lit(None).cast("array<struct<position:double,color:string,alpha:double>>")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.paint_xml(F.lit("solid"), F.lit("00FF00"), F.col("p_size") / 50, F.lit(0.0), F.array(F.lit(0.0), F.lit(0.0)), none, F.lit(1.0)).alias("xml"))


@query("SELECT o_orderkey AS id, CASE s WHEN 'top' THEN 5 WHEN 'bottom' THEN 5 WHEN 'left' THEN 0 ELSE 10 END * 1.0 AS x, CASE s WHEN 'top' THEN 0 WHEN 'bottom' THEN 4 ELSE 2 END * 1.0 AS y FROM (SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'top' WHEN 1 THEN 'left' WHEN 2 THEN 'bottom' ELSE 'right' END AS s FROM orders) t")
def port_places(spark, sf_dir):
    """Middles of a box's sides."""
    side = F.element_at(F.array(*map(F.lit, connectors.SIDES)), (F.col("o_custkey") % 4 + 1).cast("int"))
    p = connectors.port(side, *(F.lit(v) for v in (0.0, 0.0, 10.0, 4.0)))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), p["x"].alias("x"), p["y"].alias("y"))


CONNECTORS = """SELECT 1 AS slide, CAST(o_orderkey AS STRING) AS id, concat('c', CAST(o_orderkey % 4000 AS STRING)) AS name, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('n', CAST(o_custkey AS STRING)) END AS source_id, concat('n', CAST(o_orderkey % 1800 AS STRING)) AS target_id, o_orderkey % 5 = 0 AS plain, o_orderkey FROM {orders}"""


@query(
    """WITH c AS (SELECT * FROM {c}), n AS (SELECT 'n' || CAST(c_custkey AS VARCHAR) AS id FROM customer)
SELECT 'duplicate connector name' AS rule, name FROM c GROUP BY name HAVING count(*) > 1 UNION ALL SELECT 'unbound end', name FROM c WHERE source_id IS NULL
UNION ALL SELECT 'dangling end', name FROM c WHERE source_id IS NOT NULL AND source_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'dangling end', name FROM c WHERE target_id NOT IN (SELECT id FROM n)""",
    c=CONNECTORS,
)
def connector_issues(spark, sf_dir):
    """Connectors with repeated names, and ends that are unbound or dangling."""
    c = derived(spark, sf_dir, CONNECTORS).select("slide", "id", "name", "source_id", F.lit("3").alias("source_port"), "target_id", F.lit("1").alias("target_port"), F.lit("none").alias("start_arrow"), F.lit("none").alias("end_arrow"), *(F.lit(v).alias(k) for k, v in zip("xywh", (0, 0, 0, 0), strict=True)), F.lit(False).alias("flip_h"), F.lit(False).alias("flip_v"), F.lit(False).alias("plain"))
    s = table(spark, sf_dir, "customer").select(F.lit(1).alias("slide"), F.concat(F.lit("n"), "c_custkey").alias("id"), F.col("c_name").alias("name"), *(F.lit(0).alias(k) for k in "xywh"), F.lit(False).alias("plain"))
    return connectors.audit(c, s, require_bound=True).select("rule", "name")


@query("SELECT o_orderkey AS edge, side, target FROM (SELECT o_orderkey, 'a' AS side, o_custkey AS target FROM orders UNION ALL SELECT o_orderkey, 'b', o_orderkey % 3000 FROM orders) t WHERE target NOT IN (SELECT c_custkey FROM customer)")
def dangling_ends(spark, sf_dir):
    """Edge ends that name no node."""
    e = table(spark, sf_dir, "orders").select(F.lit(1).alias("page"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 3000).alias("b"))
    return connectors.dangling(e, table(spark, sf_dir, "customer").select(F.lit(1).alias("page"), F.col("c_custkey").alias("id")), "page", ["a", "b"]).drop("page")


@query("SELECT c_custkey AS name, 'r' AS reason, c_custkey % 3 = 0 OR regexp_matches('x' || CAST(c_custkey AS VARCHAR), '^x1') AS selected FROM customer")
def scoped_reasons(spark, sf_dir):
    """Limits of objects that a contract's names or patterns choose, and of others."""
    c = table(spark, sf_dir, "customer")
    name = F.concat(F.lit("x"), "c_custkey")
    p = spark.range(1).select(F.lit("^x1").alias("pattern"))
    d = grammar.scope(c.select(name.alias("name"), F.lit("r").alias("reason")), c.filter("c_custkey % 3 = 0").select(name.alias("name")), p)
    return d.select(F.substring("name", 2, 20).cast("long").alias("name"), "reason", "selected")


@query("SELECT n1.n_name AS a, n2.n_name AS b FROM (SELECT n_name, n_nationkey % 5 AS x, n_regionkey AS y FROM nation) n1 JOIN (SELECT n_name, n_nationkey % 5 AS x, n_regionkey AS y FROM nation) n2 ON n1.n_name < n2.n_name AND n1.x <= n2.x + 1 AND n2.x <= n1.x + 1 AND n1.y <= n2.y + 2 AND n2.y <= n1.y + 2")
def meeting_boxes(spark, sf_dir):
    """Boxes of nations, one by two, that meet or touch."""
    n = table(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") % 5).alias("x0"), F.col("n_regionkey").alias("y0")).withColumn("x1", F.col("x0") + 1).withColumn("y1", F.col("y0") + 2)
    a, b = (n.select(*(F.col(c).alias(f"{s}_{c}") for c in n.columns)) for s in "ab")
    box = lambda s: {k: F.col(f"{s}_{k}") for k in ("x0", "y0", "x1", "y1")}
    return a.join(b, (F.col("a_n_name") < F.col("b_n_name")) & N.intersects(box("a"), box("b"))).select(F.col("a_n_name").alias("a"), F.col("b_n_name").alias("b"))


@query("SELECT l_orderkey * 8 + l_linenumber AS id, ((l_quantity - 40 + 180) % 360 + 360) % 360 - 180 AS d FROM lineitem")
def angle_differences(spark, sf_dir):
    """Signed differences of angles."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), N.angle_difference(F.col("l_quantity"), F.lit(40.0)).alias("d"))


@query(
    """WITH d AS (SELECT p_partkey AS id, p_partkey % 4 AS kind, CAST(p_size AS DOUBLE) AS s, CAST(p_size % 3 AS DOUBLE) AS r FROM part)
SELECT id, CASE kind WHEN 0 THEN CASE WHEN r > 0 THEN concat('M ', s, ' 0.0 H ', s + 2, ' V ', r, ' H ', s, ' Z') END WHEN 1 THEN CASE WHEN r > 0 THEN concat('M ', s - r, ' 1.0 A ', r, ' ', r, ' 0 1 0 ', s + r, ' 1.0 A ', r, ' ', r, ' 0 1 0 ', s - r, ' 1.0 Z') END
WHEN 2 THEN CASE WHEN r > 0 THEN concat('M ', s - r, ' 1.0 A ', r, ' 4.0 0 1 0 ', s + r, ' 1.0 A ', r, ' 4.0 0 1 0 ', s - r, ' 1.0 Z') END ELSE concat('M ', s, ' 0.0 L 1.0 ', r) END AS d FROM d"""
)
def primitive_paths(spark, sf_dir):
    """Rectangles, circles, ellipses and lines as path text; without a size there is none."""
    kind, s, r = F.col("p_partkey") % 4, F.col("p_size").cast("double"), (F.col("p_size") % 3).cast("double")
    tag = F.when(kind == 0, "rect").when(kind == 1, "circle").when(kind == 2, "ellipse").otherwise("line")
    f = {"x": s, "y": F.lit(0.0), "width": F.lit(2.0), "height": r, "cx": s, "cy": F.lit(1.0), "r": r, "rx": r, "ry": F.lit(4.0), "x1": s, "y1": F.lit(0.0), "x2": F.lit(1.0), "y2": r}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), N.primitive_path(tag, f).alias("d"))


@query("SELECT p_partkey AS id, CASE WHEN w = 0 THEN 'a rectangle has no size' END AS rule, CASE WHEN w > 0 THEN CASE WHEN p_size % 3 = 0 THEN '4682B4' ELSE '1A2B3C' END END AS fill, CASE WHEN w > 0 THEN 5 END AS steps, CASE WHEN w > 0 THEN p_size + 2.0 END AS x0, CASE WHEN w > 0 THEN p_size + 2.0 + 2 * w END AS x1 FROM (SELECT *, p_size % 4 AS w FROM part) t")
def vector_parts(spark, sf_dir):
    """Moved and scaled rectangles of SVG documents; without a size the document is outside the profile."""
    size = F.col("p_size")
    svg = F.format_string('<svg viewBox="0 0 100 100"><g transform="translate(%d 1) scale(2)"><rect x="1" width="%d" height="3" fill="%s"/></g></svg>', size, size % 4, F.when(size % 3 == 0, "steelblue").otherwise("#1a2b3c"))
    d = vectors.parts(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), svg.alias("content")))
    at = lambda k: F.get(F.get(F.col("commands"), F.lit(k))["xy"], F.lit(0))
    return d.select(F.col("path").cast("long").alias("id"), "rule", "fill", F.when(F.col("commands").isNotNull(), F.size("commands")).alias("steps"), at(0).alias("x0"), at(1).alias("x1"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'NOT_VERIFIED' WHEN a < b THEN 'PASS' ELSE 'FAIL' END AS state FROM (SELECT c_custkey, c_custkey % 7 AS a, c_custkey % 5 AS b FROM customer) t WHERE a <> b")
def paint_orders(spark, sf_dir):
    """Whether backs are painted before fronts."""
    o = spark.range(7).select(F.col("id").alias("ord"), F.concat(F.lit("o"), "id").alias("name"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 7 <> c_custkey % 5")
    back = F.when(F.col("c_custkey") % 50 == 0, "none").otherwise(F.concat(F.lit("o"), F.col("c_custkey") % 7))
    return images.paint_order(o, c.select(F.col("c_custkey").alias("id"), back.alias("back"), F.concat(F.lit("o"), F.col("c_custkey") % 5).alias("front")))
