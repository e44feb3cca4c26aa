"""More audits over tables derived from the data set, each with the SQL that says the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from figmill.functions import numeric as N
from figmill.operators import coverage, fits, graph, masks, rings, series
from figmill.plans import connectors, contracts, curves, documents, editability, evidence, fidelity, images, manifest, runner, structure, texts
from figmill.plans.checks import PIXELS, SERIES, STRIPS, pixels
from figmill.plans.registry import derived, query, table


@query("""
WITH RECURSIVE p AS (SELECT o_custkey AS k, CAST(o_orderkey AS DOUBLE) AS x, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders),
r AS (SELECT k, CAST(1 AS BIGINT) AS i, [x] AS kept FROM p WHERE i = 1 UNION ALL SELECT r.k, r.i + 1, CASE WHEN len(list_filter(kept, lambda y: abs(y - p.x) < 900)) = 0 THEN list_append(kept, p.x) ELSE kept END FROM r JOIN p ON p.k = r.k AND p.i = r.i + 1),
f AS (SELECT k, unnest(arg_max(kept, i)) AS x FROM r GROUP BY k) SELECT f.k, f.x, v AS prominence FROM f JOIN p ON p.k = f.k AND p.x = f.x""")
def suppressed_peaks(spark, sf_dir):
    """Each customer's dearest orders, no two of them within 900 numbers."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").cast("double").alias("x"), F.col("o_totalprice").alias("prominence"))
    return series.suppress(o, ["k"], "x", 900.0)


@query(
    """WITH m AS (SELECT image_id, y, x FROM {p} WHERE g > 90), v AS (SELECT image_id, y + i AS y, x + j AS x, count(*) AS n, count(DISTINCT (i + j) % 2) AS parities FROM m, generate_series(0, 1) a(i), generate_series(0, 1) b(j) GROUP BY image_id, y + i, x + j),
c AS (SELECT image_id, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND parities = 1 THEN 2 ELSE 0 END) AS corners FROM v GROUP BY image_id),
e AS (SELECT m.image_id, count(*) * 4 - (SELECT count(*) FROM m p JOIN m q ON p.image_id = q.image_id AND abs(p.y - q.y) + abs(p.x - q.x) = 1 WHERE p.image_id = m.image_id) AS edges, count(*) AS area FROM m GROUP BY m.image_id)
SELECT e.image_id, CAST(area AS DOUBLE) AS area, CAST(edges AS BIGINT) AS edges, CAST(corners AS BIGINT) AS corners FROM e JOIN c ON c.image_id = e.image_id""",
    p=PIXELS,
)
def ring_figures(spark, sf_dir):
    """Edges, corners and signed area of the rings around each image's mask: the area is its pixels, holes taken off."""
    found = rings.rings(pixels(spark, sf_dir, "g > 90"), ["image_id"])
    return rings.areas(found, ["image_id"]).groupBy("image_id").agg(F.sum("area").alias("area"), F.sum("edges").alias("edges"), F.sum("corners").alias("corners"))


LINKS = "SELECT o_custkey AS a, CAST(floor(o_totalprice) % 150 AS BIGINT) AS b FROM {orders} WHERE o_orderpriority = '1-URGENT'"


@query("WITH RECURSIVE e AS (SELECT DISTINCT a, b FROM {e} t), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT p.a AS id, max(p.b) AS circle FROM r p JOIN r q ON q.a = p.b AND q.b = p.a WHERE EXISTS (SELECT 1 FROM r s WHERE s.a = p.a AND s.b = p.a) GROUP BY p.a", e=LINKS)
def circle_members(spark, sf_dir):
    """Nodes of a directed graph that lie on circles, with the largest of those that reach each other."""
    return graph.on_circles(derived(spark, sf_dir, LINKS))


SOURCES = """SELECT CAST(p_partkey AS STRING) AS path, CASE p_partkey % 5 WHEN 0 THEN 'svg' WHEN 1 THEN 'drawio' WHEN 2 THEN 'excalidraw' WHEN 3 THEN 'html' ELSE 'mermaid' END AS format,
CASE p_partkey % 5 WHEN 0 THEN concat('<svg viewBox="0 0 10 10"><image width="10" height="', CAST(p_size % 12 AS STRING), '"/><g><rect/></g></svg>')
  WHEN 1 THEN concat('<mxfile><mxGraphModel><root><object id="7"><mxCell vertex="1"/></object><mxCell id="2" vertex="1"/><mxCell id="3" edge="1" source="7" target="', CAST(p_size % 4 AS STRING), '"><mxGeometry relative="', CAST(p_size % 2 AS STRING), '"/></mxCell></root></mxGraphModel></mxfile>')
  WHEN 2 THEN concat('{{"elements":[{{"id":"a","type":"text"}},{{"id":"', CASE WHEN p_size % 3 = 0 THEN 'a' ELSE 'b' END, '","type":"arrow","startBinding":{{"elementId":"', CASE WHEN p_size % 2 = 0 THEN 'a' ELSE 'z' END, '"}}}},{{"id":"gone","isDeleted":true}}]}}')
  WHEN 3 THEN concat('<div><img src="', CASE WHEN p_size % 2 = 0 THEN '//e' ELSE 'e' END, '"><script>var a="<svg>"</script></div>')
  ELSE CASE WHEN p_size % 2 = 0 THEN 'flowchart TD' ELSE concat(' %% note', chr(10), 'graph LR', chr(10), 'a --> b') END END AS content, p_size FROM {part}"""


@query(
    """SELECT CAST(path AS BIGINT) AS id, CASE format WHEN 'drawio' THEN CASE WHEN p_size % 4 IN (0, 1) THEN 'page 1: dangling target' ELSE '' END WHEN 'excalidraw' THEN CASE WHEN p_size % 3 = 0 THEN 'duplicate ids' || CASE WHEN p_size % 2 = 1 THEN ', dangling startBinding' ELSE '' END WHEN p_size % 2 = 1 THEN 'dangling startBinding' ELSE '' END ELSE '' END AS errors,
CASE format WHEN 'svg' THEN CASE WHEN p_size % 12 >= 8 THEN 'image covers the canvas' ELSE '' END WHEN 'drawio' THEN CASE WHEN p_size % 2 = 0 THEN 'malformed edges' ELSE '' END WHEN 'html' THEN CASE WHEN p_size % 2 = 0 THEN 'images only, external assets' ELSE 'images only' END ELSE '' END AS risks,
CASE WHEN format = 'mermaid' AND p_size % 2 = 0 THEN 'no edges' ELSE '' END AS warnings, CASE format WHEN 'svg' THEN 1 WHEN 'drawio' THEN 3 WHEN 'excalidraw' THEN 2 WHEN 'html' THEN 1 ELSE p_size % 2 END AS n FROM {d} t""",
    d=SOURCES,
)
def document_reports(spark, sf_dir):
    """Reports of drawings in five formats, with faults that follow the part's size."""
    d = documents.audit(derived(spark, sf_dir, SOURCES).select("path", "format", "content"))
    n = F.coalesce(*(F.try_element_at("stats", F.lit(k)) for k in ("native_drawables", "cells", "elements", "structural_elements", "edge_tokens")))
    return d.select(F.col("path").cast("long").alias("id"), *(F.array_join(c, ", ").alias(c) for c in ("errors", "risks", "warnings")), n.alias("n"))


@query("""
WITH s AS (SELECT o_custkey AS package, count(*) AS slides, sum(o_orderkey % 5) AS native, sum(o_orderkey % 3) AS pictures, count(*) FILTER (WHERE o_orderkey % 3 > 0 AND o_orderkey % 5 = 0) AS raster FROM orders GROUP BY o_custkey),
f AS (SELECT l_suppkey AS package, count(*) AS findings, count(*) FILTER (WHERE l_linenumber > 2) AS blocks FROM lineitem GROUP BY l_suppkey)
SELECT coalesce(s.package, f.package) AS package, coalesce(slides, 0) AS slides, CAST(coalesce(native, 0) AS BIGINT) AS native, CAST(coalesce(pictures, 0) AS BIGINT) AS pictures, coalesce(raster, 0) AS raster_dominant, coalesce(findings, 0) AS findings, coalesce(blocks, 0) + coalesce(raster, 0) AS blocking FROM s FULL JOIN f ON f.package = s.package""")
def package_totals(spark, sf_dir):
    """Sums of slides and findings by package, advice apart."""
    o = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("package"), (o % 5).alias("native"), (o % 3).alias("pictures"), editability.classify(F.lit(False), o % 3, o % 5).alias("classification"))
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("package"), F.when(F.col("l_linenumber") > 2, "out of bounds").otherwise("no East Asian font").alias("rule"), F.lit("x").alias("subject"))
    return editability.totals(s, f)


BORDER = "SELECT m.* FROM (SELECT image_id, y, x FROM {p} WHERE c > 150) m WHERE (SELECT count(*) FROM (SELECT image_id, y, x FROM {p} WHERE c > 150) n WHERE n.image_id = m.image_id AND abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4"


@query(
    "WITH a AS (" + BORDER.replace("c > 150", "r > 60") + "), b AS (" + BORDER.replace("c > 150", "g > 60") + """),
d AS (SELECT a.image_id, 0 AS way, a.y, a.x, min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) AS s FROM a JOIN b ON a.image_id = b.image_id GROUP BY a.image_id, a.y, a.x UNION ALL SELECT b.image_id, 1, b.y, b.x, min((a.y - b.y) ** 2 + (a.x - b.x) ** 2) FROM a JOIN b ON a.image_id = b.image_id GROUP BY b.image_id, b.y, b.x)
SELECT image_id, round(sqrt(max(s)), 9) AS boundary_max, CASE WHEN arg_min(way, (-s, way, y, x)) = 0 THEN 'a to b' ELSE 'b to a' END AS direction, arg_min(y, (-s, way, y, x)) AS worst_y, arg_min(x, (-s, way, y, x)) AS worst_x FROM d GROUP BY image_id""",
    p=PIXELS,
)
def worst_boundary(spark, sf_dir):
    """The greatest distance between two masks' boundaries, which way it is and where."""
    d = structure.distances(pixels(spark, sf_dir, "r > 60"), pixels(spark, sf_dir, "g > 60"))
    return d.select("image_id", F.round("boundary_max", 9).alias("boundary_max"), "direction", "worst_y", "worst_x")


@query(
    """WITH m AS (SELECT image_id, y, x FROM {p} WHERE g > 100), v AS (SELECT image_id, y + i AS y, x + j AS x, count(*) AS n, count(DISTINCT (i + j) % 2) AS parities FROM m, generate_series(0, 1) a(i), generate_series(0, 1) b(j) GROUP BY image_id, y + i, x + j)
SELECT image_id, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND parities = 1 THEN -2 ELSE 0 END) / 4 AS BIGINT) AS euler FROM v GROUP BY image_id""",
    p=PIXELS,
)
def euler_numbers(spark, sf_dir):
    """Parts less holes of masks that touch by corners too: the same as a sum over squares of two by two pixels.  The frame is wider by one, so that what it would cut off isn't a hole."""
    m = pixels(spark, sf_dir, "g > 100").select("image_id", (F.col("y") + 1).cast("int").alias("y"), (F.col("x") + 1).cast("int").alias("x"))
    return masks.topology(m, 26, 34).select("image_id", (F.col("parts") - F.col("holes")).cast("long").alias("euler"))


@query(
    """WITH s AS (SELECT image_id, x, g % 5 > 0 AS filled FROM {s}), r AS (SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY image_id ORDER BY x) AS run FROM s),
p AS (SELECT image_id, CASE image_id % 3 WHEN 0 THEN [1, 2] WHEN 1 THEN [1, 1] ELSE [2, 9] END AS spots FROM (SELECT DISTINCT image_id FROM s) t), u AS (SELECT image_id, unnest(spots) AS x FROM p),
j AS (SELECT u.image_id, count(*) AS n, count(DISTINCT u.x) AS places, count(*) FILTER (WHERE filled) AS hits, count(DISTINCT run) FILTER (WHERE filled) AS runs FROM u LEFT JOIN r ON r.image_id = u.image_id AND r.x = u.x GROUP BY u.image_id)
SELECT image_id, CASE WHEN places < n THEN 'repeated seed' WHEN hits < n THEN 'seed off the support' WHEN runs <> 1 THEN 'seeds disagree' ELSE 'owned' END AS status FROM j""",
    s=STRIPS,
)
def seed_owners(spark, sf_dir):
    """Whether two seeds of an image lie on one region of its mask."""
    s = derived(spark, sf_dir, STRIPS)
    at = F.when(F.col("image_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).when(F.col("image_id") % 3 == 1, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(2), F.lit(9)))
    seeds = s.select("image_id").distinct().select("image_id", F.lit(0).alias("y"), F.explode(at).alias("x"))
    return structure.owned(s.filter("g % 5 > 0").select("image_id", "y", "x"), seeds).select("image_id", "status")


@query("""
SELECT k, side, rule FROM (SELECT o_orderkey AS k, 'source' AS side, CASE WHEN o_orderkey % 11 = 0 THEN 'name' WHEN o_orderkey % 7 = 0 THEN 'binding' WHEN o_orderkey % 5 = 0 THEN 'endpoint' WHEN o_orderkey % 3 = 0 THEN 'site' END AS rule FROM orders
UNION ALL SELECT o_orderkey, 'target', CASE WHEN o_orderkey % 11 = 0 THEN 'name' WHEN o_custkey % 4 = 0 THEN 'binding' END FROM orders) t WHERE rule IS NOT NULL""")
def connector_readback(spark, sf_dir):
    """Where an application's connectors differ from the package's: name, binding, end or site."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("c"), k.cast("string"))
    none = F.lit(None).cast("string")
    p = o.select(F.lit(1).alias("slide"), k.alias("id"), name.alias("name"), F.lit("a").alias("source_id"), F.lit("A").alias("source_name"), F.lit("2").alias("source_port"), none.alias("target_id"), none.alias("target_name"), none.alias("target_port"))
    a = o.select(F.lit(1).alias("slide"), k.alias("id"), F.when(k % 11 == 0, "other").otherwise(name).alias("name"), (k % 7 != 0).alias("begin_connected"), F.when(k % 5 == 0, "b").otherwise("a").alias("begin_id"), F.lit("A").alias("begin_name"), F.when(k % 3 == 0, 1).otherwise(3).alias("begin_site"), (F.col("o_custkey") % 4 == 0).alias("end_connected"), none.alias("end_id"), none.alias("end_name"), F.lit(None).cast("int").alias("end_site"))
    return connectors.readback(p, a).select(F.col("id").alias("k"), "side", "rule")


@query("WITH c AS (SELECT k, i AS a, lead(i) OVER (PARTITION BY k ORDER BY i) AS b FROM {s} WHERE i % 4 = 1) SELECT c.k, arg_min(s.i, (v, s.i)) AS i, min(v) AS v FROM c JOIN {s} s ON s.k = c.k AND s.i > a AND s.i < b GROUP BY c.k, a, b", s=SERIES)
def series_valleys(spark, sf_dir):
    """The lowest order between each two that are four apart."""
    s = derived(spark, sf_dir, SERIES)
    return series.valleys(s.select("k", "i", "v"), s.filter("i % 4 = 1").select("k", "i"), ["k"], "i", "v")


@query("""
WITH c AS (SELECT l_orderkey AS path, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_quantity AS q FROM lineitem), g AS (SELECT path, count(*) AS n, bool_or(i > 1 AND q > 48) AS bad, path % 9 = 0 AS flat FROM c GROUP BY path)
SELECT path, CASE WHEN flat OR bad OR n < 2 THEN 'unsupported' ELSE 'supported' END AS status, CASE WHEN flat THEN 'no width or height' WHEN bad THEN 'unsupported command' WHEN n < 2 THEN 'fewer than two points' END AS reason, CASE WHEN NOT (flat OR bad OR n < 2) THEN n END AS points FROM g""")
def decoded_paths(spark, sf_dir):
    """Paths of a start and lines for each order; arcs are outside what is read."""
    l = table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    c = l.select(F.col("l_orderkey").cast("string").alias("path"), i.alias("ord"), "l_quantity", "l_partkey", "l_orderkey")
    kind = F.when(F.col("ord") == 1, "moveTo").when(F.col("l_quantity") > 48, "arcTo").otherwise("lnTo")
    size = F.when(F.col("l_orderkey") % 9 == 0, 0.0).otherwise(100.0)
    c = c.select("path", "ord", kind.alias("kind"), F.array(F.struct(F.col("l_quantity").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y"))).alias("points"), size.alias("w"), size.alias("h"))
    return curves.decode(c).select(F.col("path").cast("long").alias("path"), "status", "reason", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"))


@query("SELECT p_partkey AS id, round(p_size / 50.0 * 5 / 25, 9) AS middle FROM part WHERE p_size > 0 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size <= 0")
def circle_stops(spark, sf_dir):
    """The middle stop of a circle of radius p_size / 5 in a box of 30 by 40, as a stop of the circle around the box."""
    stop = lambda p, c: F.struct(F.lit(p).alias("position"), F.lit(c).alias("color"), F.lit(1.0).alias("alpha"))
    stops = F.array(stop(0.0, "000000"), stop(0.5, "808080"), stop(1.0, "FFFFFF"))
    moved = N.radial_stops(stops, F.col("p_size") / 5, F.lit(30.0), F.lit(40.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(F.get(moved, F.lit(1))["position"], 9).alias("middle"))


@query("SELECT l_orderkey * 8 + l_linenumber AS id, l_quantity * 12700 + l_linenumber * 100 = (l_quantity + l_linenumber % 2) * 12700 AS exact, abs(floor((8 * (l_quantity * 12700 + l_linenumber * 100) + 6350) / 12700) / 8 - (l_quantity + l_linenumber % 2)) <= 1e-6 OR l_quantity * 12700 + l_linenumber * 100 = (l_quantity + l_linenumber % 2) * 12700 AS eighths FROM lineitem")
def length_units(spark, sf_dir):
    """Lengths in EMU against points, exactly and to an eighth of a point."""
    emu, points = F.col("l_quantity") * 12700 + F.col("l_linenumber") * 100, F.col("l_quantity") + F.col("l_linenumber") % 2
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), N.same_points(emu, points, F.lit(False)).alias("exact"), N.same_points(emu, points, F.lit(True)).alias("eighths"))


@query("SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 OR o_orderkey % 100 + 10 > 100 THEN 'invalid box' WHEN o_orderkey % 6 = 0 THEN 'no text' END AS rule FROM orders WHERE o_orderkey % 3 <> 2 AND o_orderstatus = 'F'")
def chosen_texts(spark, sf_dir):
    """The text items that a list chooses, and what is wrong with their boxes."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    i = o.select(k.alias("id"), F.when(k % 3 != 2, "text").otherwise("icon").alias("role"), F.when(k % 6 != 0, "t").alias("text"), F.array((k % 100).cast("double"), F.lit(0.0), F.lit(10.0), F.when(F.col("o_custkey") % 4 == 0, 0.0).otherwise(5.0)).alias("bbox"))
    return texts.chosen(i, o.filter("o_orderstatus = 'F'").select(k.alias("id")), 100.0, 100.0)


@query("SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS bound FROM orders")
def bound_prompts(spark, sf_dir):
    """Prompts that end with their contract in its canonical form; the others have spaces in it."""
    k = F.col("o_orderkey").cast("string")
    contract = F.concat(F.lit('{"b": [1, "é"], "a": '), k, F.lit("}"))
    end = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"a":'), k, F.lit(',"b":[1,"é"]}'))).otherwise(F.concat(F.lit('{"a": '), k, F.lit(', "b": [1, "é"]}')))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), manifest.prompt_bound(F.concat(F.lit("Draw it. "), end), contract).alias("bound"))


@query("SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN 'UNAVAILABLE' WHEN l_returnflag = 'R' THEN 'ERROR' WHEN l_quantity > 40 THEN 'REJECTED' ELSE 'EXTRACTED' END AS status FROM lineitem")
def channel_states(spark, sf_dir):
    """What came of an optional channel of each row."""
    s = images.channel_status(F.col("l_linenumber") != 7, F.col("l_returnflag") == "R", F.col("l_quantity") > 40)
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), s.alias("status"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def held_groups(spark, sf_dir):
    """Groups that hold some native object."""
    g = table(spark, sf_dir, "orders").select(F.lit(1).alias("slide"), F.col("o_orderkey").alias("id"), F.lit("g").alias("name"))
    o = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.lit(1).alias("slide"), F.col("l_orderkey").alias("group"))
    return images.native_groups(o, g).select("id")


@query("""
WITH g AS (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING max(l_linenumber) <> count(DISTINCT l_linenumber) OR min(l_linenumber) <> 1 OR count(*) <> count(DISTINCT l_linenumber)) t),
c AS (SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer) t), o AS (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS w FROM orders)
SELECT 'numbering' AS name, true AS required, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n AS failed, 0 AS open, (SELECT count(*) FROM g WHERE n > 0) = 0 AND (SELECT count(*) FROM c WHERE n > 0) = 0 AS passed FROM g
UNION ALL SELECT 'customers', true, CASE WHEN n > 0 THEN 'FAIL' ELSE 'PASS' END, n, 0, (SELECT count(*) FROM g WHERE n > 0) = 0 AND n = 0 FROM c
UNION ALL SELECT 'totals', false, CASE WHEN f > 0 THEN 'FAIL' WHEN w > 0 THEN 'NOT_VERIFIED' ELSE 'PASS' END, f, w, (SELECT count(*) FROM g WHERE n > 0) = 0 AND (SELECT count(*) FROM c WHERE n > 0) = 0 FROM o
UNION ALL SELECT 'curves', true, 'NOT_APPLICABLE', NULL, NULL, (SELECT count(*) FROM g WHERE n > 0) = 0 AND (SELECT count(*) FROM c WHERE n > 0) = 0""")
def quality_run(spark, sf_dir):
    """Four checks, each written once and counted while it is written, and the verdict over the required ones."""
    t = lambda name: table(spark, sf_dir, name)
    checks = [
        runner.Check("numbering", lambda: coverage.sequence_gaps(t("lineitem"), ["l_orderkey"], "l_linenumber").filter("has_gap OR n_repeated > 0")),
        runner.Check("customers", lambda: coverage.missing(t("orders").select(F.col("o_custkey").alias("id")), t("customer").select(F.col("c_custkey").alias("id")), ["id"])),
        runner.Check("totals", lambda: t("orders").filter("o_totalprice < 0 OR o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus", "o_totalprice"), required=False, open=(F.col("o_orderstatus") == "P") & (F.col("o_totalprice") >= 0)),
        runner.Check("curves", None),
    ]
    return runner.run(spark, checks, f"{graph.shared_folder(spark)}/quality-{uuid.uuid4().hex}", [sf_dir]).drop("reason")


@query("""
WITH i AS (SELECT o_custkey AS path, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS spot, 'i' || CAST(o_orderkey % 400 AS VARCHAR) AS id, 'm' || CAST(o_orderkey % 3 AS VARCHAR) AS module, o_orderkey % 4 AS role, o_orderkey % 8 AS said, o_orderkey % 90 AS x FROM orders),
c AS (SELECT path, max(o_orderkey) AS top FROM i GROUP BY path)
SELECT path, 'id repeated' AS rule, id AS subject FROM i GROUP BY path, id HAVING count(*) > 1 UNION ALL SELECT path, 'item in unknown module', module FROM i WHERE module = 'm2'
UNION ALL SELECT path, 'unknown role', CAST(spot AS VARCHAR) FROM i WHERE role = 2 UNION ALL SELECT path, 'text missing', CAST(spot AS VARCHAR) FROM i WHERE role = 0 AND said = 0 UNION ALL SELECT path, 'item beyond the canvas', CAST(spot AS VARCHAR) FROM i WHERE x + 20 > 100
UNION ALL SELECT path, 'module without items', m FROM c, (VALUES ('m0'), ('m1')) v(m) WHERE top % 5 = 0 AND NOT EXISTS (SELECT 1 FROM i WHERE i.path = c.path AND i.module = m)
UNION ALL SELECT path, 'connection to unknown module', 'm' || CAST(top % 3 AS VARCHAR) FROM c WHERE top % 3 = 2
UNION ALL SELECT path, 'no grammar', '' FROM c WHERE top % 5 = 0 AND top % 2 = 1 UNION ALL SELECT path, 'edge pattern', 'c' FROM c WHERE top % 2 = 0 AND top % 7 = 0 UNION ALL SELECT path, 'connected module without role', 'm1' FROM c WHERE top % 2 = 0 AND top % 3 = 1""")
def manifest_contracts(spark, sf_dir):
    """A manifest of each customer's orders, with faults that follow their numbers, against all contracts."""
    k = F.col("o_orderkey")
    number = lambda prefix, v: F.concat(F.lit(prefix), v.cast("string"))
    role = F.when(k % 4 == 0, "text").when(k % 4 == 1, "icon").when(k % 4 == 2, "oval").otherwise("chart")
    item = F.struct(k.alias("k"), number("i", k % 400).alias("id"), number("m", k % 3).alias("module"), role.alias("role"), F.when(k % 8 == 0, " ").otherwise("x").alias("text"), F.lit("native_primitive").alias("representation"), F.array((k % 90).cast("double"), F.lit(0.0), F.lit(20.0), F.lit(5.0)).alias("bbox"))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.array_sort(F.collect_list(item)).alias("source_inventory"), F.max(k).alias("top"))
    top = F.col("top")
    module = F.array(*(F.struct(F.lit(m).alias("id"), F.array(*map(F.lit, (x, 0.0, 40.0, 40.0))).alias("bbox")) for m, x in (("m0", 0.0), ("m1", 50.0))))
    node = lambda m: F.struct(F.lit("r").alias("role"), F.array(F.lit("rect")).alias("allowed_geometries"), F.array(F.lit(f"{m}-box")).alias("output_names"))
    edges = F.create_map(F.lit("c"), F.struct(F.lit("r").alias("role"), F.when(top % 7 == 0, "[").otherwise("^c").alias("output_name_regex")))
    nodes = F.when(top % 3 == 1, F.create_map(F.lit("m0"), node("m0"))).otherwise(F.create_map(F.lit("m0"), node("m0"), F.lit("m1"), node("m1")))
    grammar = F.when(top % 2 == 0, F.struct(F.lit("flow").alias("visual_type"), F.lit(True).alias("preserve_visual_type"), F.lit(False).alias("allow_representation_change"), F.lit("direct").alias("routing"), nodes.alias("node_roles"), edges.alias("edge_roles")))
    whole = F.struct(
        F.lit(1).alias("schema_version"), F.lit("faithful").alias("mode"), F.when(top % 5 == 0, "dense").otherwise("fast").alias("execution_profile"), F.struct(F.lit("a.png").alias("path")).alias("source"), F.struct(F.lit(100.0).alias("width"), F.lit(80.0).alias("height")).alias("canvas"),
        F.array(F.struct(F.lit("svg").alias("format"), F.lit("b.svg").alias("path"))).alias("targets"), module.alias("modules"), "source_inventory", F.array(F.struct(F.lit("c").alias("id"), F.lit("m0").alias("source"), number("m", top % 3).alias("target"))).alias("connections"), grammar.alias("diagram_grammar"),
    )
    return contracts.violations(d.select(F.col("path").cast("string").alias("path"), F.to_json(whole).alias("content"))).select(F.col("path").cast("long").alias("path"), "rule", "subject")


@query("SELECT coalesce(r.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'missing file' WHEN r.id IS NULL THEN 'extra file' ELSE 'changed file' END AS rule FROM (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents) r FULL JOIN (SELECT doc_id + 3 - doc_id % 7 % 2 * 3 AS id, min(sha256(coalesce(text, ''))) AS h FROM documents GROUP BY 1 HAVING count(*) = 1) f ON f.id = r.id WHERE r.id IS NULL OR f.id IS NULL OR r.h <> f.h")
def bound_files(spark, sf_dir):
    """Receipts of documents against files, some of which stand under other numbers: missing, extra and changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    moved = F.col("doc_id") + 3 - F.col("doc_id") % 7 % 2 * 3
    files = d.groupBy(moved.alias("id")).agg(F.min("sha256").alias("sha256"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return evidence.bound(d.withColumnRenamed("doc_id", "id"), files, ["id"])


@query("""
WITH p AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS lost, o_orderkey % 13 = 0 AS twice, o_orderkey % 5 = 0 AS other, o_orderkey % 7 = 0 AS off, o_orderkey % 6 = 0 AS turned FROM orders), r AS (SELECT *, NOT lost AND NOT twice AS one FROM p)
SELECT 'not one picture' AS rule, CAST(k AS VARCHAR) AS subject FROM r WHERE NOT one UNION ALL SELECT 'media differ', CAST(k AS VARCHAR) FROM r WHERE one AND other UNION ALL SELECT 'moved', CAST(k AS VARCHAR) FROM r WHERE one AND off
UNION ALL SELECT 'turned', CAST(k AS VARCHAR) FROM r WHERE one AND turned UNION ALL SELECT 'anchor moved', CAST(k AS VARCHAR) || '/a' FROM r WHERE one AND (off OR turned) UNION ALL SELECT 'picture without a plan', '1/x' || CAST(k AS VARCHAR) FROM r WHERE k % 17 = 0""")
def picture_readback(spark, sf_dir):
    """A planned picture of each order against a package's: lost, doubled, of other bytes, moved, turned, or not planned."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    inch, none = float(evidence.INCH), F.array(*[F.lit(0.0)] * 4)
    plan = o.select(k.cast("string").alias("instance_id"), F.lit("A").alias("asset_id"), F.lit(1).alias("slide"), k.cast("string").alias("output_name"), F.array(*map(F.lit, (1.0, 1.0, 1.0, 1.0))).alias("bbox_inches"), none.alias("crop"), F.lit(0.0).alias("rotation"), F.lit(0.01).alias("placement_tolerance_inches"), F.array(F.struct(F.lit("a").alias("id"), F.array(F.lit(0.0), F.lit(0.0)).alias("uv"), F.array(F.lit(1.0), F.lit(1.0)).alias("expected_inches"))).alias("anchors"))
    x = F.when(k % 7 == 0, 1.5).otherwise(1.0)
    upright = F.array(F.lit(inch), F.lit(0.0), F.lit(0.0), F.lit(inch), x * inch, F.lit(inch))
    quarter = F.array(F.lit(0.0), F.lit(inch), F.lit(-inch), F.lit(0.0), (x + 1) * inch, F.lit(inch))
    copies = F.when(k % 11 == 0, 0).when(k % 13 == 0, 2).otherwise(1)
    shown = o.select(F.lit(1).alias("slide"), k.cast("string").alias("name"), F.lit("pic").alias("kind"), F.when(k % 6 == 0, quarter).otherwise(upright).alias("matrix"), none.alias("crop"), F.when(k % 5 == 0, "b").otherwise("a").alias("target"), F.lit(None).cast("string").alias("unsupported"), F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).drop("copy")
    loose = o.filter("o_orderkey % 17 = 0").select(F.lit(1).alias("slide"), F.concat(F.lit("x"), k.cast("string")).alias("name"), F.lit("pic").alias("kind"), upright.alias("matrix"), none.alias("crop"), F.lit("a").alias("target"), F.lit(None).cast("string").alias("unsupported"))
    assets = spark.range(1).select(F.lit("A").alias("asset_id"), F.lit("right").alias("sha256"), F.lit("illustration").alias("content_class"))
    hashes = spark.range(2).select(F.when(F.col("id") == 0, "a").otherwise("b").alias("part"), F.when(F.col("id") == 0, "right").otherwise("wrong").alias("sha256"))
    return evidence.readback(plan, assets, shown.unionByName(loose), hashes, (10 * inch, 5 * inch))


@query(
    """WITH t AS (SELECT *, greatest(0, least(255, r + CASE WHEN (x + y) % 9 = 0 THEN 60 ELSE 0 END)) AS r1 FROM {p} WHERE y < 12 AND x < 16), m AS (SELECT image_id, y, x FROM t WHERE floor((abs(r - r1) * 19595 + 32768) / 65536.0) > 10),
w AS (SELECT image_id, y - i AS y, x - j AS x, count(*) AS n FROM m, generate_series(0, 2) a(i), generate_series(0, 2) b(j) WHERE y >= i AND x >= j GROUP BY image_id, y - i, x - j), g AS (SELECT image_id, max(n) AS worst FROM w GROUP BY image_id), c AS (SELECT image_id, count(*) AS n FROM m GROUP BY image_id)
SELECT i.image_id AS id, round(coalesce(c.n, 0) / 192.0, 9) AS mismatch_ratio, round(coalesce(worst, 0) / 9.0, 9) AS worst_window_ratio, coalesce(c.n, 0) / 192.0 <= 0.09 AND coalesce(worst, 0) / 9.0 <= 0.25 AS color_passed, CASE i.image_id % 4 WHEN 0 THEN 'NOT_DECLARED' WHEN 1 THEN 'PASS' WHEN 2 THEN 'FAIL' ELSE 'NOT_VERIFIED' END AS structure_status,
coalesce(c.n, 0) / 192.0 <= 0.09 AND coalesce(worst, 0) / 9.0 <= 0.25 AND i.image_id % 4 < 2 AS passed FROM (SELECT DISTINCT image_id FROM {p}) i LEFT JOIN c ON c.image_id = i.image_id LEFT JOIN g ON g.image_id = i.image_id""",
    p=PIXELS,
)
def regional_fidelity(spark, sf_dir):
    """A region of each image against one with lighter pixels: limits of the whole, of the worst window, and of a declared structure."""
    p = pixels(spark, sf_dir)
    lighter = F.when((F.col("x") + F.col("y")) % 9 == 0, F.least(F.lit(255), F.col("r") + 60)).otherwise(F.col("r"))
    images_ = p.select("image_id").distinct()
    regions = images_.select(F.col("image_id").alias("id"), "image_id", *(F.lit(v).alias(n) for n, v in (("x", 0), ("y", 0), ("w", 16), ("h", 12), ("threshold", 10), ("window", 3), ("max_mismatch_ratio", 0.09), ("max_window_ratio", 0.25))))
    structure_ = images_.filter("image_id % 4 > 0").select(F.col("image_id").alias("id"), F.when(F.col("image_id") % 4 < 3, F.col("image_id") % 4 == 1).alias("passed"))
    d = fidelity.regional(p, p.withColumn("r", lighter.cast("int")), regions, structure_)
    return d.select("id", F.round("mismatch_ratio", 9).alias("mismatch_ratio"), F.round("worst_window_ratio", 9).alias("worst_window_ratio"), "color_passed", "structure_status", "passed")


@query("""
WITH q AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS clear, o_orderkey % 7 = 0 AS unsure, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'FAIL' ELSE 'PASS' END AS status, o_orderkey % 4 AS n FROM orders),
s AS (SELECT *, CASE WHEN n = 0 THEN CASE WHEN clear THEN 'actual, dark, light' ELSE '' END WHEN n = 1 THEN '' WHEN n = 2 THEN CASE WHEN clear THEN 'actual, dark, detail, light' ELSE 'detail' END ELSE CASE WHEN clear THEN 'actual, dark, delivered, light' ELSE 'delivered' END END AS short FROM q),
r AS (SELECT k, status, list_filter([CASE WHEN unsure THEN 'uncertain source' END, CASE WHEN status IS NULL THEN 'no review' END, CASE WHEN status IS NOT NULL AND short <> '' THEN 'no view: ' || short END, CASE WHEN status = 'FAIL' THEN 'rejected' END], lambda v: v IS NOT NULL) AS reasons FROM s)
SELECT k, CASE WHEN status = 'FAIL' THEN 'FAIL' WHEN len(reasons) > 0 THEN 'NOT_VERIFIED' ELSE 'PASS' END AS review, array_to_string(reasons, '; ') AS reasons FROM r""")
def review_states(spark, sf_dir):
    """What reviews of each order's appearance come to, with views that are missing or changed."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    key = [k.cast("string").alias("item"), F.lit("r").alias("requirement")]
    need = o.select(*key, F.when(k % 3 == 0, "transparency").otherwise("colour").alias("dimension"), F.when(k % 7 == 0, "uncertain").otherwise("certain").alias("certainty"))
    said = o.filter("o_orderkey % 5 <> 0").select(*key, F.when(k % 11 == 0, "FAIL").otherwise("PASS").alias("status"), F.lit("seen").alias("observation"))
    scales = F.when(k % 4 == 1, F.array(*map(F.lit, fidelity.SCALES))).otherwise(F.array(*map(F.lit, fidelity.NEEDED)))
    views = o.select(*key, F.explode(scales).alias("scale"), k.alias("k"))
    changed = ((F.col("k") % 4 == 2) & (F.col("scale") == "detail")) | ((F.col("k") % 4 == 3) & (F.col("scale") == "delivered"))
    path = F.concat_ws("/", "item", "scale")
    found = fidelity.reviews(need, said, views.select("item", "requirement", path.alias("path"), F.lit("a").alias("sha256"), "scale"), views.select(path.alias("path"), F.when(changed, "b").otherwise("a").alias("sha256")))[0]
    return found.select(F.col("item").cast("long").alias("k"), "review", F.array_join("reasons", "; ").alias("reasons"))


@query(
    """WITH m AS (SELECT image_id, upper(lpad(hex(CAST(round_even(median(r), 0) AS INT)), 2, '0') || lpad(hex(CAST(round_even(median(g), 0) AS INT)), 2, '0') || lpad(hex(CAST(round_even(median(b), 0) AS INT)), 2, '0')) AS c, min(a) AS a, count(*) AS n FROM {p} WHERE x < 3 AND y < 2 GROUP BY image_id)
SELECT i.image_id AS paint, CASE WHEN coalesce(n, 0) < 6 OR a < 255 THEN 'patch not whole or not opaque' WHEN i.image_id % 3 = 0 AND c <> '000000' THEN 'another colour' END AS rule, CASE WHEN coalesce(n, 0) < 6 OR a < 255 THEN '-' ELSE c END AS sampled FROM (SELECT DISTINCT image_id FROM {p}) i LEFT JOIN m ON m.image_id = i.image_id""",
    p=PIXELS,
)
def paint_samples(spark, sf_dir):
    """Solid paints against the median colour of a patch of their image; a third of them are declared black."""
    p = pixels(spark, sf_dir)
    images_ = p.select("image_id").distinct()
    patch = images_.select(F.col("image_id").alias("paint"), F.lit(0).alias("place"), "image_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(3).alias("w"), F.lit(2).alias("h"))
    own = images.patch_colours(p, patch.select(F.col("paint").alias("patch"), "image_id", "x", "y", "w", "h")).select(F.col("patch").alias("image_id"), F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in "rgb")).alias("c"))
    said = F.when(F.col("image_id") % 3 == 0, "000000").otherwise(F.coalesce("c", F.lit("000000")))
    paints = images_.join(own, "image_id", "left").select(F.col("image_id").alias("paint"), F.lit("solid").alias("kind"), F.array(F.struct(F.lit(0.0).alias("position"), said.alias("color"))).alias("stops"))
    return fidelity.sampled_paints(p, patch, paints)


@query("SELECT image_id, label, area, place FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY area DESC, label) AS place FROM (SELECT image_id, r % 50 AS label, count(*) AS area FROM {p} GROUP BY image_id, r % 50) t) u WHERE place <= 4", p=PIXELS)
def largest_labels(spark, sf_dir):
    """The four largest labels of each image."""
    s = masks.region_stats(pixels(spark, sf_dir).withColumn("label", F.col("r") % 50), 24, 32)
    return masks.largest(s, ["image_id"], 4).select("image_id", "label", "area", "place")


@query("SELECT p_partkey AS id, abs(round((300 - w * k) / 2, 9)) AS x, abs(round((200 - h * k) / 2, 9)) AS y, abs(round((300 - w * c) / 2, 9)) AS cx, 300.0::DOUBLE AS sw FROM (SELECT p_partkey, 10.0 + p_size AS w, 60.0 - p_size AS h, least(300 / (10.0 + p_size), 200 / (60.0 - p_size)) AS k, greatest(300 / (10.0 + p_size), 200 / (60.0 - p_size)) AS c FROM part) t")
def canvas_fits(spark, sf_dir):
    """How far images of each part's size lie from the edges of a canvas of 300 by 200: within it, over it, stretched to it."""
    w, h = 10.0 + F.col("p_size"), 60.0 - F.col("p_size")
    at = {m: N.fitted(m, w, h, F.lit(300.0), F.lit(200.0)) for m in ("contain", "crop", "stretch")}
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.abs(F.round(at[m][c], 9)).alias(n) for m, c, n in (("contain", "x", "x"), ("contain", "y", "y"), ("crop", "x", "cx"))), at["stretch"]["w"].alias("sw"))


@query(r"""
WITH w AS (SELECT min(p_partkey) AS ord, t AS text FROM (SELECT p_partkey, 'size' || CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END AS t FROM part) a GROUP BY t), s AS (SELECT DISTINCT 'a size' || CAST(s_suppkey % 50 AS VARCHAR) || CASE WHEN s_suppkey % 3 = 0 THEN 'x z' ELSE 'xz' END AS said FROM supplier)
SELECT text FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE regexp_matches(said, '(^|[^A-Za-z0-9_])' || text || '([^A-Za-z0-9_]|$)'))""")
def missing_texts(spark, sf_dir):
    """Declared texts that no object says as a word of its own."""
    p = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(p.alias("ord"), F.concat(F.lit("size"), F.col("p_size").cast("string"), F.when(p % 2 == 0, "x").otherwise("y")).alias("text"))
    k = F.col("s_suppkey")
    o = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a  size"), (k % 50).cast("string"), F.when(k % 3 == 0, "x z").otherwise("xz")).alias("text"))
    return editability.missing_required(t, o)


CORNERS = "SELECT o_custkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS patch, o_totalprice AS v FROM {orders}"


@query("WITH c AS (SELECT k, sum(CASE WHEN patch IN (1, 4) THEN v ELSE -v END) AS e FROM {c} WHERE patch <= 4 GROUP BY k HAVING count(*) = 4) SELECT k, CAST(p AS BIGINT) AS patch, round(abs(e) / 4, 4) AS fit_error, round(abs(e), 4) AS held_out_error FROM c, generate_series(1, 4) s(p)", c=CORNERS)
def held_out_patches(spark, sf_dir):
    """Four orders of each customer as the corners of a square: a plane through all misses each by a quarter of what the plane through the other three does."""
    c = derived(spark, sf_dir, CORNERS).filter("patch <= 4")
    whole = c.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n = 4").select("k")
    side = lambda *at: F.when(F.col("patch").isin(*at), -1.0).otherwise(1.0)
    samples = c.join(whole, "k", "left_semi").select("k", "patch", side(1, 3).alias("x"), side(1, 2).alias("y"), "v")
    d = fits.held_out(samples, fits.affine_fits(samples, ["k"]), ["k"])
    return d.select("k", "patch", F.round("fit_error", 4).alias("fit_error"), F.round("held_out_error", 4).alias("held_out_error"))
