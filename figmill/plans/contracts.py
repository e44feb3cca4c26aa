"""Contracts of whole manifests: JSON documents as tables of their sections, and rules over all manifests at once.

Every section is a table keyed by `path`.  A rule about one entry is a condition on its row; ids that must be
known, or known once, are anti-joins and counts by path; nothing is looped over in Python.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from figmill.functions import text as T
from figmill.functions.numeric import finite
from figmill.operators import graph
from figmill.plans.manifest import REPRESENTATIONS, ROLES, box_issue, inside

# What a manifest may say.
PROFILES, POLICIES = ("fast", "standard", "dense"), ("native", "hybrid")
FORMATS = ("pptx", "svg", "drawio", "excalidraw", "mermaid", "graphviz", "dot", "html")
ROUTINGS = ("orthogonal", "direct", "curved", "mixed", "source_defined")
TYPE_BASES = ("source_observed", "source_estimated", "user_specified", "redesign_system")
CURVE_BASES = ("source_vector", "raw_data", "source_observed", "source_estimated", "user_specified")
CURVE_KINDS = ("line_curve", "filled_ridge", "density_outline", "step_curve", "signal_trace")
WANTED = ("must_connect", "must_contain", "must_preserve_text", "same_style_token", "custom")
BARRED = ("must_not_connect", "must_not_overlap", "single_stroke_owner", "custom")
SOURCES, CONTENTS = ("local", "licensed", "source_crop", "generated"), ("illustration", "evidence")
PROTECTED = ("text", "connector", "chart", "table")

_RULE = "array<struct<id:string,type:string,subjects:array<string>,rule:string,verification:string>>"
SCHEMA = f"""schema_version int, mode string, execution_profile string, editing_policy string, hybrid_authorization string,
source struct<path:string,width:double,height:double>, canvas struct<width:double,height:double>, targets array<struct<format:string,path:string>>,
modules array<struct<id:string,bbox:array<double>>>, connections array<struct<id:string,source:string,target:string>>, raster_exceptions array<struct<id:string,reason:string>>,
source_inventory array<struct<id:string,module:string,role:string,text:string,representation:string,bbox:array<double>,output_slide:int,required_count:int,output_name:string,raster_exception:string,component_instance:string,native_required:boolean>>,
icon_signatures array<struct<id:string,module:string,object_class:string,required_features:array<string>,source_crop:array<double>>>, semantic_constraints {_RULE}, negative_constraints {_RULE},
diagram_grammar struct<visual_type:string,preserve_visual_type:boolean,allow_representation_change:boolean,authorization:string,routing:string,node_roles:map<string,struct<role:string,allowed_geometries:array<string>,output_names:array<string>>>,edge_roles:map<string,struct<role:string,output_name_regex:string,endpoint_binding:struct<source_output_name:string,target_output_name:string,ordered_output_names:array<string>,tolerance:double>>>>,
typography_hierarchy struct<basis:string,measurement:string,baseline_role:string,default_tolerance:double,default_max_intra_role_spread:double,roles:map<string,struct<target_ratio:double,output_name_regex:string,tolerance:double,max_intra_role_spread:double,required:boolean>>>,
curve_fidelity struct<basis:string,measurement:string,default_max_x_aligned_mae:double,default_peak_x_tolerance:double,default_peak_prominence:double,default_min_peak_distance:double,series:array<struct<id:string,source_inventory_id:string,kind:string,source_trace:string,output_name_regex:string,output_path_index:int,expected_output_count:int,expected_peak_count:int,expected_peak_positions:array<double>>>>,
component_assets array<struct<asset_id:string,path:string,origin:string,authorization:string,editing_unit:string,sha256:string,source_kind:string,extent:string,content_class:string,contains_native_required:boolean,requires_alpha:boolean,min_visible_pixels:double,min_dpi:double,invariants:array<string>,license:string,attribution:string,source_sha256:string,source_bbox:array<double>,comparison:string>>,
component_instances array<struct<instance_id:string,asset_id:string,output_name:string,slide:int,bbox_inches:array<double>,crop:array<double>,rotation:double,placement_tolerance_inches:double,anchors:array<struct<id:string,uv:array<double>,expected_inches:array<double>>>>>"""


@F.pandas_udf(BooleanType())
def compiles(pattern: pd.Series) -> pd.Series:
    """Whether a text is a regular expression; the JVM's own functions fail on one that isn't."""

    def one(p):
        try:
            return p is not None and bool(re.compile(p))
        except re.error:
            return False

    return pattern.map(one)


def read(docs: DataFrame) -> DataFrame:
    """Manifests (path, content as JSON) with their sections as columns, and whether they are JSON objects (`object_`); what has another type than it should is null, and so are all sections of what isn't an object."""
    object_ = F.coalesce(F.col("content").rlike(r"^\s*\{") & F.try_parse_json("content").isNotNull(), F.lit(False))
    return docs.select(F.col("path").cast("string").alias("path"), object_.alias("object_"), F.from_json("content", SCHEMA).alias("m")).select("path", "object_", "m.*")


def _blank(c: Column) -> Column:
    return F.coalesce(T.stripped(c) == "", F.lit(True))


def _none_of(c: Column, values) -> Column:
    return ~F.coalesce(c.isin(*values), F.lit(False))


def _texts(c: Column) -> Column:
    """Whether a list has texts, none of them blank."""
    return F.coalesce((F.size(c) > 0) & ~F.exists(c, _blank), F.lit(False))


def _share(c: Column) -> Column:
    return F.coalesce(finite(c) & c.between(0, 0.5), F.lit(False))


def _off(c: Column, test: Column) -> Column:
    """Whether an optional value is there and fails a test."""
    return c.isNotNull() & ~F.coalesce(test, F.lit(False))


def _each(rows: DataFrame, subject: Column, rules: dict[str, Column]) -> DataFrame:
    """(path, rule, subject): the rules whose conditions hold, row by row, in one pass."""
    found = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))
    return rows.select("path", F.explode(found).alias("rule"), subject.cast("string").alias("subject"))


def _unknown(rows: DataFrame, column: str, known: DataFrame, rule: str) -> DataFrame:
    """Rows (path, ...) whose value isn't among the known ones (path, id) of their manifest; a null is unknown."""
    lost = rows.select("path", F.col(column).alias("id")).join(graph.dealt(known.select("path", "id")), ["path", "id"], "left_anti")
    return lost.select("path", F.lit(rule).alias("rule"), F.coalesce("id", F.lit("")).alias("subject"))


def _repeated(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    g = rows.dropna(subset=keys).groupBy("path", *keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return g.select("path", F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("subject"))


def _section(m: DataFrame, name: str, *more: Column) -> DataFrame:
    """The entries of a section with their place, and more columns of their manifest; an entry's own path is `file`."""
    d = m.select("path", *more, F.posexplode(name).alias("at", "e")).filter("e IS NOT NULL")
    own = d.select("e.*").columns
    return d.select(*d.columns[:-1], *(F.col(f"e.{c}").alias("file" if c == "path" else c) for c in own))


def _roles(m: DataFrame, column: str) -> DataFrame:
    return m.select("path", F.explode(column).alias("id", "e")).select("path", "id", "e.*")


def layout(m: DataFrame) -> list[DataFrame]:
    """Rules of the head, targets, modules, inventory, icons and connections."""
    canvas = F.col("canvas.width").alias("cw"), F.col("canvas.height").alias("ch")
    out_of = lambda box: F.coalesce((F.col("cw") > 0) & (F.col("ch") > 0) & box_issue(F.col(box)).isNull() & ~inside(F.col(box), F.col("cw"), F.col("ch")), F.lit(False))
    size = lambda c: F.coalesce(finite(F.col(c)) & (F.col(c) > 0), F.lit(False))
    module, item, icon, link, target, raster = (_section(m, s, *canvas) for s in ("modules", "source_inventory", "icon_signatures", "connections", "targets", "raster_exceptions"))
    dense, some = F.col("execution_profile") == "dense", lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    head = _each(m, F.lit(""), {
        "schema version": F.coalesce(F.col("schema_version") != 1, F.lit(True)), "unknown profile": _off(F.col("execution_profile"), F.col("execution_profile").isin(*PROFILES)), "no source": _blank(F.col("source.path")), "source size": _off(F.col("source.width"), size("source.width")) | _off(F.col("source.height"), size("source.height")),
        "canvas size": ~(size("canvas.width") & size("canvas.height")), "no targets": ~some("targets"), "no modules": ~some("modules"), "dense without inventory": F.coalesce(dense, F.lit(False)) & ~some("source_inventory"),
    })
    covered = _section(m.filter(dense), "modules").select("path", "id").join(graph.dealt(item.select("path", F.col("module").alias("id"))), ["path", "id"], "left_anti")
    crops = item.filter(F.col("representation").isin("source_crop", "evidence_raster"))
    known = module.select("path", "id")
    return [
        head, _each(target, F.col("at"), {"unknown format": _none_of(F.lower("format"), FORMATS), "target without path": _blank(F.col("file"))}), _repeated(target, ["file"], "target repeated"),
        _each(module, F.col("at"), {"module without id": _blank(F.col("id")), "module box": box_issue(F.col("bbox")).isNotNull(), "module beyond the canvas": out_of("bbox")}), _repeated(module, ["id"], "module repeated"),
        _each(item, F.col("at"), {
            "item without id": _blank(F.col("id")), "unknown role": _none_of(F.col("role"), ROLES), "unknown representation": _none_of(F.col("representation"), REPRESENTATIONS), "count or slide": _off(F.col("output_slide"), F.col("output_slide") >= 1) | _off(F.col("required_count"), F.col("required_count") >= 1),
            "text missing": (F.col("role") == "text") & _blank(F.col("text")), "item box": F.col("bbox").isNotNull() & box_issue(F.col("bbox")).isNotNull(), "item beyond the canvas": F.col("bbox").isNotNull() & out_of("bbox"),
        }), _repeated(item.select("path", "id").unionByName(known), ["id"], "id repeated"), _unknown(item, "module", known, "item in unknown module"),
        covered.select("path", F.lit("module without items").alias("rule"), F.col("id").alias("subject")), _unknown(crops, "raster_exception", raster, "unknown raster exception"),
        _each(raster, F.col("at"), {"exception without id": _blank(F.col("id")), "exception without reason": _blank(F.col("reason"))}), _repeated(raster, ["id"], "exception repeated"),
        _each(icon, F.col("at"), {"icon without id": _blank(F.col("id")), "icon without class": _blank(F.col("object_class")), "icon without features": ~_texts(F.col("required_features")), "icon crop": F.col("source_crop").isNotNull() & (box_issue(F.col("source_crop")).isNotNull() | out_of("source_crop"))}), _repeated(icon, ["id"], "icon repeated"), _unknown(icon, "module", known, "icon in unknown module"),
        _each(link, F.col("at"), {"connection without id": _blank(F.col("id"))}), _repeated(link, ["id"], "connection repeated"), _unknown(link, "source", known, "connection from unknown module"), _unknown(link, "target", known, "connection to unknown module"),
    ]


def constraints(m: DataFrame) -> list[DataFrame]:
    """Rules of semantic and negative constraints: each of a type of its own list, about known ids."""
    ids = reduce(DataFrame.unionByName, [_section(m, s).select("path", "id") for s in ("modules", "source_inventory", "icon_signatures", "connections")])
    every = reduce(DataFrame.unionByName, [_section(m, s).withColumn("allowed", F.array(*map(F.lit, types))) for s, types in (("semantic_constraints", WANTED), ("negative_constraints", BARRED))])
    subject = every.select("path", F.explode("subjects").alias("subject"))
    own = _each(every, F.col("id"), {
        "constraint without id": _blank(F.col("id")), "unknown constraint": _none_of(F.col("type"), sorted({*WANTED, *BARRED})), "constraint in the wrong list": F.col("type").isin(*WANTED, *BARRED) & ~F.array_contains("allowed", F.col("type")),
        "constraint without subjects": ~_texts(F.col("subjects")), "constraint without rule": _blank(F.col("rule")), "constraint without verification": _blank(F.col("verification")),
    })
    return [own, _repeated(every, ["id"], "constraint repeated"), _unknown(subject.filter(~_blank(F.col("subject"))), "subject", ids, "constraint about an unknown id")]


def grammar(m: DataFrame) -> list[DataFrame]:
    """Rules of the diagram grammar: what it says of itself, and that its roles cover connections and their ends, both ways."""
    link, item = _section(m, "connections"), _section(m, "source_inventory")
    bound_link = _section(m.filter("diagram_grammar IS NOT NULL"), "connections")
    lined = m.select("path", F.coalesce(F.size("connections") > 0, F.lit(False)).alias("linked"), F.coalesce(F.exists("source_inventory", lambda i: i["role"] == "connector"), F.lit(False)).alias("drawn"), "execution_profile", F.col("diagram_grammar").alias("g"))
    structured = F.col("linked") | F.col("drawn")
    has = lined.filter("g IS NOT NULL")
    node, edge = graph.cut(_roles(m, "diagram_grammar.node_roles")), graph.cut(_roles(m, "diagram_grammar.edge_roles"))
    known = _section(m, "modules").select("path", "id").unionByName(item.select("path", "id"))
    ends = bound_link.select("path", F.explode(F.array("source", "target")).alias("id")).distinct().join(graph.dealt(_section(m, "modules").select("path", "id")), ["path", "id"], "left_semi")
    change = F.coalesce("g.allow_representation_change", F.lit(False))
    names = node.select("path", F.explode("output_names").alias("name"))
    ordered = F.col("endpoint_binding.ordered_output_names")
    bound = F.col("endpoint_binding")
    return [
        _each(lined, F.lit(""), {"no grammar": structured & F.col("execution_profile").isin("standard", "dense") & F.col("g").isNull()}),
        _each(has, F.lit(""), {
            "no visual type": _blank(F.col("g.visual_type")), "preservation not stated": F.col("g.preserve_visual_type").isNull() | F.col("g.allow_representation_change").isNull(), "change without authorization": change & _blank(F.col("g.authorization")),
            "change not allowed": ~change & F.coalesce(~F.col("g.preserve_visual_type"), F.lit(False)), "unknown routing": _none_of(F.col("g.routing"), ROUTINGS), "no node roles": F.col("g.node_roles").isNull() | (structured & (F.size("g.node_roles") == 0)), "no edge roles": F.col("g.edge_roles").isNull(),
        }),
        _each(node, F.col("id"), {"node without role": _blank(F.col("role")), "node without geometries": ~_texts(F.col("allowed_geometries")), "node without outputs": ~_texts(F.col("output_names"))}),
        _unknown(node, "id", known, "role of an unknown node"), _repeated(names, ["name"], "output of several nodes"), _unknown(ends, "id", node, "connected module without role"),
        _unknown(edge, "id", link, "role of an unknown connection"), _unknown(bound_link.filter(~_blank(F.col("id"))), "id", edge, "connection without role"),
        _each(edge, F.col("id"), {
            "edge without role": _blank(F.col("role")), "edge without pattern": _blank(F.col("output_name_regex")), "edge pattern": ~_blank(F.col("output_name_regex")) & ~compiles(F.col("output_name_regex")), "binding without ends": bound.isNotNull() & (_blank(bound["source_output_name"]) | _blank(bound["target_output_name"])),
            "binding order": ordered.isNotNull() & ~(_texts(ordered) & (F.size(F.array_distinct(ordered)) == F.size(ordered))), "binding tolerance": _off(bound["tolerance"], finite(bound["tolerance"]) & (bound["tolerance"] >= 0)),
        }),
    ]


def typography(m: DataFrame) -> list[DataFrame]:
    """Rules of the typography hierarchy, whose baseline role has the ratio 1."""
    t = m.filter("typography_hierarchy IS NOT NULL").select("path", "mode", F.col("typography_hierarchy").alias("t"))
    role = graph.cut(_roles(m, "typography_hierarchy.roles"))
    base = t.select("path", F.col("t.baseline_role").alias("id"))
    ratio = base.join(graph.dealt(role.select("path", "id", "target_ratio")), ["path", "id"]).filter(~F.coalesce(F.abs(F.col("target_ratio") - 1) <= 1e-9, F.lit(False)))
    return [
        _each(t, F.lit(""), {
            "typography basis": _none_of(F.col("t.basis"), TYPE_BASES), "redesign basis without redesign": (F.col("t.basis") == "redesign_system") & F.coalesce(F.col("mode") != "redesign", F.lit(True)), "typography measurement": _none_of(F.col("t.measurement"), ["resolved_font_size"]),
            "typography tolerance": ~(_share(F.col("t.default_tolerance")) & _share(F.col("t.default_max_intra_role_spread"))), "no typography roles": F.coalesce(F.size("t.roles") < 1, F.lit(True)),
        }),
        _each(role, F.col("id"), {"role without name": _blank(F.col("id")), "role ratio": ~F.coalesce(finite(F.col("target_ratio")) & (F.col("target_ratio") > 0), F.lit(False)), "role without pattern": _blank(F.col("output_name_regex")), "role pattern": ~_blank(F.col("output_name_regex")) & ~compiles(F.col("output_name_regex")), "role tolerance": _off(F.col("tolerance"), _share(F.col("tolerance"))) | _off(F.col("max_intra_role_spread"), _share(F.col("max_intra_role_spread")))}),
        _unknown(base, "id", role, "unknown baseline role"), ratio.select("path", F.lit("baseline ratio is not 1").alias("rule"), F.col("id").alias("subject")),
    ]


def curves(m: DataFrame) -> list[DataFrame]:
    """Rules of the curve contract: series of known items, each with a trace and a pattern of its own."""
    c = m.filter("curve_fidelity IS NOT NULL").select("path", F.col("curve_fidelity").alias("c"))
    series = graph.cut(_section(m, "curve_fidelity.series"))
    peaks, positions = F.col("expected_peak_count"), F.col("expected_peak_positions")
    ordered = ~F.exists(positions, lambda v: ~F.coalesce(finite(v) & v.between(0, 1), F.lit(False))) & (positions == F.array_sort(F.array_distinct(positions)))
    defaults = reduce(lambda a, b: a & b, [_share(F.col(f"c.{k}")) for k in ("default_max_x_aligned_mae", "default_peak_x_tolerance", "default_peak_prominence", "default_min_peak_distance")])
    return [
        _each(c, F.lit(""), {"curve basis": _none_of(F.col("c.basis"), CURVE_BASES), "curve measurement": _none_of(F.col("c.measurement"), ["x_aligned_profile"]), "curve tolerance": ~defaults, "no series": F.coalesce(F.size("c.series") < 1, F.lit(True))}),
        _each(series, F.col("id"), {
            "series without id": _blank(F.col("id")), "unknown kind": _none_of(F.col("kind"), CURVE_KINDS), "series without trace": _blank(F.col("source_trace")), "trace outside the task": F.coalesce(F.col("source_trace").rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)"), F.lit(False)),
            "series without pattern": _blank(F.col("output_name_regex")), "series pattern": ~_blank(F.col("output_name_regex")) & ~compiles(F.col("output_name_regex")), "series counts": _off(F.col("expected_output_count"), F.col("expected_output_count") >= 1) | _off(peaks, peaks >= 0) | _off(F.col("output_path_index"), F.col("output_path_index") >= 0),
            "peak positions": _off(positions, ordered), "peaks and positions differ": F.coalesce(peaks != F.size(positions), F.lit(False)) & positions.isNotNull(),
        }),
        _repeated(series, ["id"], "series repeated"), _repeated(series, ["source_trace"], "trace of several series"), _unknown(series, "source_inventory_id", _section(m, "source_inventory"), "series of an unknown item"),
    ]


def assets(m: DataFrame) -> list[DataFrame]:
    """Rules of component assets and their instances: one instance for each raster item, no asset without one, native roles never rasterized."""
    asset, one, item = (graph.cut(_section(m, s)) for s in ("component_assets", "component_instances", "source_inventory"))
    raster = item.filter("representation = 'component_raster'")
    used = m.withColumn("raster", F.exists(F.coalesce("source_inventory", F.array().cast(m.schema["source_inventory"].dataType)), lambda i: F.coalesce(i["representation"] == "component_raster", F.lit(False))))
    hybrid = F.coalesce(F.col("editing_policy") == "hybrid", F.lit(False))
    applies = hybrid | F.col("raster") | F.col("component_assets").isNotNull() | F.col("component_instances").isNotNull()
    bound = used.filter(applies)
    whole = lambda c, n: F.coalesce((F.size(c) == n) & ~F.exists(c, lambda v: ~F.coalesce(finite(v), F.lit(False))), F.lit(False))
    get = lambda c, k: F.get(F.col(c), F.lit(k))
    placed = F.coalesce(whole("bbox_inches", 4) & (F.least(get("bbox_inches", 0), get("bbox_inches", 1)) >= 0) & (F.least(get("bbox_inches", 2), get("bbox_inches", 3)) > 0), F.lit(False))
    cropped = F.coalesce(whole("crop", 4) & ~F.exists("crop", lambda v: (v < 0) | (v >= 1)) & (get("crop", 0) + get("crop", 2) < 1) & (get("crop", 1) + get("crop", 3) < 1), F.lit(False))
    anchors = F.col("anchors")
    anchored = ~F.exists(anchors, lambda a: _blank(a["id"]) | ~(whole(a["uv"], 2) & ~F.exists(a["uv"], lambda v: (v < 0) | (v > 1)) & whole(a["expected_inches"], 2))) & (F.size(F.array_distinct(F.transform(anchors, lambda a: a["id"]))) == F.size(anchors))
    kind = F.col("source_kind")
    mine = _section(bound, "source_inventory")
    native = F.col("representation").isin("native_primitive", "native_composite")
    is_raster = F.coalesce(F.col("representation") == "component_raster", F.lit(False))
    instance = one.select("path", F.col("instance_id").alias("id"))
    return [
        _each(used, F.lit(""), {"unknown policy": _off(F.col("editing_policy"), F.col("editing_policy").isin(*POLICIES)), "assets without authorized hybrid policy": applies & ~(hybrid & ~_blank(F.col("hybrid_authorization"))), "hybrid in the fast profile": applies & F.coalesce(F.col("execution_profile") == "fast", F.lit(False)), "hybrid without assets": applies & (F.coalesce(F.size("component_assets") < 1, F.lit(True)) | F.coalesce(F.size("component_instances") < 1, F.lit(True))), "two records of rasters": applies & F.coalesce(F.size("raster_exceptions") > 0, F.lit(False))}),
        _each(asset, F.col("asset_id"), {
            "asset without id": _blank(F.col("asset_id")), "asset origin": reduce(lambda a, b: a | b, [_blank(F.col(c)) for c in ("file", "origin", "authorization", "editing_unit")]), "asset hash": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "asset source": _none_of(kind, SOURCES),
            "asset extent": F.coalesce(F.col("extent") != "object", F.lit(True)), "asset content": _none_of(F.col("content_class"), CONTENTS), "asset with native content": F.coalesce("contains_native_required", F.lit(True)), "asset alpha": F.col("requires_alpha").isNull(), "asset pixels": ~F.coalesce(finite(F.col("min_visible_pixels")) & (F.col("min_visible_pixels") >= 1), F.lit(False)), "asset resolution": ~F.coalesce(finite(F.col("min_dpi")) & (F.col("min_dpi") > 0), F.lit(False)), "asset invariants": ~_texts(F.col("invariants")),
            "asset license": (kind == "licensed") & (_blank(F.col("license")) | _blank(F.col("attribution"))), "asset crop": (kind == "source_crop") & (~F.coalesce(F.col("source_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)) | box_issue(F.col("source_bbox")).isNotNull()), "asset comparison": F.coalesce(F.col("comparison") != F.when(kind == "generated", "approved_surrogate").otherwise("source_exact"), F.lit(True)),
        }), _repeated(asset, ["asset_id"], "asset repeated"),
        _each(one, F.col("instance_id"), {"instance without id": _blank(F.col("instance_id")), "instance output": _blank(F.col("output_name")) | F.coalesce(F.col("slide") < 1, F.lit(True)), "instance box": ~placed, "instance crop": ~cropped, "instance rotation": ~F.coalesce(finite(F.col("rotation")), F.lit(False)), "instance tolerance": ~F.coalesce(finite(F.col("placement_tolerance_inches")) & F.col("placement_tolerance_inches").between(0, 0.05), F.lit(False)), "instance anchors": ~F.coalesce(anchored, F.lit(False))}),
        _repeated(one, ["instance_id"], "instance repeated"), _repeated(one.withColumn("slide", F.col("slide").cast("string")), ["slide", "output_name"], "output of several instances"), _unknown(one, "asset_id", asset.select("path", F.col("asset_id").alias("id")), "instance of an unknown asset"),
        _each(mine, F.col("id"), {"native role rasterized": is_raster & (F.coalesce(F.col("role").isin(*PROTECTED), F.lit(False)) | F.coalesce("native_required", F.lit(False))), "native item with an instance": ~is_raster & F.col("component_instance").isNotNull(), "picture outside the assets": ~is_raster & ~F.coalesce(native, F.lit(False)), "native item without output": ~is_raster & _blank(F.col("output_name"))}),
        _unknown(raster, "component_instance", instance, "item of an unknown instance"), _repeated(raster, ["component_instance"], "instance of several items"), _unknown(one, "instance_id", raster.select("path", F.col("component_instance").alias("id")), "instance without item"), _unknown(asset, "asset_id", one.select("path", F.col("asset_id").alias("id")), "asset without instance"),
    ]


def violations(docs: DataFrame) -> DataFrame:
    """(path, rule, subject) of manifests (path, content): one row for each entry that breaks a rule; what isn't a JSON object has the rule `not a manifest`."""
    m = graph.cut(read(docs))
    broken = m.filter("NOT object_").select("path", F.lit("not a manifest").alias("rule"), F.lit("").alias("subject"))
    m = m.drop("object_").join(graph.dealt(broken.select("path")), "path", "left_anti") if not broken.isEmpty() else m.drop("object_")
    return reduce(DataFrame.unionByName, [*layout(m), *constraints(m), *grammar(m), *typography(m), *curves(m), *assets(m)], broken)
