"""Manifest contracts: a whole manifest passes, and each fault gives its rule."""

import copy
import json

import pytest

from figmill.plans import contracts

HASH = "0" * 64


def manifest():
    return {
        "schema_version": 1, "mode": "faithful", "execution_profile": "dense", "source": {"path": "a.png", "width": 100, "height": 80}, "canvas": {"width": 100, "height": 80}, "targets": [{"format": "svg", "path": "b.svg"}],
        "modules": [{"id": "m", "bbox": [0, 0, 40, 40]}, {"id": "n", "bbox": [50, 0, 40, 40]}],
        "source_inventory": [{"id": "t", "module": "m", "role": "text", "text": "x", "representation": "native_primitive", "bbox": [1, 1, 5, 5], "output_name": "T"}, {"id": "p", "module": "n", "role": "icon", "representation": "component_raster", "component_instance": "i"}],
        "connections": [{"id": "c", "source": "m", "target": "n"}], "icon_signatures": [{"id": "s", "module": "m", "object_class": "cell", "required_features": ["round"]}],
        "semantic_constraints": [{"id": "k", "type": "must_connect", "subjects": ["m", "c"], "rule": "r", "verification": "v"}], "negative_constraints": [],
        "diagram_grammar": {"visual_type": "flow", "preserve_visual_type": True, "allow_representation_change": False, "routing": "direct", "node_roles": {k: {"role": "r", "allowed_geometries": ["rect"], "output_names": [f"{k}-box"]} for k in "mn"}, "edge_roles": {"c": {"role": "r", "output_name_regex": "^c-"}}},
        "typography_hierarchy": {"basis": "source_observed", "measurement": "resolved_font_size", "baseline_role": "b", "default_tolerance": 0.1, "default_max_intra_role_spread": 0.1, "roles": {"b": {"target_ratio": 1.0, "output_name_regex": "^b"}}},
        "curve_fidelity": {"basis": "raw_data", "measurement": "x_aligned_profile", "default_max_x_aligned_mae": 0.1, "default_peak_x_tolerance": 0.1, "default_peak_prominence": 0.1, "default_min_peak_distance": 0.1, "series": [{"id": "q", "source_inventory_id": "t", "kind": "line_curve", "source_trace": "t/q.json", "output_name_regex": "^q$", "expected_peak_count": 2, "expected_peak_positions": [0.2, 0.6]}]},
        "editing_policy": "hybrid", "hybrid_authorization": "said so",
        "component_assets": [{"asset_id": "a", "path": "a.png", "origin": "o", "authorization": "y", "editing_unit": "u", "sha256": HASH, "source_kind": "local", "extent": "object", "content_class": "illustration", "contains_native_required": False, "requires_alpha": True, "min_visible_pixels": 9, "min_dpi": 90, "invariants": ["v"], "comparison": "source_exact"}],
        "component_instances": [{"instance_id": "i", "asset_id": "a", "output_name": "P", "slide": 1, "bbox_inches": [0, 0, 1, 1], "crop": [0, 0, 0, 0], "rotation": 0, "placement_tolerance_inches": 0.01, "anchors": [{"id": "z", "uv": [0.5, 0.5], "expected_inches": [1, 1]}]}],
    }


# Each fault: a path into the manifest, the value put there (ABSENT takes it away), and the rules that follow.
ABSENT = object()
FAULTS = [
    ("schema_version", 2, {"schema version"}), ("execution_profile", "quick", {"unknown profile"}), ("source.path", " ", {"no source"}), ("source.width", -1, {"source size"}), ("canvas.height", 0, {"canvas size"}), ("targets", [], {"no targets"}), ("targets.0.format", "bmp", {"unknown format"}), ("targets.0.path", "", {"target without path"}),
    ("modules.0.bbox", [0, 0, 0, 1], {"module box"}), ("modules.0.bbox", [70, 0, 40, 40], {"module beyond the canvas"}), ("modules.1.id", "m", {"module repeated", "id repeated", "item in unknown module", "module without items", "connection to unknown module", "role of an unknown node"} - {"module without items"}),
    ("source_inventory.0.id", "p", {"id repeated", "series of an unknown item"}), ("source_inventory.0.module", "z", {"item in unknown module", "module without items"}), ("source_inventory.0.role", "oval", {"unknown role"}), ("source_inventory.0.representation", "sketch", {"unknown representation", "picture outside the assets"}),
    ("source_inventory.0.output_slide", 0, {"count or slide"}), ("source_inventory.0.text", " ", {"text missing"}), ("source_inventory.0.bbox", [90, 0, 20, 5], {"item beyond the canvas"}), ("source_inventory.0.bbox", [1], {"item box"}), ("source_inventory.0.representation", "source_crop", {"unknown raster exception", "picture outside the assets"}),
    ("icon_signatures.0.required_features", [], {"icon without features"}), ("icon_signatures.0.module", "z", {"icon in unknown module"}), ("icon_signatures.0.source_crop", [99, 0, 9, 9], {"icon crop"}), ("connections.0.target", "z", {"connection to unknown module"}), ("connections.0.id", "d", {"constraint about an unknown id", "role of an unknown connection", "connection without role"}),
    ("semantic_constraints.0.subjects", ["m", "missing"], {"constraint about an unknown id"}), ("semantic_constraints.0.type", "must_not_connect", {"constraint in the wrong list"}), ("semantic_constraints.0.type", "must", {"unknown constraint"}), ("semantic_constraints.0.verification", ABSENT, {"constraint without verification"}), ("semantic_constraints.0.subjects", [], {"constraint without subjects"}),
    ("negative_constraints", [{"id": "k", "type": "custom", "subjects": ["m"], "rule": "r", "verification": "v"}], {"constraint repeated"}), ("raster_exceptions", [{"id": "x"}], {"exception without reason", "two records of rasters"}),
    ("diagram_grammar", ABSENT, {"no grammar"}), ("diagram_grammar.node_roles.n", ABSENT, {"connected module without role"}), ("diagram_grammar.edge_roles", {}, {"connection without role"}), ("diagram_grammar.allow_representation_change", True, {"change without authorization"}), ("diagram_grammar.preserve_visual_type", False, {"change not allowed"}),
    ("diagram_grammar.preserve_visual_type", ABSENT, {"preservation not stated"}), ("diagram_grammar.routing", "bent", {"unknown routing"}), ("diagram_grammar.edge_roles.c.output_name_regex", "[", {"edge pattern"}), ("diagram_grammar.node_roles.n.output_names", ["m-box"], {"output of several nodes"}), ("diagram_grammar.node_roles.m.allowed_geometries", [], {"node without geometries"}),
    ("diagram_grammar.edge_roles.c.endpoint_binding", {"source_output_name": "a"}, {"binding without ends"}), ("diagram_grammar.edge_roles.c.endpoint_binding", {"source_output_name": "a", "target_output_name": "b", "ordered_output_names": ["c", "c"], "tolerance": -1}, {"binding order", "binding tolerance"}),
    ("typography_hierarchy.basis", "redesign_system", {"redesign basis without redesign"}), ("typography_hierarchy.measurement", "eye", {"typography measurement"}), ("typography_hierarchy.default_tolerance", 0.6, {"typography tolerance"}), ("typography_hierarchy.roles", {}, {"no typography roles", "unknown baseline role"}), ("typography_hierarchy.roles.b.target_ratio", 1.2, {"baseline ratio is not 1"}),
    ("typography_hierarchy.roles.b.target_ratio", -1, {"role ratio", "baseline ratio is not 1"}), ("typography_hierarchy.roles.b.output_name_regex", "(", {"role pattern"}), ("typography_hierarchy.roles.b.tolerance", 0.9, {"role tolerance"}), ("typography_hierarchy.baseline_role", "z", {"unknown baseline role"}),
    ("curve_fidelity.basis", "guess", {"curve basis"}), ("curve_fidelity.default_peak_prominence", ABSENT, {"curve tolerance"}), ("curve_fidelity.series", [], {"no series"}), ("curve_fidelity.series.0.source_inventory_id", "z", {"series of an unknown item"}), ("curve_fidelity.series.0.kind", "spiral", {"unknown kind"}), ("curve_fidelity.series.0.source_trace", "../q.json", {"trace outside the task"}),
    ("curve_fidelity.series.0.output_name_regex", "*", {"series pattern"}), ("curve_fidelity.series.0.expected_peak_positions", [0.5], {"peaks and positions differ"}), ("curve_fidelity.series.0.expected_peak_positions", [0.6, 0.2], {"peak positions"}), ("curve_fidelity.series.0.expected_output_count", 0, {"series counts"}),
    ("editing_policy", "native", {"assets without authorized hybrid policy"}), ("editing_policy", "mixed", {"unknown policy", "assets without authorized hybrid policy"}), ("hybrid_authorization", "", {"assets without authorized hybrid policy"}), ("component_instances", ABSENT, {"hybrid without assets", "item of an unknown instance", "asset without instance"}),
    ("component_assets.0.sha256", "0", {"asset hash"}), ("component_assets.0.path", "", {"asset origin"}), ("component_assets.0.source_kind", "found", {"asset source"}), ("component_assets.0.source_kind", "licensed", {"asset license"}), ("component_assets.0.source_kind", "source_crop", {"asset crop"}), ("component_assets.0.source_kind", "generated", {"asset comparison"}), ("component_assets.0.extent", "panel", {"asset extent"}),
    ("component_assets.0.contains_native_required", True, {"asset with native content"}), ("component_assets.0.requires_alpha", ABSENT, {"asset alpha"}), ("component_assets.0.min_dpi", 0, {"asset resolution"}), ("component_assets.0.invariants", [" "], {"asset invariants"}), ("component_assets.0.asset_id", "b", {"instance of an unknown asset", "asset without instance"}),
    ("component_instances.0.bbox_inches", [0, 0, 0, 1], {"instance box"}), ("component_instances.0.crop", [0.5, 0, 0.5, 0], {"instance crop"}), ("component_instances.0.rotation", ABSENT, {"instance rotation"}), ("component_instances.0.placement_tolerance_inches", 0.06, {"instance tolerance"}), ("component_instances.0.anchors", ABSENT, {"instance anchors"}), ("component_instances.0.anchors.0.uv", [2, 0], {"instance anchors"}),
    ("component_instances.0.slide", 0, {"instance output"}), ("component_instances.0.instance_id", "j", {"item of an unknown instance", "instance without item"}), ("source_inventory.1.role", "chart", {"native role rasterized"}), ("source_inventory.0.component_instance", "i", {"native item with an instance"}), ("source_inventory.0.output_name", ABSENT, {"native item without output"}),
]


def faulty(path, value):
    m = copy.deepcopy(manifest())
    *way, last = [int(k) if k.isdigit() else k for k in path.split(".")]
    at = m
    for k in way:
        at = at[k]
    if value is ABSENT:
        del at[last]
    else:
        at[last] = value
    return m


@pytest.fixture(scope="module")
def found(spark):
    docs = [("good", json.dumps(manifest())), ("none", None), ("text", "no json"), ("list", "[1]"), ("plain", json.dumps({k: v for k, v in manifest().items() if k in ("schema_version", "mode", "source", "canvas", "targets", "modules")}))]
    docs += [(str(n), json.dumps(faulty(p, v))) for n, (p, v, _) in enumerate(FAULTS)]
    got = {}
    for r in contracts.violations(spark.createDataFrame(docs, "path string, content string")).collect():
        got.setdefault(r.path, set()).add(r.rule)
    return got


def test_whole_manifests(found):
    assert "good" not in found and "plain" not in found
    assert found["none"] == found["text"] == found["list"] == {"not a manifest"}


@pytest.mark.parametrize("n", range(len(FAULTS)), ids=[f"{p}-{n}" for n, (p, _, _) in enumerate(FAULTS)])
def test_fault(found, n):
    assert found.get(str(n), set()) == FAULTS[n][2]
