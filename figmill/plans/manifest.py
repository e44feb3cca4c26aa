"""Checks of manifests and contracts: every function returns violations as rows (rule, subject)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.functions.numeric import finite
from figmill.operators import coverage, graph

# The roles and representations that an item may have.
ROLES = ("text", "shape", "icon", "connector", "image", "evidence", "decoration", "chart", "table")
REPRESENTATIONS = ("native_primitive", "native_composite", "source_crop", "evidence_raster", "component_raster")


def box_issue(box: Column) -> Column:
    """Why an array isn't a box [left, top, width, height], or null."""
    v = [F.get(box, F.lit(k)) for k in range(4)]
    return F.when(box.isNull() | (F.size(box) != 4), "not four values").when(~(finite(v[0]) & finite(v[1]) & finite(v[2]) & finite(v[3])), "not finite").when((v[2] <= 0) | (v[3] <= 0), "no size").when((v[0] < 0) | (v[1] < 0), "negative origin")


def inside(box: Column, width, height, slack: float = 1e-6) -> Column:
    v = [F.get(box, F.lit(k)) for k in range(4)]
    return (v[0] + v[2] <= width + slack) & (v[1] + v[3] <= height + slack)


def blank(c: str) -> Column:
    return F.coalesce(T.stripped(c) == "", F.lit(True))


def items(inventory: DataFrame, modules: DataFrame, exceptions: DataFrame, width: float, height: float, dense: bool = False, roles=ROLES, representations=REPRESENTATIONS) -> DataFrame:
    """Violations of items (ord, id, module, role, text, representation, bbox, output_slide, required_count, raster_exception).

    Ids must be unique among items and modules (id); modules and raster exceptions (id) must exist; a dense
    manifest needs an item in every module.
    """
    at = F.col("ord").cast("string").alias("s")
    inventory = graph.cut(inventory)
    first = inventory.filter(~blank("id")).groupBy("id").agg(F.min("ord").alias("first"))
    again = inventory.join(first, "id").filter("ord > first").select(at).unionByName(inventory.join(modules.select("id"), "id", "left_semi").select(at)).distinct()
    raster = F.coalesce(F.col("representation").isin("source_crop", "evidence_raster"), F.lit(False))
    no = lambda test, rule: F.when(test, rule)
    own = F.array_compact(
        F.array(
            no(blank("id"), "id missing"), no(~F.coalesce(F.col("role").isin(*roles), F.lit(False)), "unknown role"), no(~F.coalesce(F.col("representation").isin(*representations), F.lit(False)), "unknown representation"),
            no(F.col("output_slide") < 1, "slide not positive"), no(F.col("required_count") < 1, "count not positive"), no((F.col("role") == "text") & blank("text"), "text missing"), no(F.col("bbox").isNotNull() & box_issue(F.col("bbox")).isNotNull(), "invalid box"),
            no(box_issue(F.col("bbox")).isNull() & ~inside(F.col("bbox"), width, height), "box beyond the canvas"), no(raster & blank("raster_exception"), "no raster exception"),
        )
    )
    rules = {
        "id repeated": again,
        "unknown module": inventory.join(modules.select(F.col("id").alias("module")), "module", "left_anti").select(at),
        "unknown raster exception": inventory.filter(raster & ~blank("raster_exception")).join(exceptions.select(F.col("id").alias("raster_exception")), "raster_exception", "left_anti").select(at),
    }
    if dense:
        rules["module without items"] = modules.select("id").join(inventory.select(F.col("module").alias("id")), "id", "left_anti").select(F.col("id").alias("s"))
    return inventory.select(F.explode(own).alias("rule"), at).withColumnRenamed("s", "subject").unionByName(coverage.violations(rules, "s"))


def grammar(connections: DataFrame, node_roles: DataFrame, edge_roles: DataFrame) -> DataFrame:
    """Violations of connections (id, source, target), node roles (id, output_names) and edge roles (id): both ways covered, outputs not shared."""
    ends = connections.select(F.explode(F.array("source", "target")).alias("id"))
    names = node_roles.select("id", F.explode("output_names").alias("name"))
    return coverage.violations(
        {
            "module without node role": coverage.missing(ends, node_roles, ["id"]).select(F.col("id").alias("s")),
            "edge role without connection": coverage.missing(edge_roles, connections, ["id"]).select(F.col("id").alias("s")),
            "connection without edge role": coverage.missing(connections, edge_roles, ["id"]).select(F.col("id").alias("s")),
            "node role without outputs": node_roles.filter(F.coalesce(F.size("output_names") < 1, F.lit(True)) | F.exists("output_names", lambda n: T.stripped(n) == "")).select(F.col("id").alias("s")),
            "output of several roles": names.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("name").alias("s")),
        },
        "s",
    )


def regions(df: DataFrame, width: int, height: int) -> DataFrame:
    """(ord, name, x0, y0, x1, y1, rule): named boxes (ord, name, bbox) with whole corners (half to even), and what is wrong with them."""
    v = [F.bround(F.get("bbox", F.lit(k))).cast("long") for k in range(4)]
    rule = F.when(blank("name"), "no name").when(F.coalesce(F.size("bbox"), F.lit(0)) != 4, "not four values").when((v[0] < 0) | (v[1] < 0) | (v[2] <= 0) | (v[3] <= 0), "no size or negative origin").when((v[0] + v[2] > width) | (v[1] + v[3] > height), "beyond the canvas")
    return df.select("ord", T.stripped("name").alias("name"), v[0].alias("x0"), v[1].alias("y0"), (v[0] + v[2]).alias("x1"), (v[1] + v[3]).alias("y1"), rule.alias("rule"))


def disjoint(df: DataFrame, group: str, member: str) -> DataFrame:
    """(member, groups): members of more than one group."""
    return df.select(group, member).distinct().groupBy(member).agg(F.sort_array(F.collect_set(group)).alias("groups")).filter(F.size("groups") > 1)


def preflight(requests: DataFrame) -> DataFrame:
    """(id, rules) of generation requests (id, available, provider, authorization, attempt, correction_reason, prompt, subject, style, invariants, references)."""
    refs = F.exists("references", lambda r: ~F.coalesce(r["role"].isin("structure", "style", "edit_target"), F.lit(False)))
    whole = F.exists("references", lambda r: F.coalesce((T.stripped(r["path"]) == "") | (T.stripped(r["authorization"]) == "") | (T.stripped(r["scope"]) == "") | ~r["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(True)))
    no = lambda test, why: F.when(F.coalesce(test, F.lit(True)), why)
    rules = F.array_compact(
        F.array(
            no(~F.col("available"), "tool unavailable"), no(F.col("provider") != "builtin_imagegen", "provider not supported"), no(blank("authorization"), "no authorization"), no(~F.col("attempt").isin(1, 2), "attempt out of budget"),
            F.when((F.col("attempt") == 2) & blank("correction_reason"), "no correction reason"), *(no(blank(c), f"no {c}") for c in ("prompt", "subject", "style")),
            no((F.size("invariants") < 1) | F.exists("invariants", lambda v: T.stripped(v) == ""), "no invariants"), F.when(F.col("references").isNull(), "references not listed"), F.when(F.coalesce(refs, F.lit(False)), "reference role unknown"), F.when(F.coalesce(whole, F.lit(False)), "reference without hash or scope"),
        )
    )
    return requests.select("id", rules.alias("rules"))


def prompt_bound(prompt: Column, contract: Column) -> Column:
    """Whether a prompt ends with the contract's canonical JSON."""
    return F.endswith(prompt, T.canonical_json("compact")(contract))


def revise(inventory: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with new texts, violations) for changes (id, before, after) to items (id, role, text, ...).

    A change must name one text item once, say the text that it has, and change it.  With any violation the
    rows come back as they were.
    """
    known = inventory.filter("role = 'text'").select("id", F.col("text").alias("now"))
    j = changes.join(known, "id", "left")
    wrong = coverage.violations(
        {
            "unknown item": j.filter("now is null").select(F.col("id").alias("s")),
            "changed twice": changes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("s")),
            "text has changed since": j.filter("now is not null and now <> before").select(F.col("id").alias("s")),
            "no change": j.filter("before = after").select(F.col("id").alias("s")),
            "empty text": j.filter(blank("after")).select(F.col("id").alias("s")),
        },
        "s",
    )
    clean = wrong.agg((F.count(F.lit(1)) == 0).alias("ok_"))
    new = inventory.join(changes.select("id", "after").dropDuplicates(["id"]), "id", "left").join(F.broadcast(clean))
    text = F.when(F.col("ok_") & F.col("after").isNotNull(), F.col("after")).otherwise(F.col("text"))
    return new.select(*(text.alias("text") if c == "text" else F.col(c) for c in inventory.columns)), wrong


def replace_assets(assets: DataFrame, instances: DataFrame, overrides: DataFrame) -> DataFrame:
    """(id, path, replaced): the assets (id, path) that instances (asset) use, with the paths of the overrides (id, path)."""
    used = assets.join(instances.select(F.col("asset").alias("id")), "id", "left_semi")
    return used.join(overrides.select("id", F.col("path").alias("new")), "id", "left").select("id", F.coalesce("new", "path").alias("path"), F.col("new").isNotNull().alias("replaced"))


def recipe(items_: DataFrame, instances: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, instance, asset, path, rule): items (id, instance) with their instance (id, asset) and its asset (id, path), and the first link that is missing."""
    i = instances.select(F.col("id").alias("instance"), "asset")
    a = assets.select(F.col("id").alias("asset"), "path")
    rule = F.when(F.col("asset").isNull(), "unknown instance").when(F.col("path").isNull(), "unknown asset")
    return items_.select("id", "instance").join(i, "instance", "left").join(a, "asset", "left").select("id", "instance", "asset", "path", rule.alias("rule"))


def zipped(left: DataFrame, right: DataFrame, order: str, key: str) -> DataFrame:
    """(order, left key, right key, agrees): two ordered lists side by side; a place that one lacks doesn't agree."""
    j = left.select(order, F.col(key).alias("left_key")).join(right.select(order, F.col(key).alias("right_key")), order, "full")
    return j.withColumn("agrees", F.col("left_key").eqNullSafe(F.col("right_key")))


def contained(nodes: DataFrame, slack: float = 1e-8) -> DataFrame:
    """(id, rule): nodes (id, role, parent, x, y, w, h) whose parent isn't a container, or doesn't hold them."""
    p = nodes.select(F.col("id").alias("parent"), F.col("role").alias("prole"), *(F.col(c).alias(f"p{c}") for c in "xywh"))
    j = nodes.filter("parent is not null").join(p, "parent", "left")
    out = (F.col("x") < F.col("px")) | (F.col("y") < F.col("py")) | (F.col("x") + F.col("w") > F.col("px") + F.col("pw") + slack) | (F.col("y") + F.col("h") > F.col("py") + F.col("ph") + slack)
    rule = F.when(~F.col("prole").eqNullSafe("container"), "parent is no container").when(out, "outside its container")
    return j.select("id", rule.alias("rule")).filter("rule is not null")


def merged_marks(marks: DataFrame) -> DataFrame:
    """(image_id, y, x, label, conflict): one label per pixel of marks (image_id, y, x, code); the smallest code wins.

    Even codes are one class and odd codes the other; a pixel with both is in conflict.  Hard marks have smaller
    codes than probable ones of their class.
    """
    return marks.groupBy("image_id", "y", "x").agg(F.min("code").alias("label"), (F.count_distinct(F.col("code") % 2) > 1).alias("conflict"))


def paint_issues(paints: DataFrame) -> DataFrame:
    """(id, rule) of paints (id, kind, color, alpha, angle, focus, stops array of struct(position, color, alpha)): the first thing that is wrong."""
    rgb = lambda c: F.coalesce(c.rlike("^#?[0-9A-Fa-f]{6}$"), F.lit(False))
    share = lambda v: F.coalesce(finite(v) & (v >= 0) & (v <= 1), F.lit(False))
    place = F.transform("stops", lambda s: F.bround(s["position"] * 100000))
    rising = F.forall(F.sequence(F.lit(1), F.size("stops") - 1), lambda k: F.get(place, k) > F.get(place, k - 1))
    many = F.coalesce(F.size("stops"), F.lit(0))
    graded = F.col("kind").isin("linear", "path")
    rule = (
        F.when(~F.coalesce(F.col("kind").isin("none", "group", "solid", "linear", "path"), F.lit(False)), "unknown kind")
        .when((F.col("kind") == "solid") & ~(rgb(F.col("color")) & share(F.coalesce("alpha", F.lit(1.0)))), "invalid colour")
        .when(graded & ~many.between(2, 32), "needs 2 to 32 stops")
        .when(graded & ~F.forall("stops", lambda s: share(s["position"]) & rgb(s["color"]) & share(F.coalesce(s["alpha"], F.lit(1.0)))), "invalid stop")
        .when(graded & ~((F.get("stops", F.lit(0))["position"] == 0) & (F.element_at("stops", -1)["position"] == 1) & rising), "stops don't rise from 0 to 1")
        .when((F.col("kind") == "linear") & ~F.coalesce(finite(F.col("angle")) & F.col("angle").between(0, 360), F.lit(False)), "invalid angle")
        .when((F.col("kind") == "path") & ~F.coalesce((F.size("focus") == 2) & F.forall("focus", share), F.lit(False)), "invalid focus")
    )
    return paints.select("id", rule.alias("rule")).filter("rule is not null")


def mask_issues(effects: DataFrame) -> DataFrame:
    """(id, rule) of effects (id, opacity, kind, stops): an alpha mask is a white paint whose stops all say their alpha."""
    white = F.forall("stops", lambda s: F.coalesce(F.upper(s["color"]) == "FFFFFF", F.lit(False)))
    rule = F.when(~F.coalesce(F.col("opacity").between(0, 1), F.lit(True)), "invalid opacity").when(F.col("kind").isNotNull() & ~F.col("kind").isin("solid", "linear", "path"), "not a paint").when(F.exists("stops", lambda s: s["alpha"].isNull()), "alpha not said").when(~white, "not white")
    return effects.select("id", rule.alias("rule")).filter("rule is not null")


def reachable(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): everything that links (a, b) reach from starts (id), the starts included; new ids only are followed in each round."""
    from figmill.operators.graph import cut

    seen = cut(starts.select("id").distinct())
    front = seen
    while front.head(1):
        front = cut(links.join(front.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def frozen(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, role, rule): receipts (id, role, sha256) that are lost, new or changed."""
    j = before.select("id", "role", F.col("sha256").alias("b")).join(after.select("id", "role", F.col("sha256").alias("a")), ["id", "role"], "full")
    return j.select("id", "role", F.when(F.col("a").isNull(), "lost").when(F.col("b").isNull(), "new").when(F.col("a") != F.col("b"), "changed").alias("rule")).filter("rule is not null")


def first_errors(errors: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first n errors of each group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return errors.withColumn("n_", F.row_number().over(w)).filter(F.col("n_") <= n).drop("n_")
