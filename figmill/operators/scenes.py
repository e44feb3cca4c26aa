"""Paint order, group contiguity and nesting of one scene or drawing at a time."""

from __future__ import annotations

import heapq
from graphlib import TopologicalSorter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from figmill.operators import graph, series


def paint_order(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, id, position) of nodes (key, id, z, rank): edges (key, below, above) first, then z, then rank.

    Of the nodes that have nothing unpainted below them, the one of least (z, rank) comes next.  A scene
    whose edges make a circle or name an unknown node has null positions, and `reason` says which.  Circles are
    found in all scenes at once; one scene is one task's group; a scene without nodes gives no rows, whatever its edges.
    """
    end = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("id"))
    circles = graph.on_circles(edges.select(end("below").alias("a"), end("above").alias("b")))
    bad = circles.select(F.col("id.key").alias(key)).distinct().withColumn("circle_", F.lit(True))

    def order(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({key: n[key], "id": n["id"], "position": pd.array([None] * len(n), "Int64"), "reason": None})
        known = dict(zip(n["id"], zip(n["z"], n["rank"], strict=True), strict=True))
        if n.empty:
            return out
        if not known.keys() >= set(e["below"]) | set(e["above"]):
            return out.assign(reason="unknown node")
        if len(known) < len(n):
            return out.assign(reason="repeated node")
        if n["circle_"].any():
            return out.assign(reason="circle")
        tree = TopologicalSorter({i: () for i in known})
        for below, above in zip(e["below"], e["above"], strict=True):
            tree.add(above, below)
        tree.prepare()
        place: dict = {}
        heap: list = []
        while tree.is_active():
            for i in tree.get_ready():
                heapq.heappush(heap, (*known[i], i))
            i = heapq.heappop(heap)[-1]
            place[i] = len(place)
            tree.done(i)
        return out.assign(position=pd.array([place[i] for i in n["id"]], "Int64"))

    kind = {f.name: f.dataType.simpleString() for f in nodes.schema}
    cols = edges.select(key, "below", "above")
    marked = nodes.select(key, "id", "z", "rank").join(bad, key, "left").withColumn("circle_", F.coalesce("circle_", F.lit(False)))
    return marked.groupBy(key).cogroup(cols.groupBy(key)).applyInPandas(order, f"`{key}` {kind[key]}, id {kind['id']}, position long, reason string")


MEMBERS_A_TASK = 250_000
PLACES = 100_000  # of a large group that are counted together


def contiguous(members: DataFrame, order: DataFrame, key: str) -> DataFrame:
    """(key, group, members, first, contiguous) of members (key, group, id): whether each group is a run of the paint order.

    A member that the order doesn't have makes its group not contiguous; so does one that is listed twice.  Members are dealt
    by their number, so a task's share doesn't grow with them; a large group is counted in pieces of PLACES places.
    """
    n = graph.tasks(members.count(), MEMBERS_A_TASK)
    place = order.select(key, "id", "position").repartition(n, key, "id")
    m = members.repartition(n, key, "id").join(graph.dealt(place), [key, "id"], "left").withColumn("piece_", F.floor(F.col("position") / PLACES))
    own = m.repartition(n, key, "group", "piece_").groupBy(key, "group", "piece_", "position").agg(F.count(F.lit(1)).alias("n_"))
    piece = own.groupBy(key, "group", "piece_").agg(F.sum("n_").alias("members"), F.count("position").alias("places_"), F.min("position").alias("first"), F.max("position").alias("last_"))
    g = piece.repartition(n, key, "group").groupBy(key, "group").agg(F.sum("members").alias("members"), F.sum("places_").alias("places_"), F.min("first").alias("first"), F.max("last_").alias("last_"))
    run = (F.col("last_") - F.col("first") + 1 == F.col("members")) & (F.col("places_") == F.col("members"))
    return g.select(key, "group", "members", "first", F.coalesce(run, F.lit(False)).alias("contiguous"))


FAN = 64


def _last_below(values, count, level):
    """The last place among the first `count` of an array whose value is below `level`, or null."""
    return F.array_max(F.filter(F.transform(F.slice(values, F.lit(1), count), lambda v, k: F.when(v < level, k)), lambda k: k.isNotNull()))


def previous_smaller(rows: DataFrame, keys: list[str], n: str, value: str) -> DataFrame:
    """(keys, n, before): for each row, numbered from 0 in its key, the last number before it whose value is smaller, or null.

    Rows stand in blocks of FAN, blocks in blocks of FAN, with the least value of each.  A row that finds none in its own
    block climbs until a block before its own has one, then goes down to it: a join a level, for such rows only.
    """
    at = F.col(n)
    tables = [graph.cut(rows.groupBy(*keys, F.floor(at / FAN).alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("n"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values")))]
    while tables[-1].agg(F.max("node")).first()[0]:
        up = tables[-1].select(*keys, F.floor(F.col("node") / FAN).alias("up"), F.struct("node", F.array_min("values").alias("v")).alias("s"))
        tables.append(graph.cut(up.groupBy(*keys, F.col("up").alias("node")).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("values"))))
    first = tables[0].select(*keys, "node", "values", F.posexplode("values").alias("place", "v"))
    asked = first.select(*keys, (F.col("node") * FAN + F.col("place")).alias("n"), "v", "node", _last_below(F.col("values"), F.col("place"), F.col("v")).alias("hit"))
    done = asked.filter("hit IS NOT NULL").select(*keys, "n", (F.col("node") * FAN + F.col("hit")).alias("before"))
    asked, found = graph.cut(asked.filter("hit IS NULL").drop("hit")), None
    climbing = []
    for table in tables[1:]:
        j = asked.withColumn("own", F.col("node") % FAN).withColumn("node", F.floor(F.col("node") / FAN)).join(table, [*keys, "node"])
        j = graph.cut(j.select(*keys, "n", "v", "node", _last_below(F.col("values"), F.col("own"), F.col("v")).alias("hit")))
        climbing.append(j.filter("hit IS NOT NULL").select(*keys, "n", "v", (F.col("node") * FAN + F.col("hit")).alias("node")))
        asked = j.filter("hit IS NULL").drop("hit")
    for table, here in zip(reversed(tables[:-1]), reversed(climbing), strict=True):
        found = here if found is None else found.unionByName(here)
        j = found.join(table, [*keys, "node"])
        found = j.select(*keys, "n", "v", (F.col("node") * FAN + _last_below(F.col("values"), F.size("values"), F.col("v"))).alias("node"))
    none = asked.select(*keys, "n", F.lit(None).cast("long").alias("before"))
    out = done.unionByName(none)
    return out if found is None else out.unionByName(found.select(*keys, "n", F.col("node").alias("before")))


def enclosing(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, ord, level, opens) with `parent`: ord of the innermost open scope, or null.

    A row closes the scopes whose level is not below its own; one that `opens` is a scope for what follows.  So the
    scope of a row is the last row before it of a smaller level, if that opens, else the scope of that row; such ways
    are followed by pointers of doubling length.  A key's rows are dealt by ranges of ord, so a large one is many
    tasks.  Null keys are one key; rows of one ord stand by level.
    """
    d = rows.select(F.struct(F.col(key).alias("key")).alias("k_"), F.col("ord").cast("long").alias("ord"), F.col("level").cast("int").alias("level"), F.coalesce("opens", F.lit(False)).alias("opens"))
    dealt = graph.cut(d.repartitionByRange("k_", "ord").withColumn("part_", F.spark_partition_id()))
    n = graph.cut(series.numbered(dealt, ["k_"], ["ord", "level", "opens"], F.col("part_")).select("k_", F.col("n_").alias("n"), "ord", "level", "opens"))
    before = n.join(previous_smaller(n, ["k_"], "n", "level"), ["k_", "n"])
    base = graph.cut(before)
    skip = graph.cut(base.filter("NOT opens").select("k_", "n", F.col("before").alias("to")))
    while True:
        on = skip.select("k_", F.col("n").alias("to"), F.col("to").alias("next"), F.lit(True).alias("moved"))
        skip = graph.cut(skip.join(on, ["k_", "to"], "left").select("k_", "n", F.when(F.col("moved"), F.col("next")).otherwise(F.col("to")).alias("to"), F.coalesce("moved", F.lit(False)).alias("moved")))
        ended = skip.filter("moved").isEmpty()
        skip = skip.drop("moved")
        if ended:
            break
    hop = skip.select("k_", F.col("n").alias("before"), "to", F.lit(True).alias("skipped"))
    scope = base.join(hop, ["k_", "before"], "left").select("k_", "ord", "level", "opens", F.when(F.col("skipped"), F.col("to")).otherwise(F.col("before")).alias("scope"))
    place = base.select("k_", F.col("n").alias("scope"), F.col("ord").alias("parent"))
    return scope.join(place, ["k_", "scope"], "left").select(F.col("k_.key").alias(key), "ord", "level", "opens", "parent")


def group_runs(order: DataFrame, key: str, group: str) -> DataFrame:
    """(key, group, first, last) of each maximal run of one group in the paint order."""
    w = Window.partitionBy(key).orderBy("position")
    d = order.withColumn("new_", F.when(F.lag(group).over(w).eqNullSafe(F.col(group)), 0).otherwise(1)).withColumn("run_", F.sum("new_").over(w))
    return d.groupBy(key, group, "run_").agg(F.min("position").alias("first"), F.max("position").alias("last")).drop("run_")
