"""Zone forest: parents by containment, depth, paths, children and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions import geometry as G
from sceneframe.operators.containment import (
    ZoneIndex, _level_pairs, _with_hits, zone_index, zone_memberships)
from sceneframe.operators.scale import checkpoint
from sceneframe.operators.scene import prepare_zones

#: zone columns the publish-side operators read from the index
LOCATION_COLUMNS = ("name", "depth", "parent", "full_path")


def zone_parents(zones: DataFrame, index: ZoneIndex | None = None) -> DataFrame:
    """(scene_id, zord, parent): name of the smallest zone holding every vertex.

    A container holds in particular the first vertex, so candidates come from
    locating that vertex; the full vertex test and the area rank run on those.
    Zones with fewer than three vertices keep the parent they came with.
    """
    index = index or zone_index(zones, ("name", "area"))
    probe = (zones.where(F.size("vertices") >= 3)
             .select("scene_id", F.col("zord").alias("_child"), F.col("vertices").alias("_ring"),
                     F.col("minx").alias("_lx"), F.col("maxx").alias("_hx"),
                     F.col("miny").alias("_ly"), F.col("maxy").alias("_hy"),
                     F.get(F.get("vertices", F.lit(0)), F.lit(0)).alias("_x"),
                     F.get(F.get("vertices", F.lit(0)), F.lit(1)).alias("_y")))

    def holds(z):
        boxed = ((z["zord"] != F.col("_child"))
                 & (z["minx"] <= F.col("_lx")) & (z["maxx"] >= F.col("_hx"))
                 & (z["miny"] <= F.col("_ly")) & (z["maxy"] >= F.col("_hy")))
        return F.when(boxed, G.polygon_contains_polygon(z["edges"], F.col("_ring"))).otherwise(False)

    if index.cells is not None:
        best = (_with_hits(probe, index, "_x", "_y")
                .withColumn("_b", F.array_min(F.transform(
                    F.filter("_hits", holds),
                    lambda z: F.struct(z["area"], z["zord"], z["name"]))))
                .select("scene_id", F.col("_child").alias("zord"), F.col("_b.name").alias("_up")))
    elif index.coarse or index.fine:
        pairs = _level_pairs(probe, index, "_x", "_y",
                             ("area", "name", "minx", "maxx", "miny", "maxy", "edges"))
        best = (pairs.where(holds(F.col("_z")))
                .groupBy("scene_id", F.col("_child").alias("zord"))
                .agg(F.min_by("_z.name", F.struct("_z.area", "_z.zord")).alias("_up")))
    else:
        best = zones.select("scene_id", "zord", F.lit(None).cast("string").alias("_up")).where("false")
    given = F.col("parent") if "parent" in zones.columns else F.lit(None).cast("string")
    return (zones.select("scene_id", "zord", "name", F.size("vertices").alias("_n"),
                         given.alias("_given"))
            .join(best, ["scene_id", "zord"], "left")
            .select("scene_id", "zord", "name",
                    F.when(F.col("_n") >= 3, F.col("_up")).otherwise(F.col("_given")).alias("parent")))


def zone_paths(parents: DataFrame, hops_per_round: int = 2) -> DataFrame:
    """(scene_id, zord, parent, depth, path): ancestors nearest first.

    Pointer doubling: each join doubles the number of hops known, so a chain of
    n zones needs log2(n) joins.  A repeated zone ends a walk, which makes
    cycles (possible with given parents) harmless.  Parent names resolve to the
    last zone of that name in the scene.
    """
    by_name = parents.groupBy("scene_id", F.col("name").alias("parent")).agg(
        F.max("zord").alias("_up"))
    linked = parents.join(by_name, ["scene_id", "parent"], "left")
    state = linked.select(
        "scene_id", "zord", "parent", F.col("_up").alias("_next"),
        F.when(F.col("_up").isNotNull(), F.array(F.struct(
            F.col("_up").alias("zord"), F.col("parent").alias("name"))))
        .otherwise(F.array().cast("array<struct<zord:bigint,name:string>>")).alias("path"))
    while True:
        for _ in range(hops_per_round):
            far = state.select(F.col("scene_id").alias("_s"), F.col("zord").alias("_z"),
                               F.col("path").alias("_more"), F.col("_next").alias("_after"))
            longer = F.concat("path", F.coalesce(
                F.col("_more"), F.array().cast("array<struct<zord:bigint,name:string>>")))
            state = (state.join(far, (F.col("scene_id") == F.col("_s"))
                                & (F.col("_next") == F.col("_z")), "left")
                     .withColumn("_all", longer)
                     .withColumn("path", F.array_distinct("_all"))
                     .withColumn("_next", F.when(F.size("path") == F.size("_all"), F.col("_after")))
                     .drop("_s", "_z", "_more", "_after", "_all"))
        state = checkpoint(state)
        if state.where(F.col("_next").isNotNull()).isEmpty():
            break
    return state.select("scene_id", "zord", "parent", F.size("path").cast("long").alias("depth"),
                        F.col("path.name").alias("path"))


def zone_hierarchy(zones: DataFrame, force: str | None = None) -> DataFrame:
    """Prepared zones with parent, depth, path and full_path, checkpointed."""
    prepared = checkpoint(zones if "edges" in zones.columns else prepare_zones(zones))
    index = zone_index(prepared, ("name", "area"), force)
    paths = zone_paths(checkpoint(zone_parents(prepared, index)))
    base = prepared.drop("parent", "depth", "path", "full_path", "children")
    out = base.join(paths, ["scene_id", "zord"])
    return checkpoint(out.withColumn("full_path", F.array_join(
        F.concat(F.reverse("path"), F.array("name")), " > ")))


def zone_children(hierarchy: DataFrame) -> DataFrame:
    """One row per (zone, child), to be read in order of child_ord."""
    child = hierarchy.where(F.col("parent").isNotNull() & (F.col("parent") != "")).select(
        "scene_id", F.col("parent").alias("name"), F.col("name").alias("child"),
        F.col("zord").alias("child_ord"))
    return (hierarchy.select("scene_id", "zord", "name")
            .join(child, ["scene_id", "name"])
            .select("scene_id", "zord", "name", "child_ord", "child"))


def with_children(hierarchy: DataFrame) -> DataFrame:
    """Zones with ``children``: the names of their children in list order, an empty list if there are none.

    The list belongs to one zone's answer, which holds it whole.
    """
    listed = (zone_children(hierarchy).groupBy("scene_id", "zord")
              .agg(F.array_sort(F.collect_list(F.struct("child_ord", "child"))).alias("_kids"))
              .select("scene_id", "zord", F.transform("_kids", lambda k: k["child"]).alias("children")))
    return (hierarchy.drop("children").join(listed, ["scene_id", "zord"], "left")
            .withColumn("children", F.coalesce("children", F.array().cast("array<string>"))))


def location_index(hierarchy: DataFrame, force: str | None = None) -> ZoneIndex:
    return zone_index(hierarchy, LOCATION_COLUMNS, force)


def zone_contents(objects: DataFrame, index: ZoneIndex) -> DataFrame:
    """One row per (zone, object inside it); ``direct`` marks deepest-zone members."""
    return zone_memberships(objects, index, ["ord"])


def zone_counts(objects: DataFrame, hierarchy: DataFrame, index: ZoneIndex | None = None) -> DataFrame:
    """num_objects (all inside) and num_direct_objects per zone; 0 when empty."""
    index = index or location_index(hierarchy)
    inside = (zone_contents(objects.select("scene_id", "ord", "x", "y"), index)
              .groupBy("scene_id", F.col("zone_ord").alias("zord"))
              .agg(F.count(F.lit(1)).alias("num_objects"),
                   F.count_if("direct").alias("num_direct_objects")))
    zero = F.lit(0).cast("long")
    return (hierarchy.join(inside, ["scene_id", "zord"], "left")
            .withColumn("num_objects", F.coalesce("num_objects", zero))
            .withColumn("num_direct_objects", F.coalesce("num_direct_objects", zero)))
