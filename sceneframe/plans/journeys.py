"""Multi-zone journeys: adjacent zones, shortest zone paths, progress reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sceneframe.functions import geometry as G
from sceneframe.functions.rounding import py_round
from sceneframe.functions.text import name_key
from sceneframe.operators.containment import cell_no, level_of
from sceneframe.operators.scale import broadcast_if_small, checkpoint

#: steps of a tree between two looks at what is still wanted
LEAP = 12


def _boundaries_meet(a, b, gap: float):
    """Edges cross, or a vertex of one lies within the gap of an edge of the other."""
    def close(e, f):
        crossing = G.segments_intersect(e["xj"], e["yj"], e["xi"], e["yi"],
                                        f["xj"], f["yj"], f["xi"], f["yi"])
        d1 = G.point_segment_distance(e["xi"], e["yi"], f["xj"], f["yj"], f["xi"], f["yi"])
        d2 = G.point_segment_distance(f["xi"], f["yi"], e["xj"], e["yj"], e["xi"], e["yi"])
        return crossing | (d1 <= gap) | (d2 <= gap)
    return F.exists(a, lambda e: F.exists(b, lambda f: close(e, f)))


def zone_adjacency(zones: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """(scene_id, a, b) with a < b: zones whose boundaries cross or nearly touch.

    Boxes grown by half the gap are placed on the grid of their own size and on
    the coarser grids in use; a pair meets on the coarser of its two grids and
    is tested in its first common cell only.
    """
    half = max_gap / 2.0 + 1e-9
    boxed = zones.where(F.size("vertices") >= 2).select(
        "scene_id", "zord", "edges", (F.col("minx") - half).alias("lx"),
        (F.col("maxx") + half).alias("hx"), (F.col("miny") - half).alias("ly"),
        (F.col("maxy") + half).alias("hy"))
    boxed = boxed.withColumn("own", level_of(F.greatest(F.col("hx") - F.col("lx"),
                                                        F.col("hy") - F.col("ly"))))
    levels = sorted(r[0] for r in boxed.select("own").distinct().collect())  # few exponents
    if not levels:
        return boxed.select("scene_id", F.col("zord").alias("a"), F.col("zord").alias("b"))
    size = F.pow(F.lit(2.0), F.col("level"))
    cells = (boxed.withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
             .where(F.col("level") >= F.col("own"))
             .withColumn("c0", cell_no(F.col("lx"), size)).withColumn("r0", cell_no(F.col("ly"), size))
             .withColumn("cx", F.explode(F.sequence("c0", cell_no(F.col("hx"), size))))
             .withColumn("cy", F.explode(F.sequence("r0", cell_no(F.col("hy"), size)))))
    keys = ["scene_id", "level", "cx", "cy"]
    a = cells.select(*keys, *[F.col(c).alias(f"a_{c}") for c in
                              ("zord", "edges", "own", "c0", "r0", "lx", "hx", "ly", "hy")])
    b = cells.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in
                                                                  ("zord", "edges", "own", "c0", "r0",
                                                                   "lx", "hx", "ly", "hy")])
    same = [F.col(k) == F.col(f"b_{k}") for k in keys]
    cond = same[0] & same[1] & same[2] & same[3] & (F.col("a_zord") < F.col("b_zord"))
    cond &= F.greatest("a_own", "b_own") == F.col("level")
    cond &= (F.col("cx") == F.greatest("a_c0", "b_c0")) & (F.col("cy") == F.greatest("a_r0", "b_r0"))
    cond &= (F.col("a_lx") <= F.col("b_hx")) & (F.col("b_lx") <= F.col("a_hx"))
    cond &= (F.col("a_ly") <= F.col("b_hy")) & (F.col("b_ly") <= F.col("a_hy"))
    cond &= _boundaries_meet(F.col("a_edges"), F.col("b_edges"), max_gap)
    return a.join(b, cond).select("scene_id", F.col("a_zord").alias("a"), F.col("b_zord").alias("b"))


def zone_trees(roots: DataFrame, adjacency: DataFrame, pending) -> DataFrame:
    """(scene_id, root, node, dist, link): breadth-first trees, one row per zone and root.

    ``link`` is the neighbour one step nearer to the root, of several the one with the lowest number, so that
    following links gives the path with the fewest zones and then the lowest numbers.
    ``roots`` has (scene_id, root); ``pending(trees)`` returns the roots that still lack a zone they want.

    A leap takes LEAP steps in one stage: trees stay partitioned by their root, a step joins the
    last zones with their (broadcast, if proven small) neighbours and keeps the least (dist, link) per zone.
    Between leaps finished and exhausted roots leave.
    """
    move = lambda at, to, stay: F.struct(F.col(at).alias("_at"), F.col(to).alias("next"), F.lit(stay).alias("stay"))
    moves = broadcast_if_small(checkpoint(adjacency.select(F.col("scene_id").alias("_scene"), F.explode(F.array(
        move("a", "b", False), move("b", "a", False), move("a", "a", True), move("b", "b", True))).alias("m")).select("_scene", "m.*").distinct()))
    growing = (roots.select("scene_id", "root", F.col("root").alias("node"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("link"))
               .repartition("scene_id", "root"))
    done, level = None, 0
    while True:
        for dist in range(level, level + LEAP):
            moved = growing.join(moves, (F.col("scene_id") == F.col("_scene")) & (F.col("node") == F.col("_at"))
                                 & (F.col("stay") | (F.col("dist") == dist)), "left")
            kept = F.coalesce(F.col("stay"), F.lit(True))
            growing = (moved.select("scene_id", "root", F.coalesce("next", "node").alias("node"),
                                    F.struct(F.when(kept, F.col("dist")).otherwise(dist + 1).alias("dist"),
                                             F.when(kept, F.col("link")).otherwise(F.col("node")).alias("link")).alias("_nearest"))
                       .groupBy("scene_id", "root", "node").agg(F.min("_nearest").alias("_nearest")).select("scene_id", "root", "node", "_nearest.*"))
        level += LEAP
        growing = checkpoint(growing)
        if growing.agg(F.max("dist")).first()[0] != level:
            return growing if done is None else done.unionByName(growing)
        grown = growing.where(F.col("dist") == level).select("scene_id", "root").distinct()
        left = checkpoint(pending(growing).join(grown, ["scene_id", "root"], "left_semi"))
        if left.isEmpty():
            return growing if done is None else done.unionByName(growing)
        finished = growing.join(left, ["scene_id", "root"], "left_anti")
        done = checkpoint(finished if done is None else done.unionByName(finished))
        growing = growing.join(left, ["scene_id", "root"], "left_semi").repartition("scene_id", "root")


def _followed(key, legs: pa.Table, tree: pa.Table) -> pa.Table:
    """The paths of all legs to one root, by pointer doubling over its links."""
    nodes, dist = tree.column("node").to_numpy(), tree.column("dist").to_numpy()
    order = np.argsort(nodes)
    nodes, dist = nodes[order], dist[order]
    jump = np.searchsorted(nodes, tree.column("link").fill_null(key[1].as_py()).to_numpy()[order])     # the root stays where it is
    sources = legs.column("source").to_numpy()
    sources = sources[np.isin(sources, nodes)]
    places = np.searchsorted(nodes, sources)[:, None]
    longest = dist[places].max(initial=0)
    while places.shape[1] <= longest:                   # a jump leads as many steps ahead as there are places
        places, jump = np.concatenate([places, jump[places]], axis=1), jump[jump]
    hops = dist[places[:, 0]]
    leg, hop = np.nonzero(np.arange(places.shape[1]) <= hops[:, None])
    return pa.table({"scene_id": pa.array([key[0].as_py()] * len(leg), key[0].type), "source": pa.array(sources[leg], pa.int64()),
                     "target": pa.array([key[1].as_py()] * len(leg), pa.int64()), "hop": pa.array(hop, pa.int32()),
                     "node": pa.array(nodes[places[leg, hop]], pa.int64()), "hops": pa.array(hops[leg], pa.int32())})


def shortest_zone_paths(legs: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(scene_id, source, target, hop, node, hops): fewest zones, then lowest zone numbers; a row per zone of a path.

    Trees grow from the targets; a target's legs and tree - at most a row per zone of the scene each -
    meet once to follow the links.
    """
    wanted = checkpoint(legs.select("scene_id", F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).distinct())

    def pending(trees):
        reached = trees.select("scene_id", F.col("root").alias("target"), F.col("node").alias("source"))
        return (wanted.join(reached, ["scene_id", "source", "target"], "left_anti")
                .select("scene_id", F.col("target").alias("root")).distinct())
    trees = zone_trees(wanted.select("scene_id", F.col("target").alias("root")).distinct(), adjacency, pending)
    key = wanted.schema["scene_id"].dataType.simpleString()
    return (wanted.groupBy("scene_id", "target").cogroup(trees.groupBy("scene_id", "root"))
            .applyInArrow(_followed, f"scene_id {key}, source long, target long, hop int, node long, hops int"))


def plan_journeys(journeys: DataFrame, zones: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Waypoints of multi-stop journeys, one row each, ordered by (stop_no, hop).

    journeys: journey_id, scene_id, start_zone, destinations (array of names).
    Entering a zone is a waypoint at its vertex mean; the last of a leg is a stop.
    Legs without a path, or to unknown zones, give one row with an error.
    """
    named = zones.groupBy("scene_id", F.lower("name").alias("_key")).agg(
        F.min_by(F.struct("zord", "name"), "zord").alias("_z"))
    end = lambda name: named.select("scene_id", "_key", F.col("_z.zord").alias(name))
    leg = lambda stop, i: F.struct((i + 1).alias("stop_no"), F.when(i == 0, F.col("start_zone")).otherwise(
        F.get("destinations", i - 1)).alias("begin"), stop.alias("stop"))
    legs = (journeys.select("journey_id", "scene_id", F.explode(F.transform("destinations", leg)).alias("_leg")).select("journey_id", "scene_id", "_leg.*")
            .withColumn("_key", name_key(F.col("begin"))).join(end("source"), ["scene_id", "_key"], "left")
            .withColumn("_key", name_key(F.col("stop"))).join(end("target"), ["scene_id", "_key"], "left").drop("_key", "begin"))
    legs = checkpoint(legs)
    paths = shortest_zone_paths(legs.where("source is not null and target is not null"), adjacency)
    # the first row of a path is where the leg begins, unless it ends there too
    walked = paths.where("hop > 0 or hops = 0")
    info = zones.select("scene_id", F.col("zord").alias("node"), F.col("name").alias("zone"), "cx", "cy")
    return (legs.join(walked, ["scene_id", "source", "target"], "left").join(info, ["scene_id", "node"], "left")
            .select("journey_id", "stop_no", "stop", F.coalesce("hop", F.lit(0)).alias("hop"), "zone",
                    F.col("cx").alias("x"), F.col("cy").alias("y"),
                    F.concat(F.lit("enter "), F.col("zone")).alias("action"),
                    (F.col("hop") == F.col("hops")).alias("is_stop"),
                    F.when(F.col("hop").isNull(), F.concat(F.lit("No route to '"), F.col("stop"),
                                                           F.lit("'"))).alias("error")))


def journey_status(waypoints: DataFrame, progress: DataFrame) -> DataFrame:
    """Progress report per journey.

    waypoints: journey_id, idx (from 0), action, is_stop, stop; progress:
    journey_id, current_waypoint (number of waypoints passed).  The percentage
    counts passed waypoints, the narration names the next one.
    """
    cur, idx = F.col("current_waypoint"), F.col("idx")
    facts = (waypoints.join(progress, "journey_id").groupBy("journey_id", "current_waypoint")
             .agg(F.count(F.lit(1)).alias("total_waypoints"), F.count_if("is_stop").alias("total_stops"),
                  F.count_if(F.col("is_stop") & (idx < cur)).alias("_past"),
                  F.min(F.when(idx == cur, F.col("action"))).alias("_next"),
                  F.min_by(F.when(F.col("is_stop") & (idx >= cur), F.col("stop")),
                           F.when(F.col("is_stop") & (idx >= cur), idx)).alias("_stop")))
    percent = py_round(cur * 100.0 / F.col("total_waypoints"), 1)
    done = cur >= F.col("total_waypoints")
    stop_no = F.least(F.col("_past") + 1, F.col("total_stops"))
    shown = percent.cast("string")
    where = F.when(F.col("total_stops") > 1, F.concat(
        F.lit(" (stop "), stop_no.cast("string"), F.lit(" of "), F.col("total_stops").cast("string"),
        F.lit(": "), F.col("_stop"), F.lit(")"))).otherwise("")
    text = F.when(done, F.concat(F.lit("Journey complete. "), shown, F.lit("% complete."))).otherwise(
        F.concat(F.lit("Waypoint "), (cur + 1).cast("string"), F.lit(" of "),
                 F.col("total_waypoints").cast("string"), F.lit(": "), F.col("_next"), F.lit("."),
                 where, F.lit(" "), shown, F.lit("% complete.")))
    return facts.select("journey_id", F.when(done, "succeeded").otherwise("executing").alias("status"),
                        "current_waypoint", "total_waypoints", percent.alias("progress_percent"),
                        stop_no.alias("current_stop"), "total_stops", text.alias("narration"))
