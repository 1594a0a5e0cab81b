"""Every operator as a named query over the star-schema tables.

Each entry reads its whole tables.  The zone hierarchy and its index are built
once per session and data folder and then shared, as a published scene is.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sceneframe.functions import angles as A, geometry as G, text as X
from sceneframe.functions.rounding import py_round
from sceneframe.functions.times import wall_micros
from sceneframe.operators import (
    arrivals, asof, containment, hierarchy as H, logs, lookup, nearest, ranges, routes, scene as SC)
from sceneframe.operators.scale import broadcast_if_small, checkpoint_folder
from sceneframe.plans import dispatch, evaluation as EV, journeys as J, publish as P, tools as T
from sceneframe.sources import scenes, sinks, tables as D
from sceneframe.streaming import jobs
from sceneframe.streaming.sinks import BatchTable

#: alignment used by the projection queries
ALIGN = (4.3127, -1.8406, 12.75, 1.0)
#: pose estimate used by the re-alignment queries
ESTIMATE = (10.5, -4.25, 30.0)

_published: dict = {}


def published(spark: SparkSession, sf: str) -> P.Published:
    """Filtered objects, hierarchy and index of the derived scene, built once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _published:
        zones = H.zone_hierarchy(D.zones(spark, sf))
        _published[key] = P.Published(SC.filter_objects(D.objects(spark, sf)), zones,
                                      H.location_index(zones))
    return _published[key]


def _named_poses(spark, sf):
    return D.named_poses(spark, sf, published(spark, sf).zones)


def _requests(spark, sf):
    return D.requests(spark, sf, published(spark, sf).zones)


def _alignments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(0, *ALIGN, "xz")],
        "scene_id long, translate_x double, translate_y double, rotate_deg double, scale double, "
        "world_axes string")


def _r(c, n):
    return py_round(F.col(c) if isinstance(c, str) else c, n)


# -- scalar functions ------------------------------------------------------

def project_align(spark, sf):
    placed = SC.to_map_frame(D.objects(spark, sf), _alignments(spark))
    return placed.select("id", _r("x", 3).alias("map_x"), _r("y", 3).alias("map_y"))


def inverse_align(spark, sf):
    tx, ty, deg, scale = (F.lit(v) for v in (*ALIGN[:3], 2.0))
    raw = G.inverse_affine_ring(F.col("vertices"), tx, ty, deg, scale)
    return (D.zones(spark, sf).select("zord", F.posexplode(raw).alias("i", "v"))
            .select("zord", F.col("i").cast("long").alias("i"), _r(F.col("v")[0], 3).alias("x"),
                    _r(F.col("v")[1], 3).alias("y")))


def quaternions(spark, sf):
    q = A.quaternion_from_yaw(F.col("yaw"))
    df = D.poses(spark, sf).withColumn("q", q)
    zero = F.lit(0.0)
    back = A.yaw_from_quaternion(zero, zero, F.col("q.z"), F.col("q.w"))
    return df.select("request_id", _r("q.z", 6).alias("qz"), _r("q.w", 6).alias("qw"),
                     _r(F.cos(back), 6).alias("cos_yaw"), _r(F.sin(back), 6).alias("sin_yaw"))


def pose_directions(spark, sf):
    x, y, yaw = F.col("x"), F.col("y"), F.col("yaw")
    ox, oy = F.lit(250.0), F.lit(50.0)
    dist = G.distance(x, y, ox, oy)
    return D.poses(spark, sf).select(
        "request_id", py_round(dist, 2).alias("distance"),
        py_round(A.degrees(A.bearing(x, y, ox, oy)), 1).alias("bearing_deg"),
        A.relative_direction(yaw, x, y, ox, oy, "cloud").alias("spoken"),
        A.relative_direction(yaw, x, y, ox, oy, "local").alias("compact"),
        X.distance_band(dist / 10.0).alias("band"))


def turns_to_point(spark, sf):
    x, y, yaw = F.col("x"), F.col("y"), F.col("yaw")
    deg = A.relative_angle_deg(yaw, x, y, F.lit(250.0), F.lit(50.0))
    return D.poses(spark, sf).select("request_id", py_round(deg, 1).alias("turn_degrees"),
                                     A.turn_message(F.lit("centre"), deg).alias("message"))


def polygon_facts(spark, sf):
    z = SC.valid_polygons(SC.prepare_zones(D.zones(spark, sf)))
    return z.select("zord", "name", _r("area", 3).alias("area"), _r("cx", 3).alias("cx"),
                    _r("cy", 3).alias("cy"), F.size("edges").cast("long").alias("num_edges"))


def label_colors(spark, sf):
    rgb = X.label_color(F.col("label"))
    return SC.distinct_labels(D.objects(spark, sf)).select(
        "label", rgb["r"].cast("long").alias("r"), rgb["g"].cast("long").alias("g"),
        rgb["b"].cast("long").alias("b"))


def name_keys(spark, sf):
    padded = F.concat(F.lit(" \t"), F.upper("label"), F.lit("\n "))
    return D.objects(spark, sf).select("id", X.name_key(padded).alias("name_key"))


def status_texts(spark, sf):
    code = F.element_at("status_codes", -1)
    dest = F.concat(F.lit("room "), (F.col("seq") % 7).cast("string"))
    return D.nav_status(spark, sf).select(
        "seq", X.status_name(code, "cloud").alias("cloud_status"),
        X.status_name(code, "local").alias("local_status"),
        X.status_message(code, dest).alias("message"))


def log_tags(spark, sf):
    return D.debug_lines(spark, sf).select(
        "seq", X.log_tag(F.col("text")).alias("prefix_tag"),
        X.log_tag(F.concat(F.lit("robot: "), F.col("text")), "contains").alias("contained_tag"))


def text_previews(spark, sf):
    return D.turns(spark, sf).select("case_id", "turn", X.preview(F.col("content"), 150).alias("preview"))


def rounding_modes(spark, sf):
    v = F.col("l_extendedprice") * F.col("l_discount")
    return (D.table(spark, sf, "lineitem").withColumn("v", v)
            .groupBy("l_returnflag").agg(
                F.count(F.lit(1)).alias("n"),
                F.sum((_r("v", 2) * 100.0 + 0.5).cast("long")).alias("cents"),
                F.sum((_r("v", 1) * 10.0 + 0.5).cast("long")).alias("dimes")))


# -- filters, lookups ------------------------------------------------------

def filtered_objects(spark, sf):
    kept = SC.filter_objects(D.objects(spark, sf), excluded_labels=["Small Ring", "red widget"])
    return kept.select("id", "label", "confidence", "num_points")


def filtered_by_table(spark, sf):
    banned = D.table(spark, sf, "part").where("p_size = 50").select(F.col("p_name").alias("label"))
    return SC.filter_objects(D.objects(spark, sf), 0.5, 100, banned).select("id", "label")


def label_requests(spark, sf):
    """Events asking for the label of a part, in capitals and padded."""
    names = D.table(spark, sf, "part").select("p_partkey", F.concat(
        F.lit(" "), F.upper("p_name"), F.lit(" ")).alias("object_label"))
    total = names.count()
    asked = D.events(spark, sf, "event_id").withColumn("p_partkey", (F.col("event_id") * 3) % (total + total // 10))
    return asked.join(broadcast_if_small(names), "p_partkey", "left").select(
        F.lit(0).cast("long").alias("scene_id"), F.col("event_id").alias("request_id"),
        F.coalesce("object_label", F.lit("no such thing")).alias("object_label"))


def lookup_answers(spark, sf):
    answers, _ = lookup.lookup_exact(label_requests(spark, sf), published(spark, sf).objects)
    return answers.select("request_id", "label_key", "found", "count")


def lookup_matches(spark, sf):
    _, matches = lookup.lookup_exact(label_requests(spark, sf), published(spark, sf).objects)
    return matches.select("label_key", "id", "confidence")


def substring_matches(spark, sf):
    kws = _named_poses(spark, sf).select("scene_id", "keyword").distinct()
    short = kws.withColumn("keyword", F.substring("keyword", 1, 2))
    return lookup.match_substring(kws.unionByName(short), D.objects(spark, sf)).select("keyword", "label")


def destination_misses(spark, sf):
    p = published(spark, sf)
    names = lookup.name_catalogue(p.zones, p.objects).select("scene_id", F.col("dest_key").alias("key"))
    asked = _named_poses(spark, sf).withColumn(
        "name", F.when(F.col("request_id") % 2 == 0, F.col("zone_name")).otherwise(F.col("keyword")))
    return lookup.misses(asked, names, "name").select("request_id", "error", "hint")


# -- zones -----------------------------------------------------------------

def points_in_zones(spark, sf):
    index = published(spark, sf).index
    return containment.points_in_zones(D.objects(spark, sf), index).select("id", "zone_ord", "zone_name")


def poses_in_zones(spark, sf):
    """Every pose against every zone: the containment benchmark."""
    index = published(spark, sf).index
    return containment.points_in_zones(D.poses(spark, sf), index).select(
        "request_id", "zone_ord", "zone_name")


def objects_deepest_zone(spark, sf):
    index = published(spark, sf).index
    return containment.assign_zone(D.objects(spark, sf), index, ["ord"]).select(
        "id", "zone", "parent_zone", "full_path")


def poses_first_zone(spark, sf):
    index = published(spark, sf).index
    return containment.assign_zone(D.poses(spark, sf), index, ["request_id"], "first").select(
        "request_id", "zone")


def zone_parents(spark, sf):
    return H.zone_parents(SC.prepare_zones(D.zones(spark, sf))).select("zord", "name", "parent")


def zone_hierarchy(spark, sf):
    return H.zone_hierarchy(D.zones(spark, sf)).select("zord", "name", "parent", "depth", "full_path")


def zone_ancestors(spark, sf):
    return (published(spark, sf).zones.select("zord", F.posexplode("path").alias("hop", "ancestor"))
            .select("zord", (F.col("hop") + 1).cast("long").alias("hop"), "ancestor"))


def zone_children(spark, sf):
    return H.zone_children(published(spark, sf).zones).select("zord", "name", "child_ord", "child")


def zone_counts(spark, sf):
    p = published(spark, sf)
    return H.zone_counts(D.objects(spark, sf), p.zones, p.index).select(
        "zord", "num_objects", "num_direct_objects")


def zone_contents(spark, sf):
    p = published(spark, sf)
    return H.zone_contents(p.objects, p.index).select("zone_ord", "id", "label", "direct", "full_path")


def zone_names_sorted(spark, sf):
    return published(spark, sf).zones.select("name").orderBy("name")


def zone_adjacency(spark, sf):
    return J.zone_adjacency(published(spark, sf).zones, 1.0).select("a", "b")


# -- labels and scene facts ------------------------------------------------

def distinct_labels(spark, sf):
    return SC.distinct_labels(published(spark, sf).objects, lower=True).select("label")


def label_index(spark, sf):
    return SC.label_index(published(spark, sf).objects).select("label_key", "occurrences", "first_ord", "first_id")


def scene_summary(spark, sf):
    p = published(spark, sf)
    return SC.scene_summary(p.objects, p.zones)


def scene_extent(spark, sf):
    p = published(spark, sf)
    return SC.scene_extent(p.objects, p.zones)


# -- range, nearest, route, as-of ------------------------------------------

def objects_within(spark, sf):
    pairs = ranges.objects_within(D.poses(spark, sf), published(spark, sf).objects, 3.0)
    return pairs.select("request_id", "obj_id", _r("dist", 2).alias("distance"))


def objects_within_own_radius(spark, sf):
    poses = D.poses(spark, sf).withColumn("radius", (F.col("request_id") % 5).cast("double") + 0.5)
    pairs = ranges.objects_within(poses, published(spark, sf).objects, "radius")
    return pairs.select("request_id", "obj_id", _r("dist", 2).alias("distance"))


def nearby_ranked(spark, sf):
    return ranges.nearby_ranked(D.poses(spark, sf), published(spark, sf).objects, 5.0).select(
        "request_id", "rank", "obj_id", "distance", "direction")


def nearest_object(spark, sf):
    best = nearest.nearest_object(_named_poses(spark, sf), published(spark, sf).objects)
    return best.select("request_id", "keyword", "obj_ord", "obj_label", _r("dist", 2).alias("distance"))


def resolved_destinations(spark, sf):
    p = published(spark, sf)
    asked = _mixed_names(spark, sf)
    return lookup.resolve_destination(asked, p.zones, p.objects).select(
        "request_id", "destination", "kind", _r("tx", 3).alias("x"), _r("ty", 3).alias("y"))


def _mixed_names(spark, sf):
    """Even requests ask for a zone, odd ones for an object label (some unknown)."""
    labels = label_requests(spark, sf).select("request_id", "object_label")
    return (_named_poses(spark, sf).join(labels, "request_id")
            .withColumn("name", F.when(F.col("request_id") % 2 == 0, F.col("zone_name"))
                        .otherwise(F.col("object_label"))))


def _routes(spark, sf):
    p = published(spark, sf)
    return T.routes_to(_named_poses(spark, sf), p.objects, p.zones, "zone_name")


def route_objects(spark, sf):
    found = routes.route_items(routes.route_objects(_routes(spark, sf), published(spark, sf).objects))
    return found.select("request_id", "obj_ord", "obj_label", "distance_along_path_m", "side_offset_m")


def route_objects_ranked(spark, sf):
    found = routes.route_items(routes.route_objects(_routes(spark, sf), published(spark, sf).objects))
    return routes.rank_along_route(found).select("request_id", "rank", "obj_ord", "distance_along_path_m")


def route_zones(spark, sf):
    return routes.route_zones(_routes(spark, sf), published(spark, sf).zones).select(
        "request_id", "zone_ord", "zone_name")


def _late_requests(spark, sf):
    """Each event asks again 90 minutes later."""
    return D.events(spark, sf, "event_id", "user_id", "ts").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("robot_id"),
        (F.col("ts") + F.expr("interval 90 minutes")).alias("ts"))


def pose_as_of(spark, sf):
    return asof.pose_as_of(_late_requests(spark, sf), D.poses(spark, sf)).select(
        "request_id", "x", "y", _r("yaw", 6).alias("yaw"))


def matched_responses(spark, sf):
    kind = F.col("event_type")
    log = D.events(spark, sf, "event_id", "user_id", "event_type", "ts", "props")
    asks = log.where(kind.isin("signup", "click")).select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("robot_id"), "ts",
        F.lit("zone").alias("topic"), F.col("event_id").cast("string").alias("name"))
    results = log.where(~kind.isin("signup", "click")).select(
        F.col("user_id").alias("robot_id"), "ts", F.lit("zone").alias("topic"),
        F.col("props").alias("payload"))
    return asof.match_responses(asks, results, "3 hours").select(
        "request_id", "result", "error")


def arrivals_detected(spark, sf):
    goals = D.poses(spark, sf).select(
        "robot_id", (F.col("ts") - F.expr("interval 2 hours")).alias("ts"),
        F.col("x"), F.col("y"), F.concat(F.lit("goal "), F.col("request_id").cast("string")).alias("destination"))
    return arrivals.detect_arrivals(D.poses(spark, sf), goals, 60.0).select(
        "robot_id", "destination", wall_micros(F.col("arrived_ts")).alias("arrived_us"))


# -- publish path ----------------------------------------------------------

def realigned_zones(spark, sf):
    moved = _realigned(spark, sf)
    return (moved.zones.select("zord", F.posexplode("vertices").alias("i", "v"))
            .select("zord", F.col("i").cast("long").alias("i"), _r(F.col("v")[0], 3).alias("x"),
                    _r(F.col("v")[1], 3).alias("y")))


def realigned_objects(spark, sf):
    moved = _realigned(spark, sf)
    placed = SC.to_map_frame(moved.objects, moved.alignments)
    return placed.select("id", _r("x", 3).alias("map_x"), _r("y", 3).alias("map_y"))


def _realigned(spark, sf):
    whole = scenes.Scene(D.objects(spark, sf).drop("x", "y"), D.zones(spark, sf), _alignments(spark))
    target = spark.createDataFrame(
        [(0, *ESTIMATE)], "scene_id long, translate_x double, translate_y double, rotate_deg double")
    return P.realign(whole, target)


def objects_snapshot(spark, sf):
    """Published object texts, read back field by field."""
    texts = sinks.objects_snapshot(published(spark, sf).enriched)
    doc = F.from_json("json", scenes.S.PUBLISHED_OBJECT)
    return texts.withColumn("d", doc).select(
        "ord", "d.id", "d.label", "d.confidence", F.col("d.map_position.x").alias("x"),
        F.col("d.map_position.y").alias("y"), "d.location.zone", "d.location.full_path",
        F.contains("json", F.lit('"zone":null')).alias("null_written"))


def _corners(name: str):
    """Vertices as text, in hundredths; the coordinates are multiples of a quarter."""
    return F.array_join(F.transform(name, lambda v: F.concat_ws(",", *[(v[i] * 100).cast("long").cast("string") for i in (0, 1)])), ";")


def zones_snapshot(spark, sf):
    p = published(spark, sf)
    doc = F.from_json("json", scenes.S.PUBLISHED_ZONE)
    return sinks.zones_snapshot(p.zones, p.objects, p.index).withColumn("d", doc).select(
        "zord", "d.name", "d.display_name", "d.parent", "d.depth", "d.num_objects", "d.num_direct_objects",
        F.array_join("d.children", "|").alias("children"), _corners("d.vertices_world").alias("corners"))


def map_features(spark, sf):
    p = published(spark, sf)
    return sinks.map_features(p.objects, p.zones).select(
        "ns", "feature_id", _r("x", 3).alias("x"), _r("y", 3).alias("y"), _r("z", 3).alias("z"),
        _r("size", 3).alias("size"), F.col("r").cast("long").alias("r"), F.col("alpha"), "text",
        F.size("ring").cast("long").alias("ring_points"))


def parsed_payloads(spark, sf):
    """Object messages, some broken, decoded from text."""
    o = D.objects(spark, sf)
    good = F.concat(F.lit('{"objects":['), F.to_json(F.struct(
        "id", "label", "confidence", F.struct("x", "y").alias("map_position"))), F.lit("]}"))
    messages = o.select("scene_id", F.col("id").alias("message_id"), F.when(
        F.col("id") % 10 == 3, "{not json").otherwise(good).alias("payload"))
    rows, errors = scenes.parse_scene_payload(messages, "objects")
    return (rows.select("message_id", "label", "x", "y", F.lit(None).cast("string").alias("error"))
            .unionByName(errors.select("message_id", F.lit(None).cast("string").alias("label"),
                                       F.lit(None).cast("double").alias("x"),
                                       F.lit(None).cast("double").alias("y"), "error")))


def saved_alignments(spark, sf):
    """Per-robot pose estimates persisted as alignments (4, 4, 2 decimals)."""
    last = D.poses(spark, sf).withColumn("scene_id", F.col("robot_id")).groupBy("scene_id").agg(
        F.max_by(F.struct((F.col("x") / 7.0).alias("translate_x"), (F.col("y") / 7.0).alias("translate_y"),
                          A.degrees(F.col("yaw")).alias("rotate_deg")), "ts").alias("a"))
    return sinks.alignment_rows(last.select("scene_id", "a.*", F.lit(1.0).alias("scale")))


# -- tools -----------------------------------------------------------------

def robot_pose(spark, sf):
    return T.robot_pose(D.poses(spark, sf), published(spark, sf).index).select(
        "request_id", "x", "y", "yaw_deg", "frame", "current_zone", "error")


def describe_surroundings(spark, sf):
    p = published(spark, sf)
    return T.describe_surroundings(D.poses(spark, sf), p.objects, p.index).select(
        "request_id", "current_zone", "obj_ord", "label", "distance", "direction")


def surroundings_counts(spark, sf):
    p = published(spark, sf)
    rows = T.describe_surroundings(D.poses(spark, sf), p.objects, p.index, dialect="local")
    return T.surroundings_counts(rows).select("request_id", "count", "current_zone")


def find_nearest(spark, sf):
    p = published(spark, sf)
    return T.find_nearest(_named_poses(spark, sf), p.objects, p.index).select(
        "request_id", "label", "distance_m", "direction", "zone", "error")


def distance_to(spark, sf):
    p = published(spark, sf)
    return T.distance_to(_mixed_names(spark, sf), p.objects, p.zones)


def describe_route(spark, sf):
    """Route answers as rows: one per zone and one per object on the way."""
    p = published(spark, sf)
    _, met, passed = T.describe_route(_named_poses(spark, sf), p.objects, p.zones, "zone_name")
    none = F.lit(None).cast("double")
    return met.select("request_id", F.lit("zone").alias("kind"), F.col("zone_ord").alias("ord"),
                      F.col("zone").alias("name"), none.alias("distance_along_path_m"),
                      none.alias("side_offset_m")).unionByName(
        passed.select("request_id", F.lit("object").alias("kind"), F.col("obj_ord").alias("ord"),
                      F.col("label").alias("name"), "distance_along_path_m", "side_offset_m"))


def route_summaries(spark, sf):
    p = published(spark, sf)
    answers, _, _ = T.describe_route(_named_poses(spark, sf), p.objects, p.zones, "zone_name")
    return answers.select("request_id", "destination", "total_distance_m", "direction")


def orient(spark, sf):
    p = published(spark, sf)
    return T.orient(_named_poses(spark, sf), p.objects, p.zones, "zone_name").select(
        "request_id", "target", "direction_from_current", "turn_degrees", "message", "goal_destination")


def goals_for_zones(spark, sf):
    p = published(spark, sf)
    return T.goal_for_zone(_named_poses(spark, sf), p.zones).select(
        "request_id", "zone", "goal_x", "goal_y", _r("goal_yaw", 6).alias("goal_yaw"),
        _r("goal_qz", 6).alias("goal_qz"), _r("goal_qw", 6).alias("goal_qw"))


def goals_for_objects(spark, sf):
    p = published(spark, sf)
    asked = _mixed_names(spark, sf)
    return T.goal_for_object(asked, p.objects, "name", "local").select(
        "request_id", "success", "object", "goal_x", "goal_y", "goal_yaw", "error", "hint")


def list_zones(spark, sf):
    return T.list_zones(published(spark, sf).zones).select(
        "zord", "name", "display_name", "parent", "child_ord", "child")


def list_objects(spark, sf):
    return T.list_objects(published(spark, sf).objects).select("label")


def query_zone(spark, sf):
    p = published(spark, sf)
    answers, _ = T.query_zone(_named_poses(spark, sf), p.objects, p.zones, p.index)
    return answers.select("request_id", "found", "zone", "display_name", "parent", "depth", "num_objects",
                          "num_direct_objects", F.array_join("children", "|").alias("children"),
                          _corners("vertices").alias("corners"))


def query_zone_contents(spark, sf):
    p = published(spark, sf)
    _, contents = T.query_zone(_named_poses(spark, sf), p.objects, p.zones, p.index)
    return contents.select("zone_ord", "id", "label", "x", "y", "full_path", "direct")


def query_object(spark, sf):
    p = published(spark, sf)
    answers, _ = T.query_object(label_requests(spark, sf), p.objects, p.index)
    return answers.select("request_id", "found", "count")


def query_object_matches(spark, sf):
    p = published(spark, sf)
    _, matches = T.query_object(label_requests(spark, sf), p.objects, p.index)
    return matches.select("label_key", "id", "x", "y", "confidence", "zone", "parent_zone", "full_path")


def zones_report(spark, sf):
    p = published(spark, sf)
    return T.zones_report(p.objects, p.zones, p.index).select(
        "zord", "name", "display_name", "parent", "depth", "num_objects", "num_direct_objects",
        F.array_join("children", "|").alias("children"), _corners("vertices").alias("corners"))


def _goal_log(spark, sf):
    """A goal two hours before every event of its robot."""
    return _named_poses(spark, sf).select(
        "robot_id", (F.col("ts") - F.expr("interval 2 hours")).alias("ts"), "x", "y",
        F.col("zone_name").alias("destination"))


def navigation_status(spark, sf):
    return T.navigation_status(_late_requests(spark, sf), D.nav_status(spark, sf), _goal_log(spark, sf))


def latest_status(spark, sf):
    return T.latest_status(D.nav_status(spark, sf))


def cancellations(spark, sf):
    asked = _requests(spark, sf).withColumn("tool", F.when(
        F.col("tool") == "query_zone", "cancel_navigation").otherwise(F.col("tool")))
    return T.cancellations(asked).select("request_id", "robot_id", "status_code", "success", "message")


def last_log_lines(spark, sf):
    return logs.last_n_log(D.debug_lines(spark, sf)).select("robot_id", "seq", "text")


def log_counts(spark, sf):
    return logs.log_counts(D.debug_lines(spark, sf))


def utterances(spark, sf):
    said = D.table(spark, sf, "conversations").where("role = 'user'").select(
        "conv_id", "turn", F.when(F.col("turn") % 3 == 1, " \n\t").otherwise(
            F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("text"))
    return logs.nonblank_utterances(said).select("conv_id", "turn", F.col("text"))


def request_arguments(spark, sf):
    broken = F.when(F.col("request_id") % 11 == 0, F.lit("{oops")).otherwise(F.col("args"))
    args = dispatch.parse_arguments(broken)
    return _requests(spark, sf).select(
        "request_id", F.try_element_at(args, F.lit("object_type")).alias("object_type"),
        F.try_element_at(args, F.lit("destination")).alias("destination"),
        F.try_element_at(args, F.lit("zone_name")).alias("zone_name"),
        F.size(args).cast("long").alias("num_args"))


def _answers(spark, sf, tools=tuple(D.TOOL_OF_EVENT.values())):
    asked = _requests(spark, sf).withColumn("args", F.when(
        F.col("request_id") % 50 == 7, "{oops").otherwise(F.col("args"))).withColumn(
        "tool", F.when(F.col("request_id") % 97 == 5, "fly").otherwise(F.col("tool")))
    return asked, dispatch.answer_requests(
        asked, D.poses(spark, sf), published(spark, sf), D.nav_status(spark, sf), _goal_log(spark, sf),
        tools=tools)


def answered_requests(spark, sf):
    """Mixed requests through dispatch; scalar fields read back from the answers."""
    _, got = _answers(spark, sf)
    field = lambda p: F.get_json_object("result_json", p)
    return got.headers.select(
        "request_id", "tool", "error", field("$.label").alias("label"),
        field("$.destination").alias("destination"), field("$.direction").alias("direction"),
        field("$.current_zone").alias("current_zone"), field("$.zone.name").alias("zone"),
        field("$.count").cast("long").alias("count"))


def answer_items(spark, sf):
    """List parts of the answers: rows and positions per section."""
    _, got = _answers(spark, sf)
    return got.items.groupBy("section").agg(F.count(F.lit(1)).alias("items"),
                                            F.countDistinct("items_key").alias("answers"))


def answer_documents(spark, sf):
    """Whole JSON answers: list lengths counted from the texts."""
    _, got = _answers(spark, sf)
    docs = dispatch.documents(got)
    size = lambda p: F.json_array_length(F.get_json_object("result_json", p)).cast("long")
    return docs.select("request_id", size("$.nearby_objects").alias("nearby"),
                       size("$.zones_along_path").alias("zones"),
                       size("$.objects_along_path").alias("objects"))


def _whole_answers(spark, sf, dialect):
    asked = D.all_tool_requests(_mixed_names(spark, sf))
    got = dispatch.documents(dispatch.answer_requests(asked, D.poses(spark, sf), published(spark, sf), D.nav_status(spark, sf),
                                                      _goal_log(spark, sf), dialect))
    return got.select("request_id", "tool", "result_json").join(
        dispatch.debug_lines(asked, got).select("request_id", F.col("text").alias("line")), "request_id")


def whole_answers(spark, sf):
    """All tools through dispatch: whole JSON texts and whole log lines."""
    return _whole_answers(spark, sf, "cloud")


def whole_answers_local(spark, sf):
    return _whole_answers(spark, sf, "local")


def debug_lines(spark, sf):
    asked, got = _answers(spark, sf, ("find_nearest",))
    return dispatch.debug_lines(asked, got.headers.where("tool = 'find_nearest'")).select(
        "request_id", F.substring_index("text", " -> ", 1).alias("call"))


def pose_log_lines(spark, sf):
    poses = T.robot_pose(D.poses(spark, sf), published(spark, sf).index)
    return dispatch.pose_lines(poses)


def goal_log_lines(spark, sf):
    goals = T.goal_for_zone(_named_poses(spark, sf), published(spark, sf).zones, dialect="local")
    return dispatch.goal_lines(goals)


# -- conversations ---------------------------------------------------------

def conversation_history(spark, sf):
    t = D.turns(spark, sf)
    extra = t.where("turn = 0").select("case_id", (F.col("turn") - 1).alias("turn"), "role", "content")
    return EV.conversation_history(t, extra).select(
        "case_id", F.col("part").cast("long").alias("part"), "turn", "role", "content")


def content_blocks(spark, sf):
    t = D.turns(spark, sf).where("role = 'assistant'")
    blocks = F.to_json(F.array(
        F.struct(F.lit("text").alias("type"), F.col("content").alias("text"),
                 F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"),
                 F.col("case_id").cast("string").alias("id"), F.lit("list_zones").alias("name")),
        F.struct(F.lit("text").alias("type"), F.lit("done").alias("text"),
                 F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"))))
    split = EV.content_blocks(t.select("case_id", "turn", blocks.alias("content")))
    return split.select("case_id", "turn", "text", F.size("tool_calls").cast("long").alias("num_calls"),
                        F.col("tool_calls")[0]["name"].alias("first_call"))


def tool_calls(spark, sf):
    return EV.extract_tool_calls(D.turns(spark, sf)).select(
        "case_id", "turn", F.col("round").cast("long").alias("round"),
        F.col("call_no").cast("long").alias("call_no"), "id", "name", "arguments")


def tool_results(spark, sf):
    calls = EV.extract_tool_calls(D.turns(spark, sf))
    return EV.attach_tool_results(calls, D.cases(spark, sf)).select("case_id", "turn", "name", "result")


def final_texts(spark, sf):
    return EV.final_text(D.turns(spark, sf))


def scored_cases(spark, sf):
    return EV.score_cases(D.turns(spark, sf), D.cases(spark, sf)).select(
        "case_id", "category", "passed", F.size("issues").cast("long").alias("num_issues"),
        F.array_join("issues", " | ").alias("issues"))


def eval_report(spark, sf):
    return EV.eval_report(D.turns(spark, sf), D.cases(spark, sf)).select(
        "scope", "category", "passed", "failed", "total", _r("percent", 1).alias("percent"))


# -- live state (batch form of the streams) --------------------------------

def live_pose_zone(spark, sf):
    last = D.poses(spark, sf).groupBy("robot_id").agg(
        F.max_by(F.struct("scene_id", "x", "y", "yaw"), "ts").alias("p")).select("robot_id", "p.*")
    return T.robot_pose(last, published(spark, sf).index, key=("robot_id",)).select(
        "robot_id", "x", "y", "yaw_deg", "current_zone")


# -- streams, several micro-batches to the end of the event log ------------------------------

def _stream_folder(spark) -> str:
    """A new folder next to the session's checkpoints."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _played(spark, topics, start, batches=3):
    """Topics kept as files, filled part after part (``_batch``); the stream is started again after each part, from its checkpoint."""
    folder = _stream_folder(spark)
    table = BatchTable(spark, f"{folder}/table")
    for k in range(batches):
        for kind, rows in topics.items():
            rows.where(F.col("_batch") == k).drop("_batch").write.mode("append").parquet(f"{folder}/{kind}")
        feeds = {kind: scenes.read_stream(spark, kind, f"{folder}/{kind}") for kind in topics}
        start(feeds, table, f"{folder}/progress").awaitTermination()
    return table


def _mixed():
    """Batches in which times are mixed: later ones hold earlier times."""
    return (F.col("event_id") % 3).cast("int").alias("_batch")


def _by_time(spark, sf):
    """Batches in the order of time: thirds of the log's span."""
    low, high = D.table(spark, sf, "events").agg(F.min(wall_micros(F.col("ts"))), F.max(wall_micros(F.col("ts")))).first()
    span = max(1, (high or 0) - (low or 0))
    return F.least(F.lit(2), F.floor((wall_micros(F.col("ts")) - F.lit(low or 0)) * 3 / F.lit(span)).cast("int")).alias("_batch")


def _at():
    return F.col("ts").cast("timestamp").alias("ts")


def _messages(spark, sf):
    return D.events(spark, sf, "event_id", "user_id", "ts", "props").select(
        F.col("user_id").alias("scene_id"), F.lit("props").alias("topic"), _at(), F.col("props").alias("payload"), _mixed())


def stream_latched_state(spark, sf):
    """Last message per topic, one topic per robot, over batches of mixed times."""
    table = _played(spark, {"message": _messages(spark, sf)}, lambda f, t, c: jobs.latched_state(f["message"], t, c, available_now=True))
    return table.latest("scene_id", "topic").select("scene_id", "payload")


def stream_first_receipt(spark, sf):
    """The first message of each topic to arrive, whatever the times of later batches."""
    table = _played(spark, {"message": _messages(spark, sf)}, lambda f, t, c: jobs.latched_state(f["message"], t, c, True, available_now=True))
    return table.read().select("scene_id", "payload")


def _pose_messages(spark, sf, batch):
    zero, half = F.lit(0.0), F.col("yaw_deg") * A.DEG_TO_RAD / 2.0
    return D.poses(spark, sf).withColumn("event_id", F.col("request_id")).select(
        "scene_id", "robot_id", _at(), "x", "y", zero.alias("qx"), zero.alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"), batch)


def stream_pose_zone(spark, sf):
    index = published(spark, sf).index
    table = _played(spark, {"pose": _pose_messages(spark, sf, _mixed())}, lambda f, t, c: jobs.live_pose_zone(f["pose"], index, t, c, available_now=True))
    return table.latest("robot_id").select("robot_id", "x", "y", F.col("zone").alias("current_zone"))


def stream_statuses(spark, sf):
    """The last status code of each robot, over batches of mixed times."""
    rows = D.nav_status(spark, sf).withColumn("event_id", F.col("seq")).select("robot_id", _at(), "status_codes", _mixed())
    table = _played(spark, {"status": rows}, lambda f, t, c: jobs.latest_statuses(f["status"], t, c, available_now=True))
    return table.latest("robot_id").select("robot_id", "status_code")


def stream_log_ring(spark, sf):
    rows = D.debug_lines(spark, sf).withColumn("event_id", F.col("seq")).select("robot_id", _at(), "seq", "text", _mixed())
    table = _played(spark, {"debug": rows}, lambda f, t, c: jobs.log_ring(f["debug"], t, c, available_now=True))
    return table.latest("robot_id").select("robot_id", "seq", "text")


def stream_arrivals(spark, sf):
    """Goals two hours before every pose, both topics in the order of time."""
    batch = _by_time(spark, sf)
    poses = _pose_messages(spark, sf, batch)
    goals = (D.poses(spark, sf).withColumn("ts", F.col("ts") - F.expr("interval 2 hours"))
             .select("robot_id", _at(), "x", "y", "yaw", F.concat(F.lit("goal "), F.col("request_id").cast("string")).alias("destination"), batch)
             .withColumn("_batch", F.greatest(F.lit(0), "_batch")))

    def start(feeds, table, progress):
        columns = ("robot_id", "ts", "kind", "x", "y", "destination")
        both = (feeds["pose"].withColumns({"kind": F.lit("pose"), "destination": F.lit(None).cast("string")}).select(*columns)
                .unionByName(feeds["goal"].withColumn("kind", F.lit("goal")).select(*columns)))
        return jobs.arrival_stream(both, table, progress, 60.0, available_now=True)
    return _played(spark, {"pose": poses, "goal": goals}, start).read().select(
        "robot_id", "destination", wall_micros(F.col("arrived_ts").cast("timestamp_ntz")).alias("arrived_us"))


def stream_timeouts(spark, sf):
    """Requests and results as two topics; two last messages of no robot move the watermarks past all others."""
    kind = F.col("event_type")
    log = D.events(spark, sf, "event_id", "user_id", "event_type", "ts", "props")
    batch = _by_time(spark, sf)
    ends = spark.range(2).select(F.lit(-1).cast("long").alias("robot_id"), F.col("id"), (F.col("id") + 3).cast("int").alias("_batch"))
    last = log.agg(F.max("ts").cast("timestamp").alias("ts"))
    ends = ends.withColumn("_all", F.lit(0)).join(last.withColumn("_all", F.lit(0)), "_all").withColumn(
        "ts", F.col("ts") + F.make_interval(days=(F.col("id") + 1).cast("int")))
    asks = log.where(kind.isin("signup", "click")).select(
        F.col("event_id").alias("request_id"), F.lit(0).cast("long").alias("scene_id"), F.col("user_id").alias("robot_id"), _at(), F.lit("query_zone").alias("tool"),
        F.lit(None).cast("string").alias("args"), batch)
    results = log.where(~kind.isin("signup", "click")).select(
        F.col("user_id").alias("scene_id"), F.lit("zone").alias("topic"), _at(), F.col("props").alias("payload"), batch)
    asks = asks.unionByName(ends.select((-F.col("id") - 1).alias("request_id"), "robot_id", "ts", "_batch"), allowMissingColumns=True)
    results = results.unionByName(ends.select(F.col("robot_id").alias("scene_id"), F.lit("zone").alias("topic"), "ts", "_batch"), allowMissingColumns=True)

    def start(feeds, table, progress):
        return jobs.timed_out_requests(feeds["request"].withColumn("topic", F.lit("zone")), feeds["message"].withColumnRenamed("scene_id", "robot_id"),
                                       table, progress, "3 hours", "1 minute", available_now=True)
    got = _played(spark, {"request": asks, "message": results}, start, batches=5).read().where("robot_id >= 0")
    return got.select("request_id", "result", F.when(F.col("result").isNull(), F.concat(
        F.lit("Timeout waiting for zone query result for '"), F.col("request_id").cast("string"), F.lit("'"))).alias("error"))


def stream_realigned(spark, sf):
    """The scene under the last estimate of a stream of estimates, robots in turn."""
    whole = scenes.Scene(D.objects(spark, sf).drop("x", "y"), D.zones(spark, sf), _alignments(spark))
    x, y, deg = ESTIMATE
    half = math.radians(deg) / 2.0
    last = F.max("ts").over(Window.partitionBy())
    newest = D.table(spark, sf, "events").select("ts").orderBy(F.desc("ts")).limit(3)
    rows = newest.select(F.lit(0).cast("long").alias("scene_id"), F.lit(1).cast("long").alias("robot_id"), _at(),
                         (F.lit(x) + F.when(F.col("ts") == last, 0.0).otherwise(1.0)).alias("x"), F.lit(y).alias("y"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"),
                         F.lit(math.sin(half)).alias("qz"), F.lit(math.cos(half)).alias("qw"), F.when(F.col("ts") == last, 1).otherwise(0).alias("_batch"))
    spots = {}

    def start(feeds, table, progress):
        spots["objects"] = BatchTable(spark, f"{table.path}/objects")
        return jobs.realign_stream(feeds["pose"], whole, spots["objects"], BatchTable(spark, f"{table.path}/zones"), progress, available_now=True,
                                   min_confidence=-1.0, min_points=-1)
    _played(spark, {"pose": rows}, start, batches=2)
    return spots["objects"].latest().select("id", _r("x", 3).alias("map_x"), _r("y", 3).alias("map_y"))


def stream_answers(spark, sf):
    """Requests answered as they arrive, each with the last pose, status and goal of its robot: scalar fields of the answers."""
    batch = _by_time(spark, sf)
    asked = _requests(spark, sf).select("request_id", "scene_id", "robot_id", _at(), "tool", "args", batch)
    status = D.nav_status(spark, sf).select("robot_id", _at(), "status_codes", batch)
    goals = _goal_log(spark, sf).withColumn("yaw", F.lit(0.0)).select("robot_id", _at(), "x", "y", "yaw", "destination", batch).withColumn(
        "_batch", F.greatest(F.lit(0), "_batch"))
    scene, out = published(spark, sf), _stream_folder(spark)

    def start(feeds, table, progress):
        yaw = A.yaw_from_quaternion(*[F.col(c) for c in ("qx", "qy", "qz", "qw")])
        events = jobs.robot_events(feeds["pose"].withColumn("yaw", yaw), feeds["status"], feeds["goal"], feeds["request"])
        return jobs.answer_stream(events, scene, out, progress, tools=("distance_to", "describe_surroundings"), available_now=True)
    _played(spark, {"pose": _pose_messages(spark, sf, batch), "status": status, "goal": goals, "request": asked}, start)
    field = lambda p: F.get_json_object("result_json", p)
    return spark.read.parquet(f"{out}/headers").select(
        "request_id", "tool", field("$.destination").alias("destination"), field("$.direction").alias("direction"),
        field("$.current_zone").alias("current_zone"), field("$.count").cast("long").alias("count"))


# -- journeys --------------------------------------------------------------

def journey_status(spark, sf):
    """Orders as journeys of three to seven rooms, every second room a stop."""
    n = F.col("n")
    way = (D.table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(
                F.lit(1), (F.col("o_orderkey") % 5 + 3).cast("int"))).alias("n"))
           .select(F.col("o_orderkey").alias("journey_id"), (n - 1).alias("idx"),
                   F.concat(F.lit("enter room "), n.cast("string")).alias("action"),
                   (n % 2 == 0).alias("is_stop"), F.concat(F.lit("room "), n.cast("string")).alias("stop")))
    progress = D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("journey_id"), (F.col("o_orderkey") % 4).alias("current_waypoint"))
    return J.journey_status(way, progress).select(
        "journey_id", "status", "progress_percent", "current_stop", "total_stops", "narration")


def planned_journeys(spark, sf):
    """Two-stop journeys between the zones of three consecutive requests."""
    p = published(spark, sf)
    z = D.zone_places(p.zones.select("zord", "name"))
    asked = D.events(spark, sf, "event_id").select(
        F.col("event_id").alias("journey_id"), F.lit(0).cast("long").alias("scene_id"),
        *[(F.col("event_id") * k).alias(f"z{k}") for k in (1, 3, 7)])
    for k in (1, 3, 7):
        asked = D.with_zone_name(asked, z, f"z{k}").withColumnRenamed("zone_name", f"n{k}")
    trips = asked.select("journey_id", "scene_id", F.col("n1").alias("start_zone"),
                         F.array("n3", "n7").alias("destinations"))
    return J.plan_journeys(trips, p.zones, J.zone_adjacency(p.zones, 3.0)).select(
        "journey_id", "stop_no", "hop", "zone", "is_stop", "error")


QUERIES = {f.__name__: f for f in (
    project_align, inverse_align, quaternions, pose_directions, turns_to_point, polygon_facts,
    label_colors, name_keys, status_texts, log_tags, text_previews, rounding_modes,
    filtered_objects, filtered_by_table, lookup_answers, lookup_matches, substring_matches,
    destination_misses, points_in_zones, poses_in_zones, objects_deepest_zone, poses_first_zone, zone_parents,
    zone_hierarchy, zone_ancestors, zone_children, zone_counts, zone_contents, zone_names_sorted,
    zone_adjacency, distinct_labels, label_index, scene_summary, scene_extent, objects_within,
    objects_within_own_radius, nearby_ranked, nearest_object, resolved_destinations, route_objects,
    route_objects_ranked, route_zones, pose_as_of, matched_responses, arrivals_detected,
    realigned_zones, realigned_objects, objects_snapshot, zones_snapshot, map_features,
    parsed_payloads, saved_alignments, robot_pose, describe_surroundings, surroundings_counts,
    find_nearest, distance_to, describe_route, route_summaries, orient, goals_for_zones,
    goals_for_objects, list_zones, list_objects, query_zone, query_zone_contents, query_object,
    query_object_matches, zones_report, navigation_status, latest_status, cancellations,
    last_log_lines, log_counts, utterances, request_arguments, answered_requests, answer_items,
    answer_documents, whole_answers, whole_answers_local, debug_lines, pose_log_lines, goal_log_lines, conversation_history, content_blocks, tool_calls, tool_results,
    final_texts, scored_cases, eval_report, live_pose_zone, stream_latched_state, stream_first_receipt, stream_pose_zone,
    stream_statuses, stream_log_ring, stream_arrivals, stream_timeouts, stream_realigned, stream_answers, journey_status, planned_journeys)}
