"""The question catalogue: each tool answers a whole table of requests.

Requests that depend on the robot carry its pose as x, y, yaw (see
``pose_as_of``); an unknown pose gives an error row.  List answers are rows, one
per list element, with the columns that order them; nothing is packed into one
row per request.  ``dialect`` selects the two output vocabularies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions import angles as A, geometry as G
from sceneframe.functions.rounding import py_round
from sceneframe.functions.text import name_key, status_message, status_name
from sceneframe.operators.asof import as_of
from sceneframe.operators.containment import ZoneIndex, assign_zone
from sceneframe.operators.hierarchy import with_children, zone_children, zone_contents, zone_counts
from sceneframe.operators.lookup import first_named, lookup_exact, resolve_destination
from sceneframe.operators.nearest import nearest_object
from sceneframe.operators.ranges import nearby_items, objects_within
from sceneframe.operators.routes import route_items, route_objects, route_zones
from sceneframe.operators.scale import broadcast_if_small
from sceneframe.operators.scene import distinct_labels

DEFAULT_RADIUS = 3.0
NO_POSE = "Cannot get robot pose"
NAMES_HINT = "Use list_zones or list_objects to see available names."


def _xy():
    return F.col("x"), F.col("y"), F.col("yaw")


def has_scene(requests: DataFrame, table: DataFrame, flag: str) -> DataFrame:
    """Flag requests whose scene has any row in ``table``."""
    known = table.select(F.col("scene_id").alias("_s")).distinct().withColumn(flag, F.lit(True))
    return (requests.join(broadcast_if_small(known), F.col("scene_id") == F.col("_s"), "left")
            .drop("_s").withColumn(flag, F.coalesce(flag, F.lit(False))))


def _not_found(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"{kind} '"), name, F.lit("' not found."))


def robot_pose(located: DataFrame, index: ZoneIndex, frame: str = "map",
               key=("request_id",), base_frame: str = "base_link") -> DataFrame:
    """Rounded pose and the first zone holding it."""
    x, y, yaw = _xy()
    zoned = assign_zone(located, index, key, "first", take={"name": "current_zone"})
    missing = x.isNull()
    return zoned.select(
        *key, py_round(x, 3).alias("x"), py_round(y, 3).alias("y"),
        py_round(A.degrees(yaw), 1).alias("yaw_deg"), F.lit(frame).alias("frame"), "current_zone",
        F.when(missing, NO_POSE).alias("error"),
        F.when(missing, f"Is SLAM running? Expecting TF: {frame} -> {base_frame}").alias("hint"))


def describe_surroundings(located: DataFrame, objects: DataFrame, index: ZoneIndex,
                          radius=DEFAULT_RADIUS, dialect: str = "cloud",
                          key=("request_id",)) -> DataFrame:
    """One row per nearby object; a request with none keeps one row of nulls.

    Locating the pose and probing the objects are both lookups per pose.  Read a
    request's objects in order of distance, obj_ord.  The cloud dialect takes a
    missing object position as the origin.
    """
    if dialect == "cloud":
        objects = objects.withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn(
            "y", F.coalesce("y", F.lit(0.0)))
    carried = [*key, "scene_id", "x", "y", "yaw", *([radius] if isinstance(radius, str) else [])]
    slim = located.select(*dict.fromkeys(carried))
    zoned = assign_zone(slim, index, key, "first", take={"name": "current_zone"})
    if dialect == "local":
        zoned = has_scene(zoned, objects, "_objects")
    rows = nearby_items(objects_within(zoned, objects, radius, "left"), dialect)
    distance = "distance" if dialect == "cloud" else "distance_m"
    error = F.when(F.col("x").isNull(), NO_POSE)
    if dialect == "local":
        error = error.when(~F.col("_objects"), "No object data available")
    return rows.select(*key, "scene_id", "current_zone", F.col("obj_label").alias("label"),
                       distance, "direction", "obj_ord", error.alias("error"))


def surroundings_counts(rows: DataFrame, key=("request_id",)) -> DataFrame:
    """Objects per request, with its zone and error.

    Texts can't be kept in a hash table of aggregates, so the pairs are counted with the texts as keys, next to
    the join; only the few rows that are left are put in order.
    """
    counted = rows.groupBy(*key, "current_zone", "error").agg(F.count("obj_ord").alias("_n"))
    return counted.groupBy(*key).agg(F.sum("_n").alias("count"), F.first("current_zone").alias("current_zone"),
                                     F.first("error").alias("error"))


def find_nearest(located: DataFrame, objects: DataFrame, index: ZoneIndex,
                 keyword: str = "keyword", dialect: str = "cloud",
                 key=("request_id",)) -> DataFrame:
    """Nearest object whose label contains the keyword, with direction and zone."""
    slim = located.select(*dict.fromkeys([*key, "scene_id", "x", "y", "yaw", keyword]))
    best = nearest_object(slim, objects, key, keyword)
    zoned = assign_zone(best, index, key, "first", "ox", "oy", {"name": "zone"})
    x, y, yaw = _xy()
    flagged = A.with_direction(has_scene(zoned, objects, "_objects"), "direction", yaw, x, y, F.col("ox"), F.col("oy"), dialect)
    none = F.col("obj_ord").isNull()
    error = (F.when(~F.col("_objects"), "No object data available").when(x.isNull(), NO_POSE)
             .when(none, F.concat(F.lit("No objects matching '"), F.col(keyword), F.lit("' found."))))
    return flagged.select(
        *key, F.col("obj_label").alias("label"), py_round(F.col("dist"), 2).alias("distance_m"),
        F.when(~none, F.col("direction")).alias("direction"),
        "zone", error.alias("error"),
        F.when(F.col("_objects") & x.isNotNull() & none,
               "Use list_objects to see available labels.").alias("hint"))


def _resolved(located, objects, zones, name, key):
    slim = located.select(*dict.fromkeys([*key, "scene_id", "x", "y", "yaw", name]))
    return resolve_destination(slim, zones, objects, name)


def _errors(kind: str, name: str) -> list[Column]:
    lost, unknown = F.col("x").isNull(), F.col("destination").isNull()
    # a zone without vertices has no centre
    empty = (F.col("kind") == "zone") & F.col("tx").isNull()
    return [F.when(lost, NO_POSE).when(unknown, _not_found(kind, F.col(name)))
            .when(empty, "division by zero").alias("error"),
            F.when(~lost & unknown, NAMES_HINT).alias("hint")]


def distance_to(located: DataFrame, objects: DataFrame, zones: DataFrame, name: str = "name",
                dialect: str = "cloud", key=("request_id",)) -> DataFrame:
    x, y, yaw = _xy()
    tx, ty, ok = F.col("tx"), F.col("ty"), F.col("x").isNotNull()
    return _resolved(located, objects, zones, name, key).select(
        *key, F.when(ok, F.col("destination")).alias("destination"),
        F.when(ok, F.col("kind")).alias("destination_type"),
        py_round(G.distance(x, y, tx, ty), 2).alias("distance_m"),
        A.relative_direction(yaw, x, y, tx, ty, dialect).alias("direction"),
        *_errors("Destination", name))


def routes_to(located: DataFrame, objects: DataFrame, zones: DataFrame, name: str = "name",
              key=("request_id",)) -> DataFrame:
    """Straight routes (ax, ay)-(bx, by) of the requests with a known end."""
    return (_resolved(located, objects, zones, name, key)
            .where("tx is not null and x is not null")
            .select(*key, "scene_id", F.col("x").alias("ax"), F.col("y").alias("ay"),
                    F.col("tx").alias("bx"), F.col("ty").alias("by")))


def describe_route(located: DataFrame, objects: DataFrame, zones: DataFrame, name: str = "name",
                   width: float = 2.0, dialect: str = "cloud", key=("request_id",)):
    """(answers, zones_along_path, objects_along_path).

    Zones are read in order of zone_ord (list order, not path order), objects in
    order of distance_along_path_m, obj_ord.
    """
    answers = distance_to(located, objects, zones, name, dialect, key).select(
        *key, "destination", F.col("distance_m").alias("total_distance_m"), "direction", "error", "hint")
    routes = routes_to(located, objects, zones, name, key)
    met = route_zones(routes, zones).select(*key, "zone_ord", F.col("zone_name").alias("zone"))
    passed = route_items(route_objects(routes, objects, width)).select(
        *key, "obj_ord", F.col("obj_label").alias("label"), "distance_along_path_m", "side_offset_m")
    return answers, met, passed


def orient(located: DataFrame, objects: DataFrame, zones: DataFrame, name: str = "name",
           dialect: str = "cloud", key=("request_id",)) -> DataFrame:
    """Turn towards a target, with the goal pose it produces."""
    x, y, yaw = _xy()
    tx, ty, ok = F.col("tx"), F.col("ty"), F.col("x").isNotNull() & F.col("destination").isNotNull()
    deg = A.relative_angle_deg(yaw, x, y, tx, ty)
    return (_resolved(located, objects, zones, name, key).withColumn("_deg", deg)
            .withColumn("_goal_yaw", A.bearing(x, y, tx, ty))
            .select(*key, F.when(ok, F.col("destination")).alias("target"),
                    A.relative_direction(yaw, x, y, tx, ty, dialect).alias("direction_from_current"),
                    py_round(F.col("_deg"), 1).alias("turn_degrees"),
                    F.when(ok, A.turn_message(F.col("destination"), F.col("_deg"))).alias("message"),
                    F.when(ok, x).alias("goal_x"), F.when(ok, y).alias("goal_y"),
                    F.col("_goal_yaw").alias("goal_yaw"),
                    F.when(ok, F.concat(F.lit("orient:"), F.col("destination"))).alias("goal_destination"),
                    *_errors("Target", name)))


def _goal(located, table, what, column, name, tx, ty, order, dialect, key):
    slim = located.select(*dict.fromkeys([*key, "scene_id", "x", "y", "yaw", name]))
    found = first_named(slim, table, name, column, order,
                        {column: "destination", tx: "gx", ty: "gy"})
    flagged = has_scene(found, table, "_data")
    kind = what.lower()
    bearing = A.bearing(F.col("x"), F.col("y"), F.col("gx"), F.col("gy"))
    yaw = bearing if dialect == "cloud" else F.when(F.col("found"), 0.0)
    q = A.quaternion_from_yaw(F.col("goal_yaw"))
    listing = "list_zones" if kind == "zone" else "list_objects"
    noun = {("zone", "cloud"): "names", ("zone", "local"): "zone names",
            ("object", "cloud"): "labels", ("object", "local"): "object labels"}[kind, dialect]
    advice = f"Use {listing} to see available {noun}."
    base = _not_found(what, F.col(name))
    absent = F.concat(base, F.lit(f" {advice}")) if dialect == "cloud" else base
    hint = F.lit(None).cast("string") if dialect == "cloud" else F.when(
        F.col("_data") & ~F.col("found"), advice)
    return flagged.withColumn("goal_yaw", yaw).select(
        *key, F.col("found").alias("success"), F.col("destination").alias(kind),
        py_round(F.col("gx"), 3).alias("goal_x"), py_round(F.col("gy"), 3).alias("goal_y"),
        "goal_yaw", F.when(F.col("found"), q["z"]).alias("goal_qz"),
        F.when(F.col("found"), q["w"]).alias("goal_qw"),
        F.when(~F.col("_data"), f"No {kind} data available")
        .when(~F.col("found"), absent)
        .when(F.col("gx").isNull(), "division by zero").alias("error"), hint.alias("hint"))


def goal_for_zone(located: DataFrame, zones: DataFrame, name: str = "zone_name",
                  dialect: str = "cloud", key=("request_id",)) -> DataFrame:
    """Goal pose at the vertex mean of the first zone of that name."""
    return _goal(located, zones, "Zone", "name", name, "cx", "cy", "zord", dialect, key)


def goal_for_object(located: DataFrame, objects: DataFrame, name: str = "object_label",
                    dialect: str = "cloud", key=("request_id",)) -> DataFrame:
    """Goal pose at the first object with that label."""
    return _goal(located, objects, "Object", "label", name, "x", "y", "ord", dialect, key)


def list_zones(hierarchy: DataFrame) -> DataFrame:
    """One row per (zone, child); zones without children keep one row."""
    kids = zone_children(hierarchy).select("scene_id", "zord", "child_ord", "child")
    return (hierarchy.select("scene_id", "zord", "name", F.col("full_path").alias("display_name"),
                             F.nullif(F.col("parent"), F.lit("")).alias("parent"))
            .join(kids, ["scene_id", "zord"], "left"))


def list_objects(objects: DataFrame) -> DataFrame:
    return distinct_labels(objects)


def query_zone(requests: DataFrame, objects: DataFrame, hierarchy: DataFrame, index: ZoneIndex,
               name: str = "zone_name", key=("request_id",)):
    """(answers, contents) for zone reports.

    ``answers`` has one row per request with the zone's facts and counts (the last
    zone wins among equal names); ``contents`` lists the objects of every zone
    asked for, once per zone and not once per request.
    """
    counted = with_children(zone_counts(objects, hierarchy, index))
    slim = requests.select(*dict.fromkeys([*key, "scene_id", name]))
    answers = first_named(slim, counted, name, "name", "zord", {
        "zord": "zone_ord", "name": "zone", "full_path": "display_name", "parent": "parent",
        "depth": "depth", "num_objects": "num_objects",
        "num_direct_objects": "num_direct_objects", "children": "children", "vertices": "vertices"}, last=True)
    keyed = hierarchy.select("scene_id", "zord", F.lower("name").alias("_key"))
    asked = slim.select("scene_id", name_key(F.col(name)).alias("_key")).distinct()
    wanted = (keyed.join(broadcast_if_small(asked, text_columns=["_key"]), ["scene_id", "_key"], "left_semi")
              .groupBy("scene_id", "_key").agg(F.max("zord").alias("zone_ord"))
              .select("scene_id", "zone_ord"))
    contents = (zone_contents(objects, index)
                .join(broadcast_if_small(wanted), ["scene_id", "zone_ord"], "left_semi")
                .select("scene_id", "zone_ord", "ord", "id", "label", "x", "y", "zone",
                        "parent_zone", "full_path", "direct"))
    return answers, contents


def query_object(requests: DataFrame, objects: DataFrame, index: ZoneIndex,
                 name: str = "object_label", key=("request_id",)):
    """(answers, matches): counts per request and, per label, its located objects."""
    slim = requests.select(*dict.fromkeys([*key, "scene_id", name]))
    answers, matches = lookup_exact(slim, objects, name)
    return answers, assign_zone(matches, index, ["ord"], "deepest")


def zones_report(objects: DataFrame, hierarchy: DataFrame, index: ZoneIndex | None = None) -> DataFrame:
    """All zones with counts, children and vertices."""
    return with_children(zone_counts(objects, hierarchy, index)).select(
        "scene_id", "zord", "name", F.col("full_path").alias("display_name"), "parent", "depth",
        "children", "num_objects", "num_direct_objects", "vertices")


def status_events(statuses: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """(robot_id, ts, seq, status_code): the last code of each list.

    Publishing a goal counts as status 2 (under way) at that moment.
    """
    seq = F.col("seq") if "seq" in statuses.columns else F.lit(0)
    out = (statuses.where(F.size("status_codes") > 0)
           .select("robot_id", "ts", seq.cast("long").alias("seq"),
                   F.element_at("status_codes", -1).alias("status_code")))
    if goals is not None:
        out = out.unionByName(goals.select("robot_id", "ts", F.lit(-1).cast("long").alias("seq"),
                                           F.lit(2).alias("status_code")))
    return out


def latest_status(statuses: DataFrame) -> DataFrame:
    return status_events(statuses).groupBy("robot_id").agg(
        F.max_by("status_code", F.struct("ts", "seq")).alias("status_code"))


def navigation_status(requests: DataFrame, statuses: DataFrame, goals: DataFrame,
                      dialect: str = "cloud", key=("request_id",),
                      group_rows: int | None = None) -> DataFrame:
    """Status, destination and message at the time of each request."""
    slim = requests.select(*dict.fromkeys([*key, "robot_id", "ts"]))
    coded = as_of(slim, status_events(statuses, goals), ["robot_id"], "ts", "ts",
                  {"status_code": "status_code"}, tie="seq", group_rows=group_rows)
    both = as_of(coded, goals, ["robot_id"], "ts", "ts", {"destination": "destination"},
                 group_rows=group_rows)
    code = F.col("status_code")
    dest = F.when(code.isNotNull(), F.col("destination")) if dialect == "cloud" else F.col("destination")
    out = both.select(*key, status_name(code, dialect).alias("status"), dest.alias("destination"),
                      status_message(code, F.col("destination")).alias("message"))
    return out if dialect == "cloud" else out.drop("message")


def cancellations(requests: DataFrame) -> DataFrame:
    """Cancel requests as status rows; cancelling always succeeds."""
    return requests.where(F.col("tool") == "cancel_navigation").select(
        "request_id", "robot_id", "ts", F.lit(5).alias("status_code"), F.lit(True).alias("success"),
        F.lit("Navigation cancelled").alias("message"))
