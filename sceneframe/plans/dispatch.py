"""Answer a mixed table of tool requests.

The answer of a request is a header row (JSON of its scalar fields) and, for
list answers, item rows found under ``items_key``.  Answers that depend only on
the scene (a zone report, a label listing) share one set of items, so a zone
asked for by very many requests is listed once.  ``documents`` joins headers and
items back into whole JSON texts, for answers up to a given number of items.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sceneframe.functions.text import preview
from sceneframe.operators.asof import pose_as_of
from sceneframe.operators.hierarchy import with_children
from sceneframe.operators.scale import broadcast_if_small, checkpoint
from sceneframe.plans import tools as T
from sceneframe.plans.publish import Published

_NULLS = {"ignoreNullFields": "false"}

# Fixed value: tools missing from the local dialect.
CLOUD_ONLY = ("cancel_navigation",)


@dataclass
class Answers:
    headers: DataFrame  #: request_id, tool, result_json, sections, items_key, error
    items: DataFrame    #: items_key, section, pos1, pos2, item_json


@dataclass
class Context:
    """What the tools read."""
    scene: Published
    poses: DataFrame
    statuses: DataFrame
    goals: DataFrame
    dialect: str = "cloud"
    frame: str = "map"

    def located(self, mine: DataFrame) -> DataFrame:
        """Requests with the pose of their robot at their time, found once for all tools (``_pose``)."""
        extra = [c for c in ("_name", "_radius") if c in mine.columns]
        return mine.select("request_id", "scene_id", "robot_id", "ts", *extra, "_pose.*")


@dataclass
class Tool:
    """A handler ``(context, requests) -> (headers, [items])`` and its required argument."""
    handler: Callable
    argument: str | None = None


TOOLS: dict[str, Tool] = {}


def tool(name: str, argument: str | None = None):
    """Register a handler.

    Its requests carry the required argument as ``_name`` and all arguments as
    the map ``_args``.
    """
    def register(handler):
        TOOLS[name] = Tool(handler, argument)
        return handler
    return register


def known_tools(dialect: str = "cloud") -> list[str]:
    return [n for n in TOOLS if dialect == "cloud" or n not in CLOUD_ONLY]


def parse_arguments(args: Column) -> Column:
    """JSON arguments as a map; anything unreadable is an empty map."""
    return F.coalesce(F.from_json(args, "map<string,string>", {"mode": "PERMISSIVE"}),
                      F.create_map().cast("map<string,string>"))


def _header(df: DataFrame, body: dict[str, Column], sections=(), key: Column | None = None) -> DataFrame:
    """Header rows: the JSON of ``body``, or of the error and its hint."""
    none = F.lit(None).cast("string")
    hint = F.col("hint") if "hint" in df.columns else none
    fields = [c.alias(n) for n, c in body.items()]
    good = F.to_json(F.struct(*fields), _NULLS) if fields else F.lit("{}")
    bad = F.to_json(F.struct("error", hint.alias("hint")))
    fine = F.col("error").isNull()
    names = F.array(*[F.lit(s) for s in sections]).cast("array<string>")
    return df.select("request_id", F.when(fine, good).otherwise(bad).alias("result_json"),
                     F.when(fine, names).alias("sections"),
                     F.when(fine, none if key is None else key).alias("items_key"), "error")


def _items(df: DataFrame, key: Column, section: str, pos1: Column, pos2: Column,
           body: Column) -> DataFrame:
    return df.select(key.alias("items_key"), F.lit(section).alias("section"),
                     pos1.cast("double").alias("pos1"), pos2.cast("long").alias("pos2"),
                     body.alias("item_json"))


def _of_scenes(table: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of the scenes somebody asked about."""
    return table.join(broadcast_if_small(requests.select("scene_id").distinct()), "scene_id", "left_semi")


def _own() -> Column:
    return F.concat(F.lit("request:"), F.col("request_id").cast("string"))


def _shared(kind: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(c).cast("string") for c in columns])


def _json(*columns, keep_nulls: bool = True) -> Column:
    return F.to_json(F.struct(*columns), _NULLS if keep_nulls else {})


def _quoted(column: str) -> Column:
    """A JSON string: the only element of a one-element JSON array."""
    return F.regexp_extract(F.to_json(F.array(column)), r"(?s)^\[(.*)\]$", 1)


def _named(*columns: str) -> dict[str, Column]:
    return {c: F.col(c) for c in columns}


def _no_error(df: DataFrame) -> DataFrame:
    return df.withColumn("error", F.lit(None).cast("string"))


@tool("get_robot_pose")
def _robot_pose(ctx: Context, mine: DataFrame):
    found = T.robot_pose(ctx.located(mine), ctx.scene.index, ctx.frame)
    return _header(found, _named("x", "y", "yaw_deg", "frame", "current_zone")), []


@tool("describe_surroundings")
def _surroundings(ctx: Context, mine: DataFrame):
    asked = F.col("_args")["radius"]
    mine = mine.withColumn("_radius", F.when(asked.isNull(), T.DEFAULT_RADIUS).otherwise(
        asked.try_cast("double")))
    wrong = mine.where("_radius is null").withColumn("error", F.lit("radius must be a number"))
    mine = mine.where("_radius is not null")
    rows = T.describe_surroundings(ctx.located(mine), ctx.scene.objects, ctx.scene.index, "_radius",
                                   ctx.dialect)
    facts, body, dist = T.surroundings_counts(rows), _named("current_zone", "count"), "distance"
    if ctx.dialect == "local":
        facts = facts.join(mine.select("request_id", F.col("_radius").alias("radius_m")), "request_id")
        body, dist = _named("current_zone", "radius_m"), "distance_m"
    near = _items(rows.where("obj_ord is not null"), _own(), "nearby_objects", F.col(dist),
                  F.col("obj_ord"), _json("label", dist, "direction"))
    return _header(facts, body, ("nearby_objects",), _own()).unionByName(_header(wrong, {})), [near]


@tool("find_nearest", "object_type")
def _find_nearest(ctx: Context, mine: DataFrame):
    found = T.find_nearest(ctx.located(mine), ctx.scene.objects, ctx.scene.index, "_name", ctx.dialect)
    return _header(found, _named("label", "distance_m", "direction", "zone")), []


@tool("distance_to", "destination")
def _distance_to(ctx: Context, mine: DataFrame):
    found = T.distance_to(ctx.located(mine), ctx.scene.objects, ctx.scene.zones, "_name", ctx.dialect)
    return _header(found, _named("destination", "destination_type", "distance_m", "direction")), []


@tool("describe_route", "destination")
def _describe_route(ctx: Context, mine: DataFrame):
    answers, met, passed = T.describe_route(ctx.located(mine), ctx.scene.objects, ctx.scene.zones,
                                            "_name", dialect=ctx.dialect)
    items = [_items(met, _own(), "zones_along_path", F.lit(0.0), F.col("zone_ord"), _quoted("zone")),
             _items(passed, _own(), "objects_along_path", F.col("distance_along_path_m"),
                    F.col("obj_ord"), _json("label", "distance_along_path_m", "side_offset_m"))]
    return _header(answers, _named("destination", "total_distance_m", "direction"),
                   ("zones_along_path", "objects_along_path"), _own()), items


@tool("orient_me", "target")
def _orient(ctx: Context, mine: DataFrame):
    found = T.orient(ctx.located(mine), ctx.scene.objects, ctx.scene.zones, "_name", ctx.dialect)
    return _header(found, _named("target", "direction_from_current", "turn_degrees", "message")), []


def _goal_header(ctx: Context, found: DataFrame, kind: str) -> DataFrame:
    if ctx.dialect == "local":
        return _header(found, {"status": F.lit("goal_sent"), **_named(kind, "goal_x", "goal_y")})
    goal = F.struct(F.col("goal_x").alias("x"), F.col("goal_y").alias("y"))
    return _header(found, {"success": F.lit(True), kind: F.col(kind), "goal": goal})


@tool("navigate_to_zone", "zone_name")
def _to_zone(ctx: Context, mine: DataFrame):
    found = T.goal_for_zone(ctx.located(mine), ctx.scene.zones, "_name", ctx.dialect)
    return _goal_header(ctx, found, "zone"), []


@tool("navigate_to_object", "object_label")
def _to_object(ctx: Context, mine: DataFrame):
    found = T.goal_for_object(ctx.located(mine), ctx.scene.objects, "_name", ctx.dialect)
    return _goal_header(ctx, found, "object"), []


@tool("query_zone", "zone_name")
def _query_zone(ctx: Context, mine: DataFrame):
    answers, contents = T.query_zone(mine, ctx.scene.objects, ctx.scene.zones, ctx.scene.index, "_name")
    zone = F.when(F.col("found"), F.struct(
        F.col("zone").alias("name"), "display_name", "parent", "depth", "children",
        F.col("vertices").alias("vertices_world"), "num_objects", "num_direct_objects"))
    key = _shared("zone", "scene_id", "zone_ord")
    place = F.when(F.col("zone").isNotNull(), F.struct("zone", "parent_zone", "full_path"))
    body = _json("id", "label", F.struct("x", "y").alias("map_position"), place.alias("location"))
    items = [_items(chosen, key, part, F.lit(0.0), F.col("ord"), body) for part, chosen in
             (("objects", contents), ("direct_objects", contents.where("direct")))]
    return _header(_no_error(answers), {"query": F.col("_name"), "found": F.col("found"), "zone": zone},
                   ("objects", "direct_objects"), F.when(F.col("found"), key)), items


@tool("query_object", "object_label")
def _query_object(ctx: Context, mine: DataFrame):
    answers, matches = T.query_object(mine, ctx.scene.objects, ctx.scene.index, "_name")
    key = _shared("label", "scene_id", "label_key")
    items = _items(matches, key, "objects", F.lit(0.0), F.col("ord"), _json(
        "id", "label", "confidence", "num_points", F.col("centroid").alias("centroid_3d"),
        F.struct("x", "y").alias("map_position"),
        F.struct("zone", "parent_zone", "full_path").alias("location")))
    body = {"query": F.col("_name"), "found": F.col("found"),
            "count": F.when(F.col("found"), F.col("count"))}
    return _header(_no_error(answers), body, ("objects",), key), [items]


def _listing(mine: DataFrame, table: DataFrame, kind: str) -> DataFrame:
    return T.has_scene(mine, table, "_data").withColumn(
        "error", F.when(~F.col("_data"), f"No {kind} data available"))


@tool("list_zones")
def _list_zones(ctx: Context, mine: DataFrame):
    key = _shared("zones", "scene_id")
    z = with_children(_of_scenes(ctx.scene.zones, mine))
    # absent and empty parts are left out, not written as null
    filled = [F.nullif(F.col(c), F.lit("")).alias(n) for c, n in (("full_path", "display_name"), ("parent", "parent"))]
    kids = F.when(F.size("children") > 0, F.col("children")).alias("children")
    items = [_items(z, key, "zones", F.lit(0.0), F.col("zord"), _json("name", *filled, kids, keep_nulls=False))]
    return _header(_listing(mine, ctx.scene.zones, "zone"), {}, ("zones",), key), items


@tool("list_objects")
def _list_objects(ctx: Context, mine: DataFrame):
    key = _shared("labels", "scene_id")
    # labels are read in text order: the item itself is the last sort key
    items = _items(T.list_objects(_of_scenes(ctx.scene.objects, mine)), key, "objects", F.lit(0.0),
                   F.lit(0), _quoted("label"))
    return _header(_listing(mine, ctx.scene.objects, "object"), {}, ("objects",), key), [items]


@tool("get_navigation_status")
def _status(ctx: Context, mine: DataFrame):
    found = T.navigation_status(mine, ctx.statuses, ctx.goals, ctx.dialect)
    names = ["status", "destination", *(["message"] if ctx.dialect == "cloud" else [])]
    return _header(_no_error(found), _named(*names)), []


@tool("cancel_navigation")
def _cancel(ctx: Context, mine: DataFrame):
    return _header(_no_error(T.cancellations(mine)), _named("success", "message")), []


def answer_requests(requests: DataFrame, poses: DataFrame, scene: Published, statuses: DataFrame,
                    goals: DataFrame, dialect: str = "cloud", tools=None,
                    frame: str = "map") -> Answers:
    """One branch per tool that is asked for; each reads only its own requests.

    All requests meet the poses once, before the branches part.
    ``tools`` limits the tools; requests for other known ones are then not answered.
    """
    ctx = Context(scene, poses, statuses, goals, dialect, frame)
    known = known_tools(dialect)
    located = pose_as_of(requests.select("request_id", "scene_id", "robot_id", "ts", "tool", "args"), poses)
    requests = checkpoint(located.withColumn("_pose", F.struct("x", "y", "yaw")).drop("x", "y", "yaw"))
    parsed = requests.withColumn("_args", parse_arguments(F.col("args")))
    asked = {r[0] for r in requests.where(F.col("tool").isin(known)).select("tool").distinct().collect()}    # no more than the known ones
    headers, items = [], []
    for name in known:
        if name not in asked or tools is not None and name not in tools:
            continue
        mine = parsed.where(F.col("tool") == name)
        need = TOOLS[name].argument
        if need is not None:
            value = F.col("_args")[need]
            lacking = mine.where(value.isNull()).withColumn("error", F.lit(f"'{need}'"))
            headers.append(_header(lacking, {}).withColumn("tool", F.lit(name)))
            mine = mine.where(value.isNotNull()).withColumn("_name", value)
        header, lists = TOOLS[name].handler(ctx, mine)
        headers.append(header.withColumn("tool", F.lit(name)))
        items += lists
    unknown = parsed.where(~F.coalesce(F.col("tool"), F.lit("")).isin(known)).withColumn(
        "error", F.concat(F.lit("Unknown tool: "), F.coalesce("tool", F.lit("None"))))
    headers.append(unknown.select(
        "request_id", F.to_json(F.struct("error")).alias("result_json"),
        F.lit(None).cast("array<string>").alias("sections"),
        F.lit(None).cast("string").alias("items_key"), "error", "tool"))
    empty = _items(requests.where("false"), F.lit(""), "", F.lit(0), F.lit(0), F.lit(""))
    return Answers(reduce(DataFrame.unionByName, headers), reduce(DataFrame.unionByName, [empty, *items]))


def documents(answers: Answers) -> DataFrame:
    """Whole JSON answers, for every size: (request_id, tool, result_json, error, items_key).

    An answer's text holds all its items, so it is as large as what was asked for; callers who want
    rows instead read ``answers.headers`` and ``answers.items``.
    """
    order = F.array_sort(F.collect_list(F.struct("pos1", "pos2", "item_json")))
    lists = (answers.items.groupBy("items_key", "section").agg(F.concat(
                 F.lit("["), F.array_join(F.transform(order, lambda i: i["item_json"]), ","),
                 F.lit("]")).alias("_list"))
             .groupBy("items_key").agg(F.map_from_entries(
                 F.collect_list(F.struct("section", "_list"))).alias("_lists")))
    joined = answers.headers.join(lists, "items_key", "left")
    has_lists = F.col("_lists").isNotNull()
    parts = F.transform("sections", lambda s: F.concat(
        F.lit('"'), s, F.lit('":'),
        F.coalesce(F.when(has_lists, F.try_element_at("_lists", s)), F.lit("[]"))))
    comma = F.when(F.col("result_json") == "{}", "").otherwise(",")
    whole = F.when(
        (F.size("sections") > 0) & F.col("items_key").isNotNull(),
        F.concat(F.substring("result_json", F.lit(1), F.length("result_json") - 1), comma,
                 F.array_join(parts, ","), F.lit("}"))).otherwise(F.col("result_json"))
    return joined.select("request_id", "tool", whole.alias("result_json"), "error", "items_key")


def debug_lines(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Log line per answered request: '[tool] name(args) -> result', first 300 characters."""
    text = F.concat(F.lit("[tool] "), F.col("tool"), F.lit("("), F.coalesce("args", F.lit("{}")),
                    F.lit(") -> "), preview(F.col("result_json"), 300, one_line=False))
    return (requests.select("request_id", "robot_id", "ts", "tool", "args")
            .join(results.select("request_id", "result_json"), "request_id")
            .select("request_id", "robot_id", "ts", text.alias("text")))


def pose_lines(poses: DataFrame) -> DataFrame:
    """'[pose] Robot at (x, y), yaw=..deg, zone=..' from robot_pose rows."""
    text = F.format_string("[pose] Robot at (%.3f, %.3f), yaw=%.1fdeg, zone=%s", "x", "y", "yaw_deg",
                           F.coalesce("current_zone", F.lit("None")))
    return poses.where("error is null").select("request_id", text.alias("text"))


def goal_lines(goals: DataFrame) -> DataFrame:
    """'[nav] Published goal: ..' from goal rows."""
    text = F.concat(F.format_string("[nav] Published goal: (%.3f, %.3f, yaw=", "goal_x", "goal_y"),
                    F.coalesce(F.col("goal_yaw").cast("string"), F.lit("None")),
                    F.lit(") on /goal_pose"))
    return goals.where("error is null").select("request_id", text.alias("text"))
