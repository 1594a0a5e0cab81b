"""Star-schema tables re-read as one scene (scene_id 0) with its event logs.

Zones come from regions, nations and market segments; objects from parts; poses,
requests, statuses and log lines from events; transcripts from conversations.
Only + - * / % on small numbers is used, so that any engine gets the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sceneframe.functions.angles import DEG_TO_RAD
from sceneframe.operators.scale import broadcast_if_small, checkpoint, spread

# Keywords and tools used by the derived requests.
KEYWORDS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
TOOL_OF_EVENT = {"view": "describe_surroundings", "click": "find_nearest",
                 "error": "distance_to", "purchase": "describe_route", "signup": "query_zone"}
# Every tool with its argument, if it needs one.  Of 400 requests one lists the zones, one the labels and eight report a zone.
TOOL_ARGUMENTS = {"get_robot_pose": None, "describe_surroundings": None, "find_nearest": "object_type", "distance_to": "destination",
                  "describe_route": "destination", "orient_me": "target", "navigate_to_zone": "zone_name",
                  "navigate_to_object": "object_label", "query_object": "object_label", "get_navigation_status": None,
                  "cancel_navigation": None, "query_zone": "zone_name", "list_zones": None, "list_objects": None}
STATUS_OF_EVENT = {"view": 2, "click": 1, "purchase": 4, "error": 6, "signup": 5}
TAG_OF_EVENT = {"view": "pose", "click": "tool", "error": "error", "purchase": "nav",
                "signup": "voice"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The event log with only the named columns, over all cores."""
    return spread(table(spark, sf_dir, "events").select(*columns), "event_id")


def _mapped(column, mapping):
    out = None
    for k, v in mapping.items():
        out = F.when(column == k, v) if out is None else out.when(column == k, v)
    return out


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheared rectangles in three nested levels: regions, nations, market segments of nations."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    segments = (table(spark, sf_dir, "customer").select("c_mktsegment").distinct()
                .withColumn("m", F.row_number().over(Window.orderBy("c_mktsegment")) - 1))
    # rooms are numbered after all regions and nations, nation by nation: one row of counts, from these small tables
    whole = Window.partitionBy()
    segments = segments.withColumn("_per", F.count(F.lit(1)).over(whole))
    regions = region.agg((F.max("r_regionkey") + 1).alias("_regions"), F.lit(0).alias("_all"))
    # ranks run over the nations, grouped by region
    ranked = (nation.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
              .withColumn("_nations", F.max("n_nationkey").over(whole) + 1).withColumn("_all", F.lit(0)).join(regions, "_all"))
    nations = ranked.withColumn("nx", F.col("n_regionkey") * 100.0 + 2.0 + F.col("k") * 19.0)
    rects = (region.select(F.col("r_regionkey").cast("long").alias("zord"),
                           F.col("r_name").alias("name"), (F.col("r_regionkey") * 100.0).alias("x0"),
                           F.lit(100.0).alias("w"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("h"))
             .unionByName(nations.select(
                 (F.col("n_nationkey") + F.col("_regions")).cast("long").alias("zord"), F.col("n_name").alias("name"),
                 F.col("nx").alias("x0"), F.lit(17.0).alias("w"), F.lit(2.0).alias("y0"),
                 F.lit(96.0).alias("h")))
             .unionByName(nations.join(segments.withColumn("_all", F.lit(0)), "_all").select(
                 (F.col("_regions") + F.col("_nations") + F.col("n_nationkey") * F.col("_per") + F.col("m")).cast("long").alias("zord"),
                 F.concat("n_name", F.lit("/"), "c_mktsegment").alias("name"),
                 (F.col("nx") + 1.0).alias("x0"), F.lit(15.0).alias("w"),
                 (F.col("m") * 18.0 + 4.0).alias("y0"), F.lit(16.0).alias("h"))))

    def corner(dx, dy):
        y = F.col("y0") + dy
        return F.array(F.col("x0") + dx + y * 0.25, y)
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    return rects.select(F.lit(0).cast("long").alias("scene_id"), "zord", "name",
                        F.lit(None).cast("string").alias("parent"),
                        F.array(corner(zero, zero), corner(w, zero), corner(w, h),
                                corner(zero, h)).alias("vertices"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    x = ((k * 37) % 5250).cast("double") / 10.0
    y = ((k * 7919) % 1000).cast("double") / 10.0
    return table(spark, sf_dir, "part").select(
        F.lit(0).cast("long").alias("scene_id"), k.alias("ord"), k.alias("id"),
        F.col("p_name").alias("label"),
        F.struct(x.alias("x"), F.lit(0.0).alias("y"), y.alias("z")).alias("centroid"),
        (F.col("p_size").cast("double") / 50.0).alias("confidence"),
        ((k * 13) % 200).alias("num_points"), x.alias("x"), y.alias("y"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    yaw_deg = ((e * 31) % 3600).cast("double") / 10.0 - 180.0
    return events(spark, sf_dir, "event_id", "user_id", "ts").select(
        F.lit(0).cast("long").alias("scene_id"), e.alias("request_id"),
        F.col("user_id").alias("robot_id"), "ts",
        (((e * 7919) % 5250).cast("double") / 10.0).alias("x"),
        (((e * 104729) % 1000).cast("double") / 10.0).alias("y"),
        (yaw_deg * DEG_TO_RAD).alias("yaw"), yaw_deg.alias("yaw_deg"))


def keyword_of(event_id):
    return F.element_at(F.array(*[F.lit(k) for k in KEYWORDS]), (event_id % 8 + 1).cast("int"))


def zone_places(zones: DataFrame) -> tuple[DataFrame, int]:
    """The zones' names by place in list order, and how many there are (nations times market segments and more, counted here)."""
    named = checkpoint(zones.select(
        (F.row_number().over(Window.orderBy("zord")) - 1).cast("long").alias("_place"), F.col("name").alias("zone_name")))
    return broadcast_if_small(named, text_columns=("zone_name",)), max(1, named.count())


def with_zone_name(rows: DataFrame, places: tuple[DataFrame, int], number: str) -> DataFrame:
    """Rows with the name of the zone at ``number`` modulo the count of zones."""
    named, n = places
    return rows.withColumn("_place", F.pmod(F.col(number), F.lit(n)).cast("long")).join(named, "_place").drop("_place")


def named_poses(spark: SparkSession, sf_dir: str, zones: DataFrame) -> DataFrame:
    """Every pose with a zone name and a label keyword to ask for, both picked by its number."""
    return with_zone_name(poses(spark, sf_dir).withColumn("keyword", keyword_of(F.col("request_id"))), zone_places(zones), "request_id")


def requests(spark: SparkSession, sf_dir: str, zones: DataFrame) -> DataFrame:
    """Tool requests with JSON arguments."""
    kind = F.col("event_type")
    asked = with_zone_name(events(spark, sf_dir, "event_id", "event_type", "user_id", "ts"), zone_places(zones), "event_id")
    args = (F.when(kind == "click", F.to_json(F.struct(keyword_of(F.col("event_id")).alias("object_type"))))
            .when(kind.isin("error", "purchase"), F.to_json(F.struct(F.col("zone_name").alias("destination"))))
            .when(kind == "signup", F.to_json(F.struct("zone_name"))).otherwise("{}"))
    return asked.select(F.col("event_id").alias("request_id"), F.lit(0).cast("long").alias("scene_id"),
                        F.col("user_id").alias("robot_id"), "ts",
                        _mapped(kind, TOOL_OF_EVENT).alias("tool"), args.alias("args"))


def all_tool_requests(named: DataFrame) -> DataFrame:
    """A request for one of all tools per pose (with zone_name, keyword, name and object_label to ask for)."""
    lot, tools = F.col("request_id") % 400, list(TOOL_ARGUMENTS)
    place = (F.when(lot == 0, 12).when(lot == 1, 13).when(lot < 10, 11).otherwise(lot % 11)).cast("int")
    value = {"find_nearest": "keyword", "distance_to": "name", "navigate_to_object": "object_label", "query_object": "object_label"}
    args = F.lit("{}")
    for tool, argument in TOOL_ARGUMENTS.items():
        if argument is not None:
            args = F.when(F.col("tool") == tool, F.to_json(F.struct(F.col(value.get(tool, "zone_name")).alias(argument)))).otherwise(args)
    return (named.withColumn("tool", F.element_at(F.array(*[F.lit(t) for t in tools]), place + 1))
            .select("request_id", "scene_id", "robot_id", "ts", "tool", args.alias("args")))


def nav_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = _mapped(F.col("event_type"), STATUS_OF_EVENT)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("robot_id"), "ts", F.col("event_id").alias("seq"),
        F.array(F.lit(0), code).alias("status_codes"))


def debug_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = _mapped(F.col("event_type"), TAG_OF_EVENT)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("robot_id"), "ts", F.col("event_id").alias("seq"),
        F.concat(F.lit("["), tag, F.lit("] "), F.col("props")).alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts; assistant turns carry one derived tool call."""
    t = table(spark, sf_dir, "conversations")
    name = F.element_at(F.array(*[F.lit(n) for n in (
        "find_nearest", "list_zones", "navigate_to_zone", "describe_surroundings")]),
        ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    call = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                    .alias("id"), name.alias("name"),
                    F.when(F.col("turn") % 3 == 2, "{broken").otherwise(
                        F.to_json(F.struct(keyword_of(F.col("conv_id")).alias("object_type"))))
                    .alias("arguments"))
    return t.select(F.col("conv_id").alias("case_id"), "turn", "role", F.col("text").alias("content"),
                    F.when((F.col("role") == "assistant") & (F.col("conv_id") % 5 != 0), F.array(call))
                    .otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string>>"))
                    .alias("tool_calls"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluation case per conversation, keyed on its number."""
    c = F.col("case_id")
    return (table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id")).distinct()
            .select(
                "case_id",
                F.concat(c.cast("string"), F.lit(". Cat"), (c % 7).cast("string"), F.lit(": conversation"))
                .alias("description"),
                F.when(c % 3 == 0, F.array(F.lit("list_zones"), F.lit(None).cast("string")))
                .when(c % 3 == 1, F.array(F.lit("find_nearest"), F.lit("describe_surroundings")))
                .otherwise(F.array().cast("array<string>")).alias("expected_tools"),
                F.when(c % 2 == 0, F.create_map(F.lit("object_type"), keyword_of(c + (c % 4))))
                .otherwise(F.create_map().cast("map<string,string>")).alias("arg_check"),
                F.when(c % 4 == 0, F.array(F.lit("navigate_to_zone")))
                .otherwise(F.array().cast("array<string>")).alias("reject_tools"),
                F.create_map(F.lit("list_zones"), F.lit('{"zones": []}')).alias("mock_results"),
                F.array(F.lit("the")).alias("should_contain"),
                F.array(F.lit("***")).alias("should_not_contain")))
