"""Detection filter, projection to the map frame and prepared zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions import geometry as G
from sceneframe.operators.scale import broadcast_if_small


def filter_objects(objects: DataFrame, min_confidence: float = 0.3, min_points: int = 50,
                   excluded_labels=()) -> DataFrame:
    """Keep confident, well-supported detections with an allowed label.

    ``excluded_labels`` is a list of labels or a DataFrame with a ``label`` column.
    """
    kept = objects.where((F.col("confidence") >= min_confidence)
                         & (F.col("num_points") >= min_points))
    if isinstance(excluded_labels, DataFrame):
        banned = excluded_labels.select(F.lower("label").alias("_label")).distinct()
        return kept.join(broadcast_if_small(banned),
                         F.lower("label") == F.col("_label"), "left_anti")
    labels = sorted({e.lower() for e in excluded_labels})
    if labels:
        kept = kept.where(~F.coalesce(F.lower("label"), F.lit("")).isin(labels))
    return kept


def to_map_frame(objects: DataFrame, alignments: DataFrame | None = None,
                 axes: str = "xy") -> DataFrame:
    """Add map coordinates x, y from the 3-D centroid.

    ``alignments`` has one row per scene: translate_x, translate_y, rotate_deg,
    scale, world_axes.  Scenes without one keep the projected position.
    """
    if alignments is None:
        return (objects.withColumn("x", G.project_x(F.col("centroid")))
                .withColumn("y", G.project_y(F.col("centroid"), F.lit(axes))))
    a = alignments.select(
        "scene_id", F.col("translate_x").alias("_tx"), F.col("translate_y").alias("_ty"),
        F.col("rotate_deg").alias("_deg"), F.col("scale").alias("_scale"),
        F.col("world_axes").alias("_axes"))
    px = G.project_x(F.col("centroid"))
    py = G.project_y(F.col("centroid"), F.coalesce(F.col("_axes"), F.lit(axes)))
    args = [F.coalesce(c, F.lit(v)) for c, v in
            (("_tx", 0.0), ("_ty", 0.0), ("_deg", 0.0), ("_scale", 1.0))]
    tx, ty, deg, scale = args
    return (objects.join(broadcast_if_small(a), "scene_id", "left")
            .withColumn("x", G.affine_x(px, py, tx, deg, scale))
            .withColumn("y", G.affine_y(px, py, ty, deg, scale))
            .drop("_tx", "_ty", "_deg", "_scale", "_axes"))


def valid_polygons(zones: DataFrame) -> DataFrame:
    return zones.where(F.size("vertices") >= 3)


def prepare_zones(zones: DataFrame) -> DataFrame:
    """Add edges, bounding box, area and vertex mean (null without vertices)."""
    xs = F.transform("vertices", lambda v: v[0])
    ys = F.transform("vertices", lambda v: v[1])
    return (zones.withColumn("edges", G.ring_edges(F.col("vertices")))
            .withColumn("minx", F.array_min(xs)).withColumn("maxx", F.array_max(xs))
            .withColumn("miny", F.array_min(ys)).withColumn("maxy", F.array_max(ys))
            .withColumn("area", F.when(F.size("vertices") >= 3,
                                       G.polygon_area(F.col("edges"))).otherwise(0.0))
            .withColumn("cx", G.vertex_mean_x(F.col("vertices")))
            .withColumn("cy", G.vertex_mean_y(F.col("vertices"))))


def distinct_labels(objects: DataFrame, lower: bool = False) -> DataFrame:
    label = F.lower("label") if lower else F.col("label")
    return objects.select("scene_id", label.alias("label")).distinct()


def label_index(objects: DataFrame) -> DataFrame:
    """Per lower-cased label: occurrences and the first one in list order."""
    return (objects.groupBy("scene_id", F.lower("label").alias("label_key"))
            .agg(F.count(F.lit(1)).alias("occurrences"), F.min("ord").alias("first_ord"),
                 F.min_by("id", "ord").alias("first_id")))


def scene_summary(objects: DataFrame, zones: DataFrame) -> DataFrame:
    """Objects, distinct labels and zones per scene; ready when both kinds exist."""
    o = objects.groupBy("scene_id").agg(F.count(F.lit(1)).alias("num_objects"),
                                        F.countDistinct("label").alias("num_labels"))
    z = zones.groupBy("scene_id").agg(F.count(F.lit(1)).alias("num_zones"))
    zero = F.lit(0).cast("long")
    return (o.join(z, "scene_id", "full_outer")
            .select("scene_id", *[F.coalesce(c, zero).alias(c) for c in
                                  ("num_objects", "num_labels", "num_zones")])
            .withColumn("ready", (F.col("num_labels") > 0) & (F.col("num_zones") > 0)))


def scene_extent(objects: DataFrame, zones: DataFrame, scenes: DataFrame | None = None,
                 pad: float = 1.5) -> DataFrame:
    """Padded bounds of zone vertices and object positions.

    A missing object position counts as the origin.  Scenes listed in ``scenes``
    without any geometry get the default box (-1, -1)-(11, 6), padded.
    """
    zero = F.lit(0.0)
    z = zones.select("scene_id",
                     F.array_min(F.transform("vertices", lambda v: v[0])).alias("lx"),
                     F.array_min(F.transform("vertices", lambda v: v[1])).alias("ly"),
                     F.array_max(F.transform("vertices", lambda v: v[0])).alias("hx"),
                     F.array_max(F.transform("vertices", lambda v: v[1])).alias("hy"))
    o = objects.select("scene_id", F.coalesce("x", zero).alias("lx"),
                       F.coalesce("y", zero).alias("ly"),
                       F.coalesce("x", zero).alias("hx"), F.coalesce("y", zero).alias("hy"))
    ext = z.unionByName(o).groupBy("scene_id").agg(
        F.min("lx").alias("lx"), F.min("ly").alias("ly"),
        F.max("hx").alias("hx"), F.max("hy").alias("hy"))
    if scenes is not None:
        ext = scenes.select("scene_id").distinct().join(ext, "scene_id", "left")
    return ext.select("scene_id",
                      (F.coalesce("lx", F.lit(-1.0)) - pad).alias("min_x"),
                      (F.coalesce("ly", F.lit(-1.0)) - pad).alias("min_y"),
                      (F.coalesce("hx", F.lit(11.0)) + pad).alias("max_x"),
                      (F.coalesce("hy", F.lit(6.0)) + pad).alias("max_y"))
