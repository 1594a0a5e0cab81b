"""Published snapshots and feature tables, one JSON text or row per entity.

A scene of any size is written entity by entity: the published list of a scene
is the set of its rows in order of ``ord`` / ``zord``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions import geometry as G
from sceneframe.functions.rounding import py_round
from sceneframe.functions.text import label_color
from sceneframe.operators.containment import ZoneIndex, assign_zone
from sceneframe.operators.hierarchy import with_children, zone_counts

_KEEP_NULLS = {"ignoreNullFields": "false"}


def enriched_objects(objects: DataFrame, index: ZoneIndex) -> DataFrame:
    """Map-frame objects with their location; all-null outside every zone."""
    return assign_zone(objects, index, ["ord"], "deepest")


def objects_snapshot(enriched: DataFrame) -> DataFrame:
    """(scene_id, ord, json): one published object per row, nulls written."""
    body = F.struct(
        "id", "label", "confidence", "num_points", F.col("centroid").alias("centroid_3d"),
        F.struct("x", "y").alias("map_position"),
        F.struct("zone", "parent_zone", "full_path").alias("location"))
    return enriched.select("scene_id", "ord", F.to_json(body, _KEEP_NULLS).alias("json"))


def zones_snapshot(hierarchy: DataFrame, objects: DataFrame, index: ZoneIndex | None = None) -> DataFrame:
    """(scene_id, zord, json): one published zone per row with its children and counts."""
    counted = with_children(zone_counts(objects, hierarchy, index))
    body = F.struct("name", F.col("full_path").alias("display_name"), "parent", "depth", "children",
                    F.col("vertices").alias("vertices_world"), "num_objects", "num_direct_objects")
    return counted.select("scene_id", "zord", F.to_json(body, _KEEP_NULLS).alias("json"))


def alignment_rows(alignments: DataFrame) -> DataFrame:
    """Alignment as persisted: 4, 4 and 2 decimals."""
    return alignments.select(
        "scene_id", py_round(F.col("translate_x"), 4).alias("translate_x"),
        py_round(F.col("translate_y"), 4).alias("translate_y"),
        py_round(F.col("rotate_deg"), 2).alias("rotate_deg"), "scale")


def write_alignment(alignments: DataFrame, path: str, mode: str = "overwrite") -> None:
    alignment_rows(alignments).write.mode(mode).json(path)


def write_snapshot(snapshot: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines per scene folder, so that one scene can be read alone."""
    snapshot.select("scene_id", "json").write.mode(mode).partitionBy("scene_id").text(path)


def map_features(objects: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Drawable features: object points and labels, zone rings and labels."""
    empty = F.lit(None).cast("array<array<double>>")
    text = F.lit(None).cast("string")

    def feature(df, ns, fid, x, y, z, size, rgb, alpha, label=text, ring=empty):
        return df.select(
            "scene_id", F.lit(ns).alias("ns"), fid.cast("long").alias("feature_id"),
            x.alias("x"), y.alias("y"), z.cast("double").alias("z"),
            size.cast("double").alias("size"), rgb["r"].alias("r"), rgb["g"].alias("g"),
            rgb["b"].alias("b"), F.lit(alpha).alias("alpha"), label.alias("text"),
            ring.alias("ring"))

    def plain(r, g, b):
        return F.struct(F.lit(r).alias("r"), F.lit(g).alias("g"), F.lit(b).alias("b"))

    colored = objects.withColumn("_rgb", label_color(F.col("label")))
    zones = hierarchy.where(F.size("vertices") >= 3).withColumn("_rgb", label_color(F.col("name")))
    x, y, depth, none = F.col("x"), F.col("y"), F.col("depth"), F.lit(None).cast("double")
    return (feature(colored, "centroids", F.col("id") * 2, x, y, F.lit(0.3), F.lit(0.4),
                    F.col("_rgb"), 0.8)
            .unionByName(feature(colored, "labels", F.col("id") * 2 + 1, x, y, F.lit(0.6),
                                 F.lit(0.3), plain(255, 255, 255), 1.0, F.col("label")))
            .unionByName(feature(zones, "all_zone_polygons", F.col("zord") * 2, none, none,
                                 depth * 0.05 + 0.05,
                                 F.when(depth > 0, 0.03).otherwise(0.05), F.col("_rgb"), 0.9,
                                 ring=G.close_ring(F.col("vertices"))))
            .unionByName(feature(zones, "all_zone_labels", F.col("zord") * 2 + 1, F.col("cx"),
                                 F.col("cy"), depth * 0.15 + 0.5,
                                 F.greatest(F.lit(0.2), 0.4 - depth * 0.05), plain(0, 0, 0), 1.0,
                                 F.col("full_path"))))
