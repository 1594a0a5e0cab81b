"""Publish path: scene documents to enriched, map-frame relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions import angles as A, geometry as G
from sceneframe.operators.containment import ZoneIndex
from sceneframe.operators.hierarchy import location_index, zone_hierarchy
from sceneframe.operators.scale import broadcast_if_small
from sceneframe.operators.scene import filter_objects, to_map_frame
from sceneframe.sources.scenes import Scene
from sceneframe.sources.sinks import enriched_objects


@dataclass
class Published:
    """Filtered map-frame objects, the zone hierarchy and its location index."""
    objects: DataFrame
    zones: DataFrame
    index: ZoneIndex

    @property
    def enriched(self) -> DataFrame:
        return enriched_objects(self.objects, self.index)


def publish(scene: Scene, min_confidence: float = 0.3, min_points: int = 50,
            excluded_labels=()) -> Published:
    """Filter, project and align objects; build the zone hierarchy.

    Zone vertices are already in the map frame; stored locations are ignored.
    """
    objects = to_map_frame(
        filter_objects(scene.objects, min_confidence, min_points, excluded_labels), scene.alignments)
    zones = zone_hierarchy(scene.zones)
    return Published(objects, zones, location_index(zones))


def latest_alignment(poses: DataFrame) -> DataFrame:
    """Last pose estimate per scene, read as an alignment (scale is not carried)."""
    yaw = A.yaw_from_quaternion(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw"))
    return (poses.groupBy("scene_id").agg(F.max_by(F.struct(
                F.col("x").alias("translate_x"), F.col("y").alias("translate_y"),
                A.degrees(yaw).alias("rotate_deg")), "ts").alias("_a"))
            .select("scene_id", "_a.*"))


def realign(scene: Scene, target: DataFrame, scale: float = 1.0) -> Scene:
    """Move a scene to a new alignment (scene_id, translate_x, translate_y, rotate_deg).

    Objects are projected again from their centroids.  Zones are taken back
    through the scene's own alignment and forward through the new one.  A live
    re-alignment always uses ``scale`` 1 unless told otherwise.
    """
    new = target.select("scene_id", F.col("translate_x").alias("_nx"),
                        F.col("translate_y").alias("_ny"), F.col("rotate_deg").alias("_nd"))
    old = scene.alignments.select(
        "scene_id", F.col("translate_x").alias("_ox"), F.col("translate_y").alias("_oy"),
        F.col("rotate_deg").alias("_od"), F.col("scale").alias("_os"), "world_axes")
    moves = old.join(new, "scene_id", "left")
    s = F.lit(float(scale))
    ring = G.affine_ring(
        G.inverse_affine_ring(F.col("vertices"), F.col("_ox"), F.col("_oy"), F.col("_od"), F.col("_os")),
        F.col("_nx"), F.col("_ny"), F.col("_nd"), s)
    zones = (scene.zones.join(broadcast_if_small(moves), "scene_id", "left")
             .withColumn("vertices", F.when(F.col("_nx").isNotNull(), ring).otherwise(F.col("vertices")))
             .select(*scene.zones.columns))
    alignments = moves.select(
        "scene_id", F.coalesce("_nx", "_ox").alias("translate_x"),
        F.coalesce("_ny", "_oy").alias("translate_y"), F.coalesce("_nd", "_od").alias("rotate_deg"),
        F.when(F.col("_nx").isNotNull(), s).otherwise(F.col("_os")).alias("scale"), "world_axes")
    return Scene(scene.objects, zones, alignments)
