"""Goal arrival on recorded trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sceneframe.functions.geometry import distance
from sceneframe.operators.asof import as_of

#: metres - fixed value
ARRIVAL_THRESHOLD = 0.15


def detect_arrivals(poses: DataFrame, goals: DataFrame, threshold: float = ARRIVAL_THRESHOLD,
                    group_rows: int | None = None, tie: str | None = None) -> DataFrame:
    """First pose closer than the threshold after each goal; a new goal replaces the old.

    Of two goals of one time the one with the larger ``tie`` (a goal column) is in force.

    Every pose is tagged with the goal in force at its time, so the work per pose
    is one as-of match and the result is a combinable minimum per goal.
    """
    numbered = as_of(poses.select("robot_id", "ts", "x", "y"), goals, ["robot_id"], "ts", "ts",
                     {"ts": "goal_ts", "x": "gx", "y": "gy", "destination": "destination"},
                     tie=tie, group_rows=group_rows)
    near = numbered.where(distance(F.col("x"), F.col("y"), F.col("gx"), F.col("gy")) < threshold)
    return (near.groupBy("robot_id", "goal_ts")
            .agg(F.min("ts").alias("arrived_ts"), F.min_by("destination", "ts").alias("destination"),
                 F.min_by("gx", "ts").alias("x"), F.min_by("gy", "ts").alias("y")))
