"""Debug lines and utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.functions.text import log_tag, strip

LOG_LINES = 50


def nonblank_utterances(utterances: DataFrame, column: str = "text") -> DataFrame:
    """Trimmed utterances, blank ones dropped."""
    return utterances.withColumn(column, strip(F.col(column))).where(F.col(column) != "")


def last_n_log(lines: DataFrame, n: int = LOG_LINES) -> DataFrame:
    """The last n lines per robot.

    The rank limit also runs before the shuffle: each task sends at most n rows
    per robot, however long a robot's log is.
    """
    w = Window.partitionBy("robot_id").orderBy(F.desc("ts"), F.desc("seq"))
    return (lines.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn"))


def log_counts(lines: DataFrame, mode: str = "prefix") -> DataFrame:
    return (lines.withColumn("tag", log_tag(F.col("text"), mode))
            .groupBy("robot_id", "tag").agg(F.count(F.lit(1)).alias("lines")))
