"""Helpers that keep plans bounded: checked broadcasts, reliable checkpoints
and ordered work inside groups of any size.

Nothing in this package broadcasts a table without counting it first, and no
window or collected list runs over a group whose size is not bounded: groups
above ``GROUP_ROWS`` rows are cut into ordered slices by :func:`ordered_slices`.
"""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: largest table sent to every executor, in rows
BROADCAST_ROWS = 200_000
#: and in bytes of its text and list columns
BROADCAST_BYTES = 128 << 20
#: rows of a narrow input that one task of map-only work takes
TASK_ROWS = 25_000
#: groups larger than this are cut into slices before ordered work
GROUP_ROWS = 2_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the session's ``spark.checkpoint.dir``.  Only a local session without
    that setting gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="sceneframe-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys, task_rows: int | None = None) -> DataFrame:
    """Hash a narrow input over the cores before heavy map-only work, at most about ``TASK_ROWS`` rows to a task.

    A narrow table has few partitions even if it has very many rows, and a task on a whole one lasts as long as
    the table is large.  Inputs that are cut finely enough are returned unchanged.  Call it on scans: the partition
    count is known without running anything, the row count from the footers of the files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, math.ceil(df.count() / (TASK_ROWS if task_rows is None else task_rows)))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, text_columns=(), edge_columns=(),
             max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure ``df`` against the broadcast bounds in one aggregate.

    Rows are counted; columns of unbounded width are weighed as well: the
    characters of ``text_columns`` and 32 bytes per element of ``edge_columns``.
    """
    zero = F.lit(0)
    wide = sum([F.coalesce(F.length(c), zero) * 2 for c in text_columns]
               + [F.coalesce(F.size(c), zero) * 32 for c in edge_columns], zero)
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, text_columns=(),
                       edge_columns=(), max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a table proven small, a shuffled join for any other."""
    small = is_small(df, max_rows, text_columns, edge_columns, max_bytes)
    return F.broadcast(df) if small else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """Hint a sort-merge join for a table that is not proven small.

    Spark's own estimate knows nothing of the rows that ``explode`` adds: without the hint it sends a table
    of some MB in its file to every executor, however many rows it is listed in.
    """
    return df.hint("merge")


def _texts(df: DataFrame, names) -> list[str]:
    return [f.name for f in df.schema if f.name in names and f.dataType.simpleString() == "string"]


def large_groups(df: DataFrame, keys, group_rows: int | None = None) -> tuple[DataFrame, int]:
    """The groups above the bound with their row counts ``_n``, and the largest of these (0 if there is none).

    One map-side combined count, kept as a checkpointed table.
    """
    bound = GROUP_ROWS if group_rows is None else group_rows
    sized = checkpoint(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bound))
    return sized, sized.agg(F.coalesce(F.max("_n"), F.lit(0))).first()[0]


def ordered_slices(df: DataFrame, keys, position: Column, group_rows: int | None = None):
    """Cut large groups into ordered slices.

    Returns ``(df with _slice, large)``: ``_slice`` is 0 in ordinary groups, ``large``
    has one row per cut group (None if there is none).
    ``position`` must never decrease along the order used afterwards; then every
    row of slice s comes before every row of slice s+1.  The split points are
    approximate quantiles of ``position``: they affect balance, never results.
    """
    bound = GROUP_ROWS if group_rows is None else group_rows
    names = list(keys)
    placed = df.withColumn("_pos", position.cast("double"))
    chosen, most = large_groups(df, names, bound)
    if not most:
        return df.withColumn("_slice", F.lit(0)), None
    parts = min(4096, 2 * (most // bound + 1))
    chosen = broadcast_if_small(chosen, text_columns=_texts(chosen, names))
    # keep every step-th quantile, so that a group gets about 2 * n / bound points
    step = F.greatest(F.lit(1), F.floor(F.lit(parts * bound / 2.0) / F.col("_n")).cast("int"))
    points = (placed.join(chosen, names)
              .groupBy(*names)
              .agg(F.percentile_approx("_pos", [i / parts for i in range(1, parts)], 10_000)
                   .alias("_q"), F.first("_n").alias("_n"))
              .select(*names, F.array_sort(F.array_distinct(
                  F.filter("_q", lambda p, i: i % step == 0))).alias("_points")))
    # at most 2 * rows / bound split points in all: a hint only if they are few
    points = broadcast_if_small(checkpoint(points), text_columns=_texts(points, names), edge_columns=("_points",))
    sliced = (placed.join(points, names, "left")
              .withColumn("_slice", F.when(F.col("_points").isNull(), 0).otherwise(
                  F.size(F.filter("_points", lambda p: p <= F.col("_pos")))))
              .drop("_points", "_pos"))
    return sliced, chosen.select(*names)


def rank_in_group(df: DataFrame, keys, order, position: Column, name: str = "rank",
                  group_rows: int | None = None) -> DataFrame:
    """``row_number`` per group in the given order, for groups of any size.

    A large group is numbered slice by slice; each slice is then shifted by the
    row counts of the slices before it.
    """
    names = list(keys)
    sliced, large = ordered_slices(df, names, position, group_rows)
    w = Window.partitionBy(*names, "_slice").orderBy(*order)
    numbered = sliced.withColumn(name, F.row_number().over(w).cast("long"))
    if large is None:
        return numbered.drop("_slice")
    before = Window.partitionBy(*names).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    # one row per slice of the large groups
    offsets = (sliced.join(large, names, "left_semi").groupBy(*names, "_slice").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.sum("_n").over(before))
               .where(F.col("_before") > 0).select(*names, "_slice", "_before"))
    return (numbered.join(offsets, [*names, "_slice"], "left")
            .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
            .drop("_slice", "_before"))
