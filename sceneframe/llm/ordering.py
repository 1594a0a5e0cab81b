"""Global order of a table's rows without a sort in one task.

Rows are dealt out by ranges of their keys and sorted inside partitions; a row's place
follows from its place in its partition and the counts of the partitions before it.  The last
key is the row's place in the input, so equal keys - even a third of all rows - are
parted like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sceneframe.llm.common import settle


def numbered_input(df: DataFrame, name: str = "_tie") -> DataFrame:
    """The rows with their place in the input, which is the same whenever a task runs again."""
    return df.withColumn(name, F.monotonically_increasing_id())


def by_ranges(df: DataFrame, *keys: str) -> DataFrame:
    """All rows in ascending order of the keys (nulls first): partition after partition, sorted inside."""
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def positions(df: DataFrame, tree: str, *keys: str) -> DataFrame:
    """The rows with ``pos`` (from 0, in the order of the keys within a tree) and ``n`` (the tree's rows).

    Only one row per partition and tree is counted, summed and joined back.
    """
    placed = settle(by_ranges(df, tree, *keys))
    seen = placed.withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id())
    counts = seen.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_rows"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = settle(counts.select("_part", tree, (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                                   F.sum("_rows").over(Window.partitionBy(tree)).alias("n")))
    return (seen.join(offsets, ["_part", tree]).withColumn("pos", F.col("_seq") + F.col("_shift"))
            .drop("_part", "_seq", "_shift"))
