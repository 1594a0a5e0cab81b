"""Small helpers shared by the text operators.

Every operator selects the columns it needs by name, so extra columns of a table
never clash with working columns; a missing (null) text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sceneframe.operators.scale import checkpoint_folder

#: white space between words: `[\x20\x09-\x0D]`
SPACE = " \\t-\\r"

#: bytes of rows that go to a Python worker at one time; rows of any size go, and results don't depend on it
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_MIX = tuple(np.uint64(x) for x in (30, 27, 31, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; Python workers also look for this package where the driver has it (a cluster installs it)."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, root]))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of a bounded size, unless the session has a bound of its own.

    Spark's default is 10,000 rows or 64 MB: an executor then holds some 100 MB per task outside its heap, and
    its Python worker one or two such batches.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner goes by the driver's garbage collection, which a job of many stages and little data on the driver may not see
    before its end; call this after a settled table has replaced a large shuffle.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(spark: SparkSession, folder: str) -> None:
    """Delete an operator's own intermediate files in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fold_case(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(name: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; an empty text for a null id."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit(""))) % n


def by_batch(step: Callable[[dict[str, list]], dict[str, Iterable]], schema: pa.Schema, rows: int = 2000):
    """A mapInArrow function from one on plain column lists, a bounded number of rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = step(batch.slice(start, rows).to_pydict())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[f.name], f.type) for f in schema], schema=schema)
    return run


#: what operators remember between the tasks of a worker: name -> a function that forgets it
MEMORIES: dict[str, Callable[[], None]] = {}


def release(keep: str | None = None) -> None:
    """Forget what other operators' tasks left in this worker, and return freed memory to the system.

    Workers go from stage to stage; without this each would keep the most that any stage took.
    """
    for name, forget in MEMORIES.items():
        if name != keep:
            forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):        # another C library
        pass


def thin(batches: Iterator[pa.RecordBatch], rows: int = 1000, keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that few texts are Python objects at one time.

    ``keep`` names the task's own memory, which outlives it.
    """
    release(keep)
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        batch = None            # before the next one is read
    release(keep)


def scramble(x: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values."""
    a, b, c, p, q = _MIX
    x = (x ^ (x >> a)) * p
    x = (x ^ (x >> b)) * q
    return x ^ (x >> c)


def whole_groups(batches, columns: int = 1):
    """Join record batches so that rows with equal leading columns are never parted."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, bool)
        for c in range(columns):
            values = table.column(c).to_numpy()
            same &= values == values[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()
