"""What the operators share: size-checked broadcasts, bounded samples, shipping the package to executors."""

from __future__ import annotations

import ctypes
import functools
import inspect
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.scratch import discard, shared_dir, stored, temporary  # noqa: F401

#: Rows and bytes of a batch sent to Python, where the session sets none: whole texts are long, and each task holds a few batches,
#: in the worker and outside the JVM's heap.
BATCH_ROWS, BATCH = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES, BYTES = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: A side of at most this many narrow rows (ids, digests, a few numbers) may be broadcast.
BROADCAST_ROWS = 200_000


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are few; otherwise Spark shuffles both sides. `rows` counts numbers
    (of 8 bytes) instead where rows hold lists of them."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of df (all, if it has no more), chosen by a hash of all their columns, the same each time.
    Where rows are chosen, equal ones count as one, so that no number of repeats exceeds the bound."""
    total = df.count()
    if total <= rows:
        return df
    cut = int(rows / total * 2**62)
    place = F.xxhash64(F.lit("sample"), *df.columns)
    return df.filter(F.shiftrightunsigned(place, 2) < F.lit(cut)).distinct()


def small_table(spark: SparkSession, rows: list[tuple], kind: str) -> DataFrame:
    """A few rows of the driver's. A list given to Spark as it is becomes an RDD, for which each executor starts a further set of
    Python workers; these stay for a minute after their last task."""
    fields = to_arrow_schema(StructType.fromDDL(kind))
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows) if rows else [()] * len(fields), fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), kind)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_sessionlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="spark-"))  # the driver serves the file from here as long as it runs
    name = os.path.join(folder, "sessionlake.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "sessionlake").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(name)
    context._sessionlake_shipped = True


def query(f):
    """A registered query or stage: called with the session first, it sees to it that executors can import this package."""

    @functools.wraps(f)
    def shipped(spark, *args):
        ship(spark)
        for name, most in ((BATCH, BATCH_ROWS), (BYTES, BATCH_BYTES)):
            if name not in spark.conf.getAll:  # a number that the user has set stays
                spark.conf.set(name, str(most))
        return f(spark, *args)

    return shipped


def tidy(f):
    """A function over batches (or one table) whose worker gives freed memory back to the system when it is done."""

    def release() -> None:
        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to trim
            pass

    def batches(rows):
        try:
            yield from f(rows)
        finally:
            release()

    def table(rows):
        try:
            return f(rows)
        finally:
            release()

    return batches if inspect.isgeneratorfunction(f) else table
