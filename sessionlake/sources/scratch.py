"""Tables written to the cluster's shared scratch folder and read again.

They cut a lineage that several jobs share and survive lost executors. `spark.checkpoint.dir` names the
folder; only where a local session has none (tests on one machine), a local temporary folder is set.

A stored table stays until someone removes it: `temporary` removes those that a block made and doesn't
keep, `release` all that this session still has, once their results are written.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    _made.append(f"{root.rstrip('/')}/sessionlake-{uuid.uuid4().hex}")
    return _made[-1]


def stored(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch folders that no later job reads."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        if path in _made:
            _made.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later job reads."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)


@contextmanager
def temporary(spark: SparkSession):
    """What is stored inside goes when the block ends, but for tables passed to the function that this yields."""
    before, kept = set(_made), set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.scratch_path)
        return table

    try:
        yield keep
    finally:
        remove(spark, *[p for p in _made if p not in before and p not in kept])


def release(spark: SparkSession) -> None:
    """Delete all scratch folders of this process; results that were not written elsewhere go too."""
    remove(spark, *list(_made))
