"""Written tables in the shared folder that the session names.

``spark.checkpoint.dir`` is shared by the driver and all executors, so a
table written there survives the loss of any executor.  Folders are
deleted when the Python process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from regioscope.session import checkpoint_dir

BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
         "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Hand small Arrow batches to Python for the time of one job: their
    buffers lie outside the heap, where nothing else bounds them."""
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the
    lineage ends there and later uses read it column by column."""
    spark = df.sparkSession
    path = folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path, compression=codec)
    # Spark deletes the shuffle files of finished jobs when the driver's
    # garbage is collected; ask for that now, not when memory runs short
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: all that was made
    of them is itself written."""
    for t in tables:
        _delete(t.sparkSession, t._scratch_path)
        _MADE.remove((t.sparkSession, t._scratch_path))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
