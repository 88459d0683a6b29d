"""Session construction and lineage cutting."""

from __future__ import annotations

import contextlib
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  AQE re-plans joins at run time, coalesces
# small shuffle partitions and splits skewed ones; the UI stays off.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of DataFrames that are gone are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "regioscope",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, creating one with the defaults above."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(_DEFAULTS)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names it; only when it is unset (local tests) is a fresh
    folder under the system temp directory taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all "
                               "executors (e.g. on HDFS or an object store)")
        # local mode only (tests, a laptop): a fresh temp folder
        conf_dir = tempfile.mkdtemp(prefix="regioscope-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def deal(df: DataFrame, rows_a_task: int = 10_000) -> DataFrame:
    """The rows of ``df`` dealt evenly over tasks of about ``rows_a_task``
    (four tasks a core, once the rows make more).

    A small file may hold many rows: its scan is one task, and so is all work
    on them until the next shuffle.
    """
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-rows // rows_a_task), 4 * cores)
    return df.repartition(tasks) if tasks > 1 else df


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared checkpoint folder and read back: later
    passes read the columns they use and compute nothing anew."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``write(df)`` puts ``df`` as Parquet below the shared checkpoint folder
    and reads it back; the tables are deleted at the end of the block.

    A checkpoint keeps the size that the plan before it was estimated at, and
    a join multiplies the sizes of its sides: over many rounds the estimate
    outgrows the data, then the planner.  A written table has its true size.
    """
    root = f"{checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    numbers = itertools.count()

    def write(df: DataFrame) -> DataFrame:
        path = f"{root}/{next(numbers)}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield write
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(root)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
