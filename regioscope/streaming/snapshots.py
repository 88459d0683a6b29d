"""Snapshot folders processed incrementally.

The reference loops over one registry file per period and writes one
aggregate per file.  Here that loop is a file-source stream: every new
snapshot file that lands in the folder is read with the declared schema,
its period is taken from the file name, and each micro-batch's per-(period, key)
partial aggregates are written to a folder of their own, ``batch_id=n``.
The aggregate is made of the batch's own rows (no state is carried on), so
several files of one period in several runs add up, and a batch that is
retried overwrites its own folder instead of counting again.  ``availableNow``
processes whatever is present and stops, so the same job serves a backfill
and a scheduled run; the checkpoint (in the shared checkpoint folder)
records which files were done.  The final roll-up reads the partial table and merges the
partials (sums), which is exact for means and counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioscope.functions import dates as D


def ingest_snapshots(spark: SparkSession, source_dir: str, schema: T.StructType | str,
                     keys: Sequence[str], value: str, out_dir: str, checkpoint: str,
                     encoding: str = "UTF-8", digits: int = 4, century: str = "20",
                     component: int = -1, max_files_per_trigger: int | None = None) -> None:
    """Run the incremental roll-up until every present file is processed."""
    r = (spark.readStream.option("header", True).option("encoding", encoding)
         .option("recursiveFileLookup", True).schema(schema))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    part_of_path = F.element_at(F.split(F.col("_metadata.file_path"), "/"), component)
    rows = r.csv(source_dir).withColumn(
        "period", D.period_from_path(F.concat(F.lit("/"), part_of_path), digits, century))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        part = (batch.groupBy("period", *keys)
                .agg(F.sum(value).alias("sum_value"), F.count(value).alias("n_value"),
                     F.count(F.lit(1)).alias("n_rows")))
        part.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    q = (rows.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def rollup(spark: SparkSession, out_dir: str, keys: Sequence[str]) -> DataFrame:
    """Merge the streamed partials: mean (NA skipped) and row count."""
    p = spark.read.parquet(out_dir)
    return (p.groupBy("period", *keys)
            .agg(F.try_divide(F.sum("sum_value"), F.sum("n_value")).alias("mean_value"),
                 F.sum("n_rows").alias("n")))
