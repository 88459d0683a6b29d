"""Readers and writers.

Every reader takes an explicit schema (ids stay strings: ``09`` is not 9),
reads whole directories in one scan (many snapshot files -> one table),
and can derive a key from each row's file path.  Writers overwrite
partitions dynamically so that one snapshot can be rewritten alone.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regioscope.functions import dates as D
from regioscope.functions.geo import RINGS_TYPE
from regioscope.session import checkpoint_dir


def read_csv(spark: SparkSession, path, schema: T.StructType | str,
             encoding: str = "UTF-8", header: bool = True,
             columns: Sequence[str] | None = None, with_path: bool = False) -> DataFrame:
    """CSV scan with a declared schema.

    ``path`` may be a file, a directory or a list (many snapshot files
    become one table in one scan).  ``columns`` prunes to a subset;
    ``with_path`` adds ``source_file`` from the hidden file metadata.
    """
    r = (spark.read.option("header", header).option("encoding", encoding)
         .option("mode", "PERMISSIVE").schema(schema))
    df = r.csv(path if isinstance(path, (list, tuple)) else [path])
    if with_path:
        df = df.withColumn("source_file", F.col("_metadata.file_path"))
    if columns:
        df = df.select(*columns, *(["source_file"] if with_path else []))
    return df


def with_period_from_path(df: DataFrame, path_col: str = "source_file",
                          component: int = -1, out: str = "period", digits: int = 4,
                          century: str = "20") -> DataFrame:
    """Snapshot date from the ``MMYY`` (or ``MMYYYY``) digits of a path
    component (S5); ``component=-2`` reads the folder of a partitioned
    write."""
    part = F.element_at(F.split(F.col(path_col), "/"), component)
    return df.withColumn(out, D.period_from_path(F.concat(F.lit("/"), part), digits, century))


def register(df: DataFrame, name: str, cache: bool = True) -> DataFrame:
    """Named table for SQL."""
    if cache:
        df = df.cache()
    df.createOrReplaceTempView(name)
    return df


def read_json_cube(spark: SparkSession, path, row_schema: T.StructType | str,
                   multiline: bool = True) -> DataFrame:
    """``{"data": [{...}, ...]}`` documents -> one row per record."""
    if isinstance(row_schema, str):
        row_schema = T._parse_datatype_string(row_schema)
    schema = T.StructType([T.StructField("data", T.ArrayType(row_schema))])
    doc = spark.read.option("multiLine", multiline).schema(schema).json(path)
    return doc.select(F.explode("data").alias("r")).select("r.*")


_FEATURE_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]))])


def read_polygons(spark: SparkSession, path, properties: Sequence[str],
                  collection: bool = False) -> DataFrame:
    """Polygon layer (S9): GeoJSON features (one per line, or a
    FeatureCollection when ``collection``) -> property columns + ``rings``."""
    if collection:
        doc = spark.read.option("multiLine", True).schema(
            T.StructType([T.StructField("features", T.ArrayType(_FEATURE_SCHEMA))])).json(path)
        feats = doc.select(F.explode("features").alias("f")).select("f.*")
    else:
        feats = spark.read.schema(_FEATURE_SCHEMA).json(path)
    rings = F.transform(F.col("geometry.coordinates"),
                        lambda ring: F.transform(ring, lambda p: F.struct(
                            p[0].alias("x"), p[1].alias("y"))))
    return feats.select(*[F.col("properties")[p].alias(p) for p in properties],
                        rings.cast(RINGS_TYPE).alias("rings"))


def write_polygons(df: DataFrame, path: str, properties: Sequence[str],
                   rings: str = "rings") -> None:
    """Polygon layer as GeoJSON features, one per line."""
    coords = F.transform(F.col(rings), lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"])))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.create_map(*[x for p in properties
                                   for x in (F.lit(p), F.col(p).cast("string"))]).alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
                    .alias("geometry"))
    df.select(F.to_json(feat).alias("value")).write.mode("overwrite").text(path)


def _gathered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of one folder in few tasks, so that not every task writes a file
    in every folder; AQE splits what is too large for one."""
    return df.hint("rebalance", *keys) if keys else df


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (),
              encoding: str = "UTF-8", header: bool = True) -> None:
    """CSV sink with header (S10); one folder per key with ``partition_by``
    and dynamic partition overwrite (S11)."""
    w = _gathered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    w = w.option("header", header).option("encoding", encoding)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    w = _gathered(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path, infer_partition_types: bool = False) -> DataFrame:
    """Parquet scan whose partition folder values stay strings (``09``
    is not 9); partition discovery happens when the DataFrame is made, so
    inference is switched off only for that call."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    old = spark.conf.get(key, "true")
    spark.conf.set(key, str(infer_partition_types).lower())
    try:
        return spark.read.parquet(*(path if isinstance(path, (list, tuple)) else [path]))
    finally:
        spark.conf.set(key, old)


def save_model(model, path: str) -> None:
    """Model sink (S12); reload with ``PipelineModel.load``."""
    model.write().overwrite().save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder on a cluster)."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
