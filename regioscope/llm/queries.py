"""The registered queries of this subpackage: one per operator, over whole
tables with production parameters, with the DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regioscope.llm import oracles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary that the BPE queries use."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@register("op2_bpe_boundaries")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import bpe_boundaries
    return bpe_boundaries.digests(table(spark, sf_dir, "documents"), vocabulary())


@register("op5_odd_sketch", oracles.OP5)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import odd_sketch
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


@register("op10_suffix_radix", oracles.OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import suffix_radix
    return suffix_radix.digests(table(spark, sf_dir, "documents"))


@register("op7_warc_index", oracles.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import warc
    return warc.round_trip(table(spark, sf_dir, "pages"))


@register("op4_site_style_tree", oracles.OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from regioscope.llm import site_style_tree
    out = site_style_tree.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op9_winnowing", oracles.OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import winnowing
    return winnowing.digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op6_fuzzy_lines")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from regioscope.llm import line_dedup
    out = line_dedup.dedup_all_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_kept"),
                      F.sha2("text", 256).alias("text_sha256"))


@register("op8_co_training")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import co_training
    out = co_training.add_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "text_score", "meta_score", "score", "kept")


@register("op1_context_tree")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import context_tree
    return context_tree.score(table(spark, sf_dir, "documents"))


@register("op3_pivot_permutation", oracles.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import pivot_permutation
    return pivot_permutation.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op11_centroids", oracles.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import centroids
    return centroids.digests(table(spark, sf_dir, "embeddings"))


@register("op12_range_maximum", oracles.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import range_maximum
    return range_maximum.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_line_rules", oracles.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from regioscope.llm import line_rules
    return line_rules.judge(table(spark, sf_dir, "documents")).drop("clean_text")
