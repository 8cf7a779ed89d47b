"""Rasters derived from the driver's tables, and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Width of the raster of embeddings: 64 components, four channels a pixel.
WIDTH = 16


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x 0..15, y = vec_id; channels are the embedding's components, shifted by 0.5 and clamped. No shuffle: a row explodes into its pixels."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    value = lambda c: F.least(F.greatest(F.get("embedding", F.col("x").cast("int") * 4 + c).cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    cells = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))).alias("x"))
    return cells.select(F.col("x").cast("bigint").alias("x"), F.col("vec_id").alias("y"), *(F.coalesce(value(i), F.lit(0.0)).alias(c) for i, c in enumerate("rgba")))


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the raster of embeddings: the greatest vec_id, which Parquet's footers have."""
    return int(spark.read.parquet(f"{sf_dir}/embeddings.parquet").agg(F.coalesce(F.max("vec_id") + 1, F.lit(0))).first()[0])


def mirrored(px: DataFrame) -> DataFrame:
    """The raster read from right to left: a second input of the same extent."""
    return px.withColumn("x", F.lit(WIDTH - 1).cast("bigint") - F.col("x"))


def px_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z = label: ten sparse layers."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("y"), F.col("label").cast("bigint").alias("z"))
    return px_embed(spark, sf_dir).join(labels, "y")


def px_line(spark: SparkSession, sf_dir: str, width: int = 256) -> DataFrame:
    """x, y from the order key, z = line number; line items of one key are averaged first."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    key = [(F.col("l_orderkey") % width).alias("x"), F.floor(F.col("l_orderkey") / width).alias("y"), F.col("l_linenumber").cast("bigint").alias("z")]
    mean = item.groupBy("l_orderkey", "l_linenumber").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"))
    return mean.select(*key, (F.col("q") / 50).alias("r"), (F.col("d") * 10).alias("g"), (F.col("t") * 12.5).alias("b"), F.lit(1.0).alias("a"))


def grid(spark: SparkSession, width: int, height: int, ox: int = 0, oy: int = 0) -> DataFrame:
    """x, y of all places of an extent."""
    return spark.range(width * height).select((F.col("id") % width + ox).alias("x"), (F.floor(F.col("id") / width).cast("bigint") + oy).alias("y"))
