"""Versioned tiles: an append-only table of (tile, generation, pixels), its latest state, undo as new versions, incremental evaluation.

Tables of many images tell them apart by ``image_id``; each has its tiles, and a generation is one of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS
from gridspark.plans.stencil import image

TILE = 256


def tiles(df: DataFrame, size: int = TILE) -> DataFrame:
    """Adds tx, ty; floors, so negative places have tiles too."""
    return df.withColumns({"tx": F.floor(F.col("x") / size).cast("int"), "ty": F.floor(F.col("y") / size).cast("int")})


def tile_of(df: DataFrame) -> list[str]:
    return [*image(df), "tx", "ty"]


def tile_list(spark, x: int, y: int, w: int, h: int, size: int = TILE) -> DataFrame:
    """tx, ty of the tiles that a region touches."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(y // size), F.lit((y + h - 1) // size))).alias("ty"))
    return one.select(F.explode(F.sequence(F.lit(x // size), F.lit((x + w - 1) // size))).alias("tx"), "ty")


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each tile; a tombstone (``hole``) leaves none."""
    newest = F.max("generation").over(Window.partitionBy(*tile_of(versions)))
    return versions.withColumn("_newest", newest).where((F.col("generation") == F.col("_newest")) & ~F.col("hole")).drop("_newest")


def edit(versions: DataFrame, changed: DataFrame, generation: int) -> DataFrame:
    """The versions with the changed tiles' pixels (tx, ty, x, y, r, g, b, a) appended as a new generation."""
    return versions.unionByName(changed.withColumns({"generation": F.lit(generation).cast("bigint"), "hole": F.lit(False)}).select(versions.columns))


def restore(versions: DataFrame, generation: int, as_generation: int) -> DataFrame:
    """Undo or redo: the tiles that changed after ``generation`` get what they had then, as a new generation; a tile that was not there becomes a hole."""
    tile = tile_of(versions)
    after = versions.where(F.col("generation") > generation).select(*tile).distinct()
    then = latest(versions.where(F.col("generation") <= generation)).join(after, tile, "left_semi")
    gone = after.join(then.select(*tile).distinct(), tile, "left_anti")
    holes = gone.select(*tile, F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), *(F.lit(0.0).alias(c) for c in CHANNELS)).withColumn("hole", F.lit(True))
    again = then.select(*tile, "x", "y", *CHANNELS).withColumn("hole", F.lit(False)).unionByName(holes)
    return versions.unionByName(again.withColumn("generation", F.lit(as_generation).cast("bigint")).select(versions.columns))


def incremental(versions: DataFrame, since: int, before: DataFrame, f) -> DataFrame:
    """A point pipeline's result after edits: only tiles changed since a generation are evaluated again; the others come from ``before`` (tx, ty, x, y, channels)."""
    tile = tile_of(versions)
    changed = versions.where(F.col("generation") > since).select(*tile).distinct()
    fresh = f(latest(versions).join(changed, tile, "left_semi"))
    return before.join(changed, tile, "left_anti").unionByName(tiles(fresh).select(before.columns))
