"""Selections: u8 coverage fields (x, y, cov 0..255; absent is 0) and their algebra, each image for itself."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS
from gridspark.plans.stencil import TILE, at, image, weighted_line
from gridspark.sources.rasters import grid


def from_channel(df: DataFrame, channel: str = "r") -> DataFrame:
    return df.select(*at(df), F.least(F.greatest(F.round(F.col(channel) * 255), F.lit(0.0)), F.lit(255.0)).cast("bigint").alias("cov"))


def combine(a: DataFrame, b: DataFrame, mode: str) -> DataFrame:
    """replace, add (the larger), subtract (a less its share covered by b) or intersect (the smaller)."""
    both = a.select(*at(a), F.col("cov").alias("p")).join(b.select(*at(a), F.col("cov").alias("q")), at(a), "full_outer")
    p, q = F.coalesce("p", F.lit(0)), F.coalesce("q", F.lit(0))
    value = {"replace": q, "add": F.greatest(p, q), "subtract": F.floor((p * (255 - q) + 127) / 255), "intersect": F.least(p, q)}[mode]
    return both.select(*at(a), value.cast("bigint").alias("cov"))


def over_frame(cov: DataFrame, width: int, height: int) -> DataFrame:
    """All places of the frame of each image that the selection knows, with null where it has no row."""
    keys = image(cov)
    if not keys:
        full = grid(cov.sparkSession, width, height)
    else:
        full = cov.select(*keys).distinct().withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(height - 1).cast("bigint"))))
        full = full.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint"))))
    return full.join(cov.select(*at(cov), "cov"), at(cov), "left")


def invert(cov: DataFrame, width: int, height: int) -> DataFrame:
    return over_frame(cov, width, height).select(*at(cov), (255 - F.coalesce("cov", F.lit(0))).alias("cov"))


def _overlap(at: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(at + 1, F.lit(hi)) - F.greatest(at, F.lit(lo)), F.lit(0.0))


def rectangle(spark: SparkSession, width: int, height: int, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Exact area coverage of a rectangle."""
    area = _overlap(F.col("x").cast("double"), x0, x1) * _overlap(F.col("y").cast("double"), y0, y1)
    return grid(spark, width, height).select("x", "y", F.round(area * 255).cast("bigint").alias("cov"))


def ellipse(spark: SparkSession, width: int, height: int, cx: float, cy: float, rx: float, ry: float) -> DataFrame:
    """4 x 4 samples of each pixel."""
    inside = [((F.col("x") + (i + 0.5) / 4 - cx) / rx) * ((F.col("x") + (i + 0.5) / 4 - cx) / rx) + ((F.col("y") + (j + 0.5) / 4 - cy) / ry) * ((F.col("y") + (j + 0.5) / 4 - cy) / ry) <= 1 for j in range(4) for i in range(4)]
    hits = sum((F.when(c, 1).otherwise(0) for c in inside[1:]), F.when(inside[0], 1).otherwise(0))
    return grid(spark, width, height).select("x", "y", F.round(hits * 255 / 16).cast("bigint").alias("cov"))


def polygon(spark: SparkSession, width: int, height: int, points: list[tuple[float, float]]) -> DataFrame:
    """Even-odd filling with four scan lines a pixel row and exact coverage along them."""
    if len(points) < 3:
        return grid(spark, width, height).select("x", "y", F.lit(0).cast("bigint").alias("cov"))
    edges = spark.createDataFrame([(*p, *q) for p, q in zip(points, [*points[1:], points[0]], strict=True)], "ax double, ay double, bx double, by double")
    lines = spark.range(4 * height).select("id", ((F.col("id") + 0.5) / 4).alias("at"))
    # an edge holds its upper end, not its lower one
    crossing = lines.join(F.broadcast(edges), (F.least("ay", "by") <= F.col("at")) & (F.col("at") < F.greatest("ay", "by")))
    crossing = crossing.select("id", (F.col("ax") + (F.col("at") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("cx"))
    order = F.row_number().over(Window.partitionBy("id").orderBy("cx")) - 1
    spans = crossing.withColumn("n", order).groupBy("id", F.floor(F.col("n") / 2).alias("pair")).agg(F.min("cx").alias("lo"), F.max("cx").alias("hi"))
    first, last = F.greatest(F.floor("lo"), F.lit(0)), F.least(F.ceil("hi") - 1, F.lit(width - 1))
    cells = spans.where(last >= first).withColumn("x", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    part = F.greatest(F.least(F.col("x") + 1.0, F.col("hi")) - F.greatest(F.col("x").cast("double"), F.col("lo")), F.lit(0.0))
    area = cells.groupBy("x", F.floor(F.col("id") / 4).alias("y")).agg((F.sum(part) / 4).alias("area"))
    full = grid(spark, width, height).join(area, ["x", "y"], "left")
    return full.select("x", "y", F.round(F.least(F.coalesce("area", F.lit(0.0)), F.lit(1.0)) * 255).cast("bigint").alias("cov"))


def _near(df: DataFrame, x: int, y: int, tolerance: float) -> DataFrame:
    """x, y of the pixels whose channels all are within the tolerance (in bytes) of those of their image's pixel at the seed."""
    keys = image(df)
    seed = df.where((F.col("x") == x) & (F.col("y") == y)).select(*keys, *(F.round(F.col(c) * 255).alias(f"k_{c}") for c in CHANNELS))
    far = F.greatest(*(F.abs(F.round(F.col(c) * 255) - F.col(f"k_{c}")) for c in CHANNELS))
    held = df.join(seed, keys) if keys else df.join(F.broadcast(seed))  # one row
    return held.where(far <= tolerance).select(*at(df))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which executors share; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridspark-"))
    return sc.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def connected(places: DataFrame, seeds: DataFrame) -> DataFrame:
    """The x, y of ``places`` that are connected to one of ``seeds`` by steps along x and y.

    Runs along rows (cut at tiles, so that a line is no unit) are the nodes; labels pass between touching runs and jump to
    their labels' labels, so the rounds grow with the logarithm of a region's turns."""
    keys = image(places)
    tile = F.floor(F.col("x") / TILE)
    step = F.col("x") - F.row_number().over(Window.partitionBy(*keys, "y", "tile").orderBy("x"))
    runs = places.select(*keys, "x", "y", tile.alias("tile")).withColumn("run", step).groupBy(*keys, "y", "tile", "run").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    runs = settled(runs.select(*keys, "y", "tile", "lo", "hi", F.struct("y", "lo").alias("node")))
    after = runs.select(*keys, (F.col("y") - 1).alias("y"), "tile", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("node").alias("b"))
    beside = runs.select(*keys, "y", (F.col("lo") - 1).alias("hi"), F.col("node").alias("b"))
    down = runs.join(after, [*keys, "y", "tile"]).where((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi")))
    edges = down.select(*keys, F.col("node").alias("a"), "b").unionByName(runs.join(beside, [*keys, "y", "hi"]).select(*keys, F.col("node").alias("a"), "b"))
    edges = settled(edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = settled(runs.select(*keys, "node", F.col("node").alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, [*keys, "node"], "left").select(*keys, "node", "label", F.coalesce(F.least("label", "near"), "label").alias("least"))
        # what a node hears is also told to the node that its label names, so that whole trees are hung up at once
        told = met.select(*keys, "node", "least", F.col("label").alias("old")).unionByName(met.select(*keys, F.col("label").alias("node"), "least", F.lit(None).cast(met.schema["label"].dataType).alias("old")))
        hung = told.groupBy(*keys, "node").agg(F.min("least").alias("label"), F.max("old").alias("old"))
        jump = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("far"))
        new = settled(hung.join(jump, [*keys, "label"]).select(*keys, "node", "old", F.least("label", "far").alias("label")))
        labels = new.drop("old")
        if new.where("old != label").isEmpty():
            break
    held = runs.join(labels, [*keys, "node"])
    asked = seeds.select(*keys, "y", F.col("x").alias("sx"), F.floor(F.col("x") / TILE).alias("tile")).distinct()
    wanted = held.join(asked, [*keys, "y", "tile"]).where(F.col("sx").between(F.col("lo"), F.col("hi"))).select(*keys, "label").distinct()
    return held.join(wanted, [*keys, "label"], "left_semi").select(*keys, F.explode(F.sequence("lo", "hi")).alias("x"), "y")


def wand(df: DataFrame, x: int, y: int, tolerance: float, contiguous: bool = True) -> DataFrame:
    """Places like the seed, all of them or those connected to it by their edges."""
    near = _near(df, x, y, tolerance)
    if contiguous:
        near = connected(near, near.where((F.col("x") == x) & (F.col("y") == y)))
    return near.withColumn("cov", F.lit(255).cast("bigint"))


def feather(cov: DataFrame, sigma: float, width: int, height: int) -> DataFrame:
    """A separable Gaussian of three sigmas; outside is 0 and the weights are not made up for at the border."""
    r = math.ceil(3 * sigma)
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}
    weights = {d: w / sum(raw.values()) for d, w in raw.items()}
    field = over_frame(cov, width, height).select(*at(cov), F.coalesce(F.col("cov"), F.lit(0)).cast("double").alias("r"), *(F.lit(0.0).alias(c) for c in "gba"))
    soft = weighted_line(weighted_line(field, weights, "x", "zero"), weights, "y", "zero")
    return soft.select(*at(cov), F.least(F.greatest(F.round("r"), F.lit(0.0)), F.lit(255.0)).cast("bigint").alias("cov"))


def mask_window(cov: DataFrame, df: DataFrame) -> DataFrame:
    """x, y, m for the masked operators: the selection over the places of a raster, 0 where it has none."""
    return df.select(*at(df)).join(cov.select(*at(cov), "cov"), at(cov), "left").select(*at(df), (F.coalesce("cov", F.lit(0)) / 255).alias("m"))


def quick_select(df: DataFrame, painted: DataFrame) -> DataFrame:
    """The painted places and all that are connected to them through places within min(72, 16 + 1.5 sigma) bytes of the painted
    places' mean, in each of the four channels, in their image."""
    keys = image(df)
    inked = df.join(painted.select(*at(painted)), at(painted), "left_semi")
    stats = inked.groupBy(*keys).agg(*(f(F.round(F.col(c) * 255)).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    far = [F.abs(F.round(F.col(c) * 255) - F.col(f"m_{c}")) > F.least(F.lit(72.0), 16 + 1.5 * F.col(f"s_{c}")) for c in CHANNELS]
    rows = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))  # one row
    alike = rows.where(~(far[0] | far[1] | far[2] | far[3])).select(*at(df))
    held = inked.select(*at(df))
    return connected(alike.unionByName(held).distinct(), held).withColumn("cov", F.lit(255).cast("bigint"))
