"""Reductions: histograms, statistics, bounds, pyramids, of each image for itself. All are partial aggregates before one small shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, LUMA_601, LUMA_709, Px, luma
from gridspark.plans.stencil import TILE, at, image


def to_byte(v: Column) -> Column:
    return F.least(F.greatest(F.round(v * 255), F.lit(0.0)), F.lit(255.0)).cast("bigint")


def long_form(df: DataFrame, **values: Column) -> DataFrame:
    """channel, value: one row for each of the named values, with the columns that tell the image."""
    pairs = F.array(*(F.struct(F.lit(k).alias("channel"), v.alias("value")) for k, v in values.items()))
    return df.select(*image(df), F.inline(pairs))


def histogram(df: DataFrame, with_luma: bool = False) -> DataFrame:
    """channel, bin, n over 0..255 of r, g, b and alpha, or of Rec. 601 luma instead; empty bins are left out."""
    p = Px.of()
    values = {c: to_byte(getattr(p, c)) for c in "rgb"}
    if with_luma:
        # whole thousandths, so that halves round alike everywhere
        weighted = [v * round(w * 1000) for v, w in zip(values.values(), LUMA_601, strict=True)]
        values["luma"] = F.least(F.floor((weighted[0] + weighted[1] + weighted[2] + 500) / 1000), F.lit(255)).cast("bigint")
    else:
        values["a"] = to_byte(p.a)
    return long_form(df, **values).groupBy(*image(df), "channel", F.col("value").alias("bin")).agg(F.count("*").alias("n"))


def dense_histogram(hist: DataFrame) -> DataFrame:
    """With a row for each of the 256 bins."""
    keys = image(hist)
    bins = hist.select(*keys, "channel").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint"))))
    return bins.join(hist, [*keys, "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def percentile_bin(hist: DataFrame, fraction: float) -> DataFrame:
    """channel, bin: the first bin whose running count reaches the fraction (and at least one)."""
    each = Window.partitionBy(*image(hist), "channel")
    running, total = F.sum("n").over(each.orderBy("bin")), F.sum("n").over(each)
    counted = hist.select(*image(hist), "channel", "bin", running.alias("running"), total.alias("total"))
    return counted.where(F.col("running") >= F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))).groupBy(*image(hist), "channel").agg(F.min("bin").alias("bin"))


def channel_mean(hist: DataFrame) -> DataFrame:
    return hist.groupBy(*image(hist), "channel").agg((F.sum(F.col("bin") * F.col("n")) / F.sum("n")).alias("mean"))


def statistics(df: DataFrame) -> DataFrame:
    """channel, lo, hi, mean; zeros for an empty image."""
    p = Px.of()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    row = df.groupBy(*image(df)).agg(*(f(getattr(p, c)).alias(f"{c}_{n}") for c in CHANNELS for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))))
    return row.select(*image(df), F.inline(F.array(*(F.struct(F.lit(c).alias("channel"), *(zero(F.col(f"{c}_{n}")).alias(n) for n in ("lo", "hi", "mean"))) for c in CHANNELS))))


def channel_stats(df: DataFrame) -> DataFrame:
    """channel, lo, hi, mean of the channels and Rec. 709 luma; no rows for an empty image."""
    p = Px.of()
    values = {c: getattr(p, c) for c in CHANNELS} | {"luma": luma(p.rgb, LUMA_709)}
    return long_form(df, **values).groupBy(*image(df), "channel").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))


def auto_enhance(df: DataFrame) -> DataFrame:
    """One row for each image: in_black, in_white from the 0.5 % and 99.5 % of luma, temp and tint of a gray world; the identity for a flat or black image."""
    keys, hist = image(df), histogram(df, with_luma=True)
    low, high = (percentile_bin(hist, f).where("channel = 'luma'").groupBy(*keys).agg(F.max("bin").alias(n)) for f, n in ((0.005, "low"), (0.995, "high")))
    means = channel_mean(hist).groupBy(*keys).agg(*(F.max(F.when(F.col("channel") == c, F.col("mean"))).alias(f"m_{c}") for c in "rgb"))
    one = low.join(high, keys or None).join(means, keys or None)  # one row each, or one for each image
    gray = (F.col("m_r") + F.col("m_g") + F.col("m_b")) / 3
    fine = (F.col("high") > F.col("low")) & (F.least("m_r", "m_g", "m_b") > 1)
    gain = lambda c: gray / F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    kept = lambda v, d: F.when(fine, v).otherwise(d)
    return one.select(*keys, kept(F.col("low") / 255, 0.0).alias("in_black"), kept(F.col("high") / 255, 1.0).alias("in_white"), kept((gain("m_r") - gain("m_b")) / 2, 0.0).alias("temp"), kept(gain("m_g") - 1, 0.0).alias("tint"))


def lossless_shape(df: DataFrame) -> DataFrame:
    """shape: the fewest channels that hold the 8-bit image (gray, graya, rgb, rgba)."""
    b = {c: to_byte(getattr(Px.of(), c)) for c in CHANNELS}
    row = df.groupBy(*image(df)).agg(F.bool_and((b["r"] == b["g"]) & (b["g"] == b["b"])).alias("gray"), F.bool_and(b["a"] == 255).alias("opaque"))
    return row.select(*image(df), F.concat(F.when(F.col("gray"), "gray").otherwise("rgb"), F.when(F.col("opaque"), "").otherwise("a")).alias("shape"))


def content_hash(df: DataFrame) -> DataFrame:
    """n and an order-independent digest of a raster's places and bytes (not the byte hash of an encoded file)."""
    prime = 2147483647
    b = [to_byte(F.col(c)) for c in CHANNELS]
    word = (((b[0] * 256 + b[1]) * 256 + b[2]) * 256 + b[3]) % prime
    mixed = ((F.col("x") * 73856093 + F.col("y") * 19349663) % prime * 31 + word) % prime * 48271 % prime
    return df.groupBy(*image(df)).agg(F.count("*").alias("n"), F.coalesce(F.sum(mixed * mixed % prime), F.lit(0)).alias("digest"))


def bounds(coverage: DataFrame) -> DataFrame:
    """x0, y0, x1, y1 of the selected places; nulls if there are none."""
    x, y = (F.when(F.col("cov") > 0, F.col(c)) for c in "xy")
    return coverage.groupBy(*image(coverage)).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def selected_fraction(coverage: DataFrame) -> DataFrame:
    n = F.count("*")
    return coverage.groupBy(*image(coverage)).agg(F.when(n == 0, 0.0).otherwise(F.coalesce(F.sum("cov"), F.lit(0)) / (255 * F.when(n == 0, 1).otherwise(n))).alias("fraction"), F.coalesce(F.bool_and(F.col("cov") == 255), F.lit(True)).alias("all_one"), F.coalesce(F.bool_and(F.col("cov") == 0), F.lit(True)).alias("all_zero"))


def downsample_2x(df: DataFrame, width: int, height: int) -> DataFrame:
    """Half the size by 2x2 means of bytes, rounded down; an odd last row or column is left out. Images of one raster are of one size."""
    w, h = max(width // 2, 1), max(height // 2, 1)
    cell = df.where((F.col("x") < max(2 * w, 1)) & (F.col("y") < max(2 * h, 1))).groupBy(*image(df), F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
    return cell.agg(*(F.floor(F.sum(to_byte(F.col(c))) / F.count("*")).alias(c) for c in CHANNELS))


def pyramid(df: DataFrame, width: int, height: int, levels: int) -> DataFrame:
    """level, x, y, bytes of the channels; level 0 is the image. Each level is one aggregate of the one before. Images of one raster are of one size."""
    keys = [c for c in image(df) if c != "level"]
    base = df.select(*keys, "x", "y", *(to_byte(F.col(c)).alias(c) for c in CHANNELS))
    out, current = base.withColumn("level", F.lit(0)), base
    for level in range(1, levels):
        w, h = max(width // 2, 1), max(height // 2, 1)
        cells = current.where((F.col("x") < 2 * w) & (F.col("y") < 2 * h)).groupBy(*keys, F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
        current = cells.agg(*(F.floor(F.sum(c) / F.count("*")).alias(c) for c in CHANNELS))
        out, width, height = out.unionByName(current.withColumn("level", F.lit(level))), w, h
    return out


def window_opaque(df: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """One row for each image: is every pixel of a window there and opaque as a byte."""
    keys, inside = image(df), F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1)
    rows = df if keys else df.where(inside)  # images without a pixel in the window have their row, too
    full = F.coalesce(F.bool_and(F.when(inside, to_byte(F.col("a")) == 255)), F.lit(True))
    return rows.groupBy(*keys).agg(((F.count(F.when(inside, 1)) == width * height) & full).alias("opaque"))


def along(df: DataFrame, line: list[str], place: str, value: str) -> DataFrame:
    """Adds ``near``: the least value + |place - its place| on each line; nulls say nothing.

    Running minima within blocks of TILE places, and from block to block over one row for each block, so that a line is no unit of work."""
    gone, to_come = F.col(value) - F.col(place), F.col(value) + F.col(place)
    rows = df.withColumn("block", F.floor(F.col(place) / TILE))
    blocks = rows.groupBy(*line, "block").agg(F.min(gone).alias("gone"), F.min(to_come).alias("to_come"))
    order, part = Window.partitionBy(*line).orderBy("block"), Window.partitionBy(*line, "block").orderBy(place)
    before, after = F.min("gone").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.min("to_come").over(order.rowsBetween(1, Window.unboundedFollowing))
    blocks = blocks.select(*line, "block", before.alias("before"), after.alias("after"))
    left, right = F.min(gone).over(part.rowsBetween(Window.unboundedPreceding, 0)), F.min(to_come).over(part.rowsBetween(0, Window.unboundedFollowing))
    held = rows.withColumns({"left": left, "right": right}).join(blocks, [*line, "block"])
    near = F.least(F.least("left", "before") + F.col(place), F.least("right", "after") - F.col(place))
    return held.withColumn("near", near).drop("block", "left", "right", "before", "after")


def distance_transform(df: DataFrame, threshold: float = 0.5, manhattan: bool = False) -> DataFrame:
    """x, y, r: the chamfer distance (steps of 1 and sqrt 2, or 1 and 2) to the nearest place with m >= threshold; 65504 where an image has none.

    A shortest path runs along a diagonal first and then along a row or a column, within the frame of both ends. So the seeds spread along
    both diagonals, and what these hold spreads along rows and columns, each by ``along``; without diagonals, along rows and then columns.
    """
    keys = image(df)
    rows = df.select(*at(df), F.when(F.col("m") >= threshold, 0.0).alias("v"))
    if manhattan:
        rows = along(rows, [*keys, "y"], "x", "v").select(*at(df), F.col("near").alias("v"))
        return along(rows, [*keys, "x"], "y", "v").select(*at(df), F.coalesce("near", F.lit(65504.0)).alias("r"))
    step = 2.0**0.5
    rows = rows.withColumns({"falling": F.col("x") - F.col("y"), "rising": F.col("x") + F.col("y")})
    for line in ("falling", "rising"):
        rows = along(rows, [*keys, line], "x", "v").withColumnRenamed("near", f"by_{line}")
    rows = rows.select(*at(df), (F.least("by_falling", "by_rising") * step).alias("v"))
    rows = along(rows, [*keys, "y"], "x", "v").withColumnRenamed("near", "across")
    out = along(rows, [*keys, "x"], "y", "v")
    return out.select(*at(df), F.coalesce(F.least("across", "near"), F.lit(65504.0)).alias("r"))
