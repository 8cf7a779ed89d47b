"""Rasters of several images: what is done to all of them at once equals what is done to each alone."""

import random
from functools import reduce as fold

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import reduce, regions, selection
from gridspark.plans import layers, versions
from gridspark.streaming import strokes

W, H, IMAGES = 9, 7, [3, 8, 11]
INK = ((0.9, 0.2, 0.1, 1.0), (0.1, 0.4, 0.8, 0.5))


@pytest.fixture(scope="module")
def px(spark):
    rng = random.Random(4)
    rows = [(i, x, y, *(rng.choice([0.0, 0.2, 0.5, 0.8, 1.0]) for _ in "rgba")) for i in IMAGES for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, r double, g double, b double, a double").cache()


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(5)
    rows = [(i, s, n, n, rng.uniform(0, W), rng.uniform(0, H), rng.uniform(0.3, 1)) for i in IMAGES for s in range(2) for n in range(3)]
    return spark.createDataFrame(rows, "image_id bigint, stroke bigint, ts bigint, event_id bigint, x double, y double, pressure double").cache()


def covers(px):
    return selection.from_channel(px.where("r > 0.3"), "g"), selection.from_channel(px.where("b > 0.3 OR x = 4"), "a")


def plates(px):
    return px.withColumn("z", F.col("x") % 2).unionByName(px.where("y > 2").withColumn("z", F.lit(2)))


def grouped(px):
    stack = layers.LayerStack(plates(px))
    top = stack.group(9, [layers.Layer(1), layers.Layer(2, "screen", 0.5)], "multiply", 0.8)
    stack.layers = [layers.Layer(0, mask=px.where("x < 6").select(*[c for c in px.columns if c == "image_id"], "x", "y", F.col("r").alias("m"))), top]
    return stack.composite()


def restored(px):
    first = versions.tiles(px, 4).withColumns({"generation": F.lit(1).cast("bigint"), "hole": F.lit(False)}).where("NOT (tx = 1 AND r > 0.9)")
    changed = versions.tiles(px.where("g > 0.7").withColumn("r", 1 - F.col("r")), 4)
    return versions.latest(versions.restore(versions.edit(first, changed, 2), 1, 3))


PIXELS = {
    "histogram": lambda p: reduce.histogram(p), "luma": lambda p: reduce.percentile_bin(reduce.histogram(p, True), 0.6), "dense": lambda p: reduce.dense_histogram(reduce.histogram(p)),
    "mean": lambda p: reduce.channel_mean(reduce.histogram(p)), "statistics": reduce.statistics, "channel_stats": reduce.channel_stats, "auto_enhance": reduce.auto_enhance,
    "shape": lambda p: reduce.lossless_shape(p.withColumn("g", F.when(F.col("r") < 2, F.col("r")))), "hash": reduce.content_hash, "half": lambda p: reduce.downsample_2x(p, W, H), "pyramid": lambda p: reduce.pyramid(p, W, H, 3),
    "opaque": lambda p: reduce.window_opaque(p.where("a > 0 OR x > 1"), 0, 0, 2, 2), "no_window": lambda p: reduce.window_opaque(p, 50, 50, 2, 2), "distance": lambda p: reduce.distance_transform(p.withColumn("m", F.when((F.col("r") == 1) & (F.col("g") == 1), 1.0).otherwise(0.0))),
    "bounds": lambda p: reduce.bounds(covers(p)[0].withColumn("cov", F.when(F.col("x") > 2, F.col("cov")).otherwise(0))), "fraction": lambda p: reduce.selected_fraction(covers(p)[0]),
    **{mode: lambda p, mode=mode: selection.combine(*covers(p), mode) for mode in ("replace", "add", "subtract", "intersect")},
    "invert": lambda p: selection.invert(covers(p)[0], W, H), "feather": lambda p: selection.feather(covers(p)[0], 0.8, W, H), "wand": lambda p: selection.wand(p, 4, 3, 80), "wand_far": lambda p: selection.wand(p, 4, 3, 80, contiguous=False),
    "quick": lambda p: selection.quick_select(p, p.where("y = 3 AND x < 4")), "clone": lambda p: regions.clone(p, covers(p)[0], 2, -1), **{f"fill_{k}": lambda p, k=k: regions.fill(p, covers(p)[0].where("x > 1 AND y < 5"), k, *INK) for k in ("radial", "noise", "solid")},
    "curve": lambda p: regions.curve_bytes(p, [255 - v for v in range(256)], covers(p)[1]), "outline": lambda p: regions.outline(covers(p)[0]), "contours": lambda p: regions.contours(covers(p)[0]),
    "stack": grouped, "chain": lambda p: layers.adjust_chain(p, blur=0.7, mask=p.where("x > 3").select(*[c for c in p.columns if c == "image_id"], "x", "y", F.col("b").alias("m")), exposure={"ev": 0.5}), "restored": restored,
}


def rows(df: DataFrame) -> list:
    names = sorted(df.columns)
    flat = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(flat(r[n]) for n in names) for r in df.collect()), key=repr)


def each_alone(px: DataFrame, f) -> DataFrame:
    return fold(DataFrame.unionByName, (f(px.where(F.col("image_id") == i).drop("image_id")).withColumn("image_id", F.lit(i).cast("bigint")) for i in IMAGES))


@pytest.mark.parametrize("name", PIXELS)
def test_all_images_at_once_are_each_alone(px, name):
    got, want = rows(PIXELS[name](px)), rows(each_alone(px, PIXELS[name]))
    assert got == want
    assert got and len({r for r in got}) > 1 or name == "no_window"


def test_strokes_of_all_images_are_those_of_each(px, samples):
    def painted(p, s):
        cover = strokes.stamp(strokes.dabs(s, 1.5), 2.0, 0.6)
        most = cover.groupBy(*[c for c in cover.columns if c in ("image_id", "x", "y")]).agg(F.max("cover").alias("cover"))
        return strokes.paint(p, strokes.effective_cover(most, 0.8, covers(p)[1]), (0.9, 0.2, 0.1))

    own = lambda df, i: df.where(F.col("image_id") == i).drop("image_id")
    alone = fold(DataFrame.unionByName, (painted(own(px, i), own(samples, i)).withColumn("image_id", F.lit(i).cast("bigint")) for i in IMAGES))
    got = rows(painted(px, samples))
    assert got == rows(alone) and got != rows(px)


def test_one_selection_for_all_images(px):
    """A selection without image_id holds for each image."""
    cover = px.where("image_id = 3 AND r > 0.3").select("x", "y", F.lit(200).cast("bigint").alias("cov"))
    got = regions.curve_bytes(px, [255 - v for v in range(256)], cover)
    assert got.count() == px.count() and got.where("image_id = 8 AND r <> 0").count() > 0
