"""One long stroke is built up by many tasks, and fills work out a place's share once."""

import random

from pyspark.sql import functions as F

from gridspark.operators import regions
from gridspark.streaming import strokes


def test_a_stroke_is_dealt_out_by_tiles(spark, monkeypatch):
    rng = random.Random(2)
    dabs = spark.createDataFrame([(1, n, rng.uniform(-90, 90), rng.uniform(-90, 90), rng.random()) for n in range(300)], "stroke long, n long, x double, y double, pressure double").repartition(1, "stroke")
    tip = spark.createDataFrame([(x, y, 60 * x + 9 * y) for x in range(4) for y in range(3)], "tx long, ty long, alpha long")
    forms = (lambda: strokes.stamp(dabs, 5.0, 0.6), lambda: strokes.stamp_sampled(dabs, tip, (4, 3), 0.6, diameter=7.0))
    whole = [{(r.x, r.y): round(r.cover, 9) for r in f().collect()} for f in forms]
    monkeypatch.setattr(strokes, "PART_CELLS", 2000, raising=False)
    for f, want in zip(forms, whole, strict=True):
        rows = f().withColumn("part", F.spark_partition_id()).collect()
        assert {(r.x, r.y): round(r.cover, 9) for r in rows} == want and len(rows) == len(want)
        assert len({r.part for r in rows}) > 3


def test_a_fill_works_out_its_place_once(spark):
    px = spark.range(9).select((F.col("id") % 3).alias("x"), F.floor(F.col("id") / 3).alias("y"), *(F.lit(0.5).alias(c) for c in "rgba"))
    out = regions.fill(px, px.select("x", "y", F.lit(255).alias("cov")), "angular")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("0.0208351") <= 8
