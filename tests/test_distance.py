"""Chamfer distances against all seeds, also from far away."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.reduce import distance_transform


def plain(seeds, x, y, manhattan):
    diagonal = 2.0 if manhattan else math.sqrt(2)
    return min((max(abs(x - a), abs(y - b)) + (diagonal - 1) * min(abs(x - a), abs(y - b)) for a, b in seeds), default=65504.0)


@pytest.mark.parametrize("manhattan", [False, True])
def test_distance_equals_all_seeds(spark, manhattan):
    """Frames of many shapes, wider and higher than a block, with few seeds and none; far seeds count as near ones."""
    rng, rows, want = random.Random(6), [], {}
    for i, (w, h, n) in enumerate([(700, 3, 1), (3, 700, 2), (40, 30, 4), (9, 5, 0), (270, 12, 3), (1, 1, 1)]):
        seeds = {(rng.randrange(w), rng.randrange(h)) for _ in range(n)}
        for x in range(w):
            for y in range(h):
                rows.append((i, x, y, 0.9 if (x, y) in seeds else 0.1))
                want[i, x, y] = plain(seeds, x, y, manhattan)
    rng.shuffle(rows)
    px = spark.createDataFrame(rows, "image_id bigint, x bigint, y bigint, m double")
    got = {tuple(r)[:3]: r.r for r in distance_transform(px, manhattan=manhattan).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert max(v for v in want.values() if v < 65504) > 300


def test_distance_without_pixels_and_of_nulls(spark):
    px = spark.createDataFrame([(0, 0, None), (1, 0, 1.0)], "x bigint, y bigint, m double")
    assert distance_transform(px.limit(0)).count() == 0
    assert {(r.x, r.r) for r in distance_transform(px).collect()} == {(0, 1.0), (1, 0.0)}
    assert [r.r for r in distance_transform(px.where(F.col("x") == 0)).collect()] == [65504.0]
