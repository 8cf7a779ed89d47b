"""Rings are chained within tiles first, so their rounds follow the tiles that they cross, not their sides."""

import random

import pytest

from gridspark.operators import regions
from tests.test_regions import plain_rings, plain_simplified, unit_steps


def comb(width, height):
    """One ring with a long border: a spine with teeth."""
    return {(x, y) for x in range(width) for y in range(height) if y == 0 or x % 2 == 0}


def test_a_long_ring_in_a_tile_takes_few_rounds(spark, monkeypatch):
    rounds, settled = [], regions.settled
    monkeypatch.setattr(regions, "settled", lambda df: rounds.append(1) or settled(df))
    inside = comb(61, 40)
    rows = regions.contours(spark.createDataFrame([(x, y, 255) for x, y in inside], "x long, y long, cov long")).orderBy("n").collect()
    assert [(r.x, r.y) for r in rows] == plain_rings(inside)[0, 0][1]
    assert len(rounds) <= 4  # the ring has 2,542 sides: doubling from side to side took 15


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_rings_across_tiles_against_a_walk(spark, monkeypatch, share):
    """Tiles of four places, also left of and above zero; two images, the same place twice, and places without x or an image."""
    monkeypatch.setattr(regions, "CHAINED", 4, raising=False)
    rng, cells, want, corners = random.Random(share), [(None, 1, 1, 255), (3, None, 1, 255)], {}, {}
    for image_id in (3, 8):
        inside = {(x, y) for x in range(-9, 10) for y in range(-7, 8) if rng.random() < share} if image_id == 3 else {(x - 5, y - 6) for x, y in comb(11, 12)}
        cells += [(image_id, x, y, c) for x in range(-9, 10) for y in range(-7, 8) for c in ([255, 255] if (x, y) in inside else [0])]
        rings = plain_rings(inside)
        corners |= {(image_id, *start): ring for start, ring in rings.items()}
        want |= {(image_id, *start): (outer, plain_simplified(unit_steps(points), 0.6)) for start, (outer, points) in rings.items()}
    cover = spark.createDataFrame(cells, "image_id long, x long, y long, cov long")
    for out, expected in ((regions.contours(cover), corners), (regions.simplified(cover, 0.6, segment=16), want)):
        got = {}
        for r in out.orderBy("image_id", "ring", "n").collect():
            at = got.setdefault((r.image_id, r.ring.x, r.ring.y), (r.outer, []))[1]
            assert r.n == len(at)
            at.append((r.x, r.y))
        assert got == expected
