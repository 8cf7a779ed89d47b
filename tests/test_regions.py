"""Contours, brush tips and region reads on small fixtures, against plain versions."""

import math
import random

import pytest

from gridspark.operators import regions
from gridspark.plans.registry import apply
from gridspark.plans.roi import Region, apply_within, required
from gridspark.streaming import strokes

STEPS = [(1, 0), (0, 1), (-1, 0), (0, -1)]


def plain_rings(inside):
    """Rings as lists of corners, by walking the sides one by one."""
    sides = {}
    for x, y in inside:
        for d, (nx, ny), start in ((0, (x, y - 1), (x, y)), (1, (x + 1, y), (x + 1, y)), (2, (x, y + 1), (x + 1, y + 1)), (3, (x - 1, y), (x, y + 1))):
            if (nx, ny) not in inside:
                sides[start, d] = True
    every, out = set(sides), {}
    while sides:
        start = min((d != 0, y, x, d) for (x, y), d in sides)
        here, d, ring = (start[2], start[1]), start[3], []
        while sides.pop((here, d), None):
            ring.append((here, d))
            here = (here[0] + STEPS[d][0], here[1] + STEPS[d][1])
            d = next((t for t in ((d + 3) % 4, d, (d + 1) % 4, (d + 2) % 4) if (here, t) in every), d)
        area = sum(x * (y + STEPS[d][1]) - (x + STEPS[d][0]) * y for (x, y), d in ring)
        corners = [p for k, (p, d) in enumerate(ring) if ring[k - 1][1] != d]
        out[ring[0][0]] = (area > 0, corners)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contours_against_a_walk(spark, seed):
    rng = random.Random(seed)
    places = [(x, y, 255 if rng.random() < (0.3, 0.6, 0.9)[seed] else 100) for x in range(14) for y in range(11)]
    got = {}
    for r in regions.contours(spark.createDataFrame(places, "x long, y long, cov long")).orderBy("ring", "n").collect():
        got.setdefault((r.ring.x, r.ring.y), (r.outer, []))[1].append((r.x, r.y))
    assert got == plain_rings({(x, y) for x, y, c in places if c >= 128})


def test_contours_of_a_frame_and_of_nothing(spark):
    frame = [(x, y, 200) for x in range(5) for y in range(5) if not (1 <= x <= 3 and 1 <= y <= 3)]
    rows = regions.contours(spark.createDataFrame(frame, "x long, y long, cov long")).collect()
    assert sorted((r.outer, r.x, r.y) for r in rows) == [(False, 1, 1), (False, 1, 4), (False, 4, 1), (False, 4, 4), (True, 0, 0), (True, 0, 5), (True, 5, 0), (True, 5, 5)]
    assert regions.contours(spark.createDataFrame([], "x long, y long, cov long")).count() == 0


def unit_steps(corners):
    """The ring's points at every pixel's corner."""
    out = []
    for (x, y), (nx, ny) in zip(corners, [*corners[1:], corners[0]], strict=True):
        n = abs(nx - x) + abs(ny - y)
        out += [(x + (nx - x) * k // n, y + (ny - y) * k // n) for k in range(n)]
    return out


def plain_simplified(points, tolerance):
    kept = []
    for i, p in enumerate(points):
        a, b = kept[-1] if kept else points[i - 1], points[(i + 1) % len(points)]
        dx, dy = b[0] - a[0], b[1] - a[1]
        far = abs((p[0] - a[0]) * dy - (p[1] - a[1]) * dx) / math.hypot(dx, dy) if (dx, dy) != (0, 0) else math.dist(p, a)
        if far > tolerance:
            kept.append(p)
    return kept if len(kept) >= 3 else points


@pytest.mark.parametrize("tolerance, segment", [(0.0, 1 << 14), (0.5, 25), (0.7, 40), (2.0, 40)])
def test_simplified_contours_against_a_walk(spark, tolerance, segment):
    """Rings of two images, cut into short segments, whose walks hand points over to each other."""
    rng, cells, want = random.Random(int(10 * tolerance)), [], {}
    for image_id in (4, 9):
        blobs = [(rng.uniform(0, 24), rng.uniform(0, 18), rng.uniform(1, 5)) for _ in range(7)]
        inside = {(x, y) for x in range(24) for y in range(18) if any(math.dist((x, y), b[:2]) < b[2] for b in blobs)}
        cells += [(image_id, x, y, 255 if (x, y) in inside else 0) for x in range(24) for y in range(18)]
        want |= {(image_id, *start): (outer, plain_simplified(unit_steps(corners), tolerance)) for start, (outer, corners) in plain_rings(inside).items()}
    got = {}
    for r in regions.simplified(spark.createDataFrame(cells, "image_id long, x long, y long, cov long"), tolerance, segment=segment).orderBy("image_id", "ring", "n").collect():
        got.setdefault((r.image_id, r.ring.x, r.ring.y), (r.outer, []))[1].append((r.x, r.y))
    assert got == want
    assert len(want) > 3


def test_simplified_contours_of_nothing(spark):
    assert regions.simplified(spark.createDataFrame([], "x long, y long, cov long"), 1.0).count() == 0


def test_sampled_tip_builds_up(spark):
    alpha = {(x, y): (x * 60 + y * 35) % 256 for x in range(4) for y in range(3)}
    tip = spark.createDataFrame([(x, y, a) for (x, y), a in alpha.items()], "tx long, ty long, alpha long")
    dabs = [(1, 0, 5.2, 6.7, 1.0), (1, 1, 6.9, 6.1, 0.5), (2, 0, 5.0, 5.0, 0.8)]
    got = {(r.stroke, r.x, r.y): r.cover for r in strokes.stamp_sampled(spark.createDataFrame(dabs, "stroke long, n long, x double, y double, pressure double"), tip, (4, 3), 0.5, diameter=6.0, flow_by_pressure=True).collect()}
    want = {}
    for stroke, _, cx, cy, pressure in dabs:
        for px in range(-2, 15):
            for py in range(-2, 15):
                u, v = (px + 0.5 - cx) / 1.5 + 2 - 0.5, (py + 0.5 - cy) / 1.5 + 1.5 - 0.5
                i, j = math.floor(u), math.floor(v)
                c = sum(alpha.get((i + a, j + b), 0) * (u - i if a else 1 - u + i) * (v - j if b else 1 - v + j) for a in (0, 1) for b in (0, 1)) / 255 * 0.5 * pressure
                if c > 0:
                    want[stroke, px, py] = 1 - (1 - want.get((stroke, px, py), 0.0)) * (1 - c)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


@pytest.mark.parametrize(("name", "params"), [("rank.median3", {}), ("conv.smart_sharpen", {"radius_px": 1.5}), ("math.invert", {}), ("geom.mosaic", {"cell_px": 4.0}), ("gen.noise", {"seed": 3})])
def test_region_reads_equal_the_whole(spark, name, params):
    rng = random.Random(5)
    px = spark.createDataFrame([(x, y, *(rng.random() for _ in range(4))) for x in range(20) for y in range(20)], "x long, y long, r double, g double, b double, a double")
    region = Region(6, 0, 7, 9)
    rounded = lambda df: sorted((r.x, r.y, *(round(r[c], 9) for c in "rgba")) for r in df.collect())
    assert rounded(apply_within(px, name, region, **params)) == rounded(region.of(apply(px, name, **params)))


def test_required_regions():
    region = Region(10, 20, 5, 6)
    assert required("math.invert", region) == region
    assert required("conv.gaussian_h", region, radius=3) == Region(7, 20, 11, 6)
    assert required("gen.noise", region) == Region(0, 0, 0, 0)
    assert required("geom.mosaic", region) is None
