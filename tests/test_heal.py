"""Healing against a plain relaxation, place by place; tones that it must keep; odd patches."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators.heal import heal
from gridspark.operators.regions import clone

SCHEMA = "image_id bigint, x bigint, y bigint, r double, g double, b double, a double"
CELLS = "image_id bigint, patch bigint, x bigint, y bigint, cover double"


def plain(image, cells, dx, dy, sweeps, margin):
    """The image (places to four values) with one patch healed."""
    cover = {p: max(c for q, c in cells if q == p) for p, _ in cells}
    cover = {p: c for p, c in cover.items() if c > 0}
    frame = [f(p[k] for p in cover) for k in (0, 1) for f in (min, max)]
    window = {p for p in image if frame[0] - margin <= p[0] <= frame[1] + margin and frame[2] - margin <= p[1] <= frame[3] + margin}
    copied = {p: image.get((p[0] + dx, p[1] + dy), (0.0,) * 4) for p in window}
    rim = [p for p in window if p not in cover and round(copied[p][3] * 255) > 0]
    out = {}
    for ch in range(3):
        field = {p: image[p][ch] - copied[p][ch] if p in rim else 0.0 for p in window}
        mean = sum(field[p] for p in rim) / len(rim) if rim else 0.0
        field |= {p: mean for p in window if p in cover}
        for _ in range(sweeps if rim else 0):
            around = lambda p: [field.get((p[0] + i, p[1] + j), field[p]) for i, j in ((-1, 0), (1, 0), (0, -1), (0, 1))]  # noqa: E731, B023
            field |= {p: sum(around(p)) / 4 for p in window if p in cover}
        for p in window & set(cover):
            out.setdefault(p, []).append(min(max(copied[p][ch] + field[p], 0.0), 1.0))
    mixed = lambda p, new: tuple(v + (n - v) * cover[p] for v, n in zip(image[p], (*new, copied[p][3]), strict=True))
    return {p: mixed(p, new) for p, new in out.items()}


@pytest.mark.parametrize("sweeps, margin, move", [(64, 6, (3, 5)), (3, 2, (-4, 2)), (0, 1, (1, 0))])
def test_heal_equals_a_plain_relaxation(spark, sweeps, margin, move):
    """Patches inside, at corners and over borders, some of their copies transparent or beyond the image, in two images; the last of two patches shows."""
    rng, rows, cells, images, want = random.Random(sweeps), [], [], {}, {}
    for i, (w, h) in enumerate([(24, 18), (11, 30)]):
        images[i] = {(x, y): tuple(rng.random() for _ in range(3)) + (rng.choice([0.0, 0.001, 0.5, 1.0]),) for x in range(w) for y in range(h)}
        rows += [(i, *p, *v) for p, v in images[i].items()]
        want |= {(i, *p): v for p, v in images[i].items()}
        for patch, (cx, cy) in enumerate([(0, 0), (6, 9), (8, 10), (w - 1, h - 2)]):
            own = [((cx + a, cy + b), rng.choice([0.0, 0.3, 1.0])) for a in range(-2, 3) for b in range(-2, 3)]
            own.append(own[3])
            cells += [(i, patch, *p, c) for p, c in own]
            want |= {(i, *p): v for p, v in plain(images[i], own, *move, sweeps, margin).items()}
    rng.shuffle(rows)
    got = heal(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(cells, CELLS), *move, sweeps, margin).collect()
    assert len(got) == len(want)
    assert all(abs(v - w) < 1e-9 for r in got for v, w in zip(tuple(r)[3:], want[tuple(r)[:3]], strict=True))
    assert any(tuple(r)[3:] != images[r.image_id][r.x, r.y] for r in got)


def test_heal_keeps_a_ramp_and_its_own_tone(spark):
    """Over a ramp of light the copy of a flat place becomes the ramp again; with no difference nothing is shifted."""
    ramp = [(0, x, y, *(x / 60 if y < 20 else 0.5,) * 3, 1.0) for x in range(30) for y in range(40)]
    px = spark.createDataFrame(ramp, SCHEMA)
    cells = spark.createDataFrame([(0, 1, x, y, 1.0) for x in range(12, 17) for y in range(8, 13)], CELLS)
    changed = heal(px, cells, 0, 20).where("x BETWEEN 12 AND 16 AND y BETWEEN 8 AND 12").collect()
    assert len(changed) == 25 and all(abs(r.r - r.x / 60) < 0.004 for r in changed)
    flat = px.withColumn("r", F.lit(0.25))
    assert {round(r.r, 12) for r in heal(flat, cells, 0, 20).collect()} == {0.25}


def test_odd_patches(spark):
    """No cells, none within the image, and a patch that is the whole image, which is a clone."""
    px = spark.createDataFrame([(0, x, y, x / 9, y / 9, 0.5, 1.0) for x in range(5) for y in range(4)], SCHEMA)
    rows = sorted(map(tuple, px.collect()))
    none = spark.createDataFrame([], CELLS)
    beyond = spark.createDataFrame([(0, 1, 40, 40, 1.0), (7, 1, 1, 1, 1.0), (0, 2, 1, 1, 0.0)], CELLS)
    for cells in (none, beyond):
        assert sorted(map(tuple, heal(px, cells, 1, 1).collect())) == rows
    assert heal(px.limit(0), beyond, 1, 1).count() == 0
    whole = spark.createDataFrame([(0, 1, x, y, 1.0) for x in range(5) for y in range(4)], CELLS)
    copied = clone(px, whole.select("image_id", "x", "y", F.lit(255).cast("bigint").alias("cov")), 1, 1)
    assert sorted(map(tuple, heal(px, whole, 1, 1).collect())) == sorted(map(tuple, copied.collect()))
