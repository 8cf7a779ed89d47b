"""Generators: rasters from an extent and parameters; they read no pixels (``df`` gives the extent)."""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, Px, clamp, hash01, let, num
from gridspark.plans.registry import kernel
from gridspark.plans.stencil import at, sizes

#: Pixels of a pattern's tile at most: it is broadcast.
TILE_PIXELS = 1 << 18
BLACK, WHITE = (0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0)


def _place(ox: int, oy: int) -> tuple[Column, Column]:
    return F.col("x") + ox, F.col("y") + oy


def _ramp(df, t: Column, c0, c1):
    return df.select(*at(df), *((num(p) + (num(q) - num(p)) * t).alias(c) for c, p, q in zip(CHANNELS, c0, c1, strict=True)))


@kernel("gen.solid", kind="frame", color=WHITE)
def solid(df, color):
    return df.select(*at(df), *(num(v).alias(c) for c, v in zip(CHANNELS, color, strict=True)))


@kernel("gen.checker", kind="frame", size=4, c0=BLACK, c1=WHITE, ox=0, oy=0)
def checker(df, size, c0, c1, ox, oy):
    x, y = _place(ox, oy)
    return _ramp(df, F.pmod(F.floor(x / size) + F.floor(y / size), F.lit(2)).cast("double"), c0, c1)


def _along(x0, y0, x1, y1, ox, oy):
    x, y = _place(ox, oy)
    ex, ey = x1 - x0, y1 - y0
    size = ex * ex + ey * ey
    return ((x - x0) * ex + (y - y0) * ey) / size if size else num(0)


@kernel("gen.linear_gradient", kind="frame", x0=0.0, y0=0.0, x1=16.0, y1=0.0, c0=BLACK, c1=WHITE, ox=0, oy=0)
def linear_gradient(df, x0, y0, x1, y1, c0, c1, ox, oy):
    return _ramp(df, clamp(_along(x0, y0, x1, y1, ox, oy)), c0, c1)


@kernel("gen.reflected_gradient", kind="frame", x0=0.0, y0=0.0, x1=16.0, y1=0.0, c0=BLACK, c1=WHITE, ox=0, oy=0)
def reflected_gradient(df, x0, y0, x1, y1, c0, c1, ox, oy):
    return _ramp(df, clamp(F.abs(_along(x0, y0, x1, y1, ox, oy))), c0, c1)


@kernel("gen.radial_gradient", kind="frame", cx=8.0, cy=8.0, radius=8.0, c0=BLACK, c1=WHITE, ox=0, oy=0)
def radial_gradient(df, cx, cy, radius, c0, c1, ox, oy):
    x, y = _place(ox, oy)
    t = clamp(F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / radius) if radius > 0 else num(0)
    return _ramp(df, t, c0, c1)


#: The degree-9 odd polynomial for the arc tangent on [0, 1] (Abramowitz and Stegun 4.4.49).
ATAN = (0.9998660, -0.3302995, 0.1801410, -0.0851330, 0.0208351)


def polynomial_atan2(y: Column, x: Column) -> Column:
    """An arc tangent that is the same on every engine, as it needs arithmetic only."""
    ax, ay = F.abs(x), F.abs(y)
    high = F.greatest(ax, ay)
    z = F.when(high == 0, 0.0).otherwise(F.least(ax, ay) / F.when(high == 0, 1.0).otherwise(high))

    def odd(z: Column) -> Column:
        s, p = z * z, num(ATAN[4])
        for k in reversed(ATAN[:4]):
            p = p * s + k
        return p * z

    angle = let(z, odd)
    angle = F.when(ay > ax, math.pi / 2 - angle).otherwise(angle)
    angle = F.when(x < 0, math.pi - angle).otherwise(angle)
    return F.when(y < 0, -angle).otherwise(angle)


def _turned(cx, cy, angle, ox, oy):
    x, y = _place(ox, oy)
    c, s = math.cos(angle), math.sin(angle)
    return (x - cx) * c + (y - cy) * s, (y - cy) * c - (x - cx) * s


@kernel("gen.angular_gradient", kind="frame", cx=8.0, cy=8.0, angle=0.0, c0=BLACK, c1=WHITE, ox=0, oy=0)
def angular_gradient(df, cx, cy, angle, c0, c1, ox, oy):
    rx, ry = _turned(cx, cy, angle, ox, oy)
    return _ramp(df, clamp((polynomial_atan2(ry, rx) + math.pi) / (2 * math.pi)), c0, c1)


@kernel("gen.diamond_gradient", kind="frame", cx=8.0, cy=8.0, angle=0.0, scale=8.0, c0=BLACK, c1=WHITE, ox=0, oy=0)
def diamond_gradient(df, cx, cy, angle, scale, c0, c1, ox, oy):
    rx, ry = _turned(cx, cy, angle, ox, oy)
    return _ramp(df, clamp((F.abs(rx) + F.abs(ry)) / scale) if scale > 0 else num(0), c0, c1)


@kernel("gen.noise", kind="frame", seed=1, amount=1.0, ox=0, oy=0)
def noise(df, seed, amount, ox, oy):
    v = hash01(*_place(ox, oy), seed) * amount
    return df.select(*at(df), v.alias("r"), v.alias("g"), v.alias("b"), num(1).alias("a"))


def _halves(v: Decimal) -> tuple[float, float]:
    """A number's multiple of 2**-26 and the rest."""
    high = round(v * 2**26) / 2**26
    return high, float(v - Decimal(high))


def _lattice(p: float, q: float, offset_x: float, offset_y: float, ox: int, oy: int) -> Column:
    """p * x + q * y of a place's middle less the offset, rounded once. Far down a raster, rounded products would lose a fraction's last digits,
    which are the weights of a pattern's pixels; so high parts, whose products are exact below 2**26 pixels, are summed before the low ones."""
    x, y = (v + 0.5 for v in _place(ox, oy))
    p, q, offset_x, offset_y = (Decimal(repr(float(v))) for v in (p, q, offset_x, offset_y))
    with localcontext(prec=80):
        parts = zip(*map(_halves, (p, q, offset_x * p + offset_y * q)), strict=True)
        high, low = (x * num(a) + y * num(b) - c for a, b, c in parts)
    return high + low


@kernel("gen.pattern", inputs=2, kind="frame", scale=1.0, angle_deg=0.0, offset_x=0.0, offset_y=0.0, opacity=1.0, tile_w=4, tile_h=4, ox=0, oy=0)
def pattern(df, tile, scale, angle_deg, offset_x, offset_y, opacity, tile_w, tile_h, ox, oy):
    """The second image's corner of tile_w x tile_h (all of it for 0), repeated on a turned and scaled lattice, over the first. A scale
    that is not above 0 shows nothing of it. The corner is one image, read by all of the first."""
    if not scale > 0:
        scale, opacity = 1.0, 0.0
    opacity = min(opacity, 1.0) if opacity > 0 else 0.0
    c, s = math.cos(math.radians(angle_deg)), math.sin(math.radians(angle_deg))
    px, py = (_lattice(p, q, offset_x, offset_y, ox, oy) / scale - 0.5 for p, q in ((c, s), (-s, c)))
    w, h = (min(n, m) if n > 0 else m for n, m in zip((tile_w, tile_h), map(int, sizes(tile.select("x", "y")).first()), strict=True))  # one row
    if w * h > TILE_PIXELS:
        raise ValueError(f"a pattern's tile has {TILE_PIXELS} pixels at most")
    small = F.broadcast(tile.where((F.col("x") < w) & (F.col("y") < h)).select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.struct(*CHANNELS).alias("_p")))
    read = df.select(*at(df), *(F.col(k).alias(f"c_{k}") for k in CHANNELS), px.alias("_px"), py.alias("_py"))
    total = None
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        wx, wy = (F.col(v) - F.floor(v) if k else 1 - F.col(v) + F.floor(v) for v, k in (("_px", i), ("_py", j)))
        read = read.withColumns({"_sx": F.pmod(F.floor("_px") + i, F.lit(w)), "_sy": F.pmod(F.floor("_py") + j, F.lit(h))}).join(small.withColumnRenamed("_p", f"_p{i}{j}"), ["_sx", "_sy"], "left").drop("_sx", "_sy")
        part = [wx * wy * F.coalesce(F.col(f"_p{i}{j}.{c}"), F.lit(0.0)) for c in CHANNELS]
        total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
    read = read.withColumns({f"s_{c}": v for c, v in zip(CHANNELS, total, strict=True)})
    # both are premultiplied: plain source-over needs no colours of its own, which pixels without alpha have none of
    return Px.of("c_").zip(Px.of("s_"), lambda b, t: t * opacity + b * (1 - F.col("s_a") * opacity)).select(read, *at(df))
