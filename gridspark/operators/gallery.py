"""Stylising kernels. Each blends its result with the input by ``amount``; alpha stays.

Hash salts of the separate noise streams are fixed values.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, LUMA_709, Px, clamp, hash01, luma, mix, num, smoothstep
from gridspark.plans.registry import kernel
from gridspark.plans.stencil import at, looked_up, moved, sobel, square3, tiled

GREEN_STREAM, BLUE_STREAM, DISC_STREAM, SITE_STREAM = 2654435769, 2246822507, 668265261, 3037000493


def _styled(rows, colour, amount, own=CHANNELS):
    """The colour blended with the pixel's own."""
    k = min(max(amount, 0.0), 1.0)
    return rows.select(*at(rows), *(mix(F.col(o), v, k).alias(c) for c, o, v in zip("rgb", own, colour, strict=False)), F.col(own[3]).alias("a"))


def _step(lo: Column, hi: Column, x: Column) -> Column:
    t = clamp((x - lo) / (hi - lo))
    return t * t * (3 - 2 * t)


def _light(p) -> Column:
    return luma([clamp(c) for c in p], LUMA_709)


def _own(df):
    return df.select(*at(df), *(F.col(c).alias(f"c_{c}") for c in CHANNELS))


OWN = tuple(f"c_{c}" for c in CHANNELS)


def _single(df, sx: Column, sy: Column):
    """Each place's own pixel (c_) and that of one other place (s_)."""
    return looked_up(df, _own(df), sx, sy)


@kernel("gallery.kuwahara", kind="frame", radius_px=2.0, amount=1.0)
def kuwahara(df, radius_px, amount):
    """The mean of the quadrant whose luma varies least; the first one wins ties."""
    r = int(min(max(math.floor(radius_px + 0.5), 1), 8))
    spans = ((-r, 0), (0, r))

    def run(source, x, y):
        own = moved(source, r, 0, 0)
        best, least = None, None
        for q in range(4):
            parts = [moved(source, r, dx, dy) for dy in range(spans[q >> 1][0], spans[q >> 1][1] + 1) for dx in range(spans[q & 1][0], spans[q & 1][1] + 1)]
            lights = [sum(p[k] * w for k, w in enumerate(LUMA_709)) for p in parts]
            mean, light, square = (sum(v) / len(v) for v in (parts, lights, [v * v for v in lights]))
            spread = np.round(np.maximum(square - light * light, 0.0), 12)
            better = np.ones(spread.shape, bool) if least is None else spread < least
            best, least = (mean, spread) if least is None else (np.where(better, mean, best), np.minimum(spread, least))
        k = min(max(amount, 0.0), 1.0)
        return np.concatenate([own[:3] + (np.clip(best[:3], 0.0, 1.0) - own[:3]) * k, own[3:]])

    return tiled(df, r, run)


def _with_luma(df):
    """Nine lumas around each place in n_r."""
    light = df.select(*at(df), luma(Px.of().rgb, LUMA_709).alias("r"), *(F.lit(0.0).alias(c) for c in "gba"))
    return square3(light).select(*at(df), F.col("n_r").alias("n_l")).join(df, at(df))


@kernel("gallery.posterize_edges", kind="frame", levels=4.0, edge_amount=1.0, edge_threshold=0.2, amount=1.0)
def posterize_edges(df, levels, edge_amount, edge_threshold, amount):
    n = max(math.floor(levels + 0.5), 2)
    rows = _with_luma(df)
    gx, gy = sobel("n_l")
    low = max(edge_threshold, 0.0)
    ink = smoothstep(low, low + 0.05, F.sqrt(gx * gx + gy * gy)) * min(max(edge_amount, 0.0), 1.0)
    return _styled(rows, [clamp(F.least(F.floor(clamp(F.col(c)) * n).cast("double"), num(n - 1)) / (n - 1) * (1 - ink)) for c in "rgb"], amount)


@kernel("gallery.glowing_edges", kind="frame", intensity=1.0, smoothness=0.5, amount=1.0)
def glowing_edges(df, intensity, smoothness, amount):
    def f(c):
        gx, gy = sobel(f"n_{c}")
        g = clamp(F.sqrt(gx * gx + gy * gy) * intensity)
        return mix(g, smoothstep(0.0, 1.0, g), min(max(smoothness, 0.0), 1.0))

    return _styled(square3(df), [f(c) for c in "rgb"], amount)


def _fract(v: Column) -> Column:
    return v - F.floor(v)


@kernel("gallery.halftone", kind="frame", cell_px=4.0, angle_deg=0.0, contrast=1.0, amount=1.0, ox=0, oy=0)
def halftone(df, cell_px, angle_deg, contrast, amount, ox, oy):
    cell, soft = max(cell_px, 1.0), max(0.5 / max(contrast, 0.01), 0.001)
    x, y = F.col("x") + ox, F.col("y") + oy

    def dots(v, turn):
        c, s = math.cos(math.radians(angle_deg + turn)), math.sin(math.radians(angle_deg + turn))
        fx, fy = _fract((x * c - y * s) / cell) - 0.5, _fract((x * s + y * c) / cell) - 0.5
        radius = F.sqrt(1 - clamp(v)) * cell * math.sqrt(0.5)
        return _step(radius - soft, radius + soft, F.sqrt(fx * fx + fy * fy) * cell)

    return _styled(df, [dots(F.col(c), turn) for c, turn in zip("rgb", (15, 75, 0), strict=True)], amount)


@kernel("gallery.grain", kind="frame", seed=1, size_px=1.0, mono=1, amount=1.0, ox=0, oy=0)
def grain(df, seed, size_px, mono, amount, ox, oy):
    s = max(size_px, 1.0)
    cx, cy = F.floor((F.col("x") + ox) / s), F.floor((F.col("y") + oy) / s)
    seeds = (seed,) * 3 if mono else (seed, seed ^ GREEN_STREAM, seed ^ BLUE_STREAM)
    return _styled(df, [clamp(F.col(c) + hash01(cx, cy, k) - 0.5) for c, k in zip("rgb", seeds, strict=True)], amount)


@kernel("gallery.diffuse", kind="frame", seed=1, radius_px=3.0, angle_deg=0.0, anisotropy=0.0, amount=1.0, ox=0, oy=0)
def diffuse(df, seed, radius_px, angle_deg, anisotropy, amount, ox, oy):
    gx, gy = F.col("x") + ox, F.col("y") + oy
    angle, rad = hash01(gx, gy, seed) * (2 * math.pi), F.sqrt(hash01(gx, gy, seed ^ DISC_STREAM)) * min(max(radius_px, 0.0), 8.0)
    dx, dy = math.cos(math.radians(angle_deg)), -math.sin(math.radians(angle_deg))
    along, across = F.cos(angle) * rad, F.sin(angle) * rad * (1 - min(max(anisotropy, 0.0), 1.0))
    read = _single(df, F.col("x") + F.rint(along * dx - across * dy), F.col("y") + F.rint(along * dy + across * dx))
    k = min(max(amount, 0.0), 1.0)
    return read.select(*at(read), *(mix(F.col(f"c_{c}"), F.col(f"s_{c}"), k).alias(c) for c in CHANNELS))


@kernel("gallery.crosshatch", kind="frame", angle_deg=45.0, spacing_px=4.0, strength=1.0, sets=2, amount=1.0, ox=0, oy=0)
def crosshatch(df, angle_deg, spacing_px, strength, sets, amount, ox, oy):
    n, gap = min(max(sets, 1), 3), max(spacing_px, 1.0)
    x, y = F.col("x") + ox, F.col("y") + oy
    half = 0.5 * clamp((1 - _light(Px.of().rgb)) * max(strength, 0.0))
    soft, paper = max(0.5 / gap, 0.001), num(1)
    for k in range(n):
        angle = math.radians(angle_deg) + math.pi * k / n
        away = F.abs(_fract((x * math.cos(angle) + y * math.sin(angle)) / gap) - 0.5)
        paper = paper * F.when(half <= 0, 1.0).otherwise(_step(half - soft, half + soft, away))
    return _styled(df, [clamp(paper)] * 3, amount)


@kernel("gallery.bas_relief", kind="frame", angle_deg=45.0, elevation_deg=30.0, height=1.0, amount=1.0)
def bas_relief(df, angle_deg, elevation_deg, height, amount):
    gx, gy = sobel("n_l")
    lx, ly = math.cos(math.radians(angle_deg)), -math.sin(math.radians(angle_deg))
    shade = clamp(0.5 + (gx * lx + gy * ly) * (height / 8) * math.cos(math.radians(min(max(elevation_deg, 0.0), 89.0))))
    return _styled(_with_luma(df), [shade] * 3, amount)


@kernel("gallery.threshold_ink", kind="frame", threshold=0.5, softness=0.1, amount=1.0)
def threshold_ink(df, threshold, softness, amount):
    s = max(softness, 2.0**-10)
    return _styled(df, [smoothstep(threshold - s, threshold + s, _light(Px.of().rgb))] * 3, amount)


@kernel("gallery.stained_glass", kind="frame", seed=1, cell_px=4.0, border=0.1, amount=1.0, ox=0, oy=0)
def stained_glass(df, seed, cell_px, border, amount, ox, oy):
    """Panes around jittered sites, coloured at the site; borders where two sites are about as far."""
    s = min(max(cell_px, 2.0), 24.0)
    px, py = (F.col("x") + ox) / s, (F.col("y") + oy) / s

    def site(i, j):
        cx, cy = F.floor(px) + i, F.floor(py) + j
        sx, sy = cx + hash01(cx, cy, seed), cy + hash01(cx, cy, seed ^ SITE_STREAM)
        return F.struct(F.sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy)).alias("d"), F.lit((j + 1) * 3 + i + 1).alias("n"), sx.alias("sx"), sy.alias("sy"))

    near = _own(df).withColumn("sites", F.array_sort(F.array(*(site(i, j) for j in (-1, 0, 1) for i in (-1, 0, 1)))))
    first, second = F.get("sites", 0), F.get("sites", 1)
    away = lambda v: clamp(F.rint(v), -24.0, 24.0)
    near = near.select(*at(df), *OWN, ((second["d"] - first["d"]) * 0.5).alias("gap"), away(first["sx"] * s - F.col("x") - ox).alias("dx"), away(first["sy"] * s - F.col("y") - oy).alias("dy"))
    read = looked_up(df, near, F.col("x") + F.col("dx"), F.col("y") + F.col("dy"))
    edge = 1 - smoothstep(0.0, max(min(max(border, 0.0), 1.0), 0.001), F.col("gap")) if border > 0 else num(0)
    return _styled(read, [clamp(F.col(f"s_{c}") * (1 - edge)) for c in "rgb"], amount, OWN)


def value_noise(px: Column, py: Column, seed: int) -> Column:
    ix, iy = F.floor(px), F.floor(py)
    fx, fy = px - ix, py - iy
    ux, uy = fx * fx * (3 - 2 * fx), fy * fy * (3 - 2 * fy)
    h = lambda i, j: hash01(ix + i, iy + j, seed)
    return mix(mix(h(0, 0), h(1, 0), ux), mix(h(0, 1), h(1, 1), ux), uy)


@kernel("gallery.glass", kind="frame", seed=1, scale_px=4.0, distortion=8.0, amount=1.0, ox=0, oy=0)
def glass(df, seed, scale_px, distortion, amount, ox, oy):
    s, most = max(scale_px, 2.0), min(max(distortion, 0.0), 16.0)
    px, py = (F.col("x") + ox) / s, (F.col("y") + oy) / s
    slope = lambda ex, ey: value_noise(px + ex, py + ey, seed) - value_noise(px - ex, py - ey, seed)
    moved = lambda v: clamp(F.rint(v * most), -16.0, 16.0)
    read = _single(df, F.col("x") + moved(slope(0.5, 0.0)), F.col("y") + moved(slope(0.0, 0.5)))
    k = min(max(amount, 0.0), 1.0)
    return read.select(*at(read), *(mix(F.col(f"c_{c}"), F.col(f"s_{c}"), k).alias(c) for c in CHANNELS))


@kernel("gallery.texturizer", kind="frame", seed=1, texture=0, scale_px=4.0, relief=1.0, angle_deg=45.0, amount=1.0, ox=0, oy=0)
def texturizer(df, seed, texture, scale_px, relief, angle_deg, amount, ox, oy):
    """texture: 0 canvas, 1 burlap, 2 brick."""
    s = max(scale_px, 2.0)

    def height(x, y):
        if texture == 1:
            return 0.65 * value_noise(x / s, y / s, seed) + 0.35 * value_noise(x / (s / 2), y / (s / 2), seed ^ 1)
        if texture == 2:
            u = _fract(x / (s * 2) + _fract(F.floor(y / s) * 0.5))
            v = _fract(y / s)
            return 1 - smoothstep(0.0, 0.12, F.least(u, 1 - u, v, 1 - v))
        return 0.5 + 0.25 * (F.sin(x * (2 * math.pi / s)) + F.sin(y * (2 * math.pi / s)))

    x, y = F.col("x") + ox, F.col("y") + oy
    lx, ly = math.cos(math.radians(angle_deg)), -math.sin(math.radians(angle_deg))
    shade = clamp(1 + ((height(x + 1, y) - height(x - 1, y)) * lx + (height(x, y + 1) - height(x, y - 1)) * ly) * relief, 0.0, 2.0)
    return _styled(df, [clamp(F.col(c) * shade) for c in "rgb"], amount)
