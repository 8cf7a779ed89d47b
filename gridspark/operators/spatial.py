"""Kernels that read neighbours: convolution, morphology, rank filters, resampling, geometry."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, LUMA_709, clamp, mix
from gridspark.plans.registry import joined, kernel
from gridspark.plans.stencil import as_pixels, at, image, looked_up, mean_of, moved, reduced_line, sampled, sized, sizes, sobel, square3, tap, tiled, weighted_line

# -- convolution --------------------------------------------------------------------------------


@kernel("conv.box", kind="frame", edge="clamp")
def box(df, edge):
    third = dict.fromkeys((-1, 0, 1), 1.0)
    both = weighted_line(weighted_line(df, third, "x", edge), third, "y", edge)
    return both.select(*at(both), *((F.col(c) / 9).alias(c) for c in CHANNELS))


#: The widest radius of the convolutions, as everywhere they are defined.
R_MAX = 24


def gaussian_weights(sigma: float, radius: int) -> dict[int, float]:
    """Weights of the places up to ``radius`` (``R_MAX`` at most), which sum to one."""
    r = min(radius, R_MAX)
    raw = {d: math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)}
    return {d: w / sum(raw.values()) for d, w in raw.items()}


@kernel("conv.gaussian_h", kind="frame", sigma=1.0, radius=3, edge="clamp")
def gaussian_h(df, sigma, radius, edge):
    return weighted_line(df, gaussian_weights(sigma, radius), "x", edge)


@kernel("conv.gaussian_v", kind="frame", sigma=1.0, radius=3, edge="clamp")
def gaussian_v(df, sigma, radius, edge):
    return weighted_line(df, gaussian_weights(sigma, radius), "y", edge)


@kernel("conv.unsharp", inputs=2, amount=1.0, threshold=0.0)
def unsharp(a, b, amount, threshold):
    return a.zip(b, lambda x, y: F.when(F.abs(x - y) > threshold, x + amount * (x - y)).otherwise(x))


@kernel("conv.emboss", kind="frame", angle_deg=0.0, height=1.0)
def emboss(df, angle_deg, height):
    dx, dy = (math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1) for v in (math.cos(math.radians(angle_deg)), -math.sin(math.radians(angle_deg))))
    place = 4 + dy * 3 + dx
    n = square3(df)
    return n.select(*at(n), *(clamp(0.5 + (F.get(f"n_{c}", place) - F.get(f"n_{c}", 8 - place)) * height * 0.5).alias(c) for c in "rgb"), "a")


def edge_size(n: str) -> Column:
    gx, gy = sobel(n)
    return F.sqrt(gx * gx + gy * gy)


@kernel("conv.find_edges", kind="frame", strength=1.0)
def find_edges(df, strength):
    return square3(df).select(*at(df), *(clamp(1 - edge_size(f"n_{c}") * strength).alias(c) for c in "rgb"), "a")


TAPS = [i / 8 - 1 for i in range(17)]


@kernel("conv.motion", kind="frame", angle_deg=0.0, length_px=8.0)
def motion(df, angle_deg, length_px):
    dx, dy = math.cos(math.radians(angle_deg)) * length_px / 2, -math.sin(math.radians(angle_deg)) * length_px / 2
    r = math.ceil(abs(length_px) / 2) + 1

    def run(source, x, y):
        taps = (source[:, (np.rint(y + t * dy).astype(int) - y[0] + r)[:, None], (np.rint(x + t * dx).astype(int) - x[0] + r)[None, :]] for t in TAPS)
        return sum(taps) / len(TAPS)

    return tiled(df, r, run)


@kernel("conv.radial", kind="frame", cx=0.5, cy=0.5, amount=0.1, mode=0)
def radial(df, cx, cy, amount, mode):
    """mode 0 spins around the centre, any other zooms."""
    places = sized(df.select(*at(df)), df)
    mx, my = F.col("w") * cx, F.col("h") * cy
    rx, ry = F.col("x") - mx, F.col("y") - my
    rad, angle = F.sqrt(rx * rx + ry * ry), F.atan2(ry, rx)
    if mode == 0:
        taps = [tap(F.rint(mx + F.cos(angle + t * amount) * rad), F.rint(my + F.sin(angle + t * amount) * rad)) for t in TAPS]
    else:
        taps = [tap(F.rint(mx + rx * (1 + t * amount)), F.rint(my + ry * (1 + t * amount))) for t in TAPS]
    return mean_of(df, places, taps)


def disc(radius: float) -> list[tuple[int, int]]:
    r = math.ceil(radius)
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]


def _light(p: np.ndarray) -> np.ndarray:
    return sum(p[k] * w for k, w in enumerate(LUMA_709))


def _core(source: np.ndarray, r: int) -> np.ndarray:
    return moved(source, r, 0, 0)


@kernel("conv.lens", kind="frame", radius_px=2.0, threshold=0.8, boost=1.0)
def lens(df, radius_px, threshold, boost):
    """A disc of up to ``R_MAX`` pixels in which lights above the threshold weigh more."""
    radius = min(max(radius_px, 0.0), float(R_MAX))
    r = math.ceil(radius)
    if r < 1:
        return df

    def run(source, x, y):
        total, out = 0.0, 0.0
        for dx, dy in disc(radius):
            p = moved(source, r, dx, dy)
            light = _light(p)
            w = np.where(light > threshold, 1 + boost * (light - threshold), 1.0)
            total, out = total + w, out + p * w
        return np.where(total == 0, 0.0, out / np.where(total == 0, 1.0, total))

    return tiled(df, r, run)


def _square(r: int) -> list[tuple[int, int]]:
    return [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


@kernel("conv.bilateral", kind="frame", radius_px=2.0, sigma_range=0.1, amount=1.0)
def bilateral(df, radius_px, sigma_range, amount):
    radius, k = min(max(radius_px, 0.0), 8.0), min(max(amount, 0.0), 1.0)
    r, sigma, tone = math.ceil(radius), max(radius / 2, 1e-4), max(sigma_range, 1e-4)

    def run(source, x, y):
        own, total, out = _core(source, r), 0.0, 0.0
        for dx, dy in _square(r):
            p = moved(source, r, dx, dy)
            away = ((p[:3] - own[:3]) ** 2).sum(axis=0)
            w = math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) * np.exp(-away / (2 * tone * tone))
            total, out = total + w, out + p * w
        return own + (out / total - own) * k

    return tiled(df, r, run)


@kernel("conv.smart_sharpen", kind="frame", radius_px=2.0, amount=1.0, threshold=0.0, clamp_hi=1.0)
def smart_sharpen(df, radius_px, amount, threshold, clamp_hi):
    radius = min(max(radius_px, 0.0), 8.0)
    r, sigma = max(math.ceil(radius), 1), max(radius / 2, 1e-4)
    places = [(dx, dy, math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))) for dx, dy in _square(r)]

    def run(source, x, y):
        own = _core(source, r)
        soft = sum(moved(source, r, dx, dy) * w for dx, dy, w in places) / sum(w for _, _, w in places)
        diff = own[:3] - soft[:3]
        sharp = np.clip(own[:3] + np.clip(diff * amount, -clamp_hi, clamp_hi), 0.0, 1.0)
        return np.concatenate([np.where(np.abs(diff).max(axis=0) < threshold, own[:3], sharp), own[3:]])

    return tiled(df, r, run)


#: Pixels of a shape at most: it is sent to all tasks.
SHAPE_PIXELS = 1 << 18


@kernel("conv.shape", inputs=2, kind="frame", radius_px=2.0, amount=1.0, shape_w=0, shape_h=0)
def shape_blur(df, shape, radius_px, amount, shape_w, shape_h):
    """The red channel of the second image (one image of up to ``SHAPE_PIXELS``), stretched over the box, gives the weights; sizes of 0 mean all of it."""
    if not amount > 0 or not radius_px >= 0.5:
        return df
    w, h = sizes(shape.select("x", "y")).first()  # one row
    w, h = (min(n, m) if n > 0 else m for n, m in ((shape_w, int(w or 1)), (shape_h, int(h or 1))))
    if w * h > SHAPE_PIXELS:
        raise ValueError(f"a shape has {SHAPE_PIXELS} pixels at most")
    field = np.zeros((h, w))
    for p in shape.where((F.col("x") < w) & (F.col("y") < h)).select("x", "y", "r").collect():  # at most SHAPE_PIXELS
        field[p.y, p.x] = p.r
    radius = min(radius_px, float(R_MAX))
    r, k = math.ceil(radius), min(amount, 1.0)
    places = [(dx, dy, field[min(int((dy + radius) * h / (2 * radius)), h - 1), min(int((dx + radius) * w / (2 * radius)), w - 1)]) for dx, dy in _square(r) if max(abs(dx), abs(dy)) <= radius]
    places = [(dx, dy, weight) for dx, dy, weight in places if weight > 0]
    if not places:
        return df

    def run(source, x, y):
        own = _core(source, r)
        soft = sum(moved(source, r, dx, dy) * weight for dx, dy, weight in places) / sum(weight for _, _, weight in places)
        return own + (soft - own) * k

    return tiled(df, r, run)


# -- morphology and rank ------------------------------------------------------------------------


@kernel("morph.dilate", kind="frame")
def dilate(df):
    return reduced_line(reduced_line(df, 1, "x", F.max), 1, "y", F.max)


@kernel("morph.erode", kind="frame")
def erode(df):
    return reduced_line(reduced_line(df, 1, "x", F.min), 1, "y", F.min)


@kernel("rank.median3", kind="frame")
def median3(df):
    return square3(df).select(*at(df), *(F.get(F.array_sort(f"n_{c}"), 4).alias(c) for c in CHANNELS))


@kernel("rank.despeckle", kind="frame", edge_threshold=0.2, amount=1.0)
def despeckle(df, edge_threshold, amount):
    def f(c):
        s = F.array_sort(f"n_{c}")
        return mix(F.col(c), F.when(F.get(s, 7) - F.get(s, 1) <= edge_threshold, F.get(s, 4)).otherwise(F.col(c)), amount)

    return square3(df).select(*at(df), *(f(c).alias(c) for c in "rgb"), "a")


@kernel("rank.dust_scratches", kind="frame", radius=2, threshold=0.1)
def dust_scratches(df, radius, threshold):
    r = min(max(radius, 1), 4)

    def run(source, x, y):
        own = _core(source, r)
        middle = np.median(np.stack([moved(source, r, dx, dy)[:3] for dx, dy in _square(r)]), axis=0)
        return np.concatenate([np.where(np.abs(own[:3] - middle) > threshold, middle, own[:3]), own[3:]])

    return tiled(df, r, run)


# -- resampling ---------------------------------------------------------------------------------


def _mitchell(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    near, far = (7 * t**3 - 12 * t**2 + 16 / 3) / 6, (-7 / 3 * t**3 + 12 * t**2 - 20 * t + 32 / 3) / 6
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


def _lanczos3(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


def _resample(df, width, height, reach, weight):
    """A grid of the new size for each image, and the place of each of its pixels in the old one."""
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    out = sizes(df).select("*", span(height).alias("y")).select("*", span(width).alias("x"))
    px, py = (F.col("x") + 0.5) * (F.col("w") / width) - 0.5, (F.col("y") + 0.5) * (F.col("h") / height) - 0.5
    if weight is None:
        return as_pixels(looked_up(df, out, F.floor(px + 0.5), F.floor(py + 0.5)))
    return as_pixels(sampled(df, out, px, py, reach, weight, normalize=True))


@kernel("resample.nearest", kind="frame", width=8, height=8)
def nearest(df, width, height):
    return _resample(df, width, height, 0, None)


@kernel("resample.mitchell", kind="frame", width=8, height=8)
def mitchell(df, width, height):
    return _resample(df, width, height, 2, _mitchell)


@kernel("resample.lanczos3", kind="frame", width=8, height=8)
def lanczos3(df, width, height):
    return _resample(df, width, height, 3, _lanczos3)


# -- geometry -----------------------------------------------------------------------------------


def _moved(df, x, y):
    return df.select(*image(df), x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), *CHANNELS)


@kernel("geom.flip_h", kind="frame", width=16)
def flip_h(df, width):
    return _moved(df, width - 1 - F.col("x"), F.col("y"))


@kernel("geom.flip_v", kind="frame", height=16)
def flip_v(df, height):
    return _moved(df, F.col("x"), height - 1 - F.col("y"))


@kernel("geom.rotate90_cw", kind="frame", src_h=16)
def rotate90_cw(df, src_h):
    return _moved(df, src_h - 1 - F.col("y"), F.col("x"))


@kernel("geom.rotate90_ccw", kind="frame", src_w=16)
def rotate90_ccw(df, src_w):
    return _moved(df, F.col("y"), src_w - 1 - F.col("x"))


@kernel("geom.crop", kind="frame", off_x=0, off_y=0, width=8, height=8)
def crop(df, off_x, off_y, width, height):
    """A cut: a filter that reaches the scan. Where it goes beyond the image, the border's pixels are repeated: each then stands for a range of places."""
    cut = df.where(F.col("x").between(off_x, off_x + width - 1) & F.col("y").between(off_y, off_y + height - 1))
    rim = sizes(df).where((F.lit(off_x) < 0) | (F.lit(off_y) < 0) | (F.col("w") < off_x + width) | (F.col("h") < off_y + height))
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    places = rim.select("*", span(height).alias("y")).select("*", span(width).alias("x"))
    sx, sy = F.col("x") + off_x, F.col("y") + off_y
    outside = places.where((sx < 0) | (sy < 0) | (sx >= F.col("w")) | (sy >= F.col("h")))
    return _moved(cut, F.col("x") - off_x, F.col("y") - off_y).unionByName(as_pixels(looked_up(df, outside, sx, sy)))


def _sampled(df, px, py, edge="clamp"):
    return as_pixels(sampled(df, sized(df.select(*at(df)), df), px, py, edge=edge))


@kernel("geom.rotate_bilinear", kind="frame", degrees=0.0)
def rotate_bilinear(df, degrees):
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    mx, my = (F.col("w") - 1) / 2, (F.col("h") - 1) / 2
    rx, ry = F.col("x") - mx, F.col("y") - my
    return _sampled(df, rx * c + ry * s + mx, ry * c - rx * s + my)


@kernel("geom.offset", kind="frame", dx=0.0, dy=0.0, edge=0)
def offset(df, dx, dy, edge):
    """edge: 0 transparent, 1 clamp, 2 wrap."""
    return _sampled(df, F.col("x") - dx, F.col("y") - dy, ("zero", "clamp", "wrap")[edge])


@kernel("geom.mosaic", kind="frame", cell_px=4.0)
def mosaic(df, cell_px):
    """Each cell shows the pixel at its middle."""
    cell = max(cell_px, 1.0)
    middle = lambda c: F.floor(F.floor(F.col(c) / cell) * cell + cell / 2)
    return as_pixels(looked_up(df, df.select(*at(df)), middle("x"), middle("y")))


@kernel("geom.warp_backward", kind="frame", warp=0, amount=0.5, cx=8.0, cy=8.0, radius=8.0, frequency=1.0)
def warp_backward(df, warp, amount, cx, cy, radius, frequency):
    """warp: 0 pinch, 1 spherize, 2 twirl, 3 wave."""
    dx, dy = F.col("x") - cx, F.col("y") - cy
    t = F.sqrt(dx * dx + dy * dy) / radius
    inside = t < 1
    if warp in (0, 1):
        k = 1 + amount * (1 - t) if warp == 0 else 1 + amount * F.sin(math.pi * t)
        px, py = cx + dx * k, cy + dy * k
    elif warp == 2:
        angle = amount * (1 - t)
        px, py = cx + dx * F.cos(angle) - dy * F.sin(angle), cy + dx * F.sin(angle) + dy * F.cos(angle)
    else:
        px, py, inside = F.col("x") + amount * radius * 0.05 * F.sin(frequency * 2 * math.pi * dy / radius), F.col("y") + 0.0, F.lit(True)
    return _sampled(df, F.when(inside, px).otherwise(F.col("x").cast("double")), F.when(inside, py).otherwise(F.col("y").cast("double")))


@kernel("geom.move_selection", inputs=2, kind="frame", dx=0.0, dy=0.0, vacate=1)
def move_selection(df, selection, dx, dy, vacate):
    """``selection`` (red channel: weight) moves its share of the pixels by (dx, dy): what was there stays by 1 - leaving, where leaving is
    the own weight, or for ``vacate`` 1 (a copy) the arriving one. Beyond the border there is nothing."""
    held = joined(df, selection).select(*at(df), *CHANNELS, F.col("b_r").alias("m"))
    px, py = F.col("x") - dx, F.col("y") - dy
    own = held.select(*at(df), *(F.col(c).alias(f"c_{c}") for c in CHANNELS), "m")
    colour = sampled(df, own, px, py, edge="zero").select(*at(df), *(f"c_{c}" for c in CHANNELS), "m", *(F.col(f"s_{c}").alias(f"p_{c}") for c in CHANNELS))
    weight = held.select(*at(df), F.col("m").alias("r"), *(F.lit(0.0).alias(c) for c in "gba"))
    both = sampled(weight, colour, px, py, edge="zero")
    leaving = F.col("s_r") if vacate == 1 else F.col("m")
    return both.select(*at(df), *((F.col(f"c_{c}") * (1 - leaving) + F.col(f"p_{c}") * F.col("s_r")).alias(c) for c in CHANNELS))
