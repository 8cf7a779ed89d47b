"""Layer stacks and adjustment chains: folds whose length is known when the plan is built, so they are unrolled into one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import gridspark.operators.point as point
from gridspark.functions.pixel import CHANNELS, Px, mix, num, premultiply, unpremultiply
from gridspark.plans.registry import KERNELS, apply
from gridspark.plans.stencil import at

# The layer file format's blend keys.
BLEND_KEYS = {
    "norm": "normal", "mul ": "multiply", "scrn": "screen", "over": "overlay", "dark": "darken", "lite": "lighten", "div ": "color_dodge", "idiv": "color_burn", "hLit": "hard_light",
    "sLit": "soft_light", "diff": "difference", "smud": "exclusion", "hue ": "hue", "sat ": "saturation", "colr": "color", "lum ": "luminosity", "lbrn": "linear_burn", "lddg": "linear_dodge",
    "dkCl": "darker_color", "lgCl": "lighter_color", "vLit": "vivid_light", "lLit": "linear_light", "pLit": "pin_light", "hMix": "hard_mix", "fsub": "subtract", "fdiv": "divide",
}


@dataclass
class Layer:
    """A plate of pixels (straight colour), or an adjustment of what is below."""

    z: int
    blend: str = "normal"
    opacity: float = 1.0
    visible: bool = True
    clipped: bool = False
    mask: DataFrame | None = None
    adjust: tuple[str, dict] | None = None


@dataclass
class LayerStack:
    """Layers bottom first; ``pixels`` holds all plates (x, y, z, r, g, b, a), of one image or of many that share the stack."""

    pixels: DataFrame
    layers: list[Layer] = field(default_factory=list)

    def composite(self) -> DataFrame:
        """x, y, r, g, b, a (straight). The plates come to one row for each place by one aggregate; the fold is a projection over it."""
        plates = [v for v in self.layers if v.visible and v.opacity > 0]
        if not plates:
            return self.pixels.select(*at(self.pixels), *CHANNELS).limit(0)
        kept = [v.z for v in plates if v.adjust is None]
        wide = self.pixels.where(F.col("z").isin(kept)).groupBy(*at(self.pixels)).agg(*(F.coalesce(F.max(F.when(F.col("z") == z, F.col(c))), F.lit(0.0)).alias(f"l{z}_{c}") for z in kept for c in CHANNELS))
        for v in plates:
            if v.mask is not None:
                wide = wide.join(v.mask.select(*at(v.mask), F.col("m").alias(f"m{v.z}")), at(v.mask), "left")
        below, base = Px(*(num(0) for _ in CHANNELS)), num(1)
        for v in plates:
            weight: Column = F.coalesce(f"m{v.z}", F.lit(1.0)) if v.mask is not None else num(1)
            if v.clipped:
                weight = weight * base
            if v.adjust is not None:
                name, params = v.adjust
                graded = KERNELS[name].run(below, **(KERNELS[name].params | params))
                result = below.zip(graded, lambda p, q, k=v.opacity: p + (q - p) * k)
            else:
                plate = Px.of(f"l{v.z}_")
                if not v.clipped:
                    base = plate.a
                result = point.source_over(below, premultiply(plate), point.BLENDS[v.blend], v.opacity)
            mixed = below.zip(result, lambda p, q, w=weight: mix(p, q, w))
            # a projection for each layer keeps the expressions small
            wide = wide.withColumns({f"acc_{c}": e for c, e in zip(CHANNELS, mixed, strict=True)})
            below = Px.of("acc_")
        return unpremultiply(below).select(wide, *at(self.pixels))

    def group(self, name_z: int, layers: list[Layer], blend: str = "normal", opacity: float = 1.0) -> Layer:
        """An isolated group: its own composite becomes a plate with number ``name_z``."""
        inner = LayerStack(self.pixels, layers).composite().withColumn("z", F.lit(name_z).cast("bigint"))
        columns = [*at(self.pixels), "z", *CHANNELS]
        self.pixels = self.pixels.select(*columns).unionByName(inner.select(*columns))
        return Layer(name_z, blend, opacity)


#: The fixed order of an adjustment chain; a stage that is not asked for is not in the plan.
CHAIN = ("exposure", "white_balance", "levels", "levels_rgb", "brightness_contrast", "color_balance", "photo_filter", "channel_mixer", "vibrance", "saturation", "black_white", "posterize", "threshold", "hue_rotate", "invert_rgb")


def adjust_chain(df: DataFrame, blur: float = 0.0, sharpen: float = 0.0, curve: list[tuple[float, float]] | None = None, mask: DataFrame | None = None, **stages: dict) -> DataFrame:
    """Point stages in their order (one projection), then blur, sharpening and the curve's table."""
    unknown = set(stages) - set(CHAIN)
    if unknown:
        raise TypeError(f"no stage {', '.join(sorted(unknown))}")
    out = reduce(lambda rows, name: apply(rows, f"adjust.{name}", **stages[name]), (n for n in CHAIN if n in stages), df)
    soft = lambda rows, sigma, r: apply(apply(rows, "conv.gaussian_h", sigma=sigma, radius=r), "conv.gaussian_v", sigma=sigma, radius=r)
    if blur:
        out = soft(out, blur, round(3 * blur + 0.5))
    if sharpen:
        out = apply(out, "conv.unsharp", other=soft(out, 1.5, 5), amount=sharpen)
    if curve is not None:
        out = apply(out, "adjust.lut1d", lut=[v / 255 for v in curve_lut(curve)])
    if mask is not None:
        rows = df.select(*at(df), *(F.col(c).alias(f"o_{c}") for c in CHANNELS)).join(out, at(df)).join(mask.select(*at(mask), "m"), at(mask), "left")
        m = F.coalesce("m", F.lit(1.0))
        out = rows.select(*at(df), *(mix(F.col(f"o_{c}"), F.col(c), m).alias(c) for c in CHANNELS))
    return out


def curve_lut(points: list[tuple[float, float]]) -> list[int]:
    """256 bytes of a monotone cubic through the points (0..255); none is the identity, one a constant, the first of equal x counts, flat beyond the ends."""
    places: dict[float, float] = {}
    for x, y in sorted(points, key=lambda p: p[0]):
        places.setdefault(x, y)
    xs, ys = list(places), list(places.values())
    byte = lambda v: int(min(max(v, 0.0), 255.0) + 0.5)
    if not xs:
        return list(range(256))
    if len(xs) == 1:
        return [byte(ys[0])] * 256
    n = len(xs) - 1
    slope = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) for i in range(n)]
    tangent = [slope[0], *(0.0 if slope[i - 1] * slope[i] <= 0 else (slope[i - 1] + slope[i]) / 2 for i in range(1, n)), slope[-1]]
    for i in range(n):
        if slope[i] == 0:
            tangent[i] = tangent[i + 1] = 0.0
            continue
        p, q = tangent[i] / slope[i], tangent[i + 1] / slope[i]
        size = p * p + q * q
        if size > 9:  # keeps the piece monotone
            tangent[i], tangent[i + 1] = 3 * p / size**0.5 * slope[i], 3 * q / size**0.5 * slope[i]
    out = []
    for v in range(256):
        if v <= xs[0] or v >= xs[-1]:
            out.append(byte(ys[0] if v <= xs[0] else ys[-1]))
            continue
        i = max(k for k in range(n) if xs[k] <= v)
        h = xs[i + 1] - xs[i]
        t = (v - xs[i]) / h
        out.append(byte((2 * t**3 - 3 * t**2 + 1) * ys[i] + (t**3 - 2 * t**2 + t) * h * tangent[i] + (3 * t**2 - 2 * t**3) * ys[i + 1] + (t**3 - t**2) * h * tangent[i + 1]))
    return out
