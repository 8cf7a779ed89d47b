"""Parts of a result: what a kernel reads for a rectangle of its output.

Spark pushes a filter on places through pointwise plans down to the scan, but not through windows and
groups by tile; for these the filter is widened by the kernel's reach and put before it.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.plans.registry import KERNELS, apply


class Region(NamedTuple):
    x0: int
    y0: int
    width: int
    height: int

    def expanded(self, rx: int, ry: int) -> Region:
        return Region(self.x0 - rx, self.y0 - ry, self.width + 2 * rx, self.height + 2 * ry)

    def of(self, px: DataFrame) -> DataFrame:
        return px.where(F.col("x").between(self.x0, self.x0 + self.width - 1) & F.col("y").between(self.y0, self.y0 + self.height - 1))


def _square(radius: float, least: int, most: int) -> tuple[int, int]:
    return (min(max(math.ceil(radius), least), most),) * 2


#: How far along x and y a kernel reads around a pixel, by its parameters.
_REACH = {
    "conv.gaussian_h": lambda p: (min(p["radius"], 24), 0), "conv.gaussian_v": lambda p: (0, min(p["radius"], 24)),
    "conv.lens": lambda p: _square(p["radius_px"], 0, 24), "conv.bilateral": lambda p: _square(p["radius_px"], 0, 8), "conv.smart_sharpen": lambda p: _square(p["radius_px"], 1, 8),
    "rank.dust_scratches": lambda p: _square(p["radius"], 1, 4),
    **dict.fromkeys(("conv.box", "conv.emboss", "conv.find_edges", "morph.dilate", "morph.erode", "rank.median3", "rank.despeckle"), lambda p: (1, 1)),
}


def required(name: str, region: Region, **params) -> Region | None:
    """The part of the input that a kernel needs: the region itself for points, a wider one for windows, an empty one for
    generators, and None, all of it, where the places read follow from the image (resampling, turns, warps)."""
    k = KERNELS[name]
    if k.kind == "point":
        return region
    if name.startswith("gen."):
        return Region(0, 0, 0, 0)
    return region.expanded(*_REACH[name](k.params | params)) if name in _REACH else None


def apply_within(px: DataFrame, name: str, region: Region, other: DataFrame | None = None, mask: DataFrame | None = None, **params) -> DataFrame:
    """``apply``, of the pixels in a region only; they equal those of the whole result."""
    part = region if name.startswith("gen.") else required(name, region, **params)  # generators read no pixels, but are asked for at their places
    return region.of(apply(px if part is None else part.of(px), name, other, mask, **params))
