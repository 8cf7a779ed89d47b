"""Healing: pixels copied from elsewhere, shifted in tone by a smooth field that meets the surroundings.

The field is the membrane of seamless cloning: outside a patch it is the difference of what is there and what would be
copied, inside it relaxes towards the mean of its neighbours. Windows of all patches are joined with the raster twice,
at their places and at the places to copy from; then each is a small array, of which a task relaxes many.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS
from gridspark.plans.stencil import at, image

#: Sweeps of the relaxation, and the places around a patch that its field is drawn from.
SWEEPS, MARGIN = 64, 6


def windows(px: DataFrame, cells: DataFrame, dx: int, dy: int, margin: int = MARGIN) -> DataFrame:
    """The places of the image around each patch: the image's keys, patch, x, y, cover (0 around the patch), d_r .. d_a as they are there
    and s_r .. s_a at (x + dx, y + dy), transparent beyond the image."""
    keys = image(px)
    own = cells.where("cover > 0").groupBy(*keys, "patch", "x", "y").agg(F.max("cover").alias("cover"))
    around = own.groupBy(*keys, "patch").agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    places = around.withColumn("y", F.explode(F.sequence(F.col("lo_y") - margin, F.col("hi_y") + margin)))
    places = places.withColumn("x", F.explode(F.sequence(F.col("lo_x") - margin, F.col("hi_x") + margin))).select(*keys, "patch", "x", "y")
    there = px.select(*at(px), *(F.col(c).cast("double").alias(f"d_{c}") for c in CHANNELS))
    copied = px.select(*keys, (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *(F.col(c).cast("double").alias(f"s_{c}") for c in CHANNELS))
    rows = places.join(there, at(px)).join(copied, at(px), "left").join(own, [*keys, "patch", "x", "y"], "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("cover", *(f"{p}_{c}" for p in "ds" for c in CHANNELS))})


def relaxed(field: np.ndarray, inside: np.ndarray, sweeps: int) -> np.ndarray:
    """The field (channels x rows x columns) after sweeps in which each inner place becomes the mean of its four neighbours; a window's edge repeats."""
    for _ in range(sweeps):
        wide = np.pad(field, ((0, 0), (1, 1), (1, 1)), "edge")
        mean = (wide[:, 1:-1, :-2] + wide[:, 1:-1, 2:] + wide[:, :-2, 1:-1] + wide[:, 2:, 1:-1]) / 4
        field = np.where(inside, mean, field)
    return field


def heal(px: DataFrame, cells: DataFrame, dx: int, dy: int, sweeps: int = SWEEPS, margin: int = MARGIN) -> DataFrame:
    """The raster with the patches of ``cells`` (patch, x, y, cover 0..1, and the image's keys) healed from the places (dx, dy) further.

    Every patch is healed from the raster as it was; a place of several patches shows the last one's. Colours are shifted by the
    field and clamped, alpha is copied; both replace what is there in proportion to the cover, as ``regions.clone`` does. Places whose
    copy is transparent tell the field nothing: it is 0 there. A patch without any other place around it is copied unshifted.
    A patch's window is one array, so patches should be dabs and not whole strokes; repeated cells count once, with the larger cover.
    """
    keys = image(px)
    rows = windows(px, cells, dx, dy, margin)
    fields = rows.select(*at(px), "patch", "cover").schema.fields
    names = [f.name for f in fields]

    def run(table: pa.Table) -> pa.Table:
        x, y, cover = (table.column(c).to_numpy() for c in ("x", "y", "cover"))
        row, column = y - y.min(), x - x.min()
        values = np.stack([table.column(f"{p}_{c}").to_numpy() for p in "ds" for c in CHANNELS])
        # what is not in the image has no say: as a window is cut to it, all of a dense raster's window is there
        inside, field = np.zeros((row.max() + 1, column.max() + 1), bool), np.zeros((3, row.max() + 1, column.max() + 1))
        inside[row, column] = cover > 0
        told = (cover == 0) & (np.rint(values[7] * 255) > 0)
        differs = np.where(told, values[:3] - values[4:7], 0.0)
        if told.any():
            field[:, row, column] = np.where(cover > 0, (differs.sum(axis=1) / told.sum())[:, None], differs)
            field = relaxed(field, inside, sweeps)
        new = np.vstack([np.clip(values[4:7] + field[:, row, column], 0.0, 1.0), values[7:]])
        kept = pa.array(cover > 0)
        return pa.table([*(table.column(n) for n in names), *(pa.array(v) for v in new)], [*names, *(f"h_{c}" for c in CHANNELS)]).filter(kept)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"h_{c} double" for c in CHANNELS)])
    solved = rows.groupBy(*keys, "patch").applyInArrow(run, schema)
    last = solved.groupBy(*at(px)).agg(F.max_by(F.struct("cover", *(f"h_{c}" for c in CHANNELS)), "patch").alias("new"))
    both = px.join(last, at(px), "left")
    return both.select(*at(px), *(F.when(F.col("new").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"new.h_{c}") - F.col(c)) * F.col("new.cover")).alias(c) for c in CHANNELS))
