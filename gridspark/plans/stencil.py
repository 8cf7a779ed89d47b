"""Neighbourhoods of pixels: window frames along lines, 3x3 arrays, tiles with a rim, and sampling at computed coordinates.

Rasters may hold many images, told apart by ``image_id``; nothing crosses images. Whatever a
kernel reads, work is dealt out by tiles, so no task holds a whole line or image:

* separable and 3x3 stencils are window functions over the lines of a tile and its rim (JVM only);
* stencils that are not separable run as array code on a tile and its rim;
* bounded or far single reads are one join on (image, x, y);
* fractional places go to the tile of the source that holds them and are interpolated there.

Places beyond the border are read as the border's pixel ("clamp"), as transparent black ("zero") or around ("wrap").
The raster must be dense. Its size is read from columns ``w`` and ``h`` where it has them, or else
found by one aggregate within the same plan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS

#: Side of a tile. Sampling deals out by smaller ones: at a magnification of s, one holds SOURCE_TILE**2 * s**2 places.
TILE, SOURCE_TILE = 256, 64


def image(df: DataFrame) -> list[str]:
    return [c for c in ("image_id", "level") if c in df.columns]


def at(df: DataFrame) -> list[str]:
    """The columns that tell a pixel's place."""
    return [*image(df), "x", "y"]


def sizes(df: DataFrame) -> DataFrame:
    """w, h of each image."""
    if {"w", "h"} <= set(df.columns):
        return df.select(*image(df), "w", "h").distinct()
    return df.groupBy(*image(df)).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def sized(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` with w, h of the source's image."""
    if {"w", "h"} <= set(rows.columns):
        return rows
    found = sizes(source)
    return rows.join(found, image(source)) if image(source) else rows.crossJoin(F.broadcast(found))  # one row


# -- lines -------------------------------------------------------------------------------------------


def rimmed(df: DataFrame, along: str, reach: int) -> DataFrame:
    """Each pixel in its tile, and again in those whose rim of ``reach`` holds it; ``_own`` tells which."""
    tile = lambda c: F.floor(c / TILE)
    copies = df.withColumn("_tile", F.explode(F.sequence(tile(F.col(along) - reach), tile(F.col(along) + reach))))
    return copies.withColumn("_own", F.col("_tile") == tile(F.col(along)))


def _line(df: DataFrame, along: str):
    return Window.partitionBy(*image(df), "_tile", "y" if along == "x" else "x").orderBy(along)


def _shifted(line, column: str, d: int, edge: str) -> Column:
    if d == 0:
        return F.col(column)
    value = F.lead(column, d).over(line) if d > 0 else F.lag(column, -d).over(line)
    if edge == "zero":
        return F.coalesce(value, F.lit(0.0))
    # what a tile and its rim lack is beyond the border, so their outermost pixel is the border's
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(value, F.last(column).over(whole) if d > 0 else F.first(column).over(whole))


def weighted_line(df: DataFrame, weights: dict[int, float], along: str, edge: str = "clamp") -> DataFrame:
    """Sums of weight * value over the places d further along x or y."""
    rows = rimmed(df, along, max(map(abs, weights)))
    line = _line(df, along)

    def total(c):
        out = None
        for d, w in sorted(weights.items()):
            term = _shifted(line, c, d, edge) * w
            out = term if out is None else out + term
        return out

    return rows.select(*at(df), "_own", *(total(c).alias(c) for c in CHANNELS)).where("_own").drop("_own")


def reduced_line(df: DataFrame, radius: int, along: str, f: Callable) -> DataFrame:
    """f (a window aggregate such as max) over the places within a radius; outside places are left out, which is what clamping means for it."""
    line = _line(df, along).rowsBetween(-radius, radius)
    return rimmed(df, along, radius).select(*at(df), "_own", *(f(c).over(line).alias(c) for c in CHANNELS)).where("_own").drop("_own")


def square3(df: DataFrame, edge: str = "clamp") -> DataFrame:
    """Adds n_r, n_g, n_b, n_a: the nine values around each place, row by row."""
    across = rimmed(df.select(*at(df), *CHANNELS), "x", 1)
    line = _line(df, "x")
    across = across.select(*at(df), *CHANNELS, "_own", *(F.array(*(_shifted(line, c, d, edge) for d in (-1, 0, 1))).alias(f"n_{c}") for c in CHANNELS)).where("_own").drop("_own")
    line = _line(df, "y")

    def rows(c):
        up, down = F.lag(f"n_{c}").over(line), F.lead(f"n_{c}").over(line)
        rim = F.col(f"n_{c}") if edge == "clamp" else F.array(*[F.lit(0.0)] * 3)
        return F.flatten(F.array(F.coalesce(up, rim), F.col(f"n_{c}"), F.coalesce(down, rim)))

    return rimmed(across, "y", 1).select(*at(df), *CHANNELS, "_own", *(rows(c).alias(f"n_{c}") for c in CHANNELS)).where("_own").drop("_own")


def sobel(n: str) -> tuple[Column, Column]:
    """Horizontal and vertical derivatives from a column of nine values."""
    v = [F.get(n, i) for i in range(9)]
    return (v[2] + 2 * v[5] + v[8]) - (v[0] + 2 * v[3] + v[6]), (v[6] + 2 * v[7] + v[8]) - (v[0] + 2 * v[1] + v[2])


# -- tiles as arrays -----------------------------------------------------------------------------------


def _dense(x: np.ndarray, y: np.ndarray, values: list[np.ndarray], lo: tuple[int, int], hi: tuple[int, int], edge: str) -> np.ndarray:
    """channels x rows x columns of the places lo..hi; what is not there is the outermost pixel, or 0."""
    x0, x1, y0, y1 = int(x.min()), int(x.max()), int(y.min()), int(y.max())
    out = np.zeros((len(values), y1 - y0 + 1, x1 - x0 + 1))
    for k, v in enumerate(values):
        out[k, y - y0, x - x0] = v
    if edge == "zero":
        whole = np.zeros((len(values), hi[1] - lo[1] + 1, hi[0] - lo[0] + 1))
        a, b = max(x0, lo[0]), min(x1, hi[0]) + 1
        c, d = max(y0, lo[1]), min(y1, hi[1]) + 1
        if a < b and c < d:
            whole[:, c - lo[1] : d - lo[1], a - lo[0] : b - lo[0]] = out[:, c - y0 : d - y0, a - x0 : b - x0]
        return whole
    rows, columns = np.clip(np.arange(lo[1], hi[1] + 1) - y0, 0, y1 - y0), np.clip(np.arange(lo[0], hi[0] + 1) - x0, 0, x1 - x0)
    return out[:, rows[:, None], columns[None, :]]


def tiled(df: DataFrame, radius: int, f: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """f on each tile as an array with a clamped rim of ``radius``: 4 x (rows + 2 radius) x (columns + 2 radius) and the core's x and y to 4 x rows x columns."""
    tile = lambda c: F.floor(c / TILE)
    rows = df.select(*at(df), *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    for c in "xy":
        rows = rows.withColumn(f"_t{c}", F.explode(F.sequence(tile(F.col(c) - radius), tile(F.col(c) + radius))))
    keys = image(df)

    def run(key, table):
        tx, ty = (k.as_py() for k in key[-2:])
        x, y = table.column("x").to_numpy(), table.column("y").to_numpy()
        own = (x // TILE == tx) & (y // TILE == ty)
        if not own.any():
            return table.slice(0, 0).select([*keys, "x", "y", *CHANNELS])
        lo, hi = (int(x[own].min()), int(y[own].min())), (int(x[own].max()), int(y[own].max()))
        source = _dense(x, y, [table.column(c).to_numpy() for c in CHANNELS], (lo[0] - radius, lo[1] - radius), (hi[0] + radius, hi[1] + radius), "clamp")
        out = f(source, np.arange(lo[0], hi[0] + 1), np.arange(lo[1], hi[1] + 1))
        keep = table.filter(pa.array(own))
        at_x, at_y = x[own] - lo[0], y[own] - lo[1]
        return pa.table([*(keep.column(k) for k in (*keys, "x", "y")), *(pa.array(out[k, at_y, at_x]) for k in range(4))], [*keys, "x", "y", *CHANNELS])

    return rows.groupBy(*keys, "_tx", "_ty").applyInArrow(run, df.select(*at(df), *(F.col(c).cast("double").alias(c) for c in CHANNELS)).schema)


def moved(source: np.ndarray, radius: int, dx: int, dy: int) -> np.ndarray:
    """The part of a rimmed array that lies (dx, dy) from its core."""
    h, w = source.shape[1] - 2 * radius, source.shape[2] - 2 * radius
    return source[:, radius + dy : radius + dy + h, radius + dx : radius + dx + w]


# -- reads at computed places --------------------------------------------------------------------------


def _inside(v: Column, n: str, edge: str) -> Column:
    v = F.floor(v).cast("bigint")
    if edge == "wrap":
        return F.pmod(v, F.col(n))
    return F.least(F.greatest(v, F.lit(0)), F.col(n) - 1) if edge == "clamp" else v


def looked_up(source: DataFrame, targets: DataFrame, sx: Column, sy: Column, edge: str = "clamp") -> DataFrame:
    """``targets`` with the pixel at (sx, sy) of the same image as s_r .. s_a: one join."""
    rows = sized(targets, source) if edge != "zero" else targets
    extra = [c for c in ("w", "h") if c in rows.columns and c not in targets.columns]
    rows = rows.withColumns({"_sx": _inside(sx, "w", edge), "_sy": _inside(sy, "h", edge)})
    src = source.select(*image(source), F.col("x").alias("_sx"), F.col("y").alias("_sy"), *(F.col(c).alias(f"s_{c}") for c in CHANNELS))
    out = rows.join(src, [*image(source), "_sx", "_sy"], "left")
    return out.withColumns({f"s_{c}": F.coalesce(f"s_{c}", F.lit(0.0)) for c in CHANNELS}).drop("_sx", "_sy", *extra)


def tap(sx: Column, sy: Column) -> Column:
    return F.struct(sx.alias("sx"), sy.alias("sy"))


def mean_of(source: DataFrame, targets: DataFrame, taps: Sequence[Column]) -> DataFrame:
    """The mean of a few far places of each target, clamped: they are listed, joined and averaged."""
    read = looked_up(source, targets.withColumn("_tap", F.explode(F.array(*taps))), F.col("_tap.sx"), F.col("_tap.sy"))
    return read.groupBy(*at(targets)).agg(*(F.avg(f"s_{c}").alias(c) for c in CHANNELS))


def hat(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(t))


def sampled(source: DataFrame, targets: DataFrame, px: Column, py: Column, reach: int = 1, weight: Callable = hat, edge: str = "clamp", normalize: bool = False) -> DataFrame:
    """``targets`` with s_r .. s_a: the source around (px, py), weighted along x and y over 2 * ``reach`` places each.

    A target goes to the tile of the source that holds its place; tiles come with the rim that the weights reach."""
    keys, own = image(source), targets.columns
    rim = reach + 1
    rows = sized(targets, source).withColumns({"_px": px.cast("double"), "_py": py.cast("double")})
    for p, n in (("_px", "w"), ("_py", "h")):
        if edge == "wrap":
            rows = rows.withColumn(p, F.col(p) - F.floor(F.col(p) / F.col(n)) * F.col(n))
        else:  # further out all places read are beyond the border
            rows = rows.withColumn(p, F.least(F.greatest(p, F.lit(-1.0 * rim)), F.col(n) - 1.0 + rim))
    for t, p, n in (("_tx", "_px", "w"), ("_ty", "_py", "h")):
        rows = rows.withColumn(t, F.floor(F.least(F.greatest(F.floor(p), F.lit(0)), F.col(n) - 1) / SOURCE_TILE))
    rows = rows.select(*own, "_px", "_py", "_tx", "_ty")
    src = source.select(*at(source), *(F.col(c).cast("double").alias(c) for c in CHANNELS))
    if edge == "wrap":
        src = sized(src, source)
        for c, n in (("x", "w"), ("y", "h")):
            around = F.array_compact(F.array(F.col(c), F.when(F.col(c) < rim, F.col(c) + F.col(n)), F.when(F.col(c) >= F.col(n) - rim, F.col(c) - F.col(n))))
            src = src.withColumn(c, F.explode(around))
    for c in "xy":
        tile = lambda v: F.floor(v / SOURCE_TILE)
        # also those next to a place beyond the border, which goes to the border's tile
        src = src.withColumn(f"_t{c}", F.explode(F.sequence(tile(F.col(c) - rim), tile(F.col(c) + rim))))
    # columns of its own, also where the targets come from the source
    src = src.select(*(F.col(c).alias(c) for c in (*keys, "_tx", "_ty")), F.col("x").alias("q_x"), F.col("y").alias("q_y"), *(F.col(c).alias(f"q_{c}") for c in CHANNELS))
    fields = [f for f in rows.schema.fields if f.name in own]
    span = np.arange(1 - reach, reach + 1)

    def run(left, right):
        px, py = left.column("_px").to_numpy(), left.column("_py").to_numpy()
        out = np.zeros((4, len(px)))
        if len(px) and len(right):
            ix, iy = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
            lo, hi = (int(ix.min()) + 1 - reach, int(iy.min()) + 1 - reach), (int(ix.max()) + reach, int(iy.max()) + reach)
            array = _dense(right.column("q_x").to_numpy(), right.column("q_y").to_numpy(), [right.column(f"q_{c}").to_numpy() for c in CHANNELS], lo, hi, "zero" if edge == "zero" else "clamp")
            wx, wy = [weight(px - ix - i) for i in span], [weight(py - iy - j) for j in span]
            total = np.zeros(len(px))
            for j, b in zip(span, wy, strict=True):
                for i, a in zip(span, wx, strict=True):
                    out += array[:, iy + j - lo[1], ix + i - lo[0]] * (a * b)
                    total += a * b
            if normalize:
                out = np.where(total == 0, 0.0, out / np.where(total == 0, 1.0, total))
        return pa.table([*(left.column(f.name) for f in fields), *(pa.array(v) for v in out)], [*(f.name for f in fields), *(f"s_{c}" for c in CHANNELS)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"s_{c} double" for c in CHANNELS)])
    return rows.groupBy(*keys, "_tx", "_ty").cogroup(src.groupBy(*keys, "_tx", "_ty")).applyInArrow(run, schema)


def as_pixels(df: DataFrame) -> DataFrame:
    """s_r .. s_a as the channels."""
    return df.select(*at(df), *(F.col(f"s_{c}").alias(c) for c in CHANNELS))
