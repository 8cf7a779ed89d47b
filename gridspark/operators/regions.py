"""Operators on regions of a raster: cuts, orientation, tiles, clones, fills and outlines.

Most are projections and filters, so a cut reaches the scan. ``clone`` and ``outline`` join a raster with a
moved copy of itself on (x, y), ``contours`` chains the sides of an outline within tiles, and the chains in a logarithmic number of joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

import gridspark.operators.spatial  # noqa: F401
from gridspark.functions.pixel import CHANNELS, Px, clamp, hash01, let, mix, num, premultiply, unpremultiply
from gridspark.operators.generators import polynomial_atan2
from gridspark.operators.point import source_over
from gridspark.operators.reduce import to_byte
from gridspark.operators.selection import settled
from gridspark.plans.stencil import as_pixels, at, image, sampled, sizes


def crop(px: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The pixels of a rectangle, counted from its corner."""
    inside = px.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def orient(px: DataFrame, orientation: int, width: int, height: int) -> DataFrame:
    """Upright pixels from one of the eight camera orientations; ``width`` and ``height`` are those of the input. Others are left as they are."""
    x, y, right, down = F.col("x"), F.col("y"), F.lit(width - 1) - F.col("x"), F.lit(height - 1) - F.col("y")
    to = {2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}.get(orientation, (x, y))
    return px.withColumns({"x": to[0].cast("bigint"), "y": to[1].cast("bigint")})


def tiles_of(regions: DataFrame, size: int = 256) -> DataFrame:
    """Tiles (tx, ty) that each region (x0, y0, width, height) touches; empty regions have none."""
    def along(start: str, length: str) -> Column:
        first = F.floor(F.col(start) / size)
        return F.when(F.col(length) > 0, F.sequence(first, F.floor((F.col(start) + F.col(length) - 1) / size))).otherwise(F.array().cast("array<bigint>"))

    return regions.withColumn("ty", F.explode(along("y0", "height"))).withColumn("tx", F.explode(along("x0", "width")))


def clone(px: DataFrame, cover: DataFrame, dx: int, dy: int) -> DataFrame:
    """Where ``cover`` (x, y, cov 0..255) is set, the pixel at (x + dx, y + dy) replaces the own one in proportion; outside the raster is transparent."""
    source = px.select(*image(px), (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), *(F.col(c).alias(f"s_{c}") for c in CHANNELS))
    joined = px.join(cover.select(*at(cover), (F.col("cov") / 255).alias("m")), at(cover), "left").join(source, at(px), "left")
    mixed = [(F.col(c) + (F.coalesce(f"s_{c}", F.lit(0.0)) - F.col(c)) * F.coalesce("m", F.lit(0.0))).alias(c) for c in CHANNELS]
    return joined.select(*at(px), *mixed)


def _between(p: float, q: float):
    return lambda t: num(p) + (num(q) - num(p)) * t


def fill(px: DataFrame, cover: DataFrame, kind: str, c0: tuple[float, ...] = (0.0, 0.0, 0.0, 1.0), c1: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0), amount: float = 1.0, seed: int = 1) -> DataFrame:
    """Fills a selection (x, y, cov) of a straight raster: ``linear``, ``radial``, ``angular``, ``reflected`` or ``diamond`` from c0 to c1
    (straight RGBA) over the bounds of the selection, or over the image where nothing is selected; ``noise`` or ``solid``."""
    keys = image(px)
    bounds = cover.where("cov > 0").groupBy(*image(cover)).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))
    whole = sizes(px.select(*at(px)))
    both = whole.join(bounds, image(cover), "left") if image(cover) else whole.crossJoin(bounds)  # bounds are one row, or one for each image
    frame = both.select(*keys, *(F.coalesce(k, d).cast("double").alias(f"f_{k}") for k, d in (("x0", F.lit(0)), ("y0", F.lit(0)), ("x1", F.col("w")), ("y1", F.col("h")))))
    rows = px.join(cover.select(*at(cover), (F.col("cov") / 255).alias("m")), at(cover), "left")
    rows = rows.join(frame, keys) if keys else rows.crossJoin(F.broadcast(frame))  # one row
    w, h = F.col("f_x1") - F.col("f_x0"), F.col("f_y1") - F.col("f_y0")
    dx, dy, half = F.col("x") - (F.col("f_x0") + w / 2), F.col("y") - (F.col("f_y0") + h / 2), F.greatest(w, h, num(1)) / 2
    t = {
        "linear": (F.col("x") - F.col("f_x0")) / w, "reflected": F.abs(dx) / (w / 2), "radial": F.sqrt(dx * dx + dy * dy) / half,
        "diamond": (F.abs(dx) + F.abs(dy)) / half, "angular": (polynomial_atan2(dy, dx) + math.pi) / (2 * math.pi),
    }.get(kind)
    if kind == "noise":
        v = hash01(F.col("x"), F.col("y"), seed) * amount
        made = Px(v, v, v, num(1))
    else:
        ends = [[v * c[3] for v in c[:3]] + [c[3]] for c in (c0, c0 if kind == "solid" else c1)]
        rows = rows.withColumn("f_t", clamp(t) if t is not None else num(0))  # once for all channels
        made = Px(*(_between(p, q)(F.col("f_t")) for p, q in zip(*ends, strict=True)))
    base, m = premultiply(Px.of()), F.coalesce("m", num(0))
    over = source_over(base, made, lambda b, s: s, 1.0)
    return unpremultiply(base.zip(over, lambda p, q: mix(p, q, m))).select(rows, *at(px))


def straighten(px: DataFrame, degrees: float, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """What lies in a frame that is turned by ``degrees`` around its own middle, upright (bilinear, borders repeated); the frame is cut to the image."""
    if degrees == 0:
        return crop(px, x0, y0, width, height)
    inside = px.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    cos, sin, cx, cy = math.cos(math.radians(-degrees)), math.sin(math.radians(-degrees)), x0 + width / 2, y0 + height / 2
    dx, dy = F.col("x") + 0.5 - cx, F.col("y") + 0.5 - cy
    turned = as_pixels(sampled(px, inside.select(*at(px)), dx * cos + dy * sin + cx - 0.5, dy * cos - dx * sin + cy - 0.5))
    return turned.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def curve_bytes(px: DataFrame, lut: list[int], cover: DataFrame | None = None) -> DataFrame:
    """x, y and the channels as bytes after a 256-entry table; with a selection, (byte * (255 - cov) + mapped * cov + 127) div 255."""
    rows = px.select(*at(px), *(to_byte(F.col(c)).alias(c) for c in CHANNELS))
    table = F.array(*(F.lit(int(v)) for v in lut))
    mapped = {c: F.get(table, F.col(c).cast("int")).cast("bigint") for c in "rgb"}
    if cover is None:
        return rows.select(*at(px), *(v.alias(c) for c, v in mapped.items()), "a")
    rows = rows.join(cover.select(*at(cover), "cov"), at(cover), "left")
    m = F.coalesce("cov", F.lit(0))
    return rows.select(*at(px), *(F.floor((F.col(c) * (255 - m) + v * m + 127) / 255).alias(c) for c, v in mapped.items()), "a")


def cmyk_to_rgba(df: DataFrame) -> DataFrame:
    """x, y and bytes r, g, b, a of ink bytes c, m, y_ink, k, by the device formula (no profile)."""
    paper = lambda ink: F.floor((1 - F.col(ink) / 255) * (1 - F.col("k") / 255) * 255 + 0.5).cast("bigint")
    return df.select(*at(df), paper("c").alias("r"), paper("m").alias("g"), paper("y_ink").alias("b"), F.lit(255).cast("bigint").alias("a"))


def outline(cover: DataFrame, least: int = 128) -> DataFrame:
    """The sides of selected pixels whose neighbour is not selected: (x0, y0) to (x1, y1), with the inside on the right."""
    keys = image(cover)
    own = cover.where(F.col("cov") >= least).select(*at(cover))
    x, y = F.col("x"), F.col("y")
    # neighbour's offset, and the corners of the side
    sides = {(0, -1): ((x, y), (x + 1, y)), (1, 0): ((x + 1, y), (x + 1, y + 1)), (0, 1): ((x + 1, y + 1), (x, y + 1)), (-1, 0): ((x, y + 1), (x, y))}

    def open_side(dx: int, dy: int) -> DataFrame:
        (ax, ay), (bx, by) = sides[dx, dy]
        beside = own.select(*keys, (x - dx).alias("x"), (y - dy).alias("y"))
        return own.join(beside, at(cover), "left_anti").select(*keys, ax.alias("x0"), ay.alias("y0"), bx.alias("x1"), by.alias("y1"))

    return reduce(DataFrame.unionByName, (open_side(*d) for d in sides))


#: Side of the tiles within which one task chains the sides of an outline.
CHAINED = 256
#: Points of a ring that one task walks at a time.
SEGMENT = 1 << 14
#: Points that are laid out as arrays at once.
POINTS = 1 << 18
#: Steps to the right, down, to the left and up.
_DX, _DY = np.array([1, 0, -1, 0]), np.array([0, 1, 0, -1])
_CHAIN = {"x": "bigint", "y": "bigint", "dir": "int", "came": "int", "next_x": "bigint", "next_y": "bigint", "next_dir": "int", "first_x": "bigint", "first_y": "bigint", "first_dir": "int"} | dict.fromkeys(
    ("ahead", "turned", "length", "turns", "twice"), "bigint"
)


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.astype(np.uint8).tobytes())])


def _behind(before: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By doubling: each side's farthest one behind it (``before``, -1 at a chain's start), how far that is, and the least rank from there to it."""
    to, far = np.where(before < 0, np.arange(len(before)), before), (before >= 0).astype(np.int64)
    least, reach = np.minimum(rank, rank[to]), 1
    while reach < len(before):
        far, least, to, reach = far + far[to], np.minimum(least, least[to]), to[to], 2 * reach
    return to, far, least


def _chained(inside: np.ndarray, x0: int, y0: int) -> dict[str, pa.Array]:
    """The chains of sides of a tile's selected pixels (``inside`` has a rim of one; x0, y0 is the rim's corner), as columns.

    A side ends where a side turned left, a straight one or one turned right begins, the first of these that there is. Rings that do not leave the
    tile are closed chains from their first side on; others have the side after them, in another tile, and how far ahead their first one is."""
    wide, flat = inside.shape[1], inside.ravel()
    own = np.zeros_like(inside)
    own[1:-1, 1:-1] = inside[1:-1, 1:-1]
    places, step, found = np.flatnonzero(own), [1, wide, -1, -wide], []
    for d in range(4):
        left, ahead = step[d - 1], step[d]
        p = places[~flat[places + left]]
        after = np.where(flat[p + left + ahead], 4 * (p + left + ahead) + (d + 3) % 4, np.where(flat[p + ahead], 4 * (p + ahead) + d, 4 * p + (d + 1) % 4))
        came = np.where(flat[p + left - ahead], (d + 1) % 4, np.where(flat[p - ahead], d, (d + 3) % 4))
        found.append((4 * p + d, after, came))
    side, after, came = (np.concatenate(v) for v in zip(*found, strict=True))
    if not len(side):
        return {k: pa.array([], pa.int64() if t == "bigint" else pa.int32()) for k, t in _CHAIN.items()} | {"steps": pa.array([], pa.binary())}
    by_place = np.argsort(side)
    side, after, came = side[by_place], after[by_place], came[by_place]

    def begins(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = s % 4
        return s // 4 % wide + x0 + ((d == 1) | (d == 2)), s // 4 // wide + y0 + (d >= 2), d

    x, y, d = begins(side)
    by_rank = np.lexsort((d, x, y, d != 0))
    rank = np.empty(len(side), np.int64)
    rank[by_rank] = np.arange(len(side))
    place = np.minimum(np.searchsorted(side, after), len(side) - 1)
    held = side[place] == after  # the next side is in this tile
    before = np.full(len(side), -1)
    before[place[held]] = np.flatnonzero(held)
    to, far, least = _behind(before, rank)
    ring = before[to] >= 0  # such sides have no start: they are cut before their first one
    if ring.any():
        before[by_rank[least[ring]]] = -1
        to, far, _ = _behind(before, rank)
    order = np.lexsort((far, to))
    start = np.flatnonzero(far[order] == 0)
    length = np.diff(np.append(start, len(order)))
    head, last = order[start], order[start + length - 1]
    first = by_rank[np.minimum.reduceat(rank[order], start)]
    turns = (came != d)[order]
    seen = np.cumsum(turns) - turns
    twice = np.choose(d, [-y, x, y, -x])  # x0 * y1 - x1 * y0
    closed = held[last]
    columns = [x[head], y[head], d[head], came[head], *begins(after[last]), x[first], y[first], d[first], far[first], seen[start + far[first]] - seen[start], length, np.add.reduceat(turns.astype(np.int64), start), np.add.reduceat(twice[order], start)]
    out = {k: pa.array(v.astype(np.int64 if t == "bigint" else np.int32), mask=closed if k.startswith("next") else None) for (k, t), v in zip(_CHAIN.items(), columns, strict=True)}
    return out | {"steps": _binary(length, d[order])}


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def _placed(cover: DataFrame, least: int) -> DataFrame:
    """The rings of an outline as chains of sides: where a chain starts (x, y), the heading before it (``came``), its steps (a byte a side: 0 to the right, 1 down,
    2 to the left, 3 up), the sides and corners from its start to its ring's first side (``ahead``, ``turned``), and the ring's sides, corners and ``outer``.

    Chains are as long as they can be within a tile, so most rings are one. Chains of rings that cross tiles learn the ring's first side and their distance from it
    by doubling: after k rounds each has seen 2**k chains, so no task walks a ring, and the rounds have a row for each crossing of a tile's border, not for each side."""
    keys, tile = image(cover), CHAINED
    own = cover.where(F.col("cov") >= least).select(*at(cover)).dropna()
    # a pixel at a tile's border is also in the rim of its neighbours
    touched = lambda c: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile).cast("bigint") for k in (-1, 1)))))
    dealt = own.select(*keys, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).withColumn("tx", touched("x")).withColumn("ty", touched("y"))

    def chain(table: pa.Table) -> pa.Table:
        x0, y0 = (table.column(c)[0].as_py() * tile - 1 for c in ("tx", "ty"))
        inside = np.zeros((tile + 2, tile + 2), bool)
        inside[table.column("y").to_numpy() - y0, table.column("x").to_numpy() - x0] = True
        columns = _chained(inside, x0, y0)
        return pa.table({k: table.column(k).take(pa.array(np.zeros(len(columns["x"]), np.int64))) for k in keys} | columns)

    fields = ", ".join([*([_fields(own, keys)] if keys else []), *(f"{k} {t}" for k, t in _CHAIN.items()), "steps binary"])
    chains = settled(dealt.groupBy(*keys, "tx", "ty").applyInArrow(chain, fields))
    named = lambda y, x, d: F.struct((F.col(d) != 0).alias("turned"), F.col(y).alias("y0"), F.col(x).alias("x0"), F.col(d).alias("dir"), *keys)
    chains = chains.select(named("y", "x", "dir").alias("chain"), named("next_y", "next_x", "next_dir").alias("far"), F.col("next_dir").isNotNull().alias("leaves"),
                           F.struct(named("first_y", "first_x", "first_dir").alias("first"), "ahead", "turned").alias("head"), "length", "turns", "twice", "came", "steps")
    crossing = chains.where("leaves")
    # the least side among those of the chains seen, how far ahead it is, the chain behind the last one seen, and how far that is
    seen = settled(crossing.select("chain", "far", F.col("length").alias("reach"), F.col("turns").alias("bends"), "head", "length", "turns", "twice"))
    while True:
        there = seen.select(F.col("chain").alias("far"), F.col("far").alias("farther"), F.col("reach").alias("reach2"), F.col("bends").alias("bends2"), F.col("head").alias("head2"))
        moved = F.struct(F.col("head2.first").alias("first"), (F.col("head2.ahead") + F.col("reach")).alias("ahead"), (F.col("head2.turned") + F.col("bends")).alias("turned"))
        both = seen.join(there, "far").select("chain", F.col("farther").alias("far"), (F.col("reach") + F.col("reach2")).alias("reach"), (F.col("bends") + F.col("bends2")).alias("bends"),
                                              F.least("head", moved).alias("head"), "length", "turns", "twice", (F.col("head.first") != F.col("head2.first")).alias("moved"))
        both = settled(both)
        seen = both.drop("moved")
        if both.where("moved").isEmpty():
            break
    rings = seen.groupBy("head.first").agg(F.sum("length").alias("sides"), F.sum("turns").alias("corners"), (F.sum("twice") > 0).alias("outer"))
    told = seen.select("chain", "head", F.col("head.first").alias("first")).join(rings, "first").drop("first")
    whole = chains.where("NOT leaves").select("chain", "came", "steps", "head", F.col("length").alias("sides"), F.col("turns").alias("corners"), (F.col("twice") > 0).alias("outer"))
    placed = whole.unionByName(crossing.select("chain", "came", "steps").join(told, "chain"))
    ring = [F.col("head.first.y0").alias("ring_y"), F.col("head.first.x0").alias("ring_x")]
    return placed.select(*(F.col(f"chain.{k}").alias(k) for k in keys), *ring, F.col("chain.x0").alias("x"), F.col("chain.y0").alias("y"), "came", "steps", "head.ahead", "head.turned", "sides", "corners", "outer")


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of chains, no more at once than POINTS points where a chain is not longer: the rows, and of each point its row, its place in the chain, x, y, heading and the heading before."""
    for batch in batches:
        steps = batch.column("steps").cast(pa.binary())
        ends = np.cumsum(pc.binary_length(steps).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + POINTS, "right")))
            rows = pa.Table.from_batches([batch.slice(at, upto - at)])
            length = np.diff(ends[at:upto], prepend=ends[at - 1] if at else 0)
            start = np.cumsum(length) - length
            d = np.frombuffer(b"".join(steps.slice(at, upto - at).to_pylist()), np.uint8).astype(np.int64)
            row = np.repeat(np.arange(upto - at), length)
            came = np.roll(d, 1)
            came[start] = rows.column("came").to_numpy()
            x, y = (np.cumsum(s[d]) - s[d] for s in (_DX, _DY))
            x, y = x + (rows.column("x").to_numpy() - x[start])[row], y + (rows.column("y").to_numpy() - y[start])[row]
            yield rows, row, np.arange(len(d)) - start[row], x, y, d, came
            at = upto


def _points(placed: DataFrame, corners: bool) -> DataFrame:
    """The rings' corners, or their points at every pixel's corner, in order."""
    own = [*image(placed), "ring_y", "ring_x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row, i, x, y, d, came in _laid_out(batches):
            value = lambda c: rows.column(c).to_numpy()[row]  # noqa: E731, B023
            if corners:
                turn = came != d
                seen = np.cumsum(turn) - turn
                n, kept = (seen - seen[i == 0][row] - value("turned")) % value("corners"), np.flatnonzero(turn)
            else:
                n, kept = (i - value("ahead")) % value("sides"), np.arange(len(row))
            out = rows.select([*own, "outer"]).take(pa.array(row[kept]))
            yield from _with(out, n=n[kept], x=x[kept], y=y[kept]).to_batches()

    return _shown(placed.mapInArrow(run, f"{_fields(placed, own)}, outer boolean, n bigint, x bigint, y bigint"))


def _with(table: pa.Table, **columns: np.ndarray) -> pa.Table:
    for k, v in columns.items():
        table = table.append_column(k, pa.array(v))
    return table


def _shown(points: DataFrame) -> DataFrame:
    return points.select(*image(points), F.struct(F.col("ring_y").alias("y"), F.col("ring_x").alias("x")).alias("ring"), "n", "x", "y", "outer")


def contours(cover: DataFrame, least: int = 128) -> DataFrame:
    """The closed rings of an outline: ring, n, x, y, outer - corners only, with the inside on the right, from
    the topmost, then leftmost side that runs to the right.

    ``ring`` is the start's (y, x); ``outer`` is false around a hole. Diagonal neighbours are one region, as a ring turns left where two
    sides leave a point; one that meets its start's point twice goes on.
    """
    return _points(_placed(cover, least), True)


def _walked(steps: bytes, x: int, y: int, last: tuple[int, int], tolerance: float) -> tuple[list[int], tuple[int, int]]:
    """Which points stay, and the last one that stayed: those further than the tolerance from the line between the last one that stayed and the one after them."""
    stays, (lx, ly) = [], last
    for i, d in enumerate(steps):
        nx, ny = x + (d == 0) - (d == 2), y + (d == 1) - (d == 3)
        dx, dy = nx - lx, ny - ly
        across = abs((x - lx) * dy - (y - ly) * dx)
        if (across and across / math.hypot(dx, dy) > tolerance) or (not (dx or dy) and math.hypot(x - lx, y - ly) > tolerance):
            stays.append(i)
            lx, ly = x, y
        x, y = nx, ny
    return stays, (lx, ly)


def _segments(placed: DataFrame, segment: int) -> DataFrame:
    """Rings cut where n is a multiple of ``segment``: a row for each part, with its first n, x, y, the point before it (last_x, last_y), its steps, and the ring's sides."""
    own = [*image(placed), "ring_y", "ring_x"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, row, i, x, y, d, came in _laid_out(batches):
            n = (i - rows.column("ahead").to_numpy()[row]) % rows.column("sides").to_numpy()[row]
            start = np.flatnonzero((i == 0) | (n % segment == 0))
            out = rows.select([*own, "sides", "outer"]).take(pa.array(row[start]))
            out = _with(out, segment=n[start] // segment, n=n[start], x=x[start], y=y[start], last_x=(x - _DX[came])[start], last_y=(y - _DY[came])[start])
            yield from out.append_column("steps", _binary(np.diff(np.append(start, len(d))), d)).to_batches()

    first = ["n", "x", "y", "last_x", "last_y"]
    pieces = placed.mapInArrow(cut, f"{_fields(placed, own)}, sides bigint, outer boolean, segment bigint, {', '.join(f'{k} bigint' for k in first)}, steps binary")
    pieces = settled(pieces.withColumn("all", (F.col("n") % segment == 0) & (F.octet_length("steps") == F.least(F.lit(segment), F.col("sides") - F.col("n")))))
    parted = pieces.where("NOT all").groupBy(*own, "segment", "sides", "outer").agg(F.sort_array(F.collect_list(F.struct(*first, "steps"))).alias("p"))
    joined = F.reduce("p", F.lit(b""), lambda done, piece: F.concat(done, piece["steps"]))
    parted = parted.select(*own, "segment", "sides", "outer", *(F.col("p")[0][k].alias(k) for k in first), joined.alias("steps"))
    return settled(pieces.where("all").drop("all").unionByName(parted))


def simplified(cover: DataFrame, tolerance: float, least: int = 128, segment: int = SEGMENT) -> DataFrame:
    """The rings of an outline as by ``contours``, with the points (at every pixel's corner) that are further than ``tolerance`` from the line between the last
    point that stayed and the next point; until one stays, each looks back to the point before it. A ring of which fewer than three would stay keeps every point.
    So from sqrt(1/2) on, the distance of a corner from the line between its neighbours, every ring is kept as it is; below, its first corner stays.

    What stays depends on all that came before, but only through the last point that stayed. So rings are cut into segments; each is walked as if the point before it had
    stayed, and again while the segment before it hands over another one. Walks that began apart soon meet, so few segments are walked more than twice;
    no task holds more than a segment of a ring. Rings of one segment, nearly all, are walked once."""
    placed = _placed(cover, least)
    if tolerance >= 0.5**0.5:
        return _points(placed, False)
    parts, tolerance = _segments(placed, segment), max(tolerance, 0.0)
    own = [*image(placed), "ring_y", "ring_x"]
    place = [*own, "segment"]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each segment's last point that stays, the given one if none does, and how many do."""
        for batch in batches:
            walks = [_walked(r["steps"], r["x"], r["y"], (r["last_x"], r["last_y"]), tolerance) for r in batch.select(["steps", "x", "y", "last_x", "last_y"]).to_pylist()]
            out = pa.Table.from_batches([batch.select([*place, "last_x", "last_y"])])
            yield from _with(out, end_x=np.array([w[1][0] for w in walks], np.int64), end_y=np.array([w[1][1] for w in walks], np.int64), stay=np.array([len(w[0]) for w in walks], np.int64)).to_batches()

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The points that stay, numbered from those of the segments before on; all points of a ring of few."""
        for rows, row, i, x, y, _, _ in _laid_out(batches):
            index, n, start = [], [], 0
            for r in rows.select(["steps", "n", "x", "y", "last_x", "last_y", "stay_before", "few", "sides"]).to_pylist():
                stays, _ = _walked(r["steps"], r["x"], r["y"], (r["last_x"], r["last_y"]), tolerance)
                few = len(stays) < 3 if r["few"] is None else r["few"]
                stays = range(len(r["steps"])) if few else stays
                index.append(np.fromiter(stays, np.int64, len(stays)) + start)
                n.append(np.arange(len(stays)) + (r["n"] if few else r["stay_before"]))
                start += len(r["steps"])
            at = np.concatenate(index)
            yield from _with(rows.select([*own, "outer"]).take(pa.array(row[at])), n=np.concatenate(n), x=x[at], y=y[at]).to_batches()

    many = parts.where(F.col("sides") > segment)
    walk = lambda df: df.mapInArrow(ends, f"{_fields(parts, own)}, segment bigint, last_x bigint, last_y bigint, end_x bigint, end_y bigint, stay bigint")
    ended = settled(walk(many))
    while True:
        told = ended.select(*own, (F.col("segment") + 1).alias("segment"), F.col("end_x").alias("new_x"), F.col("end_y").alias("new_y"))
        # a ring's first segment always looks back to the ring's last point, as its first point is a corner that stays
        other = ended.join(told, place).where((F.col("new_x") != F.col("last_x")) | (F.col("new_y") != F.col("last_y")))
        changed = settled(other.select(*place, F.col("new_x").alias("last_x"), F.col("new_y").alias("last_y")))
        if changed.isEmpty():
            break
        ended = settled(walk(many.drop("last_x", "last_y").join(changed, place)).unionByName(ended.join(changed, place, "left_anti")))
    ring = Window.partitionBy(*own)  # a row for each segment of a long ring
    before = F.coalesce(F.sum("stay").over(ring.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = ended.select(*place, "last_x", "last_y", before.alias("stay_before"), (F.sum("stay").over(ring) < 3).alias("few"))
    one = parts.where(F.col("sides") <= segment).withColumns({"stay_before": F.lit(0).cast("bigint"), "few": F.lit(None).cast("boolean")})
    given = one.unionByName(many.drop("last_x", "last_y").join(counted, place)).withColumn("came", F.lit(0))
    return _shown(given.mapInArrow(kept, f"{_fields(parts, own)}, outer boolean, n bigint, x bigint, y bigint"))
