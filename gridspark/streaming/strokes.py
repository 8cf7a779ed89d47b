"""Brush strokes: dabs every ``step`` of arc length along a stroke's samples, their footprint, and their accumulation.

The batch form is window functions over each stroke; the stream keeps each stroke's last sample and
the length left over in ``applyInPandasWithState``, and gives the same dabs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.functions.pixel import num
from gridspark.plans.stencil import at, image


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes from the events: one for each user, in the order of time."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return from_events(e)


def from_events(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("stroke"), "ts", "event_id", (F.col("event_id") % 256).cast("double").alias("x"), (F.col("value") / 2).alias("y"), (F.col("value") / 500).alias("pressure"))


def dabs(samples: DataFrame, step: float) -> DataFrame:
    """stroke, n, x, y, pressure of dab n = 0, 1, ... at n * step along the stroke; positions and pressure lie on the segment between two samples.
    Strokes of many images come with ``image_id``, which all that follows keeps."""
    order = Window.partitionBy(*image(samples), "stroke").orderBy("ts", "event_id")
    before = {c: F.lag(c).over(order) for c in ("x", "y", "pressure")}
    seg = samples.withColumns({f"p_{c}": F.coalesce(v, F.col(c)) for c, v in before.items()} | {"first": F.row_number().over(order) == 1})
    seg = seg.withColumn("len", F.sqrt((F.col("x") - F.col("p_x")) * (F.col("x") - F.col("p_x")) + (F.col("y") - F.col("p_y")) * (F.col("y") - F.col("p_y"))))
    seg = seg.withColumn("to", F.sum("len").over(order)).withColumn("from", F.col("to") - F.col("len"))
    # a segment holds the dabs in (from, to]; the first sample holds dab 0
    lo = F.when(F.col("first"), F.lit(0)).otherwise(F.floor(F.col("from") / step + 1e-9) + 1)
    hi = F.floor(F.col("to") / step + 1e-9)
    each = seg.where(hi >= lo).withColumn("n", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    t = F.when(F.col("len") > 0, (F.col("n") * step - F.col("from")) / F.when(F.col("len") > 0, F.col("len")).otherwise(1.0)).otherwise(0.0)
    return each.select(*image(samples), "stroke", "n", *((F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * t).alias(c) for c in ("x", "y", "pressure")))


_STATE = "n bigint, left double, x double, y double, pressure double"


def dab_stream(samples: DataFrame, step: float) -> DataFrame:
    """The dabs of a stream of samples that come in order within a stroke."""

    def run(key, batches, state: GroupState):
        held = state.get if state.exists else None
        for batch in batches:
            out = []
            for s in batch.sort_values(["ts", "event_id"]).itertuples(index=False):
                if held is None:
                    out.append((key[0], 0, s.x, s.y, s.pressure))
                    held = (0, step, s.x, s.y, s.pressure)
                    continue
                n, left, x, y, p = held
                length = math.hypot(s.x - x, s.y - y)
                at = left
                while length > 0 and at <= length + 1e-9 * step:
                    n, t = n + 1, at / length
                    out.append((key[0], n, x + (s.x - x) * t, y + (s.y - y) * t, p + (s.pressure - p) * t))
                    at += step
                held = (n, at - length, s.x, s.y, s.pressure)
            yield pd.DataFrame(out, columns=["stroke", "n", "x", "y", "pressure"])
        state.update(held)

    return samples.groupBy("stroke").applyInPandasWithState(run, "stroke bigint, n bigint, x double, y double, pressure double", _STATE, "append", GroupStateTimeout.NoTimeout)


def tip(distance: Column, radius: Column, hardness: float, pencil: bool = False) -> Column:
    """Coverage of a round tip: full inside hardness * radius, falling smoothly to none at the radius, over one pixel at least; a pencil's has no slope."""
    if pencil:
        return F.when((radius > 0) & (distance <= radius), 1.0).otherwise(0.0)
    t = F.least(F.greatest((radius - distance) / F.greatest(radius - radius * min(max(hardness, 0.0), 1.0), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return F.when(radius > 0, t * t * (3 - 2 * t)).otherwise(0.0)


#: Side of the tiles by which footprints are dealt out, and pixels of footprints in a part, which one task builds up at a time.
TILE, PART_CELLS = 32, 2_000_000


def _dealt(d: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column]) -> DataFrame:
    """Each dab's pixels (px, py) from first to last along x and y. Dabs are dealt by stroke and tile before they explode into pixels, in as many
    parts as all pixels take, so that neither a shuffle nor a task ever holds all of them."""
    d = d.withColumns({n: v.cast("bigint") for n, v in zip(("x_lo", "x_hi", "y_lo", "y_hi"), (*x, *y), strict=True)})
    cells = d.agg(F.sum(((F.col("x_hi") - F.col("x_lo") + 1) * (F.col("y_hi") - F.col("y_lo") + 1)).cast("double"))).first()[0] or 0
    across = lambda c: F.explode(F.sequence(F.floor(F.col(f"{c}_lo") / TILE), F.floor(F.col(f"{c}_hi") / TILE)))
    dealt = d.withColumn("q_x", across("x")).withColumn("q_y", across("y")).repartition(int(cells // PART_CELLS) + 1, *image(d), "stroke", "q_x", "q_y")
    within = lambda c: F.explode(F.sequence(F.greatest(f"{c}_lo", F.col(f"q_{c}") * TILE), F.least(f"{c}_hi", F.col(f"q_{c}") * TILE + TILE - 1)))
    return dealt.withColumn("px", within("x")).withColumn("py", within("y"))


def _built_up(hit: DataFrame) -> DataFrame:
    full = F.bool_or(F.col("c") >= 1)
    log = F.sum(F.when(F.col("c") < 1, F.log1p(-F.col("c"))).otherwise(0.0))
    built = hit.groupBy(*image(hit), "stroke", "q_x", "q_y", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.when(full, 1.0).otherwise(1 - F.exp(log)).alias("cover"))
    return built.drop("q_x", "q_y")


def stamp(dabs: DataFrame, radius: float, flow: float, hardness: float = 0.8, by_pressure: bool = True, flow_by_pressure: bool = False, pencil: bool = False) -> DataFrame:
    """stroke, x, y, cover: 1 less the product over dabs of (1 - flow * tip), the tip taken at the pixels' centres.
    Dabs explode into the pixels of their footprint; the product is an order-free aggregate."""
    size = F.col("pressure") * radius if by_pressure else F.lit(float(radius))
    ink = F.col("pressure") * flow if flow_by_pressure else F.lit(float(flow))
    d = dabs.select(*image(dabs), "stroke", "x", "y", size.alias("size"), ink.alias("ink")).where("size > 0")
    span = lambda c: (F.floor(F.col(c) - F.col("size") - 0.5), F.ceil(F.col(c) + F.col("size") - 0.5))
    cells = _dealt(d, span("x"), span("y"))
    dx, dy = F.col("px") + 0.5 - F.col("x"), F.col("py") + 0.5 - F.col("y")
    hit = cells.withColumn("c", F.col("ink") * tip(F.sqrt(dx * dx + dy * dy), F.col("size"), hardness, pencil)).where("c > 0")
    return _built_up(hit)


def stamp_sampled(dabs: DataFrame, tip: DataFrame, size: tuple[int, int], flow: float, diameter: float | None = None, roundness: float = 1.0, flip: tuple[bool, bool] = (False, False), by_pressure: bool = False, flow_by_pressure: bool = False) -> DataFrame:
    """``stamp`` with a bitmap for a tip: ``tip`` has tx, ty and alpha (0 to 255), absent texels are 0; ``size`` is its width and height.

    The longer side is scaled to ``diameter`` pixels, the height by ``roundness`` too, and read bilinearly at the pixels' centres.
    Every pixel of a footprint reads four texels, by joins with the tip, which is broadcast; then comes the product over dabs."""
    (width, height), (flip_x, flip_y) = size, flip
    full = float(max(width, height)) if diameter is None or not 0 < diameter < math.inf else float(diameter)
    roundness = roundness if 0 < roundness < math.inf else 1.0
    scale = F.lit(full / max(width, height)) * (F.col("pressure") if by_pressure else F.lit(1.0))
    ink = F.col("pressure") * flow if flow_by_pressure else F.lit(float(flow))
    d = dabs.select(*image(dabs), "stroke", "n", "x", "y", scale.alias("sx"), (scale * roundness).alias("sy"), ink.alias("ink")).where("sx > 0 AND ink > 0")
    span = lambda c, s, n: (F.floor(F.col(c) - F.col(s) * n / 2 - 1), F.ceil(F.col(c) + F.col(s) * n / 2 + 1) - 1)
    cells = _dealt(d, span("x", "sx", width), span("y", "sy", height))
    tx, ty = (F.col("px") + 0.5 - F.col("x")) / F.col("sx") + width / 2, (F.col("py") + 0.5 - F.col("y")) / F.col("sy") + height / 2
    cells = cells.withColumns({"u": (width - tx if flip_x else tx) - 0.5, "v": (height - ty if flip_y else ty) - 0.5})
    texel = F.broadcast(tip.where(F.col("tx").between(0, width - 1) & F.col("ty").between(0, height - 1)).groupBy((F.col("ty") * width + F.col("tx")).cast("bigint").alias("texel")).agg(F.sum("alpha").alias("alpha")))
    read, total = cells, num(0)
    for i in (0, 1):
        for j in (0, 1):
            tx, ty = F.floor("u") + i, F.floor("v") + j
            place = F.when(tx.between(0, width - 1) & ty.between(0, height - 1), ty * width + tx)
            read = read.withColumn("texel", place).join(texel.withColumnRenamed("alpha", f"a{i}{j}"), "texel", "left").drop("texel")
            fx, fy = F.col("u") - F.floor("u"), F.col("v") - F.floor("v")
            total = total + (fx if i else 1 - fx) * (fy if j else 1 - fy) * F.coalesce(f"a{i}{j}", F.lit(0))
    return _built_up(read.withColumn("c", F.col("ink") * F.least(total / 255, F.lit(1.0))).where("c > 0"))


def effective_cover(cover: DataFrame, opacity: float = 1.0, selection: DataFrame | None = None) -> DataFrame:
    """x, y, cover of a stroke: its own, times its opacity, times the selection (x, y, cov 0..255) where there is one."""
    rows = cover.select(*at(cover), F.col("cover"))
    if selection is not None:
        rows = rows.join(selection.select(*at(selection), "cov"), at(selection), "left").withColumn("cover", F.col("cover") * F.coalesce("cov", F.lit(0)) / 255)
    return rows.select(*at(cover), (F.col("cover") * min(max(opacity, 0.0), 1.0)).alias("cover")).where("cover > 0")


def paint(px: DataFrame, cover: DataFrame, colour: tuple[float, float, float], erase: bool = False) -> DataFrame:
    """The raster (straight colour) with a stroke's effective cover: the colour over it, or alpha taken away."""
    rows = px.join(cover.select(*at(cover), "cover"), at(cover), "left")
    k = F.coalesce("cover", F.lit(0.0))
    if erase:
        return rows.select(*at(px), *"rgb", (F.col("a") * (1 - k)).alias("a"))
    alpha = k + F.col("a") * (1 - k)
    over = [F.when(alpha == 0, 0.0).otherwise((F.lit(float(v)) * k + F.col(c) * F.col("a") * (1 - k)) / F.when(alpha == 0, 1.0).otherwise(alpha)).alias(c) for c, v in zip("rgb", colour, strict=True)]
    return rows.select(*at(px), *over, alpha.alias("a"))


def stroke_windows(samples: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Stroke length and samples by session, with a watermark on streams; an addition of this library."""
    rows = samples.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy("stroke", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("pressure").alias("pressure")).select("stroke", F.col("w.start").alias("start"), "n", "pressure")
