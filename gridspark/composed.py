"""Queries of the composed operators - reductions, selections, layers, versions, strokes - and their DuckDB SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark import oracle as sql
from gridspark.functions.pixel import CHANNELS, rounded
from gridspark.operators import reduce, regions, selection
from gridspark.plans import versions
from gridspark.plans.layers import Layer, LayerStack, adjust_chain, curve_lut
from gridspark.plans.registry import apply
from gridspark.plans.roi import Region, apply_within
from gridspark.queries import shown
from gridspark.sources.rasters import grid, height, mirrored, px_embed, px_layers, px_line
from gridspark.streaming import strokes


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), digits) for c in columns})


def histogram_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-channel histogram of the levelled raster."""
    return reduce.histogram(apply(px_embed(spark, sf_dir), "adjust.levels", in_black=0.1, in_white=0.9, gamma=1.2))


def histogram_panel(spark, sf_dir):
    return reduce.histogram(px_embed(spark, sf_dir), with_luma=True)


def histogram_dense(spark, sf_dir):
    return reduce.dense_histogram(reduce.histogram(px_embed(spark, sf_dir)))


def statistics(spark, sf_dir):
    return _rounded(reduce.statistics(px_embed(spark, sf_dir)), "lo", "hi", "mean")


def channel_stats(spark, sf_dir):
    return _rounded(reduce.channel_stats(px_embed(spark, sf_dir)), "lo", "hi", "mean")


def line_statistics(spark, sf_dir):
    """Statistics of the raster of line items, the largest one."""
    return _rounded(reduce.statistics(px_line(spark, sf_dir)), "lo", "hi", "mean")


def percentiles(spark, sf_dir):
    return reduce.percentile_bin(reduce.histogram(px_embed(spark, sf_dir)), 0.9)


def channel_means(spark, sf_dir):
    return _rounded(reduce.channel_mean(reduce.histogram(px_embed(spark, sf_dir))), "mean")


def auto_enhance(spark, sf_dir):
    return _rounded(reduce.auto_enhance(px_embed(spark, sf_dir)), "in_black", "in_white", "temp", "tint")


def lossless_shape(spark, sf_dir):
    return reduce.lossless_shape(px_embed(spark, sf_dir))


def mip_level(spark, sf_dir):
    return reduce.downsample_2x(px_embed(spark, sf_dir), 16, height(spark, sf_dir))


def mip_pyramid(spark, sf_dir):
    return reduce.pyramid(px_embed(spark, sf_dir), 16, height(spark, sf_dir), 4)


def distance_transform(spark, sf_dir):
    mask = px_embed(spark, sf_dir).select("x", "y", F.when(F.col("r") > 0.75, 1.0).otherwise(0.0).alias("m"))
    return _rounded(reduce.distance_transform(mask), "r")


def _covers(spark, sf_dir):
    px = px_embed(spark, sf_dir)
    return selection.from_channel(px.where("r > 0.5"), "r"), selection.from_channel(px.where("g > 0.5"), "g")


def _combine(mode):
    return lambda spark, sf_dir: selection.combine(*_covers(spark, sf_dir), mode)


def coverage_invert(spark, sf_dir):
    return selection.invert(_covers(spark, sf_dir)[0], 16, height(spark, sf_dir))


def coverage_bounds(spark, sf_dir):
    return reduce.bounds(_covers(spark, sf_dir)[0])


def coverage_fraction(spark, sf_dir):
    return _rounded(reduce.selected_fraction(_covers(spark, sf_dir)[0]), "fraction")


def coverage_rectangle(spark, sf_dir):
    return selection.rectangle(spark, 32, 32, 3.25, 4.5, 20.6, 17.125)


def coverage_ellipse(spark, sf_dir):
    return selection.ellipse(spark, 32, 32, 15.3, 14.7, 11.0, 8.5)


def coverage_polygon(spark, sf_dir):
    return selection.polygon(spark, 32, 32, [(2.0, 3.0), (28.0, 6.0), (20.0, 29.0), (14.0, 10.0), (5.0, 25.0)])


def wand_global(spark, sf_dir):
    return selection.wand(px_embed(spark, sf_dir), 3, 10, 60, contiguous=False)


def wand_contiguous(spark, sf_dir):
    return selection.wand(px_embed(spark, sf_dir), 3, 10, 85)


def quick_select(spark, sf_dir):
    px = px_embed(spark, sf_dir)
    return selection.quick_select(px, px.where("y < 4"))


def feather(spark, sf_dir):
    return selection.feather(_covers(spark, sf_dir)[0], 1.0, 16, height(spark, sf_dir))


def masked_invert(spark, sf_dir):
    """A soft WHERE: the kernel's result weighted by a selection."""
    px = px_embed(spark, sf_dir)
    return shown(apply(px, "math.invert", mask=px.select("x", "y", (F.col("x") / 15).alias("m"))))


def adjust_chained(spark, sf_dir):
    """Stages given in any order run in the fixed one."""
    return shown(adjust_chain(px_embed(spark, sf_dir), saturation={"sat": 1.4}, exposure={"ev": 0.5}, brightness_contrast={"brightness": 0.1, "contrast": 1.3}))


def layer_composite(spark, sf_dir):
    """Four of the ten sparse layers, one by multiply, one hidden."""
    stack = LayerStack(px_layers(spark, sf_dir), [Layer(0), Layer(1, "multiply", 0.8), Layer(2, visible=False), Layer(3, "screen", 0.5)])
    return shown(stack.composite())


def layer_overlap(spark, sf_dir):
    """Two full plates and an adjustment of them."""
    px = px_embed(spark, sf_dir)
    both = px.withColumn("z", F.lit(0).cast("bigint")).unionByName(mirrored(px).withColumn("z", F.lit(1).cast("bigint")))
    return shown(LayerStack(both, [Layer(0), Layer(1, "multiply", 0.75), Layer(2, adjust=("math.mul_const", {"v": 0.9}))]).composite())


def _versions(spark, sf_dir):
    px = versions.tiles(px_embed(spark, sf_dir), 8).withColumns({"generation": F.lit(1).cast("bigint"), "hole": F.lit(False)})
    first = px.select("tx", "ty", "x", "y", *CHANNELS, "generation", "hole")
    inverted = versions.tiles(apply(px.where("ty = 3"), "math.invert"), 8)
    return versions.edit(first, inverted, 2)


def versions_latest(spark, sf_dir):
    return shown(versions.latest(_versions(spark, sf_dir)))


def versions_undo(spark, sf_dir):
    return shown(versions.latest(versions.restore(_versions(spark, sf_dir), 1, 3)))


def stroke_dabs(spark, sf_dir):
    return _rounded(strokes.dabs(strokes.samples(spark, sf_dir), 40.0), "x", "y", "pressure", digits=4)


def _strokes_cover(spark, sf_dir):
    return strokes.stamp(strokes.dabs(strokes.samples(spark, sf_dir), 40.0), 4.0, 0.6)


def stroke_stamp(spark, sf_dir):
    return _rounded(_strokes_cover(spark, sf_dir), "cover", digits=4).where("cover > 0.0001")


QUERIES = {
    "histogram_levels": histogram_levels, "histogram_panel": histogram_panel, "histogram_dense": histogram_dense, "statistics": statistics, "channel_stats": channel_stats, "line_statistics": line_statistics, "percentiles": percentiles,
    "channel_means": channel_means, "auto_enhance": auto_enhance, "lossless_shape": lossless_shape, "mip_level": mip_level, "mip_pyramid": mip_pyramid, "distance_transform": distance_transform,
    "coverage_replace": _combine("replace"), "coverage_add": _combine("add"), "coverage_subtract": _combine("subtract"), "coverage_intersect": _combine("intersect"), "coverage_invert": coverage_invert, "coverage_bounds": coverage_bounds,
    "coverage_fraction": coverage_fraction, "coverage_rectangle": coverage_rectangle, "coverage_ellipse": coverage_ellipse, "coverage_polygon": coverage_polygon, "wand_global": wand_global, "wand_contiguous": wand_contiguous, "quick_select": quick_select,
    "feather": feather, "masked_invert": masked_invert, "adjust_chain": adjust_chained, "layer_composite": layer_composite, "layer_overlap": layer_overlap, "versions_latest": versions_latest, "versions_undo": versions_undo,
    "stroke_dabs": stroke_dabs, "stroke_stamp": stroke_stamp,
}

# -- the same in DuckDB ------------------------------------------------------------------------------

_BYTE = "CAST(least(greatest(round(({}) * 255), 0), 255) AS BIGINT)"
_LONG = "SELECT channel, bin, count(*) AS n FROM (SELECT unnest(['r', 'g', 'b', '{last}']) AS channel, unnest([{r}, {g}, {b}, {l}]) AS bin FROM {source}) GROUP BY ALL"


def _hist(source="px", last="a", luma=None, level=lambda c: c):
    r, g, b, a = (_BYTE.format(level(c) if c != "a" else c) for c in "rgba")
    light = f"least(({r} * 299 + {g} * 587 + {b} * 114 + 500) // 1000, 255)"
    return _LONG.format(last=last, r=r, g=g, b=b, l=light if luma else a, source=source)


_H = f"WITH {sql.PX}, h AS ({_hist()})"
_LEVEL = lambda c: f"(pow({sql.clamp(f'((CASE WHEN a = 0 THEN 0 ELSE {c} / a END) - 0.1) / 0.8')}, {1 / 1.2!r}) * a)"
_STATS = "SELECT channel, round(min(v), 6) + 0.0 AS lo, round(max(v), 6) + 0.0 AS hi, round(avg(v), 6) + 0.0 AS mean FROM (SELECT unnest([{n}]) AS channel, unnest([{v}]) AS v FROM {t}) GROUP BY channel"
_RUN = "run AS (SELECT channel, bin, n, sum(n) OVER (PARTITION BY channel ORDER BY bin) AS s, sum(n) OVER (PARTITION BY channel) AS t FROM h)"
_COV = f"WITH {sql.PX}, a AS (SELECT x, y, {_BYTE.format('r')} AS cov FROM px WHERE r > 0.5), b AS (SELECT x, y, {_BYTE.format('g')} AS cov FROM px WHERE g > 0.5)"
_XY = "CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y"


def _combined(e: str) -> str:
    return f"{_COV} SELECT CAST(coalesce(a.x, b.x) AS BIGINT) AS x, CAST(coalesce(a.y, b.y) AS BIGINT) AS y, CAST({e} AS BIGINT) AS cov FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y"


_P, _Q = "coalesce(a.cov, 0)", "coalesce(b.cov, 0)"
_GRID = "grid AS (SELECT gx.x, gy.y FROM range(32) gx(x) CROSS JOIN range(32) gy(y))"
_NEAR = f"near AS MATERIALIZED (SELECT p.x, p.y FROM px p, px k WHERE k.x = 3 AND k.y = 10 AND greatest({', '.join(f'abs(round(p.{c} * 255) - round(k.{c} * 255))' for c in 'rgba')}) <= 60)"
_FLOOD = "SELECT n.x, n.y FROM fill f CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dx, dy) JOIN near n ON n.x = f.x + dx AND n.y = f.y + dy"
_POLY = "poly AS (SELECT * FROM (VALUES (2.0, 3.0, 28.0, 6.0), (28.0, 6.0, 20.0, 29.0), (20.0, 29.0, 14.0, 10.0), (14.0, 10.0, 5.0, 25.0), (5.0, 25.0, 2.0, 3.0)) t(ax, ay, bx, b_y))"
_FEATHER = [(d, w) for d, w in zip(range(-3, 4), (lambda r: [v / sum(r) for v in r])([2.718281828459045 ** (-d * d / 2) for d in range(-3, 4)]), strict=True)]
_ORDERED = "ev AS (SELECT user_id AS stroke, ts, event_id, CAST(event_id % 256 AS DOUBLE) AS x, value / 2 AS y, value / 500 AS pressure FROM events)"
_SEG = """seg AS (SELECT *, coalesce(lag(x) OVER o, x) AS px, coalesce(lag(y) OVER o, y) AS py, coalesce(lag(pressure) OVER o, pressure) AS pp, row_number() OVER o AS rn FROM ev WINDOW o AS (PARTITION BY stroke ORDER BY ts, event_id)),
 len AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS l FROM seg), tot AS (SELECT *, sum(l) OVER (PARTITION BY stroke ORDER BY ts, event_id) AS t1 FROM len), fr AS (SELECT *, t1 - l AS t0 FROM tot),
 dab AS (SELECT stroke, n, l, t0, px, py, pp, x, y, pressure, CASE WHEN l > 0 THEN (n * 40.0 - t0) / l ELSE 0 END AS t
 FROM (SELECT *, unnest(range(CASE WHEN rn = 1 THEN 0 ELSE CAST(floor(t0 / 40.0 + 1e-9) AS BIGINT) + 1 END, CAST(floor(t1 / 40.0 + 1e-9) AS BIGINT) + 1)) AS n FROM fr))"""
_COVER = f"""{_ORDERED}, {_SEG}, d AS (SELECT stroke, px + (x - px) * t AS x, py + (y - py) * t AS y, (pp + (pressure - pp) * t) * 4.0 AS size FROM dab),
 c AS (SELECT stroke, x, y, size, gx, gy, sqrt((gx + 0.5 - x) * (gx + 0.5 - x) + (gy + 0.5 - y) * (gy + 0.5 - y)) AS far FROM (SELECT *, unnest(range(CAST(floor(x - size) - 1 AS BIGINT), CAST(ceil(x + size) + 1 AS BIGINT))) AS gx FROM d) CROSS JOIN LATERAL
 (SELECT unnest(range(CAST(floor(y - size) - 1 AS BIGINT), CAST(ceil(y + size) + 1 AS BIGINT))) AS gy)),
 k AS (SELECT *, {sql.clamp("(size - far) / greatest(size - size * 0.8, 1)")} AS u FROM c WHERE size > 0),
 stamped AS (SELECT stroke, gx AS x, gy AS y, 1 - exp(sum(ln(1 - 0.6 * u * u * (3 - 2 * u)))) AS cover FROM k WHERE u > 0 GROUP BY ALL)"""
_STAMP = f"WITH {_COVER} SELECT stroke, x, y, round(cover, 4) + 0.0 AS cover FROM stamped WHERE round(cover, 4) > 0.0001"


def _fold(*plates: tuple[str, float, str], last: str = "1") -> str:
    """Plates (prefix of its columns, opacity, blend of below b and plate s as SQL) over each other, bottom first, from a table ``wide``; straight colour."""
    steps, below = [], {"a": "0", "r": "0", "g": "0", "b": "0"}
    for k, (name, opacity, blend) in enumerate(plates):
        alpha = f"({name}a * {opacity})"
        mixed = {c: f"{alpha} * (1 - {below['a']}) * {name}{c} + {alpha} * {below['a']} * ({blend.format(b=_straight(below, c), s=f'{name}{c}')}) + (1 - {alpha}) * {below[c]}" for c in "rgb"}
        table = "wide" if not k else f"s{k - 1}"
        steps.append(f"s{k} AS (SELECT *, {', '.join(f'{e} AS acc{k}{c}' for c, e in mixed.items())}, {alpha} + {below['a']} * (1 - {alpha}) AS acc{k}a FROM {table})")
        below = {c: f"acc{k}{c}" for c in "rgba"}
    return ", ".join(steps) + f", folded AS (SELECT x, y, {', '.join(f'CASE WHEN {below["a"]} = 0 THEN 0 ELSE {below[c]} / {below["a"]} END AS {c}' for c in 'rgb')}, {below['a']} * {last} AS a FROM s{len(plates) - 1})"


def _straight(below: dict, c: str) -> str:
    return f"(CASE WHEN {below['a']} = 0 THEN 0 ELSE {below[c]} / {below['a']} END)"


_TWO = "wide AS (SELECT p.x, p.y, p.r AS pr, p.g AS pg, p.b AS pb, p.a AS pa, q.r AS qr, q.g AS qg, q.b AS qb, q.a AS qa FROM px p JOIN px q ON q.x = 15 - p.x AND q.y = p.y)"
_PLATES = ", ".join(f"coalesce(max(CASE WHEN e.label = {z} THEN px.{c} END), 0) AS l{z}{c}" for z in (0, 1, 3) for c in "rgba")
_FEW = f"wide AS (SELECT px.x, px.y, {_PLATES} FROM px JOIN embeddings e ON e.vec_id = px.y WHERE e.label IN (0, 1, 3) GROUP BY px.x, px.y)"


ORACLE_SQL = {
    "histogram_levels": f"WITH {sql.PX} {_hist(level=_LEVEL)}", "histogram_panel": f"WITH {sql.PX} {_hist(last='luma', luma=True)}",
    "histogram_dense": f"{_H} SELECT c.channel, CAST(d.bin AS BIGINT) AS bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT channel FROM h) c CROSS JOIN range(256) d(bin) LEFT JOIN h ON h.channel = c.channel AND h.bin = d.bin",
    "statistics": f"WITH {sql.PX} " + _STATS.format(n="'r', 'g', 'b', 'a'", v="r, g, b, a", t="px"), "channel_stats": f"WITH {sql.PX} " + _STATS.format(n="'r', 'g', 'b', 'a', 'luma'", v=f"r, g, b, a, {sql.LUM709}", t="px"),
    "line_statistics": "WITH l AS (SELECT avg(l_quantity) / 50 AS r, avg(l_discount) * 10 AS g, avg(l_tax) * 12.5 AS b, 1.0::DOUBLE AS a FROM lineitem GROUP BY l_orderkey, l_linenumber) " + _STATS.format(n="'r', 'g', 'b', 'a'", v="r, g, b, a", t="l"),
    "percentiles": f"{_H}, {_RUN} SELECT channel, min(bin) AS bin FROM run WHERE s >= greatest(1, ceil(t * 0.9)) GROUP BY channel", "channel_means": f"{_H} SELECT channel, round(sum(bin * n)::DOUBLE / sum(n), 6) + 0.0 AS mean FROM h GROUP BY channel",
    "auto_enhance": f"""WITH {sql.PX}, h AS ({_hist(last='luma', luma=True)}), {_RUN}, e AS (SELECT (SELECT min(bin) FROM run WHERE channel = 'luma' AND s >= greatest(1, ceil(t * 0.005))) AS lo, (SELECT min(bin) FROM run WHERE channel = 'luma' AND s >= greatest(1, ceil(t * 0.995))) AS hi,
 (SELECT sum(bin * n)::DOUBLE / sum(n) FROM h WHERE channel = 'r') AS mr, (SELECT sum(bin * n)::DOUBLE / sum(n) FROM h WHERE channel = 'g') AS mg, (SELECT sum(bin * n)::DOUBLE / sum(n) FROM h WHERE channel = 'b') AS mb)
 SELECT round(lo / 255.0, 6)::DOUBLE AS in_black, round(hi / 255.0, 6)::DOUBLE AS in_white, round(((mr + mg + mb) / 3 / mr - (mr + mg + mb) / 3 / mb) / 2, 6) + 0.0 AS temp, round((mr + mg + mb) / 3 / mg - 1, 6) + 0.0 AS tint FROM e""",
    "lossless_shape": f"WITH {sql.PX} SELECT (CASE WHEN bool_and(round(r * 255) = round(g * 255) AND round(g * 255) = round(b * 255)) THEN 'gray' ELSE 'rgb' END) || (CASE WHEN bool_and(round(a * 255) = 255) THEN '' ELSE 'a' END) AS shape FROM px",
    "mip_level": f"WITH {sql.PX} SELECT CAST(x // 2 AS BIGINT) AS x, CAST(y // 2 AS BIGINT) AS y, {', '.join(f'CAST(sum({_BYTE.format(c)}) // count(*) AS BIGINT) AS {c}' for c in 'rgba')} FROM px WHERE y < 2 * ((SELECT max(vec_id) + 1 FROM embeddings) // 2) GROUP BY 1, 2",
    "mip_pyramid": f"WITH {sql.PX}, l0 AS (SELECT {_XY}, {', '.join(f'{_BYTE.format(c)} AS {c}' for c in 'rgba')} FROM px)" + "".join(f", l{k} AS (SELECT x // 2 AS x, y // 2 AS y, {', '.join(f'CAST(sum({c}) // count(*) AS BIGINT) AS {c}' for c in 'rgba')} FROM l{k - 1} WHERE x < {2 * (16 >> k)} AND y < 2 * greatest((SELECT max(vec_id) + 1 FROM embeddings) // {1 << k}, 1) GROUP BY 1, 2)" for k in (1, 2, 3)) + " " + " UNION ALL ".join(f"SELECT x, y, r, g, b, a, {k} AS level FROM l{k}" for k in range(4)),
    "distance_transform": f"WITH {sql.PX}, p AS (SELECT x, y, r > 0.75 AS s FROM px) SELECT CAST(p.x AS BIGINT) AS x, p.y AS y, round(coalesce(min(greatest(abs(p.x - q.x), abs(p.y - q.y)) + (sqrt(2) - 1) * least(abs(p.x - q.x), abs(p.y - q.y))), 65504), 6) + 0.0 AS r FROM p LEFT JOIN p q ON q.s GROUP BY p.x, p.y",
    "coverage_replace": _combined(_Q), "coverage_add": _combined(f"greatest({_P}, {_Q})"), "coverage_subtract": _combined(f"({_P} * (255 - {_Q}) + 127) // 255"), "coverage_intersect": _combined(f"least({_P}, {_Q})"),
    "coverage_invert": f"{_COV} SELECT CAST(gx.x AS BIGINT) AS x, CAST(gy.y AS BIGINT) AS y, CAST(255 - coalesce(a.cov, 0) AS BIGINT) AS cov FROM range(16) gx(x) CROSS JOIN (SELECT unnest(range((SELECT max(vec_id) + 1 FROM embeddings))) AS y) gy LEFT JOIN a ON a.x = gx.x AND a.y = gy.y",
    "coverage_bounds": f"{_COV} SELECT CAST(min(x) AS BIGINT) AS x0, CAST(min(y) AS BIGINT) AS y0, CAST(max(x) AS BIGINT) AS x1, CAST(max(y) AS BIGINT) AS y1 FROM a WHERE cov > 0",
    "coverage_fraction": f"{_COV} SELECT round(sum(cov) / (255.0::DOUBLE * count(*)), 6) + 0.0 AS fraction, bool_and(cov = 255) AS all_one, bool_and(cov = 0) AS all_zero FROM a",
    "coverage_rectangle": f"WITH {_GRID} SELECT {_XY}, CAST(round(greatest(least(x + 1, 20.6::DOUBLE) - greatest(x, 3.25::DOUBLE), 0) * greatest(least(y + 1, 17.125::DOUBLE) - greatest(y, 4.5::DOUBLE), 0) * 255) AS BIGINT) AS cov FROM grid",
    "coverage_ellipse": f"WITH {_GRID} SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CAST(round(sum(CASE WHEN pow((x + (i + 0.5) / 4 - 15.3::DOUBLE) / 11, 2) + pow((y + (j + 0.5) / 4 - 14.7::DOUBLE) / 8.5, 2) <= 1 THEN 1 ELSE 0 END) * 255 / 16.0) AS BIGINT) AS cov FROM grid CROSS JOIN range(4) a(i) CROSS JOIN range(4) b(j) GROUP BY x, y",
    "coverage_polygon": f"""WITH {_GRID}, {_POLY}, c AS (SELECT id, ax + ((id + 0.5) / 4 - ay) / (b_y - ay) * (bx - ax) AS cx FROM range(128) l(id) JOIN poly ON least(ay, b_y) <= (id + 0.5) / 4 AND (id + 0.5) / 4 < greatest(ay, b_y)),
 s AS (SELECT id, min(cx) AS lo, max(cx) AS hi FROM (SELECT id, cx, (row_number() OVER (PARTITION BY id ORDER BY cx) - 1) // 2 AS pair FROM c) GROUP BY id, pair)
 SELECT CAST(g.x AS BIGINT) AS x, CAST(g.y AS BIGINT) AS y, CAST(round(least(coalesce(sum(CASE WHEN s.id IS NULL THEN 0 ELSE greatest(least(g.x + 1, hi) - greatest(g.x, lo), 0) END) / 4, 0), 1) * 255) AS BIGINT) AS cov FROM grid g LEFT JOIN s ON s.id // 4 = g.y GROUP BY g.x, g.y""",
    "wand_global": f"WITH {sql.PX}, {_NEAR} SELECT {_XY}, CAST(255 AS BIGINT) AS cov FROM near",
    "wand_contiguous": f"WITH RECURSIVE {sql.PX}, {_NEAR.replace('<= 60', '<= 85')}, fill AS (SELECT x, y FROM near WHERE x = 3 AND y = 10 UNION {_FLOOD}) SELECT {_XY}, CAST(255 AS BIGINT) AS cov FROM fill",
    "quick_select": f"""WITH RECURSIVE {sql.PX}, k AS (SELECT {', '.join(f'avg(round({c} * 255)) AS m{c}, stddev_pop(round({c} * 255)) AS s{c}' for c in 'rgba')} FROM px WHERE y < 4),
 near AS (SELECT x, y FROM px, k WHERE y < 4 OR ({' AND '.join(f'abs(round({c} * 255) - m{c}) <= least(72, 16 + 1.5 * s{c})' for c in 'rgba')})), fill AS (SELECT x, y FROM near WHERE y < 4 UNION {_FLOOD}) SELECT {_XY}, CAST(255 AS BIGINT) AS cov FROM fill""",
    "feather": f"""{_COV}, w AS (SELECT * FROM (VALUES {', '.join(f'({d}, {v!r}::DOUBLE)' for d, v in _FEATHER)}) t(d, k)), g AS (SELECT x, y FROM px)
 SELECT CAST(g.x AS BIGINT) AS x, CAST(g.y AS BIGINT) AS y, CAST(round(sum(u.k * v.k * coalesce(a.cov, 0))) AS BIGINT) AS cov FROM g CROSS JOIN w u CROSS JOIN w v LEFT JOIN a ON a.x = g.x + u.d AND a.y = g.y + v.d GROUP BY g.x, g.y""",
    "masked_invert": sql.each("@ + (1 - @ - @) * (x / 15)"), "adjust_chain": sql.straight(*(f"({sql.luma('er', 'eg', 'eb')} + (e{c} - {sql.luma('er', 'eg', 'eb')}) * 1.4)" for c in "rgb"), extra="").replace("FROM u", "FROM (SELECT *, (r * 1.4142135623730951 - 0.5) * 1.3 + 0.5 + 0.1 AS er, (g * 1.4142135623730951 - 0.5) * 1.3 + 0.5 + 0.1 AS eg, (b * 1.4142135623730951 - 0.5) * 1.3 + 0.5 + 0.1 AS eb FROM u)"),
    "layer_overlap": sql.final("folded", *"rgba", _TWO, _fold(("p", 1, "{s}"), ("q", 0.75, "{b} * {s}"), last="0.9")),
    "layer_composite": sql.final("folded", *"rgba", _FEW, _fold(("l0", 1, "{s}"), ("l1", 0.8, "{b} * {s}"), ("l3", 0.5, "{b} + {s} - {b} * {s}"))),
    "versions_latest": sql.final("px", *(f"CASE WHEN y // 8 = 3 THEN 1 - {c} ELSE {c} END" for c in "rgba")), "versions_undo": sql.each("@"),
    "stroke_dabs": f"WITH {_ORDERED}, {_SEG} SELECT stroke, n, round(px + (x - px) * t, 4) + 0.0 AS x, round(py + (y - py) * t, 4) + 0.0 AS y, round(pp + (pressure - pp) * t, 4) + 0.0 AS pressure FROM dab", "stroke_stamp": _STAMP,
}


# -- regions -----------------------------------------------------------------------------------------


def _channels(df: DataFrame) -> DataFrame:
    return _rounded(df.select("x", "y", *CHANNELS), *CHANNELS)


def tile_enumeration(spark, sf_dir):
    """Tiles of a region for each order line: the line number and quantity stand for its place and size."""
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = item.select(F.col("l_partkey").alias("x0"), F.col("l_suppkey").alias("y0"), F.col("l_quantity").cast("bigint").alias("width"), F.col("l_linenumber").cast("bigint").alias("height"))
    return regions.tiles_of(part, 16).groupBy("tx", "ty").agg(F.count("*").alias("n"))


def _oriented(orientation):
    return lambda spark, sf_dir: _channels(regions.orient(px_embed(spark, sf_dir), orientation, 16, height(spark, sf_dir)))


_INK = ((0.1, 0.2, 0.3, 0.9), (0.9, 0.4, 0.6, 0.5))
_CURVE = [(0.0, 0.0), (128.0, 64.0), (255.0, 255.0)]


def _filled(kind):
    return lambda spark, sf_dir: _channels(regions.fill(px_embed(spark, sf_dir), _covers(spark, sf_dir)[0], kind, *_INK, amount=0.5, seed=42))


def _masked_by_selection(spark, sf_dir):
    px = px_embed(spark, sf_dir)
    return shown(apply(px, "math.invert", mask=selection.mask_window(_covers(spark, sf_dir)[0], px)))


def _two(spark, sf_dir):
    px = px_embed(spark, sf_dir)
    return px, px.withColumn("z", F.lit(0).cast("bigint")).unionByName(mirrored(px).withColumn("z", F.lit(1).cast("bigint")))


def layer_masked(spark, sf_dir):
    """A plate clipped to the one below and under a mask."""
    px, both = _two(spark, sf_dir)
    return shown(LayerStack(both, [Layer(0), Layer(1, "screen", 0.7, clipped=True, mask=px.select("x", "y", (F.col("x") / 15).alias("m")))]).composite())


def layer_group(spark, sf_dir):
    """A group of both plates, as a plate of its own over one of them."""
    stack = LayerStack(_two(spark, sf_dir)[1])
    group = stack.group(9, [Layer(0), Layer(1, "multiply")], opacity=0.6)
    return shown(LayerStack(stack.pixels, [Layer(1), group]).composite())


def _all_strokes(spark, sf_dir):
    cover = _strokes_cover(spark, sf_dir).groupBy("x", "y").agg(F.max("cover").alias("cover"))  # the heaviest stroke of each place
    return strokes.effective_cover(cover, 0.8, selection.rectangle(spark, 256, 256, 10.5, 0.0, 200.0, 300.0))


def stroke_cover(spark, sf_dir):
    return _rounded(_all_strokes(spark, sf_dir), "cover", digits=4).where("cover > 0.0001")


def _painted(erase):
    return lambda spark, sf_dir: _channels(strokes.paint(px_embed(spark, sf_dir), _all_strokes(spark, sf_dir), (0.9, 0.2, 0.1), erase))


def contours(spark, sf_dir):
    out = regions.contours(_covers(spark, sf_dir)[0])
    return out.select(F.col("ring.x").alias("ring_x"), F.col("ring.y").alias("ring_y"), "n", "x", "y", F.col("outer").cast("int").alias("outer"))


def contours_simplified(spark, sf_dir):
    out = regions.simplified(_covers(spark, sf_dir)[0], 0.6)
    return out.select(F.col("ring.x").alias("ring_x"), F.col("ring.y").alias("ring_y"), "n", "x", "y", F.col("outer").cast("int").alias("outer"))


def stroke_sampled_tip(spark, sf_dir):
    tip = grid(spark, 5, 4).select(F.col("x").alias("tx"), F.col("y").alias("ty"), ((F.col("x") * 50 + F.col("y") * 20) % 256).alias("alpha"))
    dabs = strokes.dabs(strokes.samples(spark, sf_dir), 40.0)
    return _rounded(strokes.stamp_sampled(dabs, tip, (5, 4), 0.6, diameter=7.0, roundness=0.8, flip=(True, False)), "cover", digits=4).where("cover > 0.0001")


QUERIES |= {
    "crop": lambda spark, sf_dir: _channels(regions.crop(px_embed(spark, sf_dir), 3, 20, 9, 200)),
    **{f"orient_{k}": _oriented(k) for k in range(1, 9)},
    "tile_enumeration": tile_enumeration,
    "selection_from_channel": lambda spark, sf_dir: selection.from_channel(px_embed(spark, sf_dir), "b"),
    "clone_stamp": lambda spark, sf_dir: _channels(regions.clone(px_embed(spark, sf_dir), _covers(spark, sf_dir)[0], 2, -3)),
    **{f"fill_{kind}": _filled(kind) for kind in ("linear", "radial", "angular", "reflected", "diamond", "noise", "solid")},
    "straighten_crop": lambda spark, sf_dir: _channels(regions.straighten(px_embed(spark, sf_dir), 7.0, 2, 30, 11, 120)),
    "curve_masked": lambda spark, sf_dir: regions.curve_bytes(px_embed(spark, sf_dir), curve_lut(_CURVE), _covers(spark, sf_dir)[0]),
    "cmyk_device": lambda spark, sf_dir: regions.cmyk_to_rgba(px_embed(spark, sf_dir).select("x", "y", *(reduce.to_byte(F.col(c)).alias(k) for c, k in zip("rgba", ("c", "m", "y_ink", "k"), strict=True)))),
    "window_opaque": lambda spark, sf_dir: reduce.window_opaque(px_embed(spark, sf_dir), 2, 5, 6, 40),
    "content_hash": lambda spark, sf_dir: reduce.content_hash(px_embed(spark, sf_dir)),
    "mask_window": _masked_by_selection, "adjust_blur": lambda spark, sf_dir: shown(adjust_chain(px_embed(spark, sf_dir), blur=1.0)),
    "adjust_sharpen": lambda spark, sf_dir: shown(adjust_chain(px_embed(spark, sf_dir), sharpen=0.8)), "adjust_curve": lambda spark, sf_dir: shown(adjust_chain(px_embed(spark, sf_dir), curve=_CURVE)),
    "layer_masked": layer_masked, "layer_group": layer_group, "stroke_cover": stroke_cover, "stroke_paint": _painted(False), "stroke_erase": _painted(True),
    "outline_edges": lambda spark, sf_dir: regions.outline(_covers(spark, sf_dir)[0]), "contours": contours, "contours_simplified": contours_simplified, "stroke_sampled_tip": stroke_sampled_tip,
    "roi_box": lambda spark, sf_dir: _channels(apply_within(px_embed(spark, sf_dir), "conv.box", Region(2, 20, 9, 120))),
    "roi_gaussian_v": lambda spark, sf_dir: _channels(apply_within(px_embed(spark, sf_dir), "conv.gaussian_v", Region(0, 30, 16, 90), sigma=1.2, radius=3)),
}

_OUT = ", ".join(f"round({{{c}}}, 6) + 0.0 AS {c}" for c in "rgba")
_PLACES = {1: ("x", "y"), 2: ("15 - x", "y"), 3: ("15 - x", "h - y"), 4: ("x", "h - y"), 5: ("y", "x"), 6: ("h - y", "x"), 7: ("h - y", "15 - x"), 8: ("y", "15 - x")}
_SELF = _OUT.format(r="r", g="g", b="b", a="a")
_RAMPS = {"r": (0.1, 0.9), "g": (0.2, 0.4), "b": (0.3, 0.6)}

_cos, _sin = (lambda f: lambda d: repr(f(math.radians(d))))(math.cos), (lambda f: lambda d: repr(f(math.radians(d))))(math.sin)


def _product(sigma: float, r: int) -> list[tuple]:
    """Taps of a two-dimensional Gaussian as products of one-dimensional weights."""
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-r, r + 1)]
    w = [v / sum(raw) for v in raw]
    return [(dx, dy, repr(w[dx + r] * w[dy + r])) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]


# the pieces between (0, 0), (128, 64) and (255, 255); tangents 1/2, the mean of both slopes, 191/127
_PIECE = "(2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {y0} + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {h} * {m0} + (3 * pow({t}, 2) - 2 * pow({t}, 3)) * {y1} + (pow({t}, 3) - pow({t}, 2)) * {h} * {m1}"
_MID = "((0.5::DOUBLE + 191 / 127) / 2)"
_HERMITE = f"""curve AS (SELECT list(CAST(floor(least(greatest(CASE WHEN v < 128 THEN {_PIECE.format(t='(v / 128)', y0=0, y1=64, h=128, m0='0.5', m1=_MID)} ELSE {_PIECE.format(t='((v - 128) / 127)', y0=64, y1=255, h=127, m0=_MID, m1='(191 / 127)')} END, 0), 255) + 0.5) AS BIGINT) ORDER BY v) AS lut FROM range(256) r(v))"""


def _fill_sql(kind: str) -> str:
    (r0, g0, b0, a0), (r1, g1, b1, a1) = _INK
    t = {
        "linear": "(x - x0) / (x1 - x0)", "reflected": "abs(x - cx) / ((x1 - x0) / 2)", "radial": "sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / half", "diamond": "(abs(x - cx) + abs(y - cy)) / half",
        "angular": f"((CASE WHEN y < cy THEN -1 ELSE 1 END) * (CASE WHEN x < cx THEN pi() - q1 ELSE q1 END) + pi()) / (2 * pi())",
    }.get(kind, "0")
    ends = [(r0 * a0, r1 * a1), (g0 * a0, g1 * a1), (b0 * a0, b1 * a1), (a0, a1)]
    made = [f"({p!r}::DOUBLE + ({q!r}::DOUBLE - {p!r}::DOUBLE) * t)" for p, q in ends]
    if kind == "noise":
        made = [f"({sql.noise('x', 'y', 42)} * 0.5)"] * 3 + ["1.0::DOUBLE"]
    over = {c: f"({c if c == 'a' else f'{c} * a'} + ({made[k]} + (1 - {made[3]}) * {c if c == 'a' else f'{c} * a'} - {c if c == 'a' else f'{c} * a'}) * m)" for k, c in enumerate("rgba")}
    steps = f"""frame AS (SELECT min(x) AS x0, max(x) + 1 AS x1, (min(x) + max(x) + 1) / 2.0 AS cx, (min(y) + max(y) + 1) / 2.0 AS cy, greatest(max(x) + 1 - min(x), max(y) + 1 - min(y)) / 2.0 AS half FROM a WHERE cov > 0),
 f AS (SELECT px.*, coalesce(a.cov, 0) / 255 AS m, frame.*, abs(px.x - cx) AS ax, abs(px.y - cy) AS ay FROM px LEFT JOIN a ON a.x = px.x AND a.y = px.y CROSS JOIN frame),
 z1 AS (SELECT *, CASE WHEN greatest(ax, ay) = 0 THEN 0 ELSE least(ax, ay) / greatest(ax, ay) END AS z FROM f), z2 AS (SELECT *, z * z AS zz FROM z1),
 z3 AS (SELECT *, CASE WHEN ay > ax THEN pi() / 2 - {sql._ATAN} ELSE {sql._ATAN} END AS q1 FROM z2), z4 AS (SELECT *, {sql.clamp(t)} AS t FROM z3), o AS (SELECT x, y, {', '.join(f'{e} AS {c}' for c, e in over.items())} FROM z4)"""
    return f"{_COV}, {steps} SELECT {_XY}, {_OUT.format(a='a', **{c: f'CASE WHEN a = 0 THEN 0 ELSE {c} / a END' for c in 'rgb'})} FROM o"


_EFFECT = "effect AS (SELECT x, y, cover * 0.8 * CAST(round(greatest(least(x + 1, 200.0::DOUBLE) - greatest(x, 10.5::DOUBLE), 0) * 255) AS BIGINT) / 255 AS k FROM (SELECT x, y, max(cover) AS cover FROM stamped GROUP BY ALL) WHERE x BETWEEN 0 AND 255 AND y BETWEEN 0 AND 255)"
_WET = "w AS (SELECT px.x AS x, px.y AS y, r, g, b, a, coalesce(k, 0) AS k FROM px LEFT JOIN effect ON effect.x = px.x AND effect.y = px.y)"
_MASKED = f"""base AS (SELECT *, {', '.join(f'p{c} * pa AS b{c}' for c in 'rgb')}, qa * 0.7 AS k, pa * (x / 15) AS weight FROM wide),
 o AS (SELECT *, {', '.join(f'k * (1 - pa) * q{c} + k * pa * (p{c} + q{c} - p{c} * q{c}) + (1 - k) * b{c} AS over_{c}' for c in 'rgb')}, k + pa * (1 - k) AS over_a FROM base),
 n AS (SELECT x, y, {', '.join(f'b{c} + (over_{c} - b{c}) * weight AS n{c}' for c in 'rgb')}, pa + (over_a - pa) * weight AS a FROM o), f AS (SELECT x, y, {', '.join(f'CASE WHEN a = 0 THEN 0 ELSE n{c} / a END AS {c}' for c in 'rgb')}, a FROM n)"""
_GROUPED = f"""inner_a AS (SELECT *, qa + pa * (1 - qa) AS ga FROM wide), grouped AS (SELECT *, {', '.join(f'CASE WHEN ga = 0 THEN 0 ELSE (qa * (1 - pa) * q{c} + qa * pa * (p{c} * q{c}) + (1 - qa) * p{c} * pa) / ga END AS g{c}' for c in 'rgb')} FROM inner_a)"""

# Every side of every ring is walked until it closes; the ring belongs to its first side that runs right.
_CONTOURS = f"""{_COV.replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM a WHERE cov >= 128),
 d AS (SELECT * FROM (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) t(dir, dx, dy, ax, ay, bx, b_y)),
 e AS (SELECT x + ax AS x0, y + ay AS y0, x + bx AS x1, y + b_y AS y1, dir FROM s, d WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.x = s.x + dx AND n.y = s.y + dy)), ids AS (SELECT *, row_number() OVER (ORDER BY dir > 0, y0, x0, dir) AS id FROM e),
 nx AS (SELECT p.id, arg_min(q.id, (q.dir - p.dir + 5) % 4) AS next FROM ids p JOIN ids q ON q.x0 = p.x1 AND q.y0 = p.y1 GROUP BY p.id),
 walk AS (SELECT id AS first, next AS here, 1 AS n FROM nx JOIN ids USING (id) WHERE dir = 0 UNION ALL SELECT first, nx.next, n + 1 FROM walk JOIN nx ON nx.id = walk.here WHERE walk.here > first),
 heads AS (SELECT first FROM walk GROUP BY first HAVING min(here) = first), places AS (SELECT first, here AS id, CASE WHEN here = first THEN 0 ELSE n END AS n FROM walk SEMI JOIN heads USING (first)),
 turns AS (SELECT first, n, x0, y0, dir, coalesce(lag(dir) OVER (PARTITION BY first ORDER BY n), last_value(dir) OVER (PARTITION BY first ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS came,
 sum(x0 * y1 - x1 * y0) OVER (PARTITION BY first) AS area FROM places JOIN ids USING (id))
 SELECT h.x0 AS ring_x, h.y0 AS ring_y, CAST(row_number() OVER (PARTITION BY t.first ORDER BY n) - 1 AS BIGINT) AS n, t.x0 AS x, t.y0 AS y, CAST(area > 0 AS INT) AS outer FROM turns t JOIN ids h ON h.id = t.first WHERE came <> t.dir"""
#: The same rings' points at every pixel's corner, walked one by one with the last one that stayed.
_SIMPLIFIED = f"""{_CONTOURS[: _CONTOURS.index(' turns AS')]} pts AS (SELECT first, n, x0 AS x, y0 AS y, coalesce(lead(x0) OVER o, first_value(x0) OVER o) AS ax, coalesce(lead(y0) OVER o, first_value(y0) OVER o) AS ay, sum(x0 * y1 - x1 * y0) OVER (PARTITION BY first) AS area FROM places JOIN ids USING (id) WINDOW o AS (PARTITION BY first ORDER BY n)),
 steps AS (SELECT first, n, x, y, true AS stays, x AS lx, y AS ly, area FROM pts WHERE n = 0 UNION ALL
 SELECT first, n, x, y, far > 0.6, CASE WHEN far > 0.6 THEN x ELSE lx END, CASE WHEN far > 0.6 THEN y ELSE ly END, area FROM (SELECT p.*, s.lx, s.ly, CASE WHEN p.ax = s.lx AND p.ay = s.ly THEN sqrt((p.x - s.lx) * (p.x - s.lx) + (p.y - s.ly) * (p.y - s.ly))
 ELSE abs((p.x - s.lx) * (p.ay - s.ly) - (p.y - s.ly) * (p.ax - s.lx)) / sqrt((p.ax - s.lx) * (p.ax - s.lx) + (p.ay - s.ly) * (p.ay - s.ly)) END AS far FROM steps s JOIN pts p ON p.first = s.first AND p.n = s.n + 1)),
 counted AS (SELECT *, count(*) FILTER (stays) OVER (PARTITION BY first) < 3 AS few FROM steps)
SELECT h.x0 AS ring_x, h.y0 AS ring_y, CAST(row_number() OVER (PARTITION BY t.first ORDER BY n) - 1 AS BIGINT) AS n, t.x, t.y, CAST(area > 0 AS INT) AS outer FROM counted t JOIN ids h ON h.id = t.first WHERE stays OR few"""
_SAMPLED = f"""WITH {_ORDERED}, {_SEG}, d AS (SELECT stroke, n, px + (x - px) * t AS x, py + (y - py) * t AS y FROM dab),
 c AS (SELECT *, 5 - ((gx + 0.5 - x) / 1.4 + 2.5) - 0.5 AS u, (gy + 0.5 - y) / 1.12 + 2 - 0.5 AS v FROM (SELECT *, unnest(range(CAST(floor(x) - 6 AS BIGINT), CAST(floor(x) + 7 AS BIGINT))) AS gx FROM d) CROSS JOIN range(-6, 7) k(dy) CROSS JOIN LATERAL (SELECT CAST(floor(y) AS BIGINT) + k.dy AS gy)),
 q AS (SELECT stroke, n, gx, gy, sum(greatest(1 - abs(u - tx), 0) * greatest(1 - abs(v - ty), 0) * ((tx * 50 + ty * 20) % 256)) / 255 AS k FROM c CROSS JOIN range(5) a(tx) CROSS JOIN range(4) b(ty) GROUP BY ALL)
 SELECT stroke, gx AS x, gy AS y, round(1 - exp(sum(ln(1 - 0.6 * least(k, 1)))), 4) + 0.0 AS cover FROM q GROUP BY ALL HAVING round(1 - exp(sum(ln(1 - 0.6 * least(k, 1)))), 4) > 0.0001"""

ORACLE_SQL |= {
    "crop": f"WITH {sql.PX} SELECT CAST(x - 3 AS BIGINT) AS x, CAST(y - 20 AS BIGINT) AS y, {_SELF} FROM px WHERE x BETWEEN 3 AND 11 AND y BETWEEN 20 AND 219",
    **{f"orient_{k}": f"WITH {sql.PX}, {sql.SIZE} SELECT CAST({i} AS BIGINT) AS x, CAST({j} AS BIGINT) AS y, {_SELF} FROM px CROSS JOIN size" for k, (i, j) in _PLACES.items()},
    "tile_enumeration": "WITH t AS (SELECT unnest(range(l_suppkey // 16, (l_suppkey + l_linenumber - 1) // 16 + 1)) AS ty, l_partkey // 16 AS a, (l_partkey + CAST(l_quantity AS BIGINT) - 1) // 16 AS b FROM lineitem WHERE l_quantity >= 1) SELECT tx, ty, count(*) AS n FROM (SELECT ty, unnest(range(a, b + 1)) AS tx FROM t) GROUP BY tx, ty",
    "selection_from_channel": f"WITH {sql.PX} SELECT {_XY}, {_BYTE.format('b')} AS cov FROM px",
    "clone_stamp": f"{_COV} SELECT CAST(p.x AS BIGINT) AS x, CAST(p.y AS BIGINT) AS y, {_OUT.format(**{c: f'p.{c} + (coalesce(s.{c}, 0) - p.{c}) * (coalesce(a.cov, 0) / 255)' for c in 'rgba'})} FROM px p LEFT JOIN a ON a.x = p.x AND a.y = p.y LEFT JOIN px s ON s.x = p.x + 2 AND s.y = p.y - 3",
    **{f"fill_{kind}": _fill_sql(kind) for kind in ("linear", "radial", "angular", "reflected", "diamond", "noise", "solid")},
    "straighten_crop": f"WITH turned AS ({sql.gathered(sql.bilinear(f'(x - 7) * {_cos(-7)} + (y - 89.5) * {_sin(-7)} + 7', f'(y - 89.5) * {_cos(-7)} - (x - 7) * {_sin(-7)} + 89.5'), False)}) SELECT CAST(x - 2 AS BIGINT) AS x, CAST(y - 30 AS BIGINT) AS y, r, g, b, a FROM turned WHERE x BETWEEN 2 AND 12 AND y BETWEEN 30 AND 149",
    "roi_box": f"SELECT * FROM ({sql.KERNEL_SQL['conv.box']}) WHERE x BETWEEN 2 AND 10 AND y BETWEEN 20 AND 139", "roi_gaussian_v": f"SELECT * FROM ({sql.KERNEL_SQL['conv.gaussian_v']}) WHERE y BETWEEN 30 AND 119",
    "stroke_sampled_tip": _SAMPLED, "contours": _CONTOURS, "contours_simplified": _SIMPLIFIED,
    "curve_masked": f"""{_COV}, {_HERMITE}, p AS (SELECT px.x, px.y, {', '.join(f'{_BYTE.format("px." + c)} AS {c}' for c in 'rgba')}, coalesce(a.cov, 0) AS m FROM px LEFT JOIN a ON a.x = px.x AND a.y = px.y)
 SELECT {_XY}, {', '.join(f'CAST(({c} * (255 - m) + lut[{c} + 1] * m + 127) // 255 AS BIGINT) AS {c}' for c in 'rgb')}, a FROM p CROSS JOIN curve""",
    "cmyk_device": f"WITH {sql.PX} SELECT {_XY}, {', '.join(f'CAST(floor((1 - {_BYTE.format(i)} / 255) * (1 - {_BYTE.format("a")} / 255) * 255 + 0.5) AS BIGINT) AS {c}' for i, c in zip('rgb', 'rgb', strict=True))}, CAST(255 AS BIGINT) AS a FROM px",
    "window_opaque": f"WITH {sql.PX} SELECT count(*) = 240 AND coalesce(bool_and({_BYTE.format('a')} = 255), true) AS opaque FROM px WHERE x BETWEEN 2 AND 7 AND y BETWEEN 5 AND 44",
    "content_hash": f"""WITH {sql.PX}, w AS (SELECT x, y, ((({_BYTE.format('r')} * 256 + {_BYTE.format('g')}) * 256 + {_BYTE.format('b')}) * 256 + {_BYTE.format('a')}) % 2147483647 AS word FROM px),
 m AS (SELECT ((CAST(x AS BIGINT) * 73856093 + y * 19349663) % 2147483647 * 31 + word) % 2147483647 * 48271 % 2147483647 AS v FROM w) SELECT count(*) AS n, CAST(sum(v * v % 2147483647) AS BIGINT) AS digest FROM m""",
    "mask_window": sql.final("p", *(f"{c} + (1 - {c} - {c}) * m" for c in "rgba"), f"c AS (SELECT x, y, {_BYTE.format('r')} AS cov FROM px WHERE r > 0.5)", "p AS (SELECT px.*, coalesce(c.cov, 0) / 255 AS m FROM px LEFT JOIN c ON c.x = px.x AND c.y = px.y)"),
    "adjust_blur": sql.grouped(_product(1.0, 4), "sum(k * q@)"), "adjust_sharpen": sql.grouped(_product(1.5, 5), "t.@ + 0.8 * (t.@ - sum(k * q@))"),
    "adjust_curve": sql.final("c", *(f"(lut[CAST(floor({c}) AS INTEGER) + 1] + (lut[CAST(least(floor({c}) + 1, 255) AS INTEGER) + 1] - lut[CAST(floor({c}) AS INTEGER) + 1]) * ({c} - floor({c}))) / 255.0 * a" for c in "rgb"), "a", sql.STRAIGHT, _HERMITE, f"c AS (SELECT x, y, a, {', '.join(f'{sql.clamp(c)} * 255 AS {c}' for c in 'rgb')}, lut FROM u CROSS JOIN curve)"),
    "layer_masked": sql.final("f", *"rgba", _TWO, _MASKED), "layer_group": sql.final("folded", *"rgba", _TWO, _GROUPED, _fold(("q", 1, "{s}"), ("g", 0.6, "{s}")).replace("FROM wide", "FROM grouped")),
    "stroke_cover": f"WITH {_COVER}, {_EFFECT} SELECT {_XY}, round(k, 4) + 0.0 AS cover FROM effect WHERE round(k, 4) > 0.0001",
    "stroke_paint": sql.final("w", *(f"CASE WHEN k + a * (1 - k) = 0 THEN 0 ELSE ({v} * k + {c} * a * (1 - k)) / (k + a * (1 - k)) END" for c, v in zip("rgb", (0.9, 0.2, 0.1), strict=True)), "k + a * (1 - k)", _COVER, _EFFECT, _WET),
    "stroke_erase": sql.final("w", "r", "g", "b", "a * (1 - k)", _COVER, _EFFECT, _WET),
    "outline_edges": f"{_COV}, s AS (SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y FROM a WHERE cov >= 128), d AS (SELECT * FROM (VALUES (0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)) t(dx, dy, ax, ay, bx, b_y)) SELECT x + ax AS x0, y + ay AS y0, x + bx AS x1, y + b_y AS y1 FROM s, d WHERE NOT EXISTS (SELECT 1 FROM s n WHERE n.x = s.x + dx AND n.y = s.y + dy)",
}
