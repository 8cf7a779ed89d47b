"""Queries over rasters of many images at once, nothing of which crosses images, and their DuckDB SQL: every line number of the order lines is an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.pixel import CHANNELS, rounded
from gridspark.operators import reduce, regions, selection
from gridspark.plans import layers, versions
from gridspark.sources.rasters import px_line


def px_album(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, x, y and the channels: the line numbers' images, of different sizes; to nine decimals, so that halves of bytes don't hang on the order of a mean."""
    return px_line(spark, sf_dir).withColumnRenamed("z", "image_id").withColumns({c: F.round(c, 9) for c in "rgb"})


def _shown(df: DataFrame) -> DataFrame:
    return df.select("image_id", "x", "y", *(rounded(F.col(c)).alias(c) for c in CHANNELS))


def _covers(spark, sf_dir):
    px = px_album(spark, sf_dir)
    return selection.from_channel(px.where("r > 0.5"), "r"), selection.from_channel(px.where("b > 0.4"), "b")


def images_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's histogram."""
    return reduce.histogram(px_album(spark, sf_dir))


def images_enhance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image's levels and white balance."""
    return reduce.auto_enhance(px_album(spark, sf_dir)).select("image_id", *(rounded(F.col(c)).alias(c) for c in ("in_black", "in_white", "temp", "tint")))


def images_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of what both selections leave in each image."""
    return reduce.bounds(selection.combine(*_covers(spark, sf_dir), "subtract"))


def images_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One selection without the other, in each image."""
    return selection.combine(*_covers(spark, sf_dir), "subtract")


def images_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image under its own copy, moved by a pixel and multiplied."""
    px = px_album(spark, sf_dir)
    both = px.withColumn("z", F.lit(0)).unionByName(px.withColumns({"z": F.lit(1), "x": F.col("x") + 1}))
    return _shown(layers.LayerStack(both, [layers.Layer(0), layers.Layer(1, "multiply", 0.5)]).composite())


def images_clone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection of each image replaced by what is three columns further."""
    return _shown(regions.clone(px_album(spark, sf_dir), _covers(spark, sf_dir)[0], 3, 0))


def images_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of every image: some edited in some of the images, the edit taken back, one made first by the edit gone again."""
    px = versions.tiles(px_album(spark, sf_dir), 32).withColumns({"generation": F.lit(1).cast("bigint"), "hole": F.lit(False)})
    edited = px.where("image_id % 2 = 1 AND tx % 3 = 0").drop("generation", "hole").withColumn("r", 1 - F.col("r"))
    return _shown(versions.latest(versions.restore(versions.edit(px.where("tx > 0 OR image_id <> 1"), edited, 2), 1, 3)))


QUERIES = {f.__name__: f for f in (images_histogram, images_enhance, images_bounds, images_subtract, images_overlap, images_clone, images_undo)}

# -- the same in DuckDB ------------------------------------------------------------------------------

_PX = """WITH px AS (SELECT CAST(l_linenumber AS BIGINT) AS image_id, l_orderkey % 256 AS x, l_orderkey // 256 AS y, round(avg(l_quantity) / 50, 9) AS r, round(avg(l_discount) * 10, 9) AS g, round(avg(l_tax) * 12.5, 9) AS b, 1.0::DOUBLE AS a FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_BYTE = "CAST(least(greatest(round({} * 255), 0), 255) AS BIGINT)"
_BYTES = {c: _BYTE.format(c) for c in CHANNELS}
_LUMA = f"least(({_BYTES['r']} * 299 + {_BYTES['g']} * 587 + {_BYTES['b']} * 114 + 500) // 1000, 255)"
_COVERS = f"{_PX}, p AS (SELECT image_id, x, y, {_BYTES['r']} AS cov FROM px WHERE r > 0.5), q AS (SELECT image_id, x, y, {_BYTES['b']} AS cov FROM px WHERE b > 0.4)"
_LEFT = "SELECT image_id, x, y, CAST((coalesce(p.cov, 0) * (255 - coalesce(q.cov, 0)) + 127) // 255 AS BIGINT) AS cov FROM p FULL JOIN q USING (image_id, x, y)"
_OUT = lambda **e: "image_id, x, y, " + ", ".join(f"round(({e[c]})::DOUBLE, 6) + 0.0 AS {c}" for c in CHANNELS)

ORACLE_SQL = {
    "images_histogram": f"{_PX} SELECT image_id, channel, bin, count(*) AS n FROM (SELECT image_id, unnest(['r', 'g', 'b', 'a']) AS channel, unnest([{', '.join(_BYTES.values())}]) AS bin FROM px) GROUP BY ALL",
    "images_enhance": f"""{_PX}, byte AS (SELECT image_id, {', '.join(f'{v} AS {c}' for c, v in _BYTES.items())}, {_LUMA} AS l FROM px),
 run AS (SELECT image_id, l, count(*) OVER (PARTITION BY image_id ORDER BY l) AS s, count(*) OVER (PARTITION BY image_id) AS t FROM byte),
 ends AS (SELECT image_id, min(l) FILTER (s >= greatest(1, ceil(t * 0.005))) AS lo, min(l) FILTER (s >= greatest(1, ceil(t * 0.995))) AS hi FROM run GROUP BY image_id),
 mean AS (SELECT image_id, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM byte GROUP BY image_id), e AS (SELECT *, hi > lo AND least(mr, mg, mb) > 1 AS fine, (mr + mg + mb) / 3 AS m FROM ends JOIN mean USING (image_id))
 SELECT image_id, CASE WHEN fine THEN round(lo / 255.0::DOUBLE, 6) ELSE 0 END + 0.0 AS in_black, CASE WHEN fine THEN round(hi / 255.0::DOUBLE, 6) ELSE 1 END + 0.0 AS in_white, CASE WHEN fine THEN round((m / mr - m / mb) / 2, 6) ELSE 0 END + 0.0 AS temp, CASE WHEN fine THEN round(m / mg - 1, 6) ELSE 0 END + 0.0 AS tint FROM e""",
    "images_bounds": f"{_COVERS}, held AS ({_LEFT}) SELECT image_id, min(x) FILTER (cov > 0) AS x0, min(y) FILTER (cov > 0) AS y0, max(x) FILTER (cov > 0) AS x1, max(y) FILTER (cov > 0) AS y1 FROM held GROUP BY image_id",
    "images_subtract": f"{_COVERS} {_LEFT}",
    "images_overlap": f"{_PX}, two AS (SELECT image_id, x, y, {', '.join(f'coalesce(p.{c}, 0) AS p{c}, coalesce(q.{c}, 0) AS q{c}' for c in CHANNELS)} FROM px p FULL JOIN (SELECT * REPLACE (x + 1 AS x) FROM px) q USING (image_id, x, y)), over_ AS (SELECT *, 0.5 * qa + pa * (1 - 0.5 * qa) AS alpha FROM two) SELECT "
    + _OUT(**{c: f"CASE WHEN alpha = 0 THEN 0 ELSE (0.5 * qa * (1 - pa) * q{c} + 0.5 * qa * pa * p{c} * q{c} + (1 - 0.5 * qa) * pa * p{c}) / alpha END" for c in "rgb"}, a="alpha") + " FROM over_",
    "images_clone": f"{_COVERS}, both_ AS (SELECT image_id, x, y, {', '.join(f'px.{c}, coalesce(s.{c}, 0) AS s{c}' for c in CHANNELS)}, coalesce(cov, 0) / 255.0::DOUBLE AS m FROM px LEFT JOIN p USING (image_id, x, y) LEFT JOIN (SELECT * REPLACE (x - 3 AS x) FROM px) s USING (image_id, x, y)) SELECT " + _OUT(**{c: f"{c} + (s{c} - {c}) * m" for c in CHANNELS}) + " FROM both_",
    "images_undo": f"{_PX} SELECT {_OUT(**{c: c for c in CHANNELS})} FROM px WHERE x >= 32 OR image_id <> 1",
}
