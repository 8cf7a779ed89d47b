"""Chains of kernels that are kept up to date: an edit of some tiles is followed through the chain, and only the tiles that it reaches are evaluated.

Below ``path`` each result of the chain (0 is the source, k the result of step k) is an append-only table of pixels, partitioned by
generation, the image's columns and blocks of tiles, and an index of the tiles that each generation wrote. A tile is as its newest
generation has it, so an edit writes what it changed and nothing else, and every generation stays readable. Damage goes forward: a kernel
that reads ``reach`` pixels around a place damages every tile within that reach of a damaged one. A step evaluates its damaged tiles from
these and the tiles that hold their rims, of the result before it; blocks without any of them are not read. Kernels whose reads
don't stay near (resampling, turns, warps, the gallery) damage every tile.

Edits are whole pixels (the image's columns, x, y, r, g, b, a); of places that the raster does not have they are left out, of several at a place
the greatest values count; an edit of nothing changes nothing. A generation that failed half way is written anew by the next attempt.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import gridspark.operators.gallery
import gridspark.operators.generators
import gridspark.operators.point
import gridspark.operators.spatial  # noqa: F401
from gridspark.functions.pixel import CHANNELS
from gridspark.plans.registry import KERNELS, apply
from gridspark.plans.roi import Region, required
from gridspark.plans.stencil import image

#: Tiles along a side of a block, which is about one file, and blocks that a scan is given by name.
BLOCK, MOST_LISTED = 8, 4096


class Step(NamedTuple):
    kernel: str
    params: dict = {}

    def reach(self) -> tuple[int, int] | None:
        """How far the kernel reads along x and y; None if that is not bounded."""
        one = required(self.kernel, Region(0, 0, 1, 1), **self.params)
        return None if one is None else (-one.x0, -one.y0)


def tile_of(v: Column, size: int) -> Column:
    return F.floor(v / size).cast("int")


def widened(tiles: DataFrame, reach: tuple[int, int], size: int) -> DataFrame:
    """The tiles (image, tx, ty) that hold a place within ``reach`` of one of ``tiles``."""
    out = tiles
    for t, r in (("tx", reach[0]), ("ty", reach[1])):
        steps = -(-r // size)  # a rim of so many tiles
        if steps:
            out = out.withColumn(t, F.explode(F.sequence(F.col(t) - steps, F.col(t) + steps)))
    return out.distinct()


class Chain:
    """The results of ``steps`` over a raster as of a generation; an edit gives the next one."""

    def __init__(self, spark: SparkSession, path: str, steps: list[Step], keys: list[str], size: int = 256, generation: int = 0):
        self.spark, self.path, self.steps, self.keys, self.size, self.generation = spark, path.rstrip("/"), list(steps), keys, size, generation
        self.tile, self.place = [*keys, "ty", "tx"], [*keys, "x", "y"]

    @classmethod
    def over(cls, raster: DataFrame, steps: list[Step], path: str, size: int = 256) -> Chain:
        """Evaluates the whole chain once, as generation 0."""
        for s in steps:
            if KERNELS[s.kernel].inputs != 1 or s.kernel.startswith("gen."):
                raise ValueError(f"{s.kernel} has not one input")
        chain = cls(raster.sparkSession, path, steps, image(raster), size)
        chain._append(0, raster)
        for k, s in enumerate(chain.steps):
            chain._append(k + 1, apply(chain.result(k), s.kernel, **s.params))
        return chain

    def _tiled(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.place, *(F.col(c).cast("double").alias(c) for c in CHANNELS)).withColumns({"tx": tile_of(F.col("x"), self.size), "ty": tile_of(F.col("y"), self.size)})

    def _append(self, k: int, rows: DataFrame) -> None:
        """Some tiles of result k, and what they are, as this generation's; a block's tiles stand in order in its files."""
        at_gen = f"gen={self.generation}"
        blocks = self._tiled(rows).withColumns({"bx": F.floor(F.col("tx") / BLOCK).cast("int"), "by": F.floor(F.col("ty") / BLOCK).cast("int")})
        blocks = blocks.repartition(*self.keys, "by", "bx").sortWithinPartitions(*self.keys, "by", "bx", "ty", "tx")
        blocks.write.mode("overwrite").partitionBy(*self.keys, "by", "bx").parquet(f"{self.path}/step{k}/{at_gen}")
        written = self._pixels(k).where(F.col("gen") == self.generation).select(*self.tile).distinct()
        written.write.mode("overwrite").parquet(f"{self.path}/index{k}/{at_gen}")

    def _pixels(self, k: int) -> DataFrame:
        own = ", ".join(f"`{c}` bigint" for c in self.keys)
        schema = f"x bigint, y bigint, {', '.join(f'{c} double' for c in CHANNELS)}, tx int, ty int, gen int, {own + ', ' if own else ''}by int, bx int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/step{k}").where(F.col("gen") <= self.generation)

    def _newest(self, k: int) -> DataFrame:
        """gen of each tile of result k: one row for a tile, however large."""
        schema = ", ".join([*(f"`{c}` bigint" for c in self.keys), "ty int", "tx int", "gen int"])
        return self.spark.read.schema(schema).parquet(f"{self.path}/index{k}").where(F.col("gen") <= self.generation).groupBy(*self.tile).agg(F.max("gen").alias("gen"))

    def result(self, k: int = -1) -> DataFrame:
        """The image's columns, x, y, r, g, b, a after step k (from 1; 0 is the source)."""
        k = k % (len(self.steps) + 1)
        return self._pixels(k).join(self._newest(k), [*self.tile, "gen"], "left_semi").select(*self.place, *CHANNELS)

    def tiles(self, k: int, wanted: DataFrame) -> DataFrame:
        """The pixels of some tiles of result k. The scan is cut to their blocks where these are few enough to be listed."""
        block = lambda t: F.floor(F.col(t) / BLOCK).cast("int")
        name = lambda by, bx: F.concat_ws("/", *(F.col(c).cast("string") for c in self.keys), by.cast("string"), bx.cast("string"))
        listed = wanted.select(name(block("ty"), block("tx")).alias("name")).distinct().limit(MOST_LISTED + 1).collect()  # bounded
        rows = self._pixels(k)
        if len(listed) <= MOST_LISTED:
            rows = rows.where(name(F.col("by"), F.col("bx")).isin([r.name for r in listed]))
        newest = self._newest(k).join(wanted, self.tile, "left_semi")
        return rows.join(newest, [*self.tile, "gen"], "left_semi").select(*self.place, *CHANNELS)

    def damage(self, edits: DataFrame) -> list[DataFrame | None]:
        """The tiles that change in the source and after each step; None: all."""
        out: list[DataFrame | None] = [self._tiled(edits).select(*self.tile).distinct()]
        for s in self.steps:
            reach = s.reach()
            out.append(None if reach is None or out[-1] is None else widened(out[-1], reach, self.size))
        return out

    def evaluated(self, k: int, wanted: DataFrame) -> DataFrame:
        """Some tiles of the result of step k, from the result before it; what the cut at the outer edge of the rims changes stays in the rims."""
        s = self.steps[k - 1]
        rows = self.tiles(k - 1, widened(wanted, s.reach(), self.size))
        return self._tiled(apply(rows, s.kernel, **s.params)).join(wanted, self.tile, "left_semi").select(*self.place, *CHANNELS)

    def edited(self, edits: DataFrame) -> Chain:
        """The next generation."""
        new = Chain(self.spark, self.path, self.steps, self.keys, self.size, self.generation + 1)
        changed = edits.groupBy(*self.place).agg(*(F.max(F.col(c).cast("double")).alias(f"n_{c}") for c in CHANNELS))
        damage = self.damage(edits)
        source = self.tiles(0, damage[0]).join(changed, self.place, "left")
        new._append(0, source.select(*self.place, *(F.coalesce(f"n_{c}", c).alias(c) for c in CHANNELS)))
        for k, s in enumerate(self.steps, 1):
            whole = damage[k] is None
            new._append(k, apply(new.result(k - 1), s.kernel, **s.params) if whole else new.evaluated(k, damage[k]))
        return new
