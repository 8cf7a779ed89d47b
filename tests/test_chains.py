"""Chains after edits against the whole chain from scratch, and what an edit reads."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridspark.plans import chains
from gridspark.plans.chains import Chain, Step
from gridspark.plans.registry import apply

SCHEMA = "image_id bigint, x bigint, y bigint, r double, g double, b double, a double"
KERNELS = [Step("math.linear", {"gain": 1.5, "bias": -0.1}), Step("math.invert"), Step("conv.box"), Step("morph.dilate"), Step("conv.gaussian_h", {"sigma": 2.0, "radius": 5}), Step("rank.median3"), Step("geom.flip_h"), Step("adjust.exposure", {"ev": 0.3}), Step("conv.bilateral", {"radius_px": 3.0})]


def raster(spark, rng, w, h, images=2):
    return spark.createDataFrame([(i, x, y, *(rng.random() for _ in range(4))) for i in range(images) for x in range(w) for y in range(h)], SCHEMA)


def values(df):
    return {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys() and a
    assert all(v == pytest.approx(b[k], abs=1e-12) for k, v in a.items())


@pytest.mark.parametrize("seed", range(3))
def test_incremental_equals_from_scratch(spark, tmp_path, seed, monkeypatch):
    """Random chains and edits over two images; after each edit every step's result is what the whole chain gives, and older generations stay."""
    monkeypatch.setattr(chains, "BLOCK", 2)
    rng = random.Random(seed)
    steps = rng.sample(KERNELS, 3)
    chain = Chain.over(raster(spark, rng, 23, 17), steps, str(tmp_path), size=4)
    source = values(chain.result(0))
    past = []
    for _ in range(2):
        edits = [(rng.randrange(2), rng.randrange(25), rng.randrange(17), *(rng.random() for _ in range(4))) for _ in range(rng.randint(1, 4))]
        past.append((chain, values(chain.result())))
        chain = chain.edited(spark.createDataFrame(edits, SCHEMA))
        best = {}
        for i, x, y, *v in edits:
            best[i, x, y] = tuple(map(max, best.get((i, x, y), v), v))
        source |= {k: v for k, v in best.items() if k in source}
        rows = spark.createDataFrame([(*k, *v) for k, v in source.items()], SCHEMA)
        same(values(chain.result(0)), source)
        for k, s in enumerate(steps, 1):
            rows = apply(rows, s.kernel, **s.params)
            same(values(chain.result(k)), values(rows))
    for old, before in past:
        same(values(old.result()), before)


def test_an_edit_reads_its_own_blocks_only(spark, tmp_path, monkeypatch):
    """Files of all other blocks are unreadable: an edit goes through, and writes the tiles within its reach."""
    monkeypatch.setattr(chains, "BLOCK", 2)
    steps = [Step("conv.box"), Step("math.invert"), Step("conv.box")]
    chain = Chain.over(raster(spark, random.Random(1), 64, 48), steps, str(tmp_path), size=4)
    edit = spark.createDataFrame([(1, 33, 21, 0.0, 0.0, 0.0, 0.0)], SCHEMA)
    whole = values(chain.edited(edit).result())
    broken = 0
    for f in Path(tmp_path).glob("step*/gen=0/image_id=*/by=*/bx=*/*.parquet"):
        part = dict(p.split("=") for p in f.parts if "=" in p)
        # the last step's tiles are 6..10 along x and 3..7 along y; with their rims they lie in blocks 2..5 and 1..4
        if part["image_id"] != "1" or int(part["by"]) not in range(1, 5) or int(part["bx"]) not in range(2, 6):
            f.write_bytes(b"not a table")
            broken += 1
    assert broken > 200
    again = chain.edited(edit)  # the same generation, written anew
    wanted = again.damage(edit)[-1]
    got = values(again.tiles(3, wanted))
    assert len(got) == 25 * 16 and all(whole[k] == pytest.approx(v) for k, v in got.items())
    # a reach of one pixel from tile to tile, twice
    assert [d.count() for d in again.damage(edit)] == [1, 9, 9, 25]
    assert spark.read.parquet(f"{tmp_path}/index3/gen=1").count() == 25
    with pytest.raises(Exception, match="not a Parquet|CANNOT_READ_FILE|FAILED_READ"):
        chain.result().agg(F.sum("r")).collect()


def test_edits_of_nothing_and_kernels_that_cannot_be(spark, tmp_path):
    chain = Chain.over(raster(spark, random.Random(2), 6, 5), [Step("conv.box")], str(tmp_path), size=4)
    before = values(chain.result())
    same(values(chain.edited(spark.createDataFrame([], SCHEMA)).result()), before)
    for k in ("math.add", "gen.solid"):
        with pytest.raises(ValueError):
            Chain.over(chain.result(0), [Step(k)], str(tmp_path / k))
