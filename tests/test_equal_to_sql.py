"""Values that doubles decide: results at thresholds and halves equal SQL's to the last decimal."""

import math
import random
from decimal import Decimal, localcontext

import duckdb
from pyspark.sql import functions as F

from gridspark.functions.pixel import rounded
from gridspark.operators.generators import _lattice
from gridspark.oracle import KERNEL_SQL
from gridspark.queries import kernel_query


def test_halves_are_rounded_as_by_sql(spark):
    rng = random.Random(3)
    values = [0.43448749999999996, 0.4344875, -0.4344875, 0.8109375, 2.5e-6, -0.0, 0.0] + [rng.randint(-(10**7), 10**7) / 10**7 * (1 + rng.randint(-2, 2) * 2.0**-53) for _ in range(3000)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(rounded(F.col("v"))).collect()]
    want = [duckdb.execute("SELECT round(?::DOUBLE, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert got == want and not any(math.copysign(1, v) < 0 for v in got if v == 0)


def test_a_pattern_equals_its_sql_far_down_and_where_alpha_is_none(spark, tmp_path):
    rng = random.Random(4)
    rows = [(y, [rng.uniform(-0.9, 0.9) for _ in range(64)]) for y in [*range(40), *(10**6 + 7 * k for k in range(400))]]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = sorted(map(tuple, kernel_query(spark, str(tmp_path), "gen.pattern").select("x", "y", *"rgba").collect()))
    assert got == sorted(db.execute(f"SELECT x, y, r, g, b, a FROM ({KERNEL_SQL['gen.pattern']})").fetchall())


def test_a_patterns_lattice_is_rounded_once(spark):
    """Weights far down the raster against exact numbers."""
    c, s = math.cos(math.radians(25)), math.sin(math.radians(25))
    places = [(x, 10**6 + 977 * k) for k in range(300) for x in (0, 7)]
    got = [r[0] for r in spark.createDataFrame(places, "x bigint, y bigint").select(_lattice(c, s, 1.25, -2.5, 0, 0)).collect()]
    with localcontext(prec=60):
        want = [float((Decimal(x) + Decimal("-0.75")) * Decimal(repr(c)) + (Decimal(y) + 3) * Decimal(repr(s))) for x, y in places]
    assert got == want
