"""Layer stacks as rows against a walk over each stack in plain Python."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import editing
from gridspark.functions import arrays
from gridspark.functions.pixel import CHANNELS, Px, num, straight
from gridspark.operators import point
from gridspark.plans import stacks
from gridspark.plans.layers import Layer, LayerStack

BLENDS = {"normal": lambda b, s: s, "multiply": lambda b, s: b * s, "screen": lambda b, s: b + s - b * s, "darken": min, "difference": lambda b, s: abs(b - s), "no such blend": lambda b, s: s}


def over(b, s, blend, opacity):
    """Premultiplied pixels."""
    straight = lambda p: [v / p[3] if p[3] else 0.0 for v in p[:3]]
    k = s[3] * opacity
    return [*(k * (1 - b[3]) * cs + k * b[3] * BLENDS[blend](cb, cs) + (1 - k) * b[3] * cb for cb, cs in zip(straight(b), straight(s))), k + b[3] * (1 - k)]


def graded(p, name, amounts):
    if name == "exposure":
        return [*(v * 2 ** amounts[0] for v in p[:3]), p[3]]
    if name == "invert_rgb":
        return [*(p[3] - v for v in p[:3]), p[3]]
    return p


def plain(layers, groups, pixels, masks):
    """One image: {place: straight pixel}. Closes and opens groups as it walks, and keeps the parked accumulators in a list."""
    groups = {g["grp"]: g for g in groups}

    def chain(g):
        out = []
        while g is not None:
            if g not in groups or g in out:
                return None
            out.insert(0, g)
            g = groups[g]["parent"]
        return out

    result = {}
    for place in {p for p, _ in pixels}:
        accs, opened, base, drawn = [[0.0] * 4], [], None, False

        def close():
            inner = accs.pop()
            g = groups[opened.pop()]
            accs[-1] = over(accs[-1], inner, g["blend"], g["opacity"])

        for v in sorted(layers, key=lambda v: (v["position"], v["z"])):
            want = chain(v["grp"])
            if not v["visible"] or v["opacity"] <= 0 or want is None or any(not groups[g]["visible"] or groups[g]["opacity"] <= 0 for g in want):
                continue
            while opened and opened[-1] not in want:
                close()
                base = None
            for g in want:
                if g not in opened and (not groups[g]["pass_through"] or groups[g]["opacity"] < 1):
                    accs.append([0.0] * 4)
                    opened.append(g)
                    base = None
            p = pixels.get((place, v["z"]), (0.0, 0.0, 0.0, 0.0))
            if v["clipped"]:
                if base is None:
                    continue
            elif v["adjust"] is None:
                base = p[3]
            weight = masks.get((place, v["z"]), 1.0) * (base if v["clipped"] else 1.0)
            below = accs[-1]
            if v["adjust"] is None:
                drawn |= (place, v["z"]) in pixels
                new = over(below, [*(c * p[3] for c in p[:3]), p[3]], v["blend"], v["opacity"])
            else:
                new = [b + (q - b) * v["opacity"] for b, q in zip(below, graded(below, v["adjust"], v["amounts"]))]
            accs[-1] = [b + (q - b) * weight for b, q in zip(below, new)]
        while opened:
            close()
        r = accs[0]
        if drawn:
            result[place] = [*(c / r[3] if r[3] else 0.0 for c in r[:3]), r[3]]
    return result


def tree(rng, n):
    """Nested groups over the layers 0..n-1 in one piece each; the group of each layer."""
    groups, of = [], [None] * n

    def split(lo, hi, parent, depth):
        at = lo
        while at < hi:
            end = rng.randint(at + 1, hi)
            if depth and rng.random() < 0.6:
                g = len(groups) + 1
                groups.append({"grp": g, "parent": parent, "blend": rng.choice(list(BLENDS)), "opacity": rng.choice([1.0, 1.0, 0.5, 0.0]) if rng.random() < 0.7 else 1.0, "visible": rng.random() > 0.1, "pass_through": rng.random() < 0.5})
                split(at, end, g, depth - 1)
            else:
                of[at:end] = [parent] * (end - at)
            at = end

    split(0, n, None, 3)
    return groups, of


def test_stacks_equal_the_walk(spark):
    rng, layers, groups, pixels, masks, want = random.Random(5), [], [], [], [], {}
    for image in range(40):
        n = rng.randint(1, 8)
        own_groups, of = tree(rng, n)
        if image % 9 == 0:  # its own ancestor, and one that is not there
            own_groups += [{"grp": 90, "parent": 91, "blend": "normal", "opacity": 1.0, "visible": True, "pass_through": False}, {"grp": 91, "parent": 90, "blend": "normal", "opacity": 1.0, "visible": True, "pass_through": False}]
            of[-1] = rng.choice([90, 99])
        own_layers = [{"z": z, "position": z * 10, "blend": rng.choice(list(BLENDS)), "opacity": rng.choice([1.0, 0.4, 0.0, 0.9]), "visible": rng.random() > 0.1, "clipped": rng.random() < 0.4, "grp": of[z], "adjust": rng.choice([None, None, None, "exposure", "invert_rgb", "no such"]), "amounts": [0.5]} for z in range(n)]
        own_pixels = {((x, y), z): tuple(rng.random() for _ in range(3)) + (rng.choice([0.0, 1.0, rng.random()]),) for z in range(n) for x in range(2) for y in range(2) if rng.random() < 0.8}
        own_masks = {k: rng.random() for k in own_pixels if rng.random() < 0.3}
        want |= {(image, *p): v for p, v in plain(own_layers, own_groups, own_pixels, own_masks).items()}
        layers += [{"image_id": image, **v} for v in own_layers]
        groups += [{"image_id": image, **g} for g in own_groups]
        pixels += [(image, *p, z, *v) for (p, z), v in own_pixels.items()]
        masks += [(image, *p, z, v) for (p, z), v in own_masks.items()]
    got = stacks.composite(
        spark.createDataFrame(pixels, "image_id bigint, x bigint, y bigint, z bigint, r double, g double, b double, a double"),
        spark.createDataFrame(layers, f"image_id bigint, {stacks.LAYERS}"),
        spark.createDataFrame(groups, f"image_id bigint, {stacks.GROUPS}"),
        spark.createDataFrame(masks, "image_id bigint, x bigint, y bigint, z bigint, m double"),
    )
    mine = {(r.image_id, r.x, r.y): [r.r, r.g, r.b, r.a] for r in got.collect()}
    assert mine.keys() == want.keys() and len(want) > 60
    assert all(v == pytest.approx(want[k], abs=1e-9) for k, v in mine.items())


@pytest.mark.parametrize("blend", ["hue", "saturation", "color", "luminosity", "soft_light", "vivid_light"])
def test_a_stack_equals_the_one_in_the_plan(spark, blend):
    """One image without image_id, the other blends: the same as a stack that is known when the plan is built."""
    rng = random.Random(blend)
    pixels = spark.createDataFrame([(x, 0, z, *(rng.random() for _ in range(4))) for x in range(6) for z in range(3)], "x bigint, y bigint, z bigint, r double, g double, b double, a double")
    rows = [(0, 0, "normal", 1.0, True, False, None, None, None), (1, 1, blend, 0.7, True, False, None, None, None), (2, 2, blend, 1.0, True, True, None, None, None)]
    mine = stacks.composite(pixels, spark.createDataFrame(rows, stacks.LAYERS))
    assert mine.columns == ["x", "y", "r", "g", "b", "a"]
    want = LayerStack(pixels, [Layer(0), Layer(1, blend, 0.7), Layer(2, blend, clipped=True)]).composite()
    order = lambda df: sorted(map(tuple, df.select("x", "y", "r", "g", "b", "a").collect()))
    for a, b in zip(order(mine), order(want), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_nothing_in_use_gives_no_rows(spark):
    pixels = spark.createDataFrame([(0, 0, 0, 1.0, 1.0, 1.0, 1.0)], "x bigint, y bigint, z bigint, r double, g double, b double, a double")
    hidden = spark.createDataFrame([(0, 0, "normal", 1.0, False, False, None, None, None)], stacks.LAYERS)
    assert stacks.composite(pixels, hidden).count() == 0 and stacks.composite(pixels, hidden.where("false")).count() == 0
    unknown = hidden.withColumns({"visible": F.lit(True), "grp": F.lit(5).cast("bigint")})
    assert stacks.composite(pixels, unknown).count() == 0


def test_stacks_equal_their_sql_to_the_last_decimal(spark, tmp_path):
    """Orders with hard mixes, thresholds and groups: plates are taken straight, never multiplied by their alpha and divided again."""
    duckdb.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.1/lineitem.parquet' WHERE l_orderkey IN (63930, 134170, 136638, 139293) UNION ALL SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet' WHERE l_orderkey IN (130, 246, 507, 679, 1063, 1216, 2802, 4264, 11116, 12487, 14478)) TO '{tmp_path}/lineitem.parquet'")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    got = sorted(map(tuple, editing.layer_stacks(spark, str(tmp_path)).select("image_id", "x", "y", *"rgba").collect()))
    assert len(got) > 30 and got == sorted(db.execute(f"SELECT image_id, x, y, r, g, b, a FROM ({editing.ORACLE_SQL['layer_stacks']})").fetchall())


def _shuffled(spark, df) -> int:
    """Bytes that the shuffles of a run write."""
    context = spark.sparkContext
    jvm = context._gateway.jvm

    def written():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()) if stages.apply(i).stageId() >= since)

    since = context._jsc.sc().dagScheduler().nextStageId()
    df.write.format("noop").mode("overwrite").save()
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return written()


def test_programs_are_not_sent_out_for_parts_that_an_image_lacks(spark):
    """Disk: 16 copies of every order's program were most of what was shuffled, 7.2 MB for the 60,000 lines of sf0.01."""
    sf = "/root/testdata/sf0.01"
    assert _shuffled(spark, editing.layer_stacks(spark, sf)) < 60 * spark.read.parquet(f"{sf}/lineitem.parquet").count()
    pixels = spark.range(4000).select(F.col("id").alias("image_id"), *(F.lit(0).cast("bigint").alias(c) for c in "xyz"), *(F.lit(0.5).alias(c) for c in "rgba"))
    layers = spark.range(4000).select(F.col("id").alias("image_id"), *(F.expr(f"CAST({v} AS {t.split()[1]})").alias(t.split()[0]) for t, v in zip(stacks.LAYERS.split(", "), ("0", "0", "'multiply'", "0.5", "true", "false", "null", "null", "null"))))
    one = stacks.composite(pixels, layers)
    assert one.count() == 4000 and _shuffled(spark, one) < 4000 * 150


def test_a_large_image_meets_its_program_in_parts(spark):
    """Places over many tiles, a few here and there, and images of one place: the same as each place alone."""
    rng = random.Random(3)
    places = [(1, x, y) for x in range(0, 400, 9) for y in range(0, 400, 13)] + [(2, -70, 5), (3, 0, 0)]
    pixels = [(*p, z, *(rng.random() for _ in range(4))) for p in places for z in range(2)]
    layers = [(i, z, z, "screen", 0.8, True, False, None, None, None) for i in (1, 2, 3) for z in range(2)]
    columns = "image_id bigint, x bigint, y bigint, z bigint, r double, g double, b double, a double"
    got = stacks.composite(spark.createDataFrame(pixels, columns), spark.createDataFrame(layers, f"image_id bigint, {stacks.LAYERS}"))
    mine = {(r.image_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in got.collect()}
    assert mine.keys() == set(places) and got.count() == len(places)
    for i in range(0, len(pixels), 2):
        acc = [0.0] * 4
        for row in pixels[i : i + 2]:
            acc = over(acc, [*(c * row[7] for c in row[4:7]), row[7]], "screen", 0.8)
        assert mine[pixels[i][:3]] == pytest.approx([*(c / acc[3] for c in acc[:3]), acc[3]], abs=1e-9)


def test_blends_and_adjustments_of_arrays_equal_the_kernels(spark):
    """Each by each, with zeros, ones, halves, equal channels and clear pixels; and a null channel, that is NaN in arrays, is missing in both."""
    rng = random.Random(12)
    value = lambda: rng.choice([0.0, 1.0, 0.5, 0.25, rng.random(), rng.random(), rng.random()])
    rows = [(i, [value() for _ in range(3)], [value() for _ in range(3)], [*(value() for _ in range(3)), value()]) for i in range(150)]
    rows += [(150, [0.4, 0.4, 0.4], [0.4, 0.4, 0.4], [0.3, 0.3, 0.3, 0.0]), (151, [None, 0.2, 0.7], [0.6, None, 0.1], [None, 0.1, 0.2, 0.5])]
    df = spark.createDataFrame(rows, "i int, b array<double>, s array<double>, p array<double>")
    three = lambda c: tuple(F.col(c)[i] for i in range(3))
    p = Px(*(F.col("p")[i] for i in range(4)))
    graded = {"exposure": (-0.7,), "brightness_contrast": (0.1, 1.3), "saturation": (0.4,), "white_balance": (0.2, -0.1), "vibrance": (0.5, -0.2), "threshold": (0.45,), "invert_rgb": (), "levels": (0.1, 0.8, 1.7, 0.05, 0.9)}
    made = {n: getattr(point, n)(p, *map(num, a)) for n, a in graded.items() if n != "levels" and n != "exposure"}
    made["exposure"] = p.color(lambda c: c * F.pow(num(2), num(graded["exposure"][0])))
    made["levels"] = straight(p, lambda c: [point.level(x, *graded["levels"]) for x in c])
    assert point.BLENDS.keys() == arrays.BLENDS.keys() and made.keys() == arrays.ADJUSTMENTS.keys()
    blends = [F.array(*f(three("b"), three("s"))).alias(f"blend {n}") for n, f in point.BLENDS.items()]
    got = [r.asDict() for r in df.select("i", *blends[:13]).join(df.select("i", *blends[13:]), "i").join(df.select("i", *(F.array(*v).alias(f"adjust {n}") for n, v in made.items())), "i").orderBy("i").collect()]
    b, s, q = (np.array([[np.nan if v is None else v for v in r[k]] for r in rows]) for k in (1, 2, 3))
    with np.errstate(all="ignore"):
        mine = {f"blend {n}": f(b, s) for n, f in arrays.BLENDS.items()}
        for k, (n, a) in enumerate(graded.items()):
            amounts = np.full((len(rows), 5), np.nan)
            amounts[:, : len(a)] = a
            mine[f"adjust {n}"] = arrays.adjusted(q, list(graded), np.full(len(rows), k), amounts)
    for name, values in mine.items():
        want = np.array([[np.nan if v is None else v for v in r[name]] for r in got])
        np.testing.assert_allclose(values, want, rtol=0, atol=1e-15 if "levels" not in name else 1e-12, err_msg=name)
    assert len(CHANNELS) == 4 and len(mine) == 34
