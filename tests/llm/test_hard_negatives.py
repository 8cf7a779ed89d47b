"""Hard negatives against a comparison of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, positives=5, negatives=10):
    """Every anchor against every row; rows as they are in the table."""
    usable = set()
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [min(max(math.floor(256 * float(np.float32(x))), -hn.LARGEST), hn.LARGEST) for x in e]
            while v and not v[-1]:
                v.pop()
            usable.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(v)))
    usable, out = sorted(usable), []
    for a, la, va in usable:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for i, label, v in usable if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            fits = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(a, p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def got(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "place", "shard", "block", "score", "number")}).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return sorted(map(tuple, hn.op13_hard_negatives(spark, str(tmp_path)).collect()))


def table(rng, n, dim, spread, n_labels=4):
    """Clusters by label, so that keys can leave out something; ids in jumps, so that many are anchors."""
    centre = rng.standard_normal((n_labels, dim))
    labels = rng.integers(0, n_labels, n)
    return [(i * 5, (spread * centre[l] + 0.3 * rng.standard_normal(dim)).tolist(), int(l)) for i, l in enumerate(labels)]


@pytest.mark.parametrize("spread,dim", [(0.0, 16), (0.5, 8), (1.0, 3)])
def test_equals_all_pairs(spark, tmp_path, monkeypatch, spread, dim):
    monkeypatch.setattr(hn, "SHARD", (97, 97))
    monkeypatch.setattr(hn, "ANCHORS_AT_ONCE", (5, 5))
    rows = table(np.random.default_rng(dim), 600, dim, spread)
    want = plain(rows)
    assert want and got(spark, rows, tmp_path) == want


def test_copies_ties_and_odd_rows(spark, tmp_path, monkeypatch):
    """A vector that most rows share under two labels, ties, repeated rows and ids, nulls, odd components, vectors of other lengths, huge values."""
    monkeypatch.setattr(hn, "SHARD", (50, 50))
    rng = np.random.default_rng(9)
    rows = table(rng, 150, 6, 0.8)
    shared = rows[0][1]
    rows += [(2000 + i, shared, i % 2) for i in range(300)] + [(100, shared, 0)] * 20
    rows += [(3000 + i, [0.5, 0.5 * (i % 2)], i % 3) for i in range(40)] + [(300, [0.25], 1), (300, [0.75, 0.1], 2)]
    rows += [(400, None, 1), (500, [0.1, None], 1), (600, [0.1, float("nan")], 1), (601, [float("inf")], 2), (700, [0.1] * 6, None), (None, [0.2] * 6, 1), (800, [], 1), (801, [0.0, 0.0], 2), (900, [1e30] * 6, 1), (901, [-1e30, 3e38], 1)]
    random.Random(1).shuffle(rows)
    assert got(spark, rows, tmp_path) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], [(100, [-1.0], 1), (1, [1.0], 1), (2, [0.5], 2)], [(i, None, 1) for i in range(3)]])
def test_small_tables(spark, tmp_path, rows):
    assert got(spark, rows, tmp_path) == plain(rows)


def test_scores_beyond_doubles_are_exact():
    big = 1 << 22
    x, q = np.full((2, 1024), float(big)), np.full(1024, float(big))
    x[1, 0] -= 1
    assert hn._scores(x, q).tolist() == [1024 * big * big, 1024 * big * big - big]


def test_keys_leave_out_what_cannot_matter(monkeypatch):
    """In clusters, a search scores a part of the rows only, and its result is the same."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16)) * 400
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 16)) * 20)
    most = float((x * x).sum(1).max())
    pivots = x[:20]
    keys = hn.Keys(np.arange(4000), np.zeros(4000, np.int64), x, np.c_[pivots, np.sqrt(most - (pivots * pivots).sum(1))], most)
    scored, plain_scores = [], hn._scores
    monkeypatch.setattr(hn, "_scores", lambda a, q: scored.append(len(a)) or plain_scores(a, q))
    for q in x[::400]:
        scored.clear()
        ids, scores = keys.search(q, np.ones(4000, bool), np.array([-(2**62)]), np.array([2**62]), 10)[0]
        order = np.lexsort((np.arange(4000), -(x @ q)))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].astype(int).tolist()
        assert sum(scored) < 4000
