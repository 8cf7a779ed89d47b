"""Links between texts that share a band, none of them a centre of it, against all pairs."""

import hashlib
import random

import numpy as np
import pytest

from gridspark.llm import near_dups
from gridspark.llm.common import Scratch

SCHEMA = "node string, hashes binary, weights binary, rest double, apart float, bands array<bigint>"


def made(seed):
    """A large family, and many small ones that share its bands but not its words."""
    rng, out = random.Random(seed), []
    for family in range(30):
        words = sorted({rng.getrandbits(60) for _ in range(40)})
        for copy in range(25 if family == 0 else rng.choice([1, 2, 2, 3])):
            own = sorted(set(words) - set(rng.sample(words, rng.randint(0, 5))) | {rng.getrandbits(60) for _ in range(rng.randint(0, 3))})
            weights = np.array([1.0 + (w % 2 if seed else 0) for w in own])
            bands = [100 * k + rng.randint(0, 1) if seed else 100 * k for k in range(3)]
            out.append((hashlib.md5(f"{family} {copy}".encode()).hexdigest(), np.array(own, np.uint64).tobytes(), weights.tobytes(), rng.choice([0.0, 1.5]), rng.random(), bands))
    return out


def all_pairs(vectors):
    label = {v[0]: v[0] for v in vectors}
    read = [(v[0], (np.frombuffer(v[1], np.uint64), np.frombuffer(v[2]), v[3]), v[5]) for v in vectors]
    for i, (a, one, bands) in enumerate(read):
        for b, two, others in read[:i]:
            if any(x == y for x, y in zip(bands, others)) and near_dups.weighted_jaccard(one, two) >= near_dups.THRESHOLD - 1e-9:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


@pytest.mark.parametrize(("seed", "options"), [(0, {}), (1, {"turns": 1, "block": 2000}), (2, {"turns": 0, "block": 1 << 20})])
def test_no_link_of_a_band_is_missed(spark, seed, options):
    vectors = made(seed)
    frame = spark.createDataFrame([tuple(bytearray(x) if isinstance(x, bytes) else x for x in v) for v in vectors], SCHEMA)
    got = {v[0]: v[0] for v in vectors} | {r.node: r.label for r in near_dups._links(frame, near_dups.THRESHOLD, Scratch(spark, "rest"), **options).collect()}
    want = all_pairs(vectors)
    groups = lambda labels: {frozenset(n for n in labels if labels[n] == v) for v in labels.values()}
    assert groups(got) == groups(want)
    assert sum(len(g) > 1 for g in groups(want)) > 10
