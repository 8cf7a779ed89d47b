"""Line dedup of every line against a set of lines seen."""

import random

from pyspark.sql import functions as F

from gridspark.llm import line_dedup
from tests.llm.test_operators import ODD, frame, prose


def test_every_repeated_line_goes(spark):
    """Single lines, short runs and blank lines too, which stay otherwise."""
    rng = random.Random(21)
    common = ["All rights reserved.", "a", "", prose(rng, 12), prose(rng, 80)]
    rows = [(i, "\n".join(x for _ in range(rng.randint(1, 6)) for x in (prose(rng, rng.randint(1, 9)), rng.choice(common))) + "\n" * (i % 3)) for i in range(60)]
    rows += [(70, rows[3][1]), (70, rows[3][1]), (71, "\n\n\n"), (72, "ab\nab"), *ODD[:9]]
    seen, want = set(), {}
    for i, text in sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}):
        lines, kept = text.encode().split(b"\n"), []
        for line in lines if lines[-1] else lines[:-1]:
            if line not in seen:
                seen.add(line)
                kept.append(line + b"\n")
        out = b"".join(kept)
        want[i, text] = (out if text.endswith("\n") else out.removesuffix(b"\n")).decode()
    got = line_dedup.dedup_passages(frame(spark, rows).withColumn("was", F.col("text")), every_line=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == want[-(2**63) if r.doc_id is None else r.doc_id, r.was or ""]
    assert sum(r.n_removed for r in got) > 100
