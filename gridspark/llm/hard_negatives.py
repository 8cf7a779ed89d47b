"""Hard negatives of anchors by exact search over one-dimensional distance keys.

Scores are inner products of integer vectors. A vector x gets one component more, sqrt(M^2 - |x|^2) with M the largest norm, an anchor q
gets 0; then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the best scores are the nearest vectors. Each vector belongs to the nearest of some
pivots and is stored at the key (pivot, distance to it), in the order of these keys. Vectors within r of q have keys within r of q's own
distance to the pivot: a search reads a key interval around each pivot, widens it and checks what is new by the exact scores. It ends
when what lies beyond the interval cannot change the result: everything unread is farther than r, and the kth best is within r (or the
whole range of wanted scores is). A range of scores is an annulus around q; keys that can only lie inside its hole are not read.

Vectors are dealt into shards by their hash, each stored in the order of its keys, and anchors into blocks; every pair of them is searched
exactly, and the best of all shards are the result. Positives come first (the best of the same label), then all windows of an anchor's
positives in one widening search.

Rows with a null id, label or vector, or with a component that is null or not finite, take no part; components become floor(256 * x), held
within +-2**22 so that scores are exact; shorter vectors count as followed by zeros; repeated rows count once, an id's other rows are not its
partners; ties go to the smaller id; anchors with no positives, and positives with no negatives, give no rows; other columns are ignored.
Of rows that share vector and label only the first few ids can be in a result, so a vector that many rows share is no large group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch

SCALE, LARGEST = 256, 1 << 22
POSITIVES, NEGATIVES = 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
LEAST, MOST = 30, 90
PIVOTS = 32
#: Vectors in a shard and anchors in a block (between these bounds, growing with the table). Every block meets every shard, so the vectors
#: are sent out ``BLOCKS`` times as long as blocks are below their upper bound.
SHARD, ANCHORS_AT_ONCE, BLOCKS = (8_192, 131_072), (128, 65_536), 16
#: Rows whose scores are worked out at once.
ROWS_AT_ONCE = 1 << 16


def rows_of(table: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v of the rows that take part, each once; ``table`` has vec_id, embedding and whatever ``label`` reads."""
    x = table["embedding"].cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = F.transform(x, lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v, F.lit(-1e9)), F.lit(1e9)) * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    # trailing zeros change no score; without them equal vectors are equal arrays
    kept = F.aggregate(F.sequence(F.lit(0), F.size(held)), F.lit(0), lambda n, i: F.when(F.get(held, i - 1) != 0, i).otherwise(n))
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"), F.when(finite, F.slice(held, F.lit(1), kept)).alias("v"))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers as doubles, zeros behind shorter ones."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles hold them where no sum can reach 2**53, integers otherwise."""
    if x.size and q.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= 2**53:
        return x.astype(np.int64) @ q.astype(np.int64)
    return (x @ q).astype(np.int64)


class Keys:
    """Vectors of a shard in the order of their keys, (nearest pivot, distance to it)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, pivots: np.ndarray, most: float):
        """``most`` is the largest squared norm of all vectors; pivots have the additional component."""
        self.pivots, self.most = pivots, most
        augmented = np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0))]
        square = (augmented * augmented).sum(1)[:, None] - 2 * augmented @ pivots.T + (pivots * pivots).sum(1)
        nearest = square.argmin(1)
        distance = np.sqrt(np.maximum(square[np.arange(len(x)), nearest], 0))
        order = np.lexsort((distance, nearest))
        self.ids, self.labels, self.x, self.distance = ids[order], labels[order], x[order], distance[order]
        self.edges = np.searchsorted(nearest[order], np.arange(len(pivots) + 1))
        # distances are doubles; what rounding could move is read as well
        self.slack = 1e-6 * (1 + np.sqrt(4 * most))

    def search(self, q: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each range low..high of scores, the ids and scores of the first k rows in it whose label is ``wanted``: a mask by row."""
        own = float(q @ q)
        squared = lambda score: np.maximum(own + self.most - 2.0 * score, 0)
        to_pivot = np.sqrt(np.maximum(own + (self.pivots * self.pivots).sum(1) - 2 * self.pivots[:, :-1] @ q, 0))
        hole = np.sqrt(squared(high.max())) - self.slack  # nothing nearer is wanted
        end = np.sqrt(squared(low)) + self.slack
        reach = max(hole, 0.0) + 2 * self.slack
        step = (np.sqrt(squared(float(np.sqrt(own * self.most)))) + np.sqrt(own + self.most)) / 16 + 1e-3
        n = len(self.pivots)
        # keys from which on, below the own distance, rows can lie outside the hole
        inner = np.array([self._at(p, hole - to_pivot[p], "left") for p in range(n)])
        first, last = np.array([self._at(p, to_pivot[p], "left") for p in range(n)]), None
        first = np.maximum(first, inner)
        last = first.copy()
        ids, scores, best = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        while True:
            a = np.array([self._at(p, to_pivot[p] - reach, "left") for p in range(n)])
            b = np.array([self._at(p, to_pivot[p] + reach, "right") for p in range(n)])
            a, b = np.minimum(np.maximum(a, inner), first), np.maximum(b, last)
            new = [np.arange(s, e) for s, e in zip([*a, *last], [*first, *b], strict=True) if e > s]
            new = np.concatenate(new) if new else np.zeros(0, np.int64)
            first, last = a, b
            new = new[wanted[new]]
            for lo in range(0, len(new), ROWS_AT_ONCE):
                part = new[lo : lo + ROWS_AT_ONCE]
                s = _scores(self.x[part], q)
                keep = (s >= low.min()) & (s <= high.max())
                ids, scores = np.r_[ids, self.ids[part[keep]]], np.r_[scores, s[keep]]
            order = np.lexsort((ids, -scores))
            ids, scores = ids[order], scores[order]
            everything = bool((first <= inner).all() and (last >= self.edges[1:]).all())
            best, needed = [], 0.0
            for l, h, e in zip(low.tolist(), high.tolist(), end.tolist(), strict=True):
                here = np.flatnonzero((scores >= l) & (scores <= h))[:k]
                best.append((ids[here], scores[here]))
                # nothing farther than the kth so far, or than the range's end, can come in
                kth = float(np.sqrt(squared(float(scores[here[-1]])))) + self.slack if len(here) == k else math.inf
                needed = max(needed, min(kth, e))
            # unread rows are farther than ``reach``
            if needed < reach or everything:
                return best
            reach, step = min(reach + step, needed + self.slack), step * 2

    def _at(self, p: int, distance: float, side: str) -> int:
        lo, hi = self.edges[p], self.edges[p + 1]
        return int(lo + np.searchsorted(self.distance[lo:hi], distance, side))


def _dealt(df: DataFrame, mine: int, its_own: str, others: int, other: str) -> DataFrame:
    own = F.pmod(F.xxhash64("vec_id", "v"), F.lit(mine)).cast("int").alias(its_own)
    return df.select("*", own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))


def _count(n: int, bounds: tuple[int, int], share: int) -> int:
    return -(-n // min(max(n // share, bounds[0]), bounds[1])) or 1


def mine(table: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` reads vec_id."""
    spark = table.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.table(rows_of(table, label), "rows")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda t, x: t + x.cast("long") * x.cast("long"))
    n, width, largest, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.count(F.when(is_anchor, 1))).first()
    # one row of each id, label and vector; of those that share label and vector the first ids, so many that an anchor can leave itself out.
    # Each task drops what is beyond before the shuffle; the dense rank counts an id once, however often its row is repeated
    place = F.dense_rank().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= max(positives, negatives) + 1).select("vec_id", "label", "v").distinct()
    few = scratch.table(few, "few")
    anchors = scratch.table(rows.where(is_anchor).distinct(), "anchors")
    picked = few.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(PIVOTS).collect()  # PIVOTS vectors
    width, most_square = max(int(width), 1), float(largest)
    pivots = _matrix(pa.array([list(r.v) for r in picked], pa.list_(pa.int32())), width) if picked else np.zeros((1, width))
    pivots = np.c_[pivots, np.sqrt(np.maximum(most_square - (pivots * pivots).sum(1), 0))]
    shards, blocks = _count(n, SHARD, 64), _count(n_anchors, ANCHORS_AT_ONCE, BLOCKS)
    index = _dealt(few, shards, "shard", blocks, "block")

    def searched(asked: DataFrame, one, schema: str) -> DataFrame:
        """``one(keys, query row, vector)`` gives the columns after anchor_id; every block of anchors meets every shard."""

        def run(queries, rows):
            keys = Keys(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _matrix(rows.column("v"), width), pivots, most_square)
            vectors, out = _matrix(queries.column("v"), width), []
            for row, q in zip(queries.drop_columns(["v"]).to_pylist(), vectors, strict=True):
                out += one(keys, row, q)
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * (schema.count(",") + 1)
            return pa.table(dict(zip([f.split()[0] for f in schema.split(", ")], map(pa.array, columns), strict=True)))

        return _dealt(asked, blocks, "block", shards, "shard").groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInArrow(run, schema)

    everything = np.array([-(2**62)]), np.array([2**62])

    def positive(keys, row, q):
        ids, scores = keys.search(q, (keys.labels == row["label"]) & (keys.ids != row["vec_id"]), *everything, positives)[0]
        return [(np.full(len(ids), row["vec_id"]), np.full(len(ids), row["label"]), np.full(len(ids), row["number"]), ids, scores)]

    # an id may stand for several rows: each is an anchor of its own, told apart by a number
    numbered = anchors.withColumn("number", F.row_number().over(Window.partitionBy("vec_id").orderBy("label", "v")).cast("bigint"))
    numbered = scratch.table(numbered, "numbered")
    first = Window.partitionBy("anchor_id", "number").orderBy(F.desc("score"), "other_id", "twin")
    found = searched(numbered, positive, "anchor_id bigint, label bigint, number bigint, other_id bigint, score bigint")
    found = found.withColumn("twin", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    found = scratch.table(found.groupBy("anchor_id", "number").agg(F.collect_list(F.struct("place", F.col("other_id").alias("id"), "score")).alias("positives")), "positives")

    def negative(keys, row, q):
        ps = row["positives"]
        score = np.array([p["score"] for p in ps], np.int64)
        low, high = -((-least * score) // 100), (most * score) // 100
        out = []
        asked = np.flatnonzero(low <= high)
        if len(asked):
            wanted = (keys.labels != row["label"]) & (keys.ids != row["vec_id"])
            for i, (ids, scores) in zip(asked.tolist(), keys.search(q, wanted, low[asked], high[asked], negatives), strict=True):
                same = [np.full(len(ids), v, np.int64) for v in (row["vec_id"], row["number"], ps[i]["place"], ps[i]["id"])]
                out.append((*same, ids, np.full(len(ids), score[i]), scores))
        return out

    asking = numbered.withColumnRenamed("vec_id", "anchor_id").join(found, ["anchor_id", "number"]).withColumnRenamed("anchor_id", "vec_id")
    schema = "anchor_id bigint, number bigint, place bigint, positive_id bigint, negative_id bigint, positive_score bigint, negative_score bigint"
    met = searched(scratch.table(asking, "asking"), negative, schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "number", "place").orderBy(F.desc("negative_score"), "negative_id"))
    best = met.withColumn("rank", rank).where(F.col("rank") <= negatives)
    result = scratch.table(best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "mined")
    for name in ("rows", "few", "anchors", "numbered", "positives", "asking"):
        scratch.forget(name)
    return result


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 100; where it is divisible by 7, the label is the next one."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table, label, F.col("vec_id") % 100 == 0)


def oracle() -> str:
    """The same by comparing each anchor with all rows, for DuckDB."""
    return f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, a.label AS label, o.vec_id AS id, o.label AS its, CAST(list_sum(list_transform(list_zip(a.e, o.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0),
positive AS (SELECT anchor_id, label, id, score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM pairs WHERE its = label) WHERE k <= {POSITIVES}),
negative AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS k
  FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND n.its <> n.label AND {LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE k <= {NEGATIVES}"""
