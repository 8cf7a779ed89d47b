"""Pattern packing: documents into sequences of a fixed length, by non-negative least squares.

The histogram of piece lengths has at most ``capacity`` bins, whatever the input. Patterns of
one to three lengths that fill a sequence exactly are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down to what is there, and
the residual goes by best fit, in runs of equal lengths. The outcome is a recipe: "the pieces
of length L with ranks lo.. go to sequences s.., at offset o"; its size is bounded by the
number of bins, so it is sent to the tasks, which look up each piece by length and rank.

Null texts are empty documents (the end id alone), null and repeated doc_ids stay separate
documents, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, slices, text_of
from gridspark.llm.tokens import default_vocabulary, documents_ids

#: Pieces of one length that are ranked by one task.
RANKED_TOGETHER = 20_000


def patterns(present: np.ndarray) -> np.ndarray:
    """All ways to fill a sequence with one to three present lengths: rows of three, 0 for none. present[L]: is there a piece of length L."""
    capacity = len(present) - 1
    have = np.flatnonzero(present)
    out = [np.array([[0, 0, capacity]])] if present[capacity] else []
    small = have[have <= capacity // 2]
    pair = small[present[capacity - small]]
    out.append(np.stack([np.zeros_like(pair), pair, capacity - pair], 1))
    for a in have[have <= capacity // 3]:
        b = have[(have >= a) & (have <= (capacity - a) // 2)]
        c = capacity - a - b
        b, c = b[present[c]], c[present[c]]
        out.append(np.stack([np.full_like(b, a), b, c], 1))
    return np.concatenate(out).astype(np.int64)


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Non-negative x that makes the patterns' lengths fit the histogram in the least-squares sense (accelerated projected gradient)."""
    n = len(histogram)
    if not len(shapes):
        return np.zeros(0)
    use, target = shapes > 0, histogram.astype(float)
    target[0] = 0
    scale = max(target.max(), 1.0)
    target = target / scale

    def made(x):
        return np.bincount(shapes.ravel(), (use * x[:, None]).ravel(), n)

    def back(r):
        return (r[shapes] * use).sum(1)

    x, step = np.ones(len(shapes)), 0.0
    for _ in range(12):  # the largest eigenvalue, for the step
        x = back(made(x))
        step = np.linalg.norm(x)
        x /= step
    x = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - back(made(y) - target) / (1.05 * step), 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x * scale


class Recipe:
    """Runs of pieces: length, first rank, how many, first sequence, offset."""

    def __init__(self):
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        runs = np.array(sorted(self.runs), np.int64).reshape(-1, 5)
        return tuple(runs.T)


def build(histogram: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> Recipe:
    """Patterns as often as the (rounded) counts say, then the residual by best fit."""
    capacity, left, ranked, out = len(histogram) - 1, histogram.astype(np.int64), np.zeros(len(histogram), np.int64), Recipe()

    def put(length, many, sequence, offset):
        out.runs.append((int(length), int(ranked[length]), int(many), int(sequence), int(offset)))
        ranked[length] += many
        left[length] -= many

    for k in np.argsort(-counts, kind="stable"):
        lengths = [int(x) for x in shapes[k] if x]
        many = min(int(counts[k]), *(int(left[x]) // lengths.count(x) for x in lengths))
        if int(counts[k]) < 1:
            break
        if many < 1:
            continue
        offset = 0
        for x in lengths:
            put(x, many, out.sequences, offset)
            offset += x
        out.sequences += many
    rooms: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, how many)
    open_ = np.zeros(capacity + 1, bool)

    def give(space, sequence, many):
        if many and space:
            rooms.setdefault(space, []).append((sequence, many))
            open_[space] = True

    for length in range(capacity, 0, -1):
        while left[length] > 0:
            fits = np.argmax(open_[length:]) + length
            if open_[fits]:
                sequence, many = rooms[fits].pop()
                open_[fits] = bool(rooms[fits])
                take = min(many, int(left[length]))
                put(length, take, sequence, capacity - fits)
                give(fits, sequence + take, many - take)
                give(fits - length, sequence, take)
            else:
                each = capacity // length
                many = max(int(left[length]) // each, 1)
                each = min(each, int(left[length]))
                for k in range(each):
                    put(length, many, out.sequences, k * length)
                give(capacity - each * length, out.sequences, many)
                out.sequences += many
    return out


def plan(histogram: np.ndarray) -> Recipe:
    """The best of a few roundings: patterns for all that was fitted, or for a share of it, so that short pieces remain to fill gaps."""
    shapes = patterns(histogram > 0)
    counts = fit_counts(shapes, histogram)
    return min((build(histogram, shapes, counts * share) for share in (1.0, 0.9, 0.7, 0.4)), key=lambda r: r.sequences)


def pieces(docs: DataFrame, capacity: int, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents with their end id, the longer ones cut every ``capacity`` tokens."""

    def cut(batches):
        for rows, buf, offsets in slices(batches):
            out = []
            for row, ids in enumerate(documents_ids(vocabulary, buf, offsets, end_id)):
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((row, k, at, len(part), zlib.crc32(part)))
            row, *rest = zip(*out, strict=True)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, types, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    return texts.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece, with sequence_id and offset; sequences hold at most ``capacity`` tokens without gaps."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").table(pieces(docs, capacity, vocabulary or default_vocabulary(), end_id), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # at most `capacity` rows
        histogram[length] = n
    length, lo, _, sequence, offset = plan(histogram).arrays()
    keys = (length << 40) | lo

    # A length may hold most of all pieces: it is ranked in groups, and the groups' sizes are summed up.
    groups = F.element_at(F.lit([int(-(-n // RANKED_TOGETHER)) or 1 for n in histogram]), F.col("length").cast("int") + 1)
    grouped = cut.withColumn("ranked_in", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups.cast("long")))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("ranked_in").rowsBetween(Window.unboundedPreceding, -1))
    bases = grouped.groupBy("length", "ranked_in").agg(F.count("*").alias("n")).select("length", "ranked_in", F.coalesce(before, F.lit(0)).alias("ranked_before"))
    within = F.row_number().over(Window.partitionBy("length", "ranked_in").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = grouped.withColumn("rank", within).join(bases, ["length", "ranked_in"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("ranked_before")).alias("rank"))

    def place(batches):
        for batch in batches:
            mine = (batch.column(3).to_numpy() << 40) | batch.column(5).to_numpy()
            at = np.searchsorted(keys, mine, side="right") - 1
            where = [pa.array(sequence[at] + mine - keys[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *where], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
