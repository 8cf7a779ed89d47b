"""Benchmark decontamination by latent semantic retrieval.

Documents are read in passages of ``2 * STRIDE`` words, one every ``STRIDE`` words. Words (lower-cased,
without punctuation at their ends) are hashed into ``FEATURES`` columns and weighted by TF-IDF, whose
passage counts cover all documents; what is in more than one in ``COMMON`` passages weighs nothing. A
randomised SVD gives ``RANK`` latent directions: a random sparse matrix of signs (one for each feature) takes the
TF-IDF passages to ``WIDTH`` columns, Spark sums up the Gram matrix of what that gives, and its eigenvectors are
the right singular vectors of the sketched passages. It is fitted, in one pass, on all passages of all documents and on
the benchmark, which weighs a fixed share of them at any size, and every passage of every document is projected. Passages whose cosine with an item (if it is
longer than a passage, with one of its own passages) reaches ``COSINE`` are candidates. So are, whatever
their cosine, those that hold ``SEVERAL`` of the ``RUN_WORDS`` rarest words of a run of ``STRIDE`` words of an
item (nearly all of them, if the item has hardly any word that is rare in the corpus): every such run of a verbatim copy lies whole in some passage. Candidates are kept if the longest common subsequence of their telling words with
the item's covers ``COVERED`` of these, and if one of the item's ``ANSWER`` rarest words is there.

Null texts have no passages, items without words match nothing, repeated rows match alike, null
doc_ids are returned as null, other columns are ignored, empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import WordHash, mix64, slices, text_of, words

STRIDE, FEATURES, WIDTH, RANK, COMMON = 32, 1 << 15, 512, 96, 20
COSINE, COVERED, ANSWER, RUN_WORDS, SEVERAL = 0.4, 0.55, 5, 8, 3
#: In the fit the runs of the benchmark weigh as much, in all, as this share of the documents' runs;
#: the directions of most variance, which tell languages apart, are left out.
ITEM_SHARE, LEFT_OUT = 0.6, 16
#: Bytes of text that a task multiplies at once; matrices of so many lots of tasks are summed up first.
FIT_BYTES, LOTS = 1 << 18, 64
#: Items that are searched for in one pass (some 50 MB in a broadcast), and directions of them that a slice is multiplied by at once.
ITEMS_AT_ONCE, DIRECTIONS_AT_ONCE = 32_768, 2048
_HASH = WordHash(seed=83, lower=True)
_EDGE = np.zeros(256, bool)
_EDGE[np.frombuffer(b".,;:!?\"'()[]{}*#&%$-", np.uint8)] = True


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words without up to three punctuation marks after and one before them."""
    starts, ends, rows = words(buf, offsets)
    which = np.arange(len(starts))
    for _ in range(3):
        which = which[_EDGE[buf[ends[which] - 1]] & (ends[which] - starts[which] > 1)]
        ends[which] -= 1
    if len(starts):
        starts = starts + (_EDGE[buf[starts]] & (ends - starts > 1))
    return _HASH.of(buf, starts, ends), rows


def blocks(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each run of ``STRIDE`` words of a row; its row; where each row's first run is."""
    edges = np.searchsorted(rows, np.arange(n_rows + 1))
    many = -(-np.diff(edges) // STRIDE)
    first_block = np.cumsum(many) - many
    row = np.repeat(np.arange(n_rows), many)
    return edges[row] + STRIDE * (np.arange(len(row)) - first_block[row]), row, np.r_[first_block, len(row)]


def passage_counts(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many runs of words each feature is, over all documents, and the number of runs."""

    def run(batches):
        total, n = np.zeros(FEATURES, np.int64), 0
        for _, buf, offsets in slices(batches):
            hashes, rows = word_hashes(buf, offsets)
            if not len(hashes):
                continue
            begin, row, _ = blocks(rows, len(offsets) - 1)
            # a few thousand runs of a slice and their features fit 32 bits, which sort fast
            for lo in range(0, len(begin), 1 << 16):
                hi = min(lo + (1 << 16), len(begin))
                end = begin[hi] if hi < len(begin) else len(hashes)
                which = np.repeat(np.arange(hi - lo, dtype=np.uint32), np.diff(np.r_[begin[lo:hi], end]))
                seen = which * np.uint32(FEATURES) + (hashes[begin[lo] : end] % np.uint64(FEATURES)).astype(np.uint32)
                seen.sort()
                first = np.r_[True, seen[1:] != seen[:-1]]
                total += np.bincount(seen[first] % np.uint32(FEATURES), minlength=FEATURES)
            n += len(begin)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(FEATURES), -1]), pa.array(np.r_[total, n])], ["feature", "n"])

    counts, n = np.zeros(FEATURES, np.int64), 0
    for feature, many in texts.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n")).collect():  # one row for each feature
        if feature < 0:
            n = many
        else:
            counts[feature] = many
    return counts, n


def weights(counts: np.ndarray, n: int) -> np.ndarray:
    """Inverse passage frequency less that of common words; 0 for these."""
    return np.maximum(0, np.log((n + COMMON) / (counts + 1)) - np.log(COMMON)).astype(np.float32)


def _signs() -> tuple[np.ndarray, np.ndarray]:
    """The sketch's column of each feature, and the sign there."""
    drawn = mix64(mix64(np.arange(1, FEATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return (drawn % np.uint64(WIDTH)).astype(np.int64), np.where(drawn >> np.uint64(63), 1.0, -1.0).astype(np.float32)


_COLUMN, _SIGN = _signs()


def _sketch(hashes: np.ndarray, rows: np.ndarray, n_rows: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketched TF-IDF passages of some texts, and the row of each."""
    begin, row, _ = blocks(rows, n_rows)
    feature = (hashes % np.uint64(FEATURES)).astype(np.int64)
    which = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(hashes)]))
    out = np.bincount(which * WIDTH + _COLUMN[feature], weight[feature] * _SIGN[feature], len(begin) * WIDTH).astype(np.float32).reshape(-1, WIDTH)
    more = np.flatnonzero(row[1:] == row[:-1])
    out[more] += out[more + 1]
    return out, row


def latent_basis(texts: DataFrame, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The right singular vectors (WIDTH x rank) of the sketched TF-IDF passages of ``texts`` (text, share: what a passage counts) after the first LEFT_OUT."""
    shared = texts.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        total = np.zeros((WIDTH, WIDTH), np.float64)
        for batch, buf, offsets in slices(batches, most=FIT_BYTES):
            hashes, rows = word_hashes(buf, offsets)
            if not len(hashes):
                continue
            y, row = _sketch(hashes, rows, len(offsets) - 1, shared.value)
            share = batch.column(1).to_numpy().astype(np.float32)[row]
            # a passage counts by its length, not the square of it: long common passages should not rule
            y *= np.sqrt(share / np.maximum(np.linalg.norm(y, axis=1), 1e-6))[:, None]
            total += y.T @ y
        lot = TaskContext.get().partitionId() % LOTS
        yield pa.RecordBatch.from_arrays([pa.array(range(0, WIDTH, 16), pa.int32()), pa.array([lot] * (WIDTH // 16), pa.int32()), pa.array([total[k : k + 16].tobytes() for k in range(0, WIDTH, 16)], pa.binary())], ["at", "lot", "part"])

    def summed(key, table):
        total = sum(np.frombuffer(b) for b in table.column("part").to_pylist())
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    parts = texts.mapInArrow(run, "at int, lot int, part binary").groupBy("at", "lot").applyInArrow(summed, "at int, part binary")
    rows = parts.groupBy("at").applyInArrow(summed, "at int, part binary").collect()  # one matrix of WIDTH x WIDTH
    shared.destroy()
    if not rows:
        return np.zeros((WIDTH, rank), np.float32)
    values, vectors = np.linalg.eigh(np.concatenate([np.frombuffer(bytes(r.part)) for r in sorted(rows, key=lambda r: r.at)]).reshape(WIDTH, WIDTH))
    return vectors[:, np.argsort(-values)[LEFT_OUT : LEFT_OUT + rank]].astype(np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for y in b:
        hit = row & at.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


class Words:
    """The rarest words of some runs of words, to find passages that hold several of one's."""

    def __init__(self, runs: list[set[int]], needed: list[int]):
        pairs = np.array([(x, k) for k, rare in enumerate(runs) for x in rare], np.uint64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        self.word, self.run, self.n, self.needed = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64), len(runs), np.array(needed, np.int64)

    def held(self, hashes: np.ndarray, begin: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Sorted passage * n + run for the passages that hold as many different words of a run as it needs."""
        none = np.zeros(0, np.int64)
        if not len(self.word) or not len(hashes):
            return none
        lo = np.searchsorted(self.word, hashes)
        hit = np.flatnonzero(self.word[np.minimum(lo, len(self.word) - 1)] == hashes)
        lo, hi = lo[hit], np.searchsorted(self.word, hashes[hit], side="right")
        # a word of a run of the text is in the passage that begins there, and in the one before
        at = np.searchsorted(begin, hit, side="right") - 1
        entry = np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange(int((hi - lo).sum()))
        at = np.repeat(at, hi - lo)
        before = np.flatnonzero((at > 0) & (of[at - 1] == of[at]))
        at, entry = np.r_[at, at[before] - 1], np.r_[entry, entry[before]]
        seen = np.unique(at * len(self.word) + entry)
        keys, many = np.unique(seen // len(self.word) * self.n + self.run[seen % len(self.word)], return_counts=True)
        return keys[many >= self.needed[keys % self.n]]


class Items:
    """A block of benchmark items: the directions of them or their passages, their telling words and rarest words."""

    def __init__(self, rows: list[tuple[int, str]], weight: np.ndarray, basis: np.ndarray, cosine: float = COSINE):
        self.cosine = cosine
        texts = [(t or "").encode() for _, t in rows]
        buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        hashes, row = word_hashes(buf, offsets)
        feature = (hashes % np.uint64(FEATURES)).astype(np.int64)
        edges = np.searchsorted(row, np.arange(len(rows) + 1))
        self.ids, self.telling, self.rarest, self.all = [i for i, _ in rows], [], [], []
        sums, self.direction_of, runs, needed, self.run_of = [], [], [], [], []
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            w = weight[feature[a:b]]
            self.all.append(hashes[a:b].tolist())
            self.telling.append(hashes[a:b][w > 0].tolist())
            self.rarest.append(set(hashes[a:b][np.argsort(-w, kind="stable")[:ANSWER]].tolist()))
            # the whole item, and the passages of one that is longer than a passage
            for lo, hi in [(a, b)] + [(x, min(x + 2 * STRIDE, b)) for x in range(a, b - STRIDE, STRIDE) if b - a > 2 * STRIDE]:
                f = feature[lo:hi]
                sums.append(np.bincount(_COLUMN[f], weight[f] * _SIGN[f], WIDTH).astype(np.float32) @ basis)
                self.direction_of.append(k)
            for lo in range(a, b, STRIDE):
                lo = max(a, min(lo, b - STRIDE))
                w, mine = weight[feature[lo : min(lo + STRIDE, b)]], hashes[lo : min(lo + STRIDE, b)]
                # words that much of the corpus holds tell little, also where it holds copies of the item: then nearly all must be there
                few = len(self.telling[k]) < 4
                telling = mine[np.argsort(-w, kind="stable")][: len(mine) if few else int((w > 0).sum())].tolist()
                rare = set(list(dict.fromkeys(telling))[:RUN_WORDS])
                if len(rare) > 1 or few:
                    runs.append(rare)
                    needed.append(max(1, len(rare) - 1) if few else min(SEVERAL, len(rare)))
                    self.run_of.append(k)
        sums = np.array(sums, np.float32).reshape(-1, basis.shape[1])
        self.direction = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        self.direction_of, self.run_of = np.array(self.direction_of, np.int64), np.array(self.run_of, np.int64)
        self.answer, self.several = Words(self.rarest, [1] * len(rows)), Words(runs, needed)

    def near(self, p: np.ndarray, hashes: np.ndarray, begin: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Candidates as passage * number of items + item: by the cosine with ``p``, if one of the item's rarest words is there, or by several words."""
        n, close = len(self.ids), []
        for lo in range(0, len(self.direction), DIRECTIONS_AT_ONCE):
            at, which = np.nonzero(p @ self.direction[lo : lo + DIRECTIONS_AT_ONCE].T >= self.cosine)
            close.append(at * n + self.direction_of[lo + which])
        close = np.unique(np.concatenate(close)) if close else np.zeros(0, np.int64)
        close = close[np.isin(close, self.answer.held(hashes, begin, of), assume_unique=True)]
        words = self.several.held(hashes, begin, of)
        if len(words):
            words = words // self.several.n * n + self.run_of[words % self.several.n]
        return np.union1d(close, words)

    def covered(self, k: int, passage: list[int], telling: list[int]) -> float:
        """Share of the item's telling words, in order, in a passage; of all its words if it has few telling ones (and then nearly all must be there)."""
        if not self.all[k] or not self.rarest[k] & set(passage):
            return 0.0
        if len(self.telling[k]) < 4:
            share = common_subsequence(self.all[k], passage) / len(self.all[k])
            return share if share > 0.85 else 0.0
        return common_subsequence(self.telling[k], telling) / len(self.telling[k])


def find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, item_id, cosine, covered: the documents that hold a passage of an item, the best one for each item."""
    return matches(docs, benchmark, cosine).groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("covered").alias("covered"))


def matches(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """doc_id, text_hash, item_id, cosine, covered: the same for each row; the hash tells rows of one doc_id apart."""
    spark = docs.sparkSession
    texts = docs.select(text_of(docs).alias("text"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("text_hash"))
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), text_of(benchmark).alias("text"))
    n_items = items.count()
    counts, n = passage_counts(texts)
    weight, share = weights(counts, n), ITEM_SHARE * n / max(1, passage_counts(items)[1])
    whole = texts.select("text", F.lit(1.0).alias("share")).unionByName(items.select("text", F.lit(float(share)).alias("share")))
    # each task sums up the documents that come to it and sends one matrix: a few tasks for each core, however large the input
    basis = latent_basis(whole.coalesce(4 * spark.sparkContext.defaultParallelism), weight)
    shared = spark.sparkContext.broadcast((weight, basis))
    n_parts = -(-n_items // ITEMS_AT_ONCE) or 1
    out = None
    for part in range(n_parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_parts)) == part).orderBy("item_id", "text").collect()  # about ITEMS_AT_ONCE
        found = _search(texts, Items([tuple(r) for r in rows], weight, basis, cosine), shared)
        out = found if out is None else out.unionByName(found)
    return out


def _search(texts: DataFrame, items: Items, shared) -> DataFrame:
    target = texts.sparkSession.sparkContext.broadcast(items)
    names = ["doc_id", "text_hash", "item_id", "cosine", "covered"]

    def run(batches):
        (weight, basis), items = shared.value, target.value
        for rows, buf, offsets in slices(batches, most=FIT_BYTES):
            hashes, row = word_hashes(buf, offsets)
            begin, of, first_block = blocks(row, len(offsets) - 1)
            feature = (hashes % np.uint64(FEATURES)).astype(np.int64)
            if not len(hashes) or not items.ids:
                continue
            p = _sketch(hashes, row, len(offsets) - 1, weight)[0] @ basis
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)
            edges, hits, n = np.searchsorted(row, np.arange(len(offsets))), {}, len(items.ids)
            # the checks that cost least come first
            for key in items.near(p, hashes, begin, of).tolist():
                at, k = divmod(key, n)
                i = int(of[at])
                # a passage and as much around it as a long item needs
                more = max(0, len(items.all[k]) - STRIDE)
                a, b = max(int(edges[i]), int(begin[at]) - more), min(int(edges[i + 1]), int(begin[at]) + 2 * STRIDE + more)
                passage = hashes[a:b].tolist()
                covered = items.covered(k, passage, hashes[a:b][weight[feature[a:b]] > 0].tolist())
                if covered >= COVERED:
                    best = float((items.direction[items.direction_of == k] @ p[at]).max())
                    hits[i, k] = max(hits.get((i, k), (0.0, -1.0)), (covered, best))
            if hits:
                at, k = zip(*hits, strict=True)
                best = list(hits.values())
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([rows.column(1).take(at), rows.column(2).take(at), pa.array([items.ids[x] for x in k], pa.int64()), pa.array([b[1] for b in best], pa.float64()), pa.array([b[0] for b in best], pa.float64())], names)

    return texts.mapInArrow(run, "doc_id bigint, text_hash bigint, item_id bigint, cosine double, covered double")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold passages of the benchmark."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
