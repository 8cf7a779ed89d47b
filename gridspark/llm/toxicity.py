"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nystroem landmarks.

Kernel: two words are alike as far as they share three-letter subsequences that span at most
``SPAN`` bytes, each weighted by ``DECAY`` to the power of the skipped bytes, so inserted
characters (``id.iot``) and endings cost little. Letters are lower-cased; a mark stands
before a word and one after it; runs of spaced-out single letters (``i d i o t``) are one word; other
characters only widen gaps. The subsequences are hashed into ``2**FEATURE_BITS`` places.

Fit (driver, on a bounded sample of labelled documents): a document's label holds for its
sentences, of which each is represented by its most telling word, chosen anew as the machine
learns (multiple instances). Landmarks are telling words and ordinary words; a word's
Nystroem features are K(landmarks)^-1/2 K(landmarks, word), and a linear machine with hinge
loss is fitted to them. As the kernel is an inner product, the machine folds into one weight
for each subsequence, which the tasks use; a logistic curve makes the largest value among a
document's words its score.

Null and empty texts score as a text without telling words; null doc_ids are scored like any
other, repeated rows alike; other columns are ignored; an empty table gives no rows. Without
labelled rows of both kinds every score is the prior.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import WordHash, give_back, held_out, slices, small_batches, text_of, words

SPAN, DECAY, FEATURE_BITS = 6, 0.7, 19
#: Labelled documents of each kind that the fit sees, drawn by a hash of the id, and landmarks of each kind.
TOXIC_DOCUMENTS, OTHER_DOCUMENTS, LANDMARKS = 1000, 2500, 160
ROUNDS = 6
STEM = 5  # bytes
_MARK, _END = 1, 2
_SYMBOL = np.zeros(256, np.uint8)  # 0: not a letter
_SYMBOL[97:123] = np.arange(97, 123)
_SYMBOL[65:91] = np.arange(97, 123)
_SYMBOL[128:] = np.arange(128, 256)
_PATTERNS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_HASH = WordHash(seed=41, lower=True)


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words; three or more single bytes in a row are one word."""
    starts, ends, rows = words(buf, offsets)
    if len(starts) < 3:
        return starts, ends, rows
    single = ends - starts == 1
    joined = np.zeros(len(starts), bool)  # to the word before
    joined[1:] = single[1:] & single[:-1] & (rows[1:] == rows[:-1])
    head = np.flatnonzero(~joined)
    size = np.diff(np.r_[head, len(starts)])
    whole = np.repeat(size >= 3, size)
    keep = ~(joined & whole)
    last = np.arange(len(starts))
    last[head] = np.where(size >= 3, head + size - 1, head)
    return starts[keep], ends[last[keep]], rows[keep]


def subsequences(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, place and weight of all marked subsequences of the given words."""
    length = ends - starts + 2
    begin = np.cumsum(length) - length
    total = int(length.sum())
    flat = np.zeros(total + SPAN, np.uint8)
    inside = np.repeat(starts - begin - 1, length) + np.arange(total)
    flat[:total] = _SYMBOL[buf[np.clip(inside, 0, len(buf) - 1)]]
    flat[begin] = _MARK
    flat[begin + length - 1] = _END
    word = np.repeat(np.arange(len(starts)), length)
    room = np.repeat(begin + length, length) - np.arange(total)
    wide = flat.astype(np.uint32)
    out = []
    for j, k in _PATTERNS:
        at = np.flatnonzero((flat[:total] > 0) & (room > k) & (flat[j : total + j] > 0) & (flat[k : total + k] > 0))
        code = (wide[at] * np.uint32(0x9E3779B1) ^ wide[at + j] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35) + wide[at + k] * np.uint32(0x27D4EB2F)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((word[at], (code >> np.uint32(32 - FEATURE_BITS)).astype(np.int64), np.full(len(at), DECAY ** (k - 2), np.float32)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def values(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The folded machine's value of each word, without its bias; the kernel is normalised by the words' lengths in feature space."""
    word, place, w = subsequences(buf, starts, ends)
    norm = np.sqrt(np.maximum(np.bincount(word, w * w, len(starts)), 1e-9))
    return np.bincount(word, w * weight[place], len(starts)) / norm


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _located(buf: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """Starts, ends and rows of all words, with hashes of them and of their beginnings; in steps and in 32 bits, to save memory."""
    out, first = [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        at, part = offsets[first], buf[offsets[first] : offsets[last]]
        starts, ends, rows = windows(part, offsets[first : last + 1] - at)
        out.append(((starts + at).astype(np.int32), (ends + at).astype(np.int32), (rows + first).astype(np.int32), _HASH.of(part, starts, ends), _HASH.of(part, starts, np.minimum(ends, starts + STEM))))
        first = last
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Words:
    """Distinct words as sparse, normalised kernel features."""

    def __init__(self, texts: list[bytes]):
        buf, offsets = _flat(texts)
        word, place, w = subsequences(buf, offsets[:-1], offsets[1:])
        order = np.argsort(word, kind="stable")
        self.n, self.word, self.place = len(texts), word[order], place[order]
        self.w = w[order] / np.sqrt(np.maximum(np.bincount(word, w**2, len(texts)), 1e-9))[self.word]
        self.edges = np.searchsorted(self.word, np.arange(len(texts) + 1))

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, self.w * weight[self.place], self.n)

    def dense(self, i: int) -> np.ndarray:
        mine = slice(self.edges[i], self.edges[i + 1])
        return np.bincount(self.place[mine], self.w[mine], 1 << FEATURE_BITS)

    def against(self, others: Words) -> np.ndarray:
        """The kernel between these words and others."""
        return np.stack([self.dot(others.dense(i)) for i in range(others.n)], 1)


def _hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 20.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on the margin's violators."""
    x = np.c_[x, np.ones(len(x))]
    ridge = np.diag(np.r_[np.ones(x.shape[1] - 1), 1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ w) < 1
        z = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + cost * z.T @ x[inside], cost * z.T @ y[inside])
        if np.allclose(new, w, atol=1e-5):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(documents: list[tuple[str, int]]) -> dict:
    """The folded weights, the bias and the logistic curve, from (text, label) rows."""
    documents = list(dict.fromkeys(documents))  # copies would count as evidence
    texts = [(t or "").encode() for t, _ in documents]
    label = np.array([int(y) for _, y in documents], np.int64)
    del documents
    prior = (label.sum() + 1) / (len(label) + 2)
    flat = {"weight": np.zeros(1 << FEATURE_BITS, np.float32), "slope": 0.0, "offset": float(np.log(prior / (1 - prior)))}
    if len(set(label.tolist())) < 2:
        return flat
    # words, and in how many documents of each kind they are
    buf, offsets = _flat(texts)
    del texts
    starts, ends, rows, hashes, stems = _located(buf, offsets)
    if not len(starts):
        return flat
    keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    which = which.astype(np.int32)
    _, stem = np.unique(stems, return_inverse=True)
    stem = stem.astype(np.int32)
    del hashes, stems
    give_back()
    pairs = np.unique(rows * np.int64(len(keys)) + which)
    row, term = pairs // len(keys), pairs % len(keys)
    n1, n0 = int(label.sum()), int((label == 0).sum())
    in1, in0 = np.bincount(term[label[row] == 1], minlength=len(keys)), np.bincount(term[label[row] == 0], minlength=len(keys))

    def texts_of(terms):
        return Words([buf[starts[first[i]] : ends[first[i]]].tobytes() for i in terms])

    share = n1 / (n1 + n0)
    value = np.zeros(len(keys))
    sure = np.log(len(keys))  # so far from chance that hardly one of all words gets there by it
    ordinary = np.flatnonzero(in0 > 0)
    ordinary = np.unique(np.concatenate([ordinary[np.argsort(-in0[ordinary], kind="stable")[:2500]], ordinary[:: max(1, len(ordinary) // 2500)]]))
    # Telling words: they stand in more toxic documents, and behind more different words there, than chance
    # gives any of all words. What copies share always stands behind the same words.
    before = np.r_[np.int32(-1), which[:-1]]
    before[np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])] = -1

    def evidence(ids):
        """How far the toxic documents of each word, or of each beginning of words, are from chance."""
        n = int(ids.max()) + 1
        seen = np.unique(rows * np.int64(n) + ids)
        toxic, other = (np.bincount(seen[label[seen // n] == y] % n, minlength=n) for y in (1, 0))
        mine = label[rows] == 1
        company = np.unique(ids[mine] * np.int64(len(keys) + 1) + before[mine] + 1) // np.int64(len(keys) + 1)
        apart = np.minimum(toxic, np.bincount(company, minlength=n))
        rate = (apart + 0.05) / (apart + other + 0.1)
        return np.where(rate > share, apart * np.log(rate / share) + other * np.log((1 - rate + 1e-9) / (1 - share)), 0), rate

    gain, rate = evidence(which)
    give_back()
    stem_gain, stem_rate = (x[stem[first]] for x in evidence(stem))
    telling = np.flatnonzero(((gain > sure) & (rate > 0.8)) | ((stem_gain > sure) & (stem_rate > 0.95) & (in0 == 0)))
    gain = np.maximum(gain, 1e-3 * stem_gain)
    telling = telling[np.argsort(-gain[telling], kind="stable")[:2000]] if len(telling) else np.argsort(-gain, kind="stable")[:1]
    hard = np.zeros(0, np.int64)
    for turn in range(ROUNDS):
        plain = np.setdiff1d(np.union1d(ordinary, hard), telling)
        few = [telling[:LANDMARKS], hard[: 2 * LANDMARKS], plain[np.linspace(0, len(plain) - 1, min(LANDMARKS, len(plain))).astype(int)] if len(plain) else plain]
        marks = texts_of(np.unique(np.concatenate(few)))
        similar, vectors = np.linalg.eigh(marks.against(marks))
        good = similar > 1e-3
        half = (vectors[:, good] / np.sqrt(similar[good])) @ vectors[:, good].T  # K^-1/2
        sides = np.concatenate([telling, plain])
        y = np.r_[np.ones(len(telling)), -np.ones(len(plain))]
        mass = np.r_[np.sqrt(in1[telling]), np.sqrt(in0[plain])]
        mass[: len(telling)] *= mass[len(telling) :].sum() / max(mass[: len(telling)].sum(), 1e-9)
        w, bias = _hinge(texts_of(sides).against(marks) @ half, y, mass)
        coefficient = half @ w
        folded = np.bincount(marks.place, marks.w * coefficient[marks.word], 1 << FEATURE_BITS)
        for lo in range(0, len(keys), 8_000):
            part = first[lo : lo + 8_000]
            value[lo : lo + 8_000] = values(buf, starts[part], ends[part], folded) + bias
        # ordinary words on the wrong side are added, the worst first
        known = np.flatnonzero((in0 > 0) & (value > -0.7))
        known = known[np.argsort(-(value[known] + 0.7) * np.sqrt(in0[known]), kind="stable")[:1000]]
        known = np.setdiff1d(known, telling)
        hard = np.concatenate([known[np.argsort(-value[known], kind="stable")], np.setdiff1d(hard, known)])
    top = np.full(len(label), -1.0)
    np.maximum.at(top, row, value[term])
    slope, offset = _logistic(np.maximum(top, -1.0), label)
    give_back()
    return {"weight": folded.astype(np.float32), "slope": slope, "offset": offset + slope * bias, "least": -1.0 - bias}


def has_learned(model: dict) -> bool:
    """Were there documents of both kinds, with words in them; otherwise every score is the share of toxic labels."""
    return model["slope"] != 0.0


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """A logistic curve through (x, y) with softened targets, by Newton steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, centre = np.where(y == 1, hi, lo), x.mean()
    design, c = np.c_[x - centre, np.ones(len(x))], np.zeros(2)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ c, -30, 30)))
        g = design.T @ (weight * (p - target)) + 1e-3 * c
        h = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        c = c - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(c[0]), float(c[1] - c[0] * centre)


def labelled(docs: DataFrame, labels: DataFrame, usable) -> list[tuple[str, int]]:
    """The bounded sample of labelled documents that the fit sees."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))

    def some(label, n):
        return known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    few = some(1, TOXIC_DOCUMENTS).unionByName(some(0, OTHER_DOCUMENTS))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic")
    return [(r.text, r.toxic) for r in sorted(texts.toLocalIterator(), key=lambda r: (r.doc_id, r.text))]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` with ``score``; a column of this name is replaced."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs["text"].cast("string").alias("text"), *(f"`{f.name}`" for f in docs.schema if f.name not in ("text", "score")))

    def run(batches):
        m = model.value
        for rows, buf, offsets in slices(batches, most=1 << 20):
            top = np.full(len(offsets) - 1, m.get("least", -1.0))
            starts, ends, row = windows(buf, offsets)
            if len(starts):
                _, first, which = np.unique(_HASH.of(buf, starts, ends), return_index=True, return_inverse=True)
                value = values(buf, starts[first], ends[first], m["weight"])[which]
                heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                top[row[heads]] = np.maximum(top[row[heads]], np.maximum.reduceat(value, heads))
            score = 1 / (1 + np.exp(-np.clip(m["slope"] * top + m["offset"], -50, 50)))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(score)], [*rows.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; labels of those whose crc32(doc_id) modulo 5 is 0 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    model = fit(labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~out))
    return score(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
