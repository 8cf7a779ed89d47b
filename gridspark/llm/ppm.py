"""Scoring by prediction by partial matching over byte contexts.

A text is a row of symbols, its bytes and an end; each is predicted from the ``order`` symbols before
it. Escapes are estimated by method D (half of the distinct followers, of the count), and a
symbol that a longer context has ruled out is excluded from the shorter ones.

The trie holds every context of the training texts, so it grows with the corpus and is never in one
place. Documents are dealt into chunks. A chunk sends each distinct context with its follower
once, with its count in the training texts, to the bucket of the context's last ``DEALT`` symbols; there all
longer contexts that end alike meet. A bucket builds its branch of the trie, works out the
probability of each follower and sends it back (as a 32-bit logarithm) to the chunks that asked; shorter contexts
are the same for all buckets: they have at most 257**3 followers whatever the corpus, a few hundred thousand
in texts. A text's score is then a sum over its symbols.

The mode "adaptive" starts each text with an empty trie and learns as it goes: plain Python
for each byte, meant for short texts.

Null texts are empty: one end symbol, one end token. Null doc_ids count as empty id text;
repeated rows count and are scored as often as they occur; other columns are ignored; an empty table gives no
rows. Without training texts all symbols are equally likely.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, WordHash, held_out, mix64, packed, release, slices, text_bytes, text_of, unpacked, words

ORDER = 5
#: Tokens seen most often are looked up in the tasks, at most so many; the rest by a join.
COMMON_TOKENS = 300_000
EDGE = 256  # stands before and after each text
SYMBOLS = 257
#: Bytes of text in a chunk and behind a bucket, whatever the input.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 8 << 20
#: Contexts are dealt out by so many of their last symbols, so that the commonest end of a context is a small share of all.
DEALT = 3
_BITS = 9
_HASH = WordHash(seed=31, lower=True)


def _last(keys: np.ndarray, symbols: int) -> np.ndarray:
    return keys & np.uint64((1 << _BITS * symbols) - 1)


def grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol to predict, packed with the ``order`` symbols before it (the follower in the lowest bits), and where each text's begin."""
    n, rows = len(buf), len(offsets) - 1
    length = np.diff(offsets)
    first = offsets[:-1] + (order + 1) * np.arange(rows) + order
    seq = np.full(n + (order + 1) * rows, EDGE, np.uint64)
    seq[np.repeat(first - offsets[:-1], length) + np.arange(n)] = buf
    at = np.repeat(first - offsets[:-1] - np.arange(rows), length + 1) + np.arange(n + rows)
    keys = np.zeros(len(at), np.uint64)
    for k in range(order, -1, -1):
        keys = (keys << np.uint64(_BITS)) | seq[at - k]
    return keys, offsets[:-1] + np.arange(rows)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def counted_tokens(texts: DataFrame, held: int = 1_500_000) -> DataFrame:
    """key, n: hashes of the tokens and how often they occur."""

    def run(batches):
        parts, size = [], 0
        for _, buf, offsets in slices(batches):
            starts, ends, _ = words(buf, offsets)
            if len(starts):
                parts.append(np.unique(_HASH.of(buf, starts, ends).view(np.int64), return_counts=True))
                size += len(parts[-1][0])
            if size > held:
                parts = [merged(parts)]
                size = len(parts[0][0])
                if size > held:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0]), pa.array(parts[0][1])], ["key", "n"])
                    parts, size = [], 0
        if parts:
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["key", "n"])

    return texts.select("text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least count t such that at most ``most`` rows have it or more; from a histogram on a logarithmic scale."""
    step = F.floor(F.log2("n") * 64)
    seen, t = 0, 1 << 62
    for _, count, least in sorted(counts.groupBy(step.alias("step")).agg(F.count("*"), F.min("n")).collect(), reverse=True):  # 64 rows for each power of two
        if seen + count > most:
            break
        seen, t = seen + count, least
    return t


class Branch:
    """Contexts of all lengths with their followers: those of ``dealt`` symbols and more from ``keys``, the shorter ones from ``short``."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray, order: int, dealt: int = 2):
        self.order, self.levels = order, {}
        for d in range(order, dealt - 1, -1):
            keys, n = merged([(_last(keys, d + 1), n)])
            self.levels[d] = [keys, n]
        for d in range(dealt - 1, -1, -1):
            self.levels[d] = [*merged([(_last(short, d + 1), short_n)])]
        for d, level in self.levels.items():
            keys, n = level
            contexts = keys >> np.uint64(_BITS)
            head = np.flatnonzero(np.r_[True, contexts[1:] != contexts[:-1]]) if len(keys) else np.zeros(0, np.int64)
            total = np.add.reduceat(n, head) if len(keys) else np.zeros(0, np.int64)
            ruled_out = np.zeros(len(head), np.int64)  # what the followers count for in the next shorter context
            if d and len(keys):
                shorter, count = self.levels[d - 1][:2]
                ruled_out = np.add.reduceat(count[np.searchsorted(shorter, _last(keys, d))], head)
            level += [contexts[head], total, np.diff(np.r_[head, len(keys)]), ruled_out]

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the follower of each key in its context."""
        out, done = np.zeros(len(keys)), np.zeros(len(keys), bool)
        # followers of a context also follow its shorter ones, so those of the longer one are what is excluded
        ruled_out, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for d in range(self.order, -1, -1):
            followers, n, contexts, total, distinct, more = self.levels[d]
            if not len(contexts):
                continue
            context, pair = _last(keys >> np.uint64(_BITS), d), _last(keys, d + 1)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            here = contexts[at] == context
            left = total[at] - ruled_out
            live = here & ~done & (left > 0)
            to = np.minimum(np.searchsorted(followers, pair), len(followers) - 1)
            found = live & (followers[to] == pair)
            out[found] += np.log10((2 * n[to[found]] - 1) / (2 * left[found]))
            done |= found
            missed = live & ~found
            out[missed] += np.log10((distinct[at[missed]] - known[missed]) / (2 * left[missed]))
            ruled_out, known = np.where(here, more[at], ruled_out), np.where(here, distinct[at], known)
        out[~done] -= np.log10(np.maximum(SYMBOLS - known[~done], 1))
        return out


def _count_chunk(order: int, n_buckets: int):
    shift = np.uint64(64 - (n_buckets - 1).bit_length())

    def run(key, table):
        parts = []
        for rows, buf, offsets in slices(table.to_batches()):
            keys, first = grams(buf, offsets, order)
            learns = np.repeat(rows.column(2).to_numpy(zero_copy_only=False).astype(np.uint64), np.diff(np.r_[first, len(keys)]))
            both, counts = np.unique((keys << np.uint64(1)) | learns, return_counts=True)
            parts.append((both >> np.uint64(1), np.where(both & np.uint64(1), counts, 0)))
        keys, n = merged(parts)
        dealt = min(DEALT, order)
        short, short_n = merged([(_last(keys[n > 0], dealt), n[n > 0])])
        bucket = (mix64(_last(keys >> np.uint64(_BITS), dealt)) >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(keys), np.int64)
        by = np.argsort(bucket, kind="stable")
        keys, n, edges = keys[by], n[by], np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        out = [(int(b), packed(keys[edges[b] : edges[b + 1]]), n[edges[b] : edges[b + 1]]) for b in full]
        if len(short):
            out.append((-1, packed(short), short_n))
        return pa.table(
            {
                "bucket": pa.array([x[0] for x in out], pa.int32()),
                "chunk": pa.array([key[0].as_py()] * len(out), pa.int32()),
                "keys": pa.array([x[1] for x in out], pa.binary()),
                "counts": pa.array([x[2].astype("<u4").tobytes() for x in out], pa.binary()),
            }
        )

    return run


def _short(batches):
    for batch in batches:
        parts = [(unpacked(k), np.frombuffer(n, "<u4").astype(np.int64)) for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if parts:
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n)], ["key", "n"])


def _answer(order: int, shared):
    def run(key, table):
        parts = [unpacked(b) for b in table.column("keys").to_pylist()]
        counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()])
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(of, counts, len(keys)).astype(np.int64)
        logs = Branch(keys[n > 0], n[n > 0], *shared.value, order, min(DEALT, order)).log10(keys).astype("<f4")[of]
        edges = np.cumsum([0, *map(len, parts)])
        return pa.table({"chunk": table.column("chunk"), "keys": table.column("keys"), "logs": pa.array([logs[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    return run


def adaptive_score(text: bytes, order: int = ORDER) -> float:
    """log10 probability of one text by a trie that starts empty and learns as it goes."""
    counts: dict[tuple, dict[int, int]] = defaultdict(dict)
    seq, total = [EDGE] * order + list(text) + [EDGE], 0.0
    for i in range(order, len(seq)):
        s, excluded, done = seq[i], set(), False
        for d in range(order, -1, -1):
            left = {x: c for x, c in counts[(*seq[i - d : i],)].items() if x not in excluded}
            if not left:
                continue
            below = 2 * sum(left.values())
            if s in left:
                total += math.log10((2 * left[s] - 1) / below)
                done = True
                break
            total += math.log10(len(left) / below)
            excluded |= left.keys()
        if not done:
            total -= math.log10(SYMBOLS - len(excluded))
        for d in range(order + 1):
            followers = counts[(*seq[i - d : i],)]
            followers[s] = followers.get(s, 0) + 1
    return total


_SCORED = "row bigint, doc_id bigint, n_tokens bigint, n_known bigint, logs double, score double, rare array<bigint>"


def _score_chunk(order: int, mode: str, shared):
    def run(docs, replies):
        known, log_count, end_count = shared.value
        keys, logs = np.zeros(0, np.uint64), np.zeros(0, "<f4")
        if len(replies):
            keys = np.concatenate([unpacked(b) for b in replies.column("keys").to_pylist()])
            logs = np.concatenate([np.frombuffer(b, "<f4") for b in replies.column("logs").to_pylist()])
            by = np.argsort(keys)
            keys, logs = keys[by], logs[by]
        out, number = [], 0
        for rows, buf, offsets in slices(docs.to_batches()):
            size = len(offsets) - 1
            starts, ends, row = words(buf, offsets)
            hashes = _HASH.of(buf, starts, ends).view(np.int64)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            base = np.bincount(row[hit], log_count[at[hit]], size) + np.log10(end_count + 1.0)
            if mode == "pretrained":
                mine, first = grams(buf, offsets, order)
                mine, which = np.unique(mine, return_inverse=True)
                scores = np.add.reduceat(logs[np.searchsorted(keys, mine)].astype(np.float64)[which], first)
            else:
                scores = np.array([adaptive_score(buf[a:b].tobytes(), order) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            rare = np.searchsorted(row[~hit], np.arange(size + 1)).astype(np.int32)
            out.append(
                pa.table(
                    {
                        "row": pa.array((rows.column(3).to_numpy().astype(np.int64) << 32) + number + np.arange(size)),
                        "doc_id": rows.column(1),
                        "n_tokens": pa.array(np.bincount(row, minlength=size) + 1),
                        "n_known": pa.array(np.bincount(row[hit], minlength=size) + int(end_count > 0)),
                        "logs": pa.array(base),
                        "score": pa.array(scores),
                        "rare": pa.ListArray.from_arrays(pa.array(rare), pa.array(hashes[~hit])),
                    }
                )
            )
            number += size
        if out:
            return pa.concat_tables(out)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()))
        return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(_SCORED.split(", "), types, strict=True)})

    return run


def score(docs: DataFrame, learns: Column, order: int = ORDER, mode: str = "pretrained") -> DataFrame:
    """For each row of ``docs``: the log10 probability of its text and a unigram baseline over tokens, learned from the rows where ``learns`` is true."""
    if not 2 <= order <= 6:
        raise ValueError("contexts have 2 to 6 symbols")
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    total = text_bytes(docs)
    n_chunks = -(-total // CHUNK_BYTES) or 1
    n_buckets = 1 << ((-(-total // BUCKET_BYTES) or 1) - 1).bit_length()
    doc_id = docs["doc_id"].cast("long")
    chunk = F.pmod(F.xxhash64(doc_id, text_of(docs)), F.lit(n_chunks)).cast("int")
    dealt = docs.select(text_of(docs).alias("text"), doc_id.alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("learns"), chunk.alias("chunk"))
    training = dealt.where("learns")
    tokens = scratch.table(counted_tokens(training), "tokens")
    end_count = training.count()
    n_words, n_distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n, v = n_words + end_count, n_distinct + (end_count > 0)
    least = frequent(tokens, COMMON_TOKENS)
    common = tokens.where(F.col("n") >= least).toArrow()
    keys, logs = common.column(0).to_numpy(), np.log10(common.column(1).to_numpy() + 1.0)
    by_key = np.argsort(keys)
    replies = spark.createDataFrame([], "chunk int, keys binary, logs binary")
    if mode == "pretrained":
        counts = scratch.table(dealt.groupBy("chunk").applyInArrow(_count_chunk(order, n_buckets), "bucket int, chunk int, keys binary, counts binary"), "grams")
        release(spark)
        # at most 257 ** DEALT rows
        short = counts.where("bucket < 0").select("keys", "counts").mapInArrow(_short, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        shorter = spark.sparkContext.broadcast((short.column(0).to_numpy().astype(np.uint64), short.column(1).to_numpy().astype(np.int64)))
        replies = scratch.table(counts.where("bucket >= 0").groupBy("bucket").applyInArrow(_answer(order, shorter), "chunk int, keys binary, logs binary"), "replies", compression="none")
        scratch.drop("grams")
    unigrams = spark.sparkContext.broadcast((keys[by_key], logs[by_key], end_count))
    scored = scratch.table(dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score_chunk(order, mode, unigrams), _SCORED), "scored")
    scratch.drop("replies")
    found = scored.select("row", F.explode("rare").alias("key")).join(tokens.where(F.col("n") < least), "key")
    found = found.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_logs"))
    base = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(n + v + 1))
    return scored.drop("rare").join(found, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by a trie of those whose crc32(doc_id) modulo 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 7, 2)
    return score(docs, ~out).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
