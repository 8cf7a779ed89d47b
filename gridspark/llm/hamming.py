"""Exact top-k search in Hamming space by incremental multi-index hashing.

An embedding's code has one bit for each of its first 64 components (1 if positive). Codes are cut into
segments, each with an index of its own from segment value to codes. For r = 0, 1, 2, ... a query
looks up, in every index, the values that differ from its own segment in exactly r bits. After
radius r has been done in all m segments, every code at a distance up to m * (r + 1) - 1 has been
met (pigeonhole), so a query stops once its kth best distance is within that. The index is dealt
into shards by code and the queries into blocks; each pair of them is searched exactly, and a
query's best k of all shards are its result.

Of vectors with one code only the k + 1 least ids are indexed: ties go to the least ids, so no others
can be in a result (a query leaves itself out). Null embeddings and null ids are
left out; missing components, NaN and zero count as not positive; repeated rows count once; other
columns are ignored; fewer than k vectors give fewer rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch

BITS, SEGMENTS = 64, 4
K = 10
#: Vectors in a shard of the index and queries in a block (between these bounds, growing with the table). Every block meets every
#: shard, so the index is sent out once for each block: ``BLOCKS`` times, as long as blocks are below their upper bound.
SHARD, QUERIES_AT_ONCE, BLOCKS = (16_384, 4_000_000), (256, 500_000), 64


def code_of(embedding: Column) -> Column:
    """64 bits as a long, bit i for component i."""
    values = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.get(embedding, i))
    positive = F.transform(values, lambda v, i: F.when((v > 0) & ~F.isnan(v), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(positive, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def masks(bits: int, r: int) -> np.ndarray:
    """All segment values with r bits set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), r)], np.int64)


class Index:
    """Multi-index of some codes: for each segment, the codes by its value."""

    def __init__(self, codes: np.ndarray, m: int = SEGMENTS):
        self.codes, self.m, self.bits = codes, m, BITS // m
        self.tables, self.masks = [], {}
        for s in range(m):
            value = self.segment(codes, s)
            order = np.argsort(value, kind="stable")
            self.tables.append((order, np.searchsorted(value[order], np.arange((1 << self.bits) + 1))))

    def segment(self, codes, s: int):
        return ((codes >> np.uint64(s * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def nearest(self, code: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the codes up to the distance of the kth nearest, ties included."""
        code, parts = np.uint64(code), []
        seen = np.zeros(len(self.codes), bool)
        for r in range(self.bits + 1):
            if r not in self.masks:
                self.masks[r] = masks(self.bits, r)
            for s, (order, edges) in enumerate(self.tables):
                probe = int(self.segment(code, s)) ^ self.masks[r]
                lo, size = edges[probe], edges[probe + 1] - edges[probe]
                lo, size = lo[size > 0], size[size > 0]
                if len(lo):
                    at = order[np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                    at = at[~seen[at]]
                    seen[at] = True
                    parts.append(at)
            met = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            distance = np.bitwise_count(self.codes[met] ^ code).astype(np.int64)
            # all codes within m * (r + 1) - 1 have been met
            if len(met) >= k and np.partition(distance, k - 1)[k - 1] <= self.m * (r + 1) - 1 or len(met) == len(self.codes):
                break
        kth = np.partition(distance, k - 1)[k - 1] if len(met) > k else BITS
        return met[distance <= kth], distance[distance <= kth]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, m: int = SEGMENTS) -> DataFrame:
    """query_id, neighbour_id, distance, rank of the k nearest other vectors of each query; ``vectors`` has vec_id and embedding."""
    usable = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    coded = usable.select(F.col("vec_id").cast("long").alias("vec_id"), code_of(F.col("embedding")).alias("code"), is_query.alias("asks"))
    coded = Scratch(vectors.sparkSession, "hamming").table(coded, "codes")
    n, n_queries = coded.count(), coded.where("asks").count()
    # each task drops what is beyond the rank before the shuffle, so a code that most vectors share is no large group;
    # the dense one counts different ids, however often their rows are repeated
    rank = F.dense_rank().over(Window.partitionBy("code").orderBy("vec_id"))
    few = coded.select("vec_id", "code").withColumn("place", rank).where(F.col("place") <= k + 1).select("vec_id", "code").distinct()
    # every block of queries meets every shard of the index; a shard answers exactly, by its own multi-index
    shards = -(-n // min(max(n // 64, SHARD[0]), SHARD[1])) or 1
    blocks = -(-n_queries // min(max(n_queries // BLOCKS, QUERIES_AT_ONCE[0]), QUERIES_AT_ONCE[1])) or 1

    def dealt(df, column, mine, its_own, other, others):
        own = F.pmod(F.xxhash64(column), F.lit(mine)).cast("int").alias(its_own)
        return df.select("vec_id", "code", own, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    index = dealt(few, "code", shards, "shard", "block", blocks)
    asked = dealt(coded.where("asks").select("vec_id", "code").distinct(), "vec_id", blocks, "block", "shard", shards)

    def search(queries, rows):
        ids, codes = rows.column("vec_id").to_numpy(), rows.column("code").to_numpy().view(np.uint64)
        found, out = Index(codes, m), []
        for i, code in zip(queries.column("vec_id").to_pylist(), queries.column("code").to_numpy().view(np.uint64).tolist(), strict=True):
            at, distance = found.nearest(code, min(k + 1, len(codes)))
            keep = ids[at] != i
            at, distance = at[keep], distance[keep]
            best = np.lexsort((ids[at], distance))[:k]
            out.append((np.full(len(best), i), ids[at[best]], distance[best]))
        q, n, d = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query_id": pa.array(q.astype(np.int64)), "neighbour_id": pa.array(n.astype(np.int64)), "distance": pa.array(d.astype(np.int32))})

    met = asked.groupBy("shard", "block").cogroup(index.groupBy("shard", "block")).applyInArrow(search, "query_id bigint, neighbour_id bigint, distance int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of each one whose id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def oracle(k: int = K) -> str:
    """The same by comparing all pairs, for DuckDB."""
    bits = " + ".join(f"(CASE WHEN embedding[{i + 1}] > 0 AND NOT isnan(embedding[{i + 1}]) THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END)" for i in range(BITS))
    return f"""
WITH codes AS (SELECT DISTINCT vec_id, CAST({bits} AS UBIGINT) AS code FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
near AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbour_id, CAST(bit_count(CAST(xor(q.code, n.code) AS BIT)) AS INTEGER) AS distance
  FROM codes q JOIN codes n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, neighbour_id, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM near
) WHERE rank <= {k}"""
