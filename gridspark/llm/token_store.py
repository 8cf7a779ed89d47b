"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

Layout below ``path`` (all Parquet, so any store that Spark reads will do):

* ``dictionary`` - one row: the dictionary's bytes, its sha256, the width of an id;
* ``blocks`` - frames of about ``block_bytes``, in ascending doc_id order. A row holds the
  concatenated frames and the index of its documents: id, tokens, first byte, tokens before it
  within its part; ``first_id``/``last_id`` let a reader skip blocks;
* ``parts`` - for each written part, the ids of all documents before it.

Null texts are empty documents (the end id only), null doc_ids come first, repeated doc_ids
stay separate documents (ordered by their frames), other columns are ignored, and an empty
table gives empty files. A long text is one frame; nothing is cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, slices, text_of
from gridspark.llm.tokens import default_vocabulary, documents_ids

#: The dictionary is fitted on so many documents, those of the least hashes of their texts, and on so many bytes of each, from
#: a place in its ids that the hash chooses.
SAMPLE_DOCUMENTS, SAMPLE_BYTES = 1024, 16384
DICTIONARY_BYTES = 65536
LEVEL = 3

_INDEX = "doc_ids array<bigint>, counts array<bigint>, starts array<bigint>, bytes_at array<bigint>"
_BLOCKS = f"part int, block int, first_id bigint, last_id bigint, n_tokens bigint, dictionary_sha256 string, {_INDEX}, frames binary"


def _width(vocabulary: str, end_id: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4


def _serialized(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, width: int) -> Iterator[tuple[pa.Array, list[int], list[bytes]]]:
    for rows, buf, offsets in slices(batches):
        ids = list(documents_ids(vocabulary, buf, offsets, end_id))
        yield rows.column(0), [len(x) for x in ids], [x.astype(f"<u{width}").tobytes() for x in ids]


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, width: int, sample: int = SAMPLE_DOCUMENTS) -> bytes:
    """A zstandard dictionary from the serialized ids of a hash sample of documents; empty if there is too little to learn from."""
    import zstandard

    hashed = docs.select(text_of(docs).alias("text")).where("text != ''").withColumn("hash", F.xxhash64("text"))
    # the hashes alone meet to find the bound; then one text of each hash below it
    bound = hashed.select("hash").distinct().orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]
    picked = hashed.where(F.col("hash") <= F.lit(bound)).dropDuplicates(["hash"]).select("hash", "text")

    def run(batches):
        for rows, buf, offsets in slices(batches):
            out = []
            for h, ids in zip(rows.column(0).to_pylist(), documents_ids(vocabulary, buf, offsets, end_id), strict=True):
                first = h % max(1, len(ids) - SAMPLE_BYTES // width + 1)
                out.append(ids[first : first + SAMPLE_BYTES // width].astype(f"<u{width}").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    rows = sorted(bytes(r.ids) for r in picked.mapInArrow(run, "ids binary").collect())  # ``sample`` short rows
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r for r in rows if len(r) > 16]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, block_bytes: int = 1 << 20) -> None:
    """Encodes whole texts of ``docs`` (doc_id, text) and writes the files below ``path``."""
    spark, vocabulary = docs.sparkSession, vocabulary or default_vocabulary()
    width = _width(vocabulary, end_id)
    dictionary = train_dictionary(docs, vocabulary, end_id, width)
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, width, bytearray(dictionary))], "sha256 string, width int, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for ids, counts, blobs in _serialized(batches, vocabulary, end_id, width):
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array([squeeze.compress(b) for b in blobs], pa.binary())], ["doc_id", "n_tokens", "frame"])

    def block(batches):
        part, number, before, held, rows = TaskContext.get().partitionId(), 0, 0, 0, []

        def built():
            ids, counts, frames = zip(*rows, strict=True)
            at = np.cumsum([0, *map(len, frames)])[:-1]
            starts = start + np.cumsum([0, *counts])[:-1]
            values = [part, number, ids[0], ids[-1], int(sum(counts)), sha, list(ids), list(counts), starts.tolist(), at.tolist(), b"".join(frames)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [f.split()[0] for f in _BLOCKS.split(", ")])

        start = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                held += len(row[2])
                before += row[1]
                if held >= block_bytes:
                    yield built()
                    number, held, rows, start = number + 1, 0, [], before
        if rows:
            yield built()

    scratch = Scratch(spark, "token-store")
    frames = scratch.table(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(compress, "doc_id bigint, n_tokens bigint, frame binary"), "frames", compression="none")
    # ranges of ids and, within one id, of frames: repeated and null ids may be many rows
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("frame"), F.col("frame")]
    ordered = frames.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(block, _BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop()
    totals = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    # one row for each written part
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.select("part", before.alias("part_start"), "n_tokens").coalesce(1).write.parquet(f"{path}/parts")


def read_store(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of all documents or of some; these are found by the index alone."""
    sha, width, dictionary = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, wanted = bytes(dictionary), None if doc_ids is None else set(doc_ids)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    if wanted is not None:
        near = F.lit(False)
        for i in sorted(wanted):
            near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
        blocks = blocks.where(near)
    parts = spark.read.schema("part int, part_start bigint, n_tokens bigint").parquet(f"{path}/parts").select("part", "part_start")

    def decode(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_sha256"] != sha:
                    raise ValueError(f"block {row['block']} of part {row['part']} was written with another dictionary")
                ends = [*row["bytes_at"][1:], len(row["frames"])]
                picked = [k for k, i in enumerate(row["doc_ids"]) if wanted is None or i in wanted]
                ids = [np.frombuffer(open_.decompress(row["frames"][row["bytes_at"][k] : ends[k]], max_output_size=row["counts"][k] * width), f"<u{width}").astype("<u4").tobytes() for k in picked]
                if any(len(x) != 4 * row["counts"][k] for x, k in zip(ids, picked, strict=True)):
                    raise ValueError(f"a frame of block {row['block']} of part {row['part']} has another length than its index says")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][k] for k in picked], pa.int64()),
                        pa.array([row["part_start"] + row["starts"][k] for k in picked], pa.int64()),
                        pa.array([row["counts"][k] for k in picked], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    # parts has one short row for each task that wrote blocks
    return blocks.join(F.broadcast(parts), "part").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = Scratch(spark, "op4").root
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
