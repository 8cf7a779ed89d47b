"""Line dedup by repeated runs of lines, and by content-defined chunks of lines.

``dedup_passages`` finds a repeated passage wherever it stands: every run of two or more neighbouring
lines that just reaches ``LEAST_BYTES`` is a unit, from each line onwards and from each line backwards,
and so is a line of ``LONG_LINE`` bytes. Of a unit that occurs more than once anywhere, the first
occurrence by doc_id and place stays and all lines of the others go. A chunk is then a run of lines
with one fate: its boundaries come from the counts of all documents, and fall in step with the passage's
first and last line whatever stands around it. Every removed line stays somewhere before; of three or more
equal lines in a row one stays. Repeated runs that have fewer than ``LEAST_BYTES`` bytes in all stay, unless
``every_line`` is asked for.

``dedup_lines`` cuts each document by itself, and misses most short passages. A rolling hash over the hashes of the last ``WINDOW`` lines ends a chunk where it is 0 modulo
``MEAN``, so the boundaries inside a repeated passage are the same wherever it stands; chunks
have 2 to ``LONGEST`` lines (the rest of a document may be a single line). A line of ``LONG_LINE``
bytes or more is a paragraph of its own and a chunk by itself. A chunk of two or more lines, or of a
long one, that occurs more than once anywhere is kept where it comes first, by doc_id and
place, and removed elsewhere. Hashes only pick the candidates; what counts as a repetition is
decided on the chunks' bytes.

Null texts are empty; rows with a null doc_id come first; rows equal in doc_id and text are one
occurrence and are treated alike; other columns are kept as they are; an empty table gives no
rows. Lines are separated by line feeds and compared byte by byte; blank lines count as lines.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import ByteHash, Scratch, mix64, release, slices, text_of

WINDOW, MEAN, LONGEST, LONG_LINE = 2, 2, 16, 240
#: Chunks and runs with fewer bytes than this are left alone: short headings repeat by chance.
LEAST_BYTES = 40
_HASH = ByteHash(seed=53)


def line_ranges(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines (with their line feed) of all rows, and their rows. Empty texts have none."""
    n = len(buf)
    stops = np.union1d(np.flatnonzero(buf == 10) + 1, offsets[offsets > 0])
    stops = stops[stops <= n]
    starts = np.r_[0, stops[:-1]].astype(np.int64) if len(stops) else np.zeros(0, np.int64)
    return starts, stops, np.searchsorted(offsets, starts, side="right") - 1


def chunk_ranges(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte, row and number of lines of the chunks."""
    starts, stops, rows = line_ranges(buf, offsets)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    feed = buf[stops - 1] == 10
    lines = _HASH.ranges(_HASH.prefix(buf), starts, stops - feed)  # the last line of a text may lack its line feed
    rolled = lines.copy()
    for k in range(1, WINDOW):
        rolled[k:] += mix64(lines[:-k] + np.uint64(k))
    cut = mix64(rolled) % np.uint64(MEAN) == 0
    last = np.r_[rows[1:] != rows[:-1], True]
    long = stops - starts >= LONG_LINE
    last |= long | np.r_[long[1:], True]
    ends, size = [], 0
    for i, (c, e) in enumerate(zip(cut.tolist(), last.tolist(), strict=True)):
        size += 1
        if e or size >= LONGEST or (c and size >= 2):
            ends.append(i)
            size = 0
    ends = np.array(ends)
    firsts = np.r_[0, ends[:-1] + 1]
    return starts[firsts], stops[ends], rows[firsts], ends - firsts + 1


def chunk_units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and end byte (without the last line feed) and row of the chunks, and which may be removed."""
    first, end, row, lines = chunk_ranges(buf, offsets)
    feed = buf[end - 1] == 10
    return first, end - feed, row, ((lines >= 2) & (end - feed - first >= LEAST_BYTES)) | (end - first >= LONG_LINE)


def run_ranges(starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, every_line: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the units: the shortest runs of two or more lines and ``LEAST_BYTES`` bytes from each line
    onwards and backwards, and long lines; with ``every_line`` each line, of which all runs consist. ``ends`` are without line feeds."""
    n = len(starts)
    line = np.arange(n)
    if every_line:
        return line, line
    on = np.maximum(np.searchsorted(ends, starts + LEAST_BYTES), line + 1)
    back = np.minimum(np.searchsorted(starts, ends - LEAST_BYTES, side="right") - 1, line - 1)
    long = line[ends - starts + 1 >= LONG_LINE]
    i, j = np.r_[line, back, long], np.r_[on, line, long]
    whole = np.flatnonzero((i >= 0) & (j < n))
    whole = whole[rows[i[whole]] == rows[j[whole]]]
    key = np.unique(i[whole] * n + j[whole])
    return key // max(n, 1), key % max(n, 1)


def run_units(buf: np.ndarray, offsets: np.ndarray, every_line: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same as ``chunk_units`` for the runs of ``run_ranges``, which overlap."""
    starts, stops, rows = line_ranges(buf, offsets)
    ends = stops - (buf[stops - 1] == 10)
    i, j = run_ranges(starts, ends, rows, every_line)
    return starts[i], ends[j], rows[i], np.ones(len(i), bool)


def keyed(docs: DataFrame) -> DataFrame:
    """text, _id, _th (which tell documents apart and order them) and ``rest``, all other columns whatever their names."""
    rest = F.struct(*(f"`{f.name}`" for f in docs.schema if f.name != "text"))
    return docs.select(text_of(docs).alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)).cast("long")).alias("_id"), F.xxhash64(text_of(docs)).alias("_th"), rest.alias("rest"))


def chunks(texts: DataFrame, units=chunk_units, only: bool = False) -> DataFrame:
    """_id, _th, n, hash of each chunk or run of ``texts`` (text, _id, _th) that may be removed if it repeats.
    ``only``: just those numbered in the fourth column, with their bytes."""

    def run(batches):
        for rows, buf, offsets in slices(batches):
            first, end, row, able = units(buf, offsets)
            number = np.arange(len(row)) - np.searchsorted(row, row)
            if only:
                edges, wanted = np.searchsorted(row, np.arange(len(offsets))), np.zeros(len(row), bool)
                for i, mine in enumerate(rows.column(3).to_pylist()):
                    wanted[edges[i] + np.array(mine, np.int64)] = True
                able &= wanted
            keep = np.flatnonzero(able)
            first, end, row = first[keep], end[keep], pa.array(row[keep])
            out = [rows.column(1).take(row), rows.column(2).take(row), pa.array(number[keep].astype(np.int32)), pa.array(_HASH.ranges(_HASH.prefix(buf), first, end).view(np.int64))]
            if only:
                raw = buf.tobytes()
                out.append(pa.array([raw[a:b] for a, b in zip(first, end, strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["_id", "_th", "n", "hash", "body"][: len(out)])

    return texts.mapInArrow(run, "_id bigint, _th bigint, n int, hash bigint" + ", body binary" * only)


def repeated(texts: DataFrame, scratch: Scratch, units=chunk_units) -> DataFrame:
    """_id, _th, gone: the chunks (or runs) to remove from each document that has some."""
    found = chunks(texts, units)
    counts = found.groupBy("hash").agg(F.count("*").alias("copies")).where("copies > 1").select("hash")
    wanted = scratch.table(found.join(counts, "hash").groupBy("_id", "_th").agg(F.collect_set("n").alias("wanted")), "wanted")
    # the bytes of those alone; merge joins at any size, as the texts would not fit a broadcast at most sizes
    candidates = scratch.table(chunks(texts.join(wanted.hint("merge"), ["_id", "_th"]).select("text", "_id", "_th", "wanted"), units, only=True), "candidates")
    release(texts.sparkSession)
    # grouping by the bytes is the comparison; each task sends one row for a chunk, however often it has it
    place = F.struct("_id", "_th", "n")
    first = candidates.groupBy("hash", "body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    gone = candidates.join(first.select("hash", "body", "first"), ["hash", "body"]).where(place != F.col("first"))
    return gone.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("n")).alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated chunks cut out of ``text``; adds (or replaces) ``n_chunks`` and ``n_removed`` (chunks)."""
    scratch = Scratch(docs.sparkSession, "line-dedup")
    rows = keyed(docs)
    gone = scratch.table(repeated(rows.select("text", "_id", "_th"), scratch), "gone")
    scratch.drop("candidates")
    joined = rows.join(gone.hint("merge"), ["_id", "_th"], "left").select("text", "gone", "rest")

    def run(batches):
        for rows, buf, offsets in slices(batches):
            first, end, row, _ = chunk_ranges(buf, offsets)
            edges, raw, texts, n_gone = np.searchsorted(row, np.arange(len(offsets))), buf.tobytes(), [], []
            for i, mine in enumerate(rows.column(1).to_pylist()):
                a, b = edges[i], edges[i + 1]
                if not mine:
                    texts.append(raw[offsets[i] : offsets[i + 1]])
                else:
                    out = set(mine)
                    kept = b"".join(raw[first[k] : end[k]] for k in range(a, b) if k - a not in out)
                    texts.append(kept.removesuffix(b"\n") if raw[offsets[i + 1] - 1 : offsets[i + 1]] != b"\n" else kept)
                n_gone.append(len(mine or ()))
            n_all = np.diff(edges).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), rows.column(2), pa.array(n_all), pa.array(n_gone, pa.int32())], ["text", "rest", "n_chunks", "n_removed"])

    out = joined.mapInArrow(run, f"text string, rest {joined.schema['rest'].dataType.simpleString()}, n_chunks int, n_removed int")
    own = [F.col("text") if f.name == "text" else F.col(f"rest.`{f.name}`") for f in docs.schema if f.name not in ("n_chunks", "n_removed")]
    return out.select(*own, "n_chunks", "n_removed")


def dedup_passages(docs: DataFrame, every_line: bool = False) -> DataFrame:
    """The rows of ``docs`` with repeated runs of lines cut out of ``text``; adds (or replaces) ``n_chunks`` and ``n_removed`` (runs of lines with one fate).
    ``every_line``: no run is too short, single and blank lines go too wherever they stand before."""
    scratch = Scratch(docs.sparkSession, "passage-dedup")
    rows = keyed(docs)
    gone = scratch.table(repeated(rows.select("text", "_id", "_th"), scratch, partial(run_units, every_line=every_line)), "gone")
    scratch.drop("candidates")
    joined = rows.join(gone.hint("merge"), ["_id", "_th"], "left").select("text", "gone", "rest")

    def run(batches):
        for rows, buf, offsets in slices(batches):
            starts, stops, of = line_ranges(buf, offsets)
            first, last = run_ranges(starts, stops - (buf[stops - 1] == 10), of, every_line)
            edges, cover = np.searchsorted(of[first], np.arange(len(offsets) - 1)), np.zeros(len(starts) + 1, np.int64)
            for i, mine in enumerate(rows.column(1).to_pylist()):
                if mine:
                    at = edges[i] + np.array(mine, np.int64)
                    np.add.at(cover, first[at], 1)
                    np.add.at(cover, last[at] + 1, -1)
            out = np.cumsum(cover)[:-1] > 0
            heads = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (out[1:] != out[:-1])][: len(of)])
            begin, end = starts[heads], stops[np.r_[heads[1:], len(of)][: len(heads)] - 1]
            row, out = of[heads], out[heads]
            n_all, n_gone = (np.bincount(x, minlength=len(offsets) - 1).astype(np.int32) for x in (row, row[out]))
            at, raw, texts = np.searchsorted(row, np.arange(len(offsets))), buf.tobytes(), []
            for i, some in enumerate(n_gone.tolist()):
                text = raw[offsets[i] : offsets[i + 1]]
                if some:
                    kept = b"".join(raw[begin[k] : end[k]] for k in range(at[i], at[i + 1]) if not out[k])
                    text = kept if text.endswith(b"\n") else kept.removesuffix(b"\n")
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), rows.column(2), pa.array(n_all), pa.array(n_gone)], ["text", "rest", "n_chunks", "n_removed"])

    out = joined.mapInArrow(run, f"text string, rest {joined.schema['rest'].dataType.simpleString()}, n_chunks int, n_removed int")
    own = [F.col("text") if f.name == "text" else F.col(f"rest.`{f.name}`") for f in docs.schema if f.name not in ("n_chunks", "n_removed")]
    return out.select(*own, "n_chunks", "n_removed")


def op7_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: how many chunks they had and lost, and a digest of what is left."""
    out = dedup_passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_chunks", "n_removed", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
