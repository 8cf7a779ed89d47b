"""What the operators of this subpackage share: the scratch folder, Arrow
slices of whole texts, and vectorised hashing of bytes, words and shingles."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch, at most.
BATCH_ROWS = 1000
#: And bytes: a few very long texts are batches of their own.
BATCH_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where it is unset, as in tests, a local session gets a temporary folder;
    on a cluster that would not be seen by the executors, so it is an error.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("gridspark.scratch.dir", None)
    if not folder:
        if not conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="gridspark-")
        spark.conf.set("gridspark.scratch.dir", folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Whole texts are long: Arrow batches of the default 10,000 rows would take hundreds of megabytes on either side."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Parquet tables of one run in the shared folder: they cut the lineage, so a lost executor
    costs one stage at most."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, **options) -> DataFrame:
        df.write.options(**options).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str = "") -> None:
        """Frees a table that no later step reads, and asks the driver to let go of finished shuffles."""
        self.forget(name)
        release(self.spark)

    def forget(self, name: str = "") -> None:
        """Removes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Shuffle files live until the driver's heap is collected; a large job can ask for that between steps.
    The cleaner works beside the driver: it gets a moment, and what that let go of a second call."""
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def give_back() -> None:
    """Returns freed memory to the system. Python workers outlive their tasks, and what one stage's arrays took would stay with them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def text_of(docs: DataFrame) -> Column:
    """The text, an empty one for null."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def text_bytes(docs: DataFrame) -> int:
    """All bytes of text, for the number of partitions."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_of(docs)).cast("long")), F.lit(0))).first()[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts batches into runs of rows with about ``most`` bytes of whole texts; yields the rows, their bytes and the offsets of the rows in these."""
    for batch in batches:
        array = batch.column(batch.schema.get_field_index(column))
        if array.null_count:
            array = array.fill_null("")
        wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
        if not len(array):
            continue
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(array):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last
    give_back()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (the public splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class ByteHash:
    """Polynomial hashes mod 2**64 of any byte ranges of a buffer, from prefix sums.

    ``values`` maps a byte to a 64-bit number (bytes that map to one number are equal)."""

    #: Powers for a usual slice, kept; those for longer texts are worked out anew.
    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, seed: int = 1, lower: bool = False):
        values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.values = values[_LOWER] if lower else values
        self.base = int(mix64(np.array([seed + 77], np.uint64))[0]) | 1

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(self.base)
        if have is None or len(have[0]) < n:
            usual = SLICE_BYTES + 1
            both = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                p = np.full(max(n, usual), b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            have = (both[0], both[1])
            if n <= usual:
                self._powers[self.base] = have
        return have

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        up, _ = self.powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * up[: len(buf)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self.powers(len(prefix))
        return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start..start+length of each range, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class WordHash:
    """Hashes of whole words: sums of a pseudo-random number for each byte at its place in the word.

    Polynomial hashes mod 2**64 fall to words built like the Thue-Morse sequence whatever their base; here
    a byte's number depends on its place by a full mixer, so no structure of a word cancels out."""

    #: Places in a word whose numbers come from a table.
    TABLE = 24

    def __init__(self, seed: int = 1, lower: bool = False):
        self.seed, self.lower = np.uint64(seed * 0x1000193 + 0x5851F42D), lower
        self.table = self._number(np.repeat(np.arange(self.TABLE), 256), np.tile(np.arange(256), self.TABLE))

    def _number(self, place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        byte = _LOWER[byte] if self.lower else byte
        return mix64(mix64((place.astype(np.uint64) << np.uint64(8)) + byte.astype(np.uint64) + self.seed) + self.seed)

    def of(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each range of ``buf``; ranges are not empty."""
        size = ends - starts
        if not len(size):
            return np.zeros(0, np.uint64)
        head = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(head, size)
        byte = buf[place + np.repeat(starts, size)]
        number = self.table[(np.minimum(place, self.TABLE - 1) << 8) + byte]
        far = np.flatnonzero(place >= self.TABLE)
        if len(far):
            number[far] = self._number(place[far], byte[far])
        return mix64(np.add.reduceat(number, head) + size.astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space, and the row of each."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[buf]
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    ends = inside[:n] & ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words of a row, and their rows. A row of fewer words has one shingle of all of them."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    length = np.diff(np.r_[first, n])
    out, where = [], []
    if n >= size:
        total = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - size + 1 + k]
        whole = rows[: n - size + 1] == rows[size - 1 :]
        out.append(mix64(total[whole]))
        where.append(rows[: n - size + 1][whole])
    for i in np.flatnonzero(length < size):
        value = 0
        for h in hashes[first[i] : first[i] + length[i]]:
            value = (value * 0x9E3779B97F4A7C15 + int(h) + 1) & 0xFFFFFFFFFFFFFFFF
        out.append(mix64(np.array([value], np.uint64)))
        where.append(rows[first[i] : first[i] + 1])
    return np.concatenate(out), np.concatenate(where).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences of as few whole bytes as the largest takes."""
    gaps = np.diff(keys)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + keys[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    gaps = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(gaps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8, offset=1)
    wide[1:, :width] = gaps
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)
