"""Byte-level BPE by sentencepiece: a model file is written directly from a vocabulary of byte strings and their ranks.

Each of the 256 bytes stands for one printable character, so a token is a string of characters; it becomes a piece with its negative
rank for a score. sentencepiece merges the neighbours whose piece scores best, the leftmost of equals, which is byte-level BPE by ranks.
Normalisation is the identity (no map of characters, no prefix, white space kept). A text is cut by the vocabulary's pattern and each
match is encoded on its own; a worker remembers what it has encoded. Decoding maps pieces back to bytes.

Null texts are empty and have no ids; whole texts are encoded, however long, without special tokens, so their strings are ordinary text;
bytes that are not UTF-8 become U+FFFD first, as in any string; null ids of documents and repeated rows stay as they are, other columns
are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import slices, small_batches, text_of

#: Letters and bytes of ids of the pre-tokens that a worker remembers; beyond that it starts anew. Longer pre-tokens aren't remembered.
REMEMBERED_BYTES, REMEMBERED_LENGTH = 32 << 20, 64
#: Pre-tokens of a text that are held at once.
AT_ONCE = 1 << 16


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern of pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def letters() -> str:
    """The character of each byte: itself where it is printable and no space, the others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


def read_ranks(path: str) -> list[bytes]:
    """The tokens in the order of their ranks, which are 0, 1, ..."""
    with open(path, "rb") as f:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, filter(None, map(bytes.strip, f))))
    if [r for r, _ in ranked] != list(range(len(ranked))) or len({t for _, t in ranked}) != len(ranked):
        raise ValueError("the ranks are not 0, 1, ... of different tokens")
    if not {bytes([b]) for b in range(256)} <= {t for _, t in ranked}:
        raise ValueError("every single byte needs a rank")
    return [t for _, t in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    """A field of the wire format that holds bytes."""
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def model_file(tokens: list[bytes]) -> bytes:
    """A sentencepiece model: the id of a piece is its rank; the unknown piece, which no text needs, comes last."""
    letter = letters()
    # Field numbers and kinds of the public model format.
    score, normal, unknown, bpe = _varint(2 << 3 | 5), 1, 2, 2
    piece = lambda text, value, kind: _message(1, _message(1, text.encode()) + score + struct.pack("<f", value) + _number(3, kind))
    pieces = [piece("".join(map(letter.__getitem__, t)), -rank, normal) for rank, t in enumerate(tokens)]
    trainer = _number(3, bpe)
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)  # no prefix, no white space removed or escaped
    return b"".join([*pieces, piece("<unk>", 0, unknown), _message(2, trainer), _message(3, normalizer)])


class Codec:
    """Encodes and decodes; one for each worker, vocabulary and pattern."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        import regex
        from sentencepiece import SentencePieceProcessor

        tokens = read_ranks(path)
        self.model = SentencePieceProcessor(model_proto=model_file(tokens))
        self.pattern, self.letter = regex.compile(pattern), letters()
        back = {c: b for b, c in enumerate(self.letter)}
        pieces = [bytes(back[c] for c in self.model.id_to_piece(i)) for i in range(len(tokens))]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.known, self.held = {}, 0

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _ids(self, words: list[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each word."""
        as_letters = [w.encode().decode("latin-1").translate(self.letter) for w in words]
        for ids in self.model.encode(as_letters, out_type=int, num_threads=1):
            yield np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> Iterator[bytes]:
        """The text's ids in parts; a long text's pre-tokens are never all held at once."""
        matches = iter([self.pattern.findall(text)]) if len(text) <= AT_ONCE else iter(lambda found=self.pattern.finditer(text): [m.group() for m in islice(found, AT_ONCE)], [])
        for words in matches:
            if self.held > REMEMBERED_BYTES:
                self.known, self.held = {}, 0
            new = [w for w in set(words) if w not in self.known]
            long = {}
            for w, ids in zip(new, self._ids(new), strict=True) if new else ():
                if len(w) <= REMEMBERED_LENGTH:
                    self.known[w] = ids
                    self.held += len(w) + len(ids) + 150
                else:
                    long[w] = ids
            if long:
                yield b"".join([long[w] if w in long else self.known[w] for w in words])
            else:
                yield b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        place = np.repeat(self.start[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        return self.bytes[place]


def _same(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids of each row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit integers."""
    small_batches(docs.sparkSession)
    path, pattern = path or default_vocabulary()[0], pattern or default_vocabulary()[1]

    def run(batches):
        codec = Codec.of(path, pattern)
        for rows, buf, offsets in slices(batches):
            raw, out = buf.tobytes(), []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append(b"".join(codec.encode(raw[a:b].decode("utf-8", "replace"))))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(docs["doc_id"].alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, f"doc_id {_same(docs)}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded: the bytes of each row's ids. An id that has no token is an error; null ids are none."""
    small_batches(encoded.sparkSession)
    path, pattern = path or default_vocabulary()[0], default_vocabulary()[1]

    def run(batches):
        codec = Codec.of(path, pattern)
        for rows, buf, offsets in slices(batches, "ids"):
            ids = np.ascontiguousarray(buf).view("<u4") if len(buf) else np.zeros(0, "<u4")
            out = [codec.decode(ids[a:b]).tobytes() for a, b in zip((offsets[:-1] // 4).tolist(), (offsets[1:] // 4).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.binary())], [*rows.schema.names, "decoded"])

    rows = encoded.select("doc_id", "n_tokens", F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {_same(encoded)}, n_tokens bigint, ids binary, decoded binary")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    coded = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
