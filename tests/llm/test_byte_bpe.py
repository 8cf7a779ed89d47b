"""Byte-level BPE by a sentencepiece model, against the tiktoken library."""

import base64
import hashlib
import random
import sys

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridspark.llm import byte_bpe

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tiktoken():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(*byte_bpe.default_vocabulary())


def ids(codec, text):
    return np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist()


def test_every_token_is_itself(codec, tiktoken):
    for rank in range(tiktoken.n_vocab):
        letters = "".join(codec.letter[b] for b in tiktoken.decode_single_token_bytes(rank))
        assert codec.model.encode(letters) == [rank]
    assert bytes(codec.decode(np.arange(tiktoken.n_vocab))) == b"".join(map(tiktoken.decode_single_token_bytes, range(tiktoken.n_vocab)))


def test_every_character(codec, tiktoken):
    for c in range(0, sys.maxunicode + 1, 1):
        if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0):
            text = f"a{chr(c)}{chr(c)}1 {chr(c)}"
            assert ids(codec, text) == tiktoken.encode_ordinary(text), hex(c)


def test_random_texts(codec, tiktoken, monkeypatch):
    rng = random.Random(3)
    parts = ["the", " of", "ing", "'s", "'ll", "  ", "\n", "\n\n", "\t", " \n ", "123", " 7", "é", "ü", "☃", "中文", "🙂", "<|endoftext|>", "<unk>", "▁", "Ġ", "aaaa", "…", "!!", " ?", "\x00", " ", "\x1c", "ͅ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 300))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000, " " * 4000 + "x", "\n" * 999, "".join(chr(rng.randrange(33, 1500)) for _ in range(4000))]
    for at_once, remembered in ((byte_bpe.AT_ONCE, byte_bpe.REMEMBERED_BYTES), (17, 500)):
        monkeypatch.setattr(byte_bpe, "AT_ONCE", at_once)
        monkeypatch.setattr(byte_bpe, "REMEMBERED_BYTES", remembered)
        for t in texts:
            mine = ids(codec, t)
            assert mine == tiktoken.encode_ordinary(t)
            assert codec.decode(np.array(mine, np.int64)).tobytes() == t.encode()


def test_odd_rows(spark, tiktoken):
    rows = [(1, None), (None, "a null id"), (None, None), (2, ""), (4, "short"), (4, "short"), (5, " \n\t "), (6, "ünï ☃ 中文 \x1c x"), (7, "word " * 60000 + "y" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "decoded")})
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = [(i, tiktoken.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    mine = [(r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)) for r in got]
    assert sorted(mine, key=repr) == sorted(want, key=repr) and all(r.n_tokens == len(r.ids) // 4 for r in got)
    assert byte_bpe.decode(byte_bpe.encode(docs.where("false"))).count() == 0
    none = spark.createDataFrame([(1, None, None)], "doc_id bigint, n_tokens bigint, ids binary")
    assert bytes(byte_bpe.decode(none).first().decoded) == b""


def test_query(spark, tiktoken):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op12_byte_bpe(spark, SF).collect()}
    want = {i: tiktoken.encode_ordinary(t) for i, t in docs.items()}
    assert got == {i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(docs[i].encode())) for i, x in want.items()}


def test_vocabularies_that_cannot_be(tmp_path):
    line = lambda t, r: base64.b64encode(t) + b" %d\n" % r
    every = [line(bytes([b]), b) for b in range(256)]
    for lines in (every[:-1], [*every, line(b"ab", 300)], [*every[:-1], line(b"ab", 255)], [*every, line(b"a", 256)]):
        (tmp_path / "ranks").write_bytes(b"".join(lines))
        with pytest.raises(ValueError):
            byte_bpe.read_ranks(str(tmp_path / "ranks"))
    (tmp_path / "ranks").write_bytes(b"".join([*every, line(b"ab", 256), b"\n"]))
    assert len(byte_bpe.read_ranks(str(tmp_path / "ranks"))) == 257
