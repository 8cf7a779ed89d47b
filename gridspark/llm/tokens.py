"""Token ids of whole texts from a public vocabulary, vectorised over distinct words.

The word vocabulary (``word_bpe_49k.json``) drops white space and never merges across
it, so a text's ids are the ids of its white-space-separated words in order. The
tokenizers library encodes each distinct word once per worker; a text is then a gather.
Words are found by 64-bit hashes and told apart by their bytes: where two words of one hash meet, the
slice's words are compared as strings.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

from gridspark.llm.common import WordHash, ragged, words

#: Distinct words that a worker remembers (about 50 bytes each); beyond that it starts anew.
REMEMBERED_WORDS = 3_000_000
_HASH = WordHash(seed=11)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes the texts of a slice; keeps what it has learned for later slices of this worker."""

    _of_path: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._of_path:
            cls._of_path[path] = cls(path)
        return cls._of_path[path]

    def forget(self) -> None:
        empty, none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tiers = [(empty, none, none, none, none)] * 2  # hash, place and number of the ids, place and length of the bytes
        self.ids, self.bytes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 18, np.uint8)
        self.used, self.filled = 0, 0

    def _find(self, keys: np.ndarray, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Place and number of the ids of each word; the words that are not known yet; is there a known one with the hash of another word."""
        place, length, clash = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64), False
        for known, places, lengths, at_byte, n_bytes in self.tiers:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = np.flatnonzero(known[at] == keys)
                at = at[hit]
                place[hit], length[hit] = places[at], lengths[at]
                clash |= bool((n_bytes[at] != sizes[hit]).any()) or not np.array_equal(self.bytes[ragged(at_byte[at], sizes[hit])], buf[ragged(starts[hit], sizes[hit])])
        return place, length, np.flatnonzero(length < 0), clash

    def _ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.array([len(e) for e in encoded], np.int64)
        return np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum())), lengths

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> None:
        flat, lengths = self._ids_of([t.decode("utf-8", "replace") for t in texts])
        raw, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.filled + len(raw) > len(self.bytes):
            self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.bytes[self.filled : self.filled + len(raw)] = raw
        new = (keys, self.used + np.cumsum(lengths) - lengths, lengths, self.filled + np.cumsum(sizes) - sizes, sizes)
        self.used, self.filled = self.used + len(flat), self.filled + len(raw)
        old, young = self.tiers

        def merged(tier, more):
            both = tuple(np.concatenate(x) for x in zip(tier, more, strict=True))
            order = np.argsort(both[0], kind="stable")
            return tuple(x[order] for x in both)

        young = merged(young, new)
        if len(young[0]) > 50_000 + len(old[0]) // 8:  # the large tier is sorted anew only when it grows
            old, young = merged(old, young), tuple(x[:0] for x in young)
        self.tiers = [old, young]

    def _plain(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each word's number of ids, by the words themselves: what decides where hashes clash."""
        texts = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        flat, lengths = self._ids_of([t.decode("utf-8", "replace") for t in number])
        place = np.cumsum(lengths) - lengths
        return flat[ragged(place[which], lengths[which])], lengths[which]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice and, for each text, the number of its ids."""
        starts, ends, rows = words(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        keys, first, which = np.unique(_HASH.of(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.tiers[0][0]) + len(self.tiers[1][0]) > REMEMBERED_WORDS:
            self.forget()
        size = ends - starts
        # equal hashes of this slice hold equal words, if no byte says otherwise
        same = np.array_equal(size, size[first][which]) and np.array_equal(buf[ragged(starts, size)], buf[ragged(starts[first][which], size)])
        place, length, new, clash = self._find(keys, buf, starts[first], size[first])
        if clash or not same:
            flat, each = self._plain(buf.tobytes(), starts, ends)
        else:
            if len(new):
                raw = buf.tobytes()
                self._learn(keys[new], [raw[starts[i] : ends[i]] for i in first[new]])
                place, length, _, _ = self._find(keys, buf, starts[first], size[first])
            each = length[which]
            flat = self.ids[ragged(place[which], each)]
        totals = np.concatenate([[0], np.cumsum(each)])
        edges = np.searchsorted(rows, np.arange(len(offsets)))
        return flat, np.diff(totals[edges])


def documents_ids(path: str, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text of a slice, with ``end_id`` after them."""
    flat, counts = WordEncoder.of(path).encode(buf, offsets)
    at = 0
    for n in counts.tolist():
        out = np.empty(n + 1, "<u4")
        out[:n] = flat[at : at + n]
        out[n] = end_id
        at += n
        yield out
