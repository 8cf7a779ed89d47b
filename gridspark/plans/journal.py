"""Undo and redo over a log of operations: what each of them does, and what a document's two stacks hold.

``log``: the document's columns (``keys``), seq, op (edit, undo or redo), bytes (of the tiles that an edit touches, as they are before it; null: it
touches none) and after (bytes of the same tiles once it is made; null: as before). An edit ends the redo branch. Both stacks together
hold at most ``most_bytes``, the undo stack at most ``most_entries``; the oldest undo entries go first, then the whole redo stack. An edit
that alone is above ``most_bytes`` leaves no history. What an undo puts on the redo stack are the tiles it replaces, so it may be larger
than the entry that it takes, and the bounds are kept then as well.

The stacks hold ``most_entries`` between them, as only an edit adds an entry and it empties the other one. So a document's log is read in order, with
nothing held but these: logs are dealt by document and sorted (Spark spills), and batches go by. A log of any length takes the same memory, but one
document's operations are one task's, one after the other. Operations of one seq stand in the order of op, bytes and after; a null seq is first; an unknown or null op
does nothing; negative bytes count as 0; null documents are one document; other columns are ignored; an empty log has no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bounds of a journal that states none.
MOST_ENTRIES, MOST_BYTES = 32, 256 << 20

_RESULT = "outcome string, target bigint, undo_depth int, redo_depth int, bytes_held bigint, generation bigint, dropped bigint"


class Held(NamedTuple):
    """An edit on a stack; ``generation`` is where the document goes when it is taken."""

    seq: int
    generation: int
    before: int
    after: int


class Stacks:
    """A document's journal."""

    def __init__(self, most_entries: int, most_bytes: int):
        self.most_entries, self.most_bytes = most_entries, most_bytes
        self.undo, self.redo = deque(), []
        self.held = self.generation = self.dropped = 0

    def step(self, seq: int | None, op: str | None, before: int | None, after: int | None) -> tuple:
        """The columns of ``_RESULT`` for one operation."""
        outcome, target = "nothing", None
        if op == "edit":
            outcome = self._edit(seq, before, after)
            target = seq if outcome == "recorded" else None
        elif op == "undo" and self.undo:
            e = self.undo.pop()
            self.redo.append(e._replace(generation=self.generation))
            self.held += e.after - e.before
            outcome, target, self.generation = "undone", e.seq, e.generation
        elif op == "redo" and self.redo:
            e = self.redo.pop()
            self.undo.append(e._replace(generation=self.generation))
            self.held += e.before - e.after
            outcome, target, self.generation = "redone", e.seq, e.generation
        self._bounded()
        return outcome, target, len(self.undo), len(self.redo), self.held, self.generation, self.dropped

    def _edit(self, seq: int | None, before: int | None, after: int | None) -> str:
        if before is None:
            return "no_change"
        before = max(before, 0)
        after = before if after is None else max(after, 0)
        if before > self.most_bytes:
            self.undo.clear()
            self._forget_redo()
            self.held = 0
            return "too_large"
        self._forget_redo()
        self.undo.append(Held(seq, self.generation, before, after))
        self.held += before
        self.generation += 1
        return "recorded"

    def _forget_redo(self) -> None:
        self.held -= sum(e.after for e in self.redo)
        self.redo.clear()

    def _bounded(self) -> None:
        while self.undo and (len(self.undo) > self.most_entries or self.held > self.most_bytes):
            self.held -= self.undo.popleft().before
            self.dropped += 1
        if self.held > self.most_bytes:
            self._forget_redo()


def _ordered(log: DataFrame, keys: list[str]) -> DataFrame:
    rows = log.select(*keys, F.col("seq").cast("bigint").alias("seq"), "op", F.col("bytes").cast("bigint").alias("bytes"), F.col("after").cast("bigint").alias("after"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "op", "bytes", "after")


def _types(df: DataFrame, keys: list[str]) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)


def resolved(log: DataFrame, keys: list[str], most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """keys, seq, op of each operation; outcome (recorded, no_change, too_large, undone, redone, nothing), target (the seq of the edit it recorded or
    moved), and how the journal stands after it: undo_depth, redo_depth, bytes_held, generation, dropped (entries that went for the bounds so far)."""
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stacks = None, None
        for batch in batches:
            out = []
            for *of, seq, op, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stacks is None or of != document:
                    document, stacks = of, Stacks(most_entries, most_bytes)
                out.append(stacks.step(seq, op, before, after))
            if out:
                types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *columns], [*keys, "seq", "op", *names])

    rows = _ordered(log, keys)
    return rows.mapInArrow(run, f"{_types(rows, keys)}seq bigint, op string, {_RESULT}")


def entries(log: DataFrame, keys: list[str], most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """keys, stack (undo or redo), place (0 is taken next), seq, bytes: what the journal of each document holds in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        document, stacks = None, None

        def left():
            # the document's columns are arrays of the batch's own types
            rows = [("undo", i, e.seq, e.before) for i, e in enumerate(reversed(stacks.undo))] + [("redo", i, e.seq, e.after) for i, e in enumerate(reversed(stacks.redo))]
            columns = [pa.array([v] * len(rows), t) for v, t in zip(document, types, strict=True)]
            own = zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True) if rows else ()
            if rows:
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, t) for c, t in own)], [*keys, "stack", "place", "seq", "bytes"])

        for batch in batches:
            types = [c.type for c in batch.columns[: len(keys)]]
            for *of, seq, op, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stacks is None or of != document:
                    if stacks is not None:
                        yield from left()
                    document, stacks = of, Stacks(most_entries, most_bytes)
                stacks.step(seq, op, before, after)
        if stacks is not None:
            yield from left()

    rows = _ordered(log, keys)
    return rows.mapInArrow(run, f"{_types(rows, keys)}stack string, place int, seq bigint, bytes bigint")
