"""The journal against a store of tiles that is really edited, snapshot and put back; its bounds; odd logs."""

import random

import pytest

from gridspark.plans import journal

SCHEMA = "document string, layer bigint, seq bigint, op string, bytes bigint, after bigint"
KEYS = ["document", "layer"]


class Store:
    """Tiles by name with their sizes; an edit keeps a copy of what it overwrites, undo and redo swap copies."""

    def __init__(self, most_entries, most_bytes):
        self.tiles, self.version, self.undo, self.redo, self.limits, self.lost = {}, 0, [], [], (most_entries, most_bytes), 0

    def size(self):
        return sum(sum(old.values()) for _, _, old in self.undo + self.redo)

    def trim(self):
        entries, size = self.limits
        while len(self.undo) > entries or (self.size() > size and self.undo):
            self.undo = self.undo[1:]
            self.lost += 1
        if self.size() > size:
            self.redo = []

    def edit(self, seq, new):
        old = {t: self.tiles.get(t, 0) for t in new}
        before, after = sum(old.values()), sum(new.values())
        self.tiles = self.tiles | new
        if before > self.limits[1]:
            self.undo, self.redo = [], []
            return before, after
        self.redo = []
        self.undo.append((seq, self.version, old))
        self.version += 1
        self.trim()
        return before, after

    def move(self, source, target):
        if not source:
            return None
        seq, version, old = source.pop()
        target.append((seq, self.version, {t: self.tiles.get(t, 0) for t in old}))
        self.tiles, self.version = self.tiles | old, version
        self.trim()
        return seq


@pytest.mark.parametrize("seed", range(2))
def test_journal_equals_a_store_of_tiles(spark, seed):
    rng = random.Random(seed)
    bounds = (4, 100)
    log, want, stacks = [], {}, set()
    for d in range(40):
        key = (rng.choice([None, "a", "b"]), d)
        s = Store(*bounds)
        for seq in range(rng.randint(1, 60)):
            op = rng.choice(["edit", "edit", "undo", "undo", "redo"])
            size, target, outcome = (None, None), None, "nothing"
            if op == "edit" and rng.random() < 0.1:
                outcome = "no_change"
            elif op == "edit":
                size = s.edit(seq, {t: rng.choice([0, 5, 20, 60]) for t in rng.sample("pqrstuv", rng.randint(1, 5))})
                outcome, target = ("too_large", None) if size[0] > bounds[1] else ("recorded", seq)
            else:
                target = s.move(*((s.undo, s.redo) if op == "undo" else (s.redo, s.undo)))
                outcome = "nothing" if target is None else {"undo": "undone", "redo": "redone"}[op]
            log.append((*key, seq, op, *size))
            want[(*key, seq)] = (outcome, target, len(s.undo), len(s.redo), s.size(), s.version, s.lost)
        stacks |= {(*key, name, i, seq, sum(old.values())) for name, held in (("undo", s.undo), ("redo", s.redo)) for i, (seq, _, old) in enumerate(reversed(held))}
    rng.shuffle(log)
    df = spark.createDataFrame(log, SCHEMA).repartition(5)
    got = {tuple(r)[:3]: tuple(r)[4:] for r in journal.resolved(df, KEYS, *bounds).collect()}
    assert got == want
    assert {v[0] for v in want.values()} == {"recorded", "no_change", "too_large", "undone", "redone", "nothing"}
    assert max(v[6] for v in want.values()) > 3 and max(v[2] for v in want.values()) == 4
    assert {tuple(r) for r in journal.entries(df, KEYS, *bounds).collect()} == stacks


def test_a_redo_stack_above_the_bound_goes_when_no_undo_is_left(spark):
    """Undoing an edit that grew its tiles puts more on the redo stack than it takes from the other one."""
    rows = [("a", 1, 0, "edit", 10, 40), ("a", 1, 1, "edit", 0, 200), ("a", 1, 2, "undo", None, None), ("a", 1, 3, "redo", None, None)]
    got = journal.resolved(spark.createDataFrame(rows, SCHEMA), KEYS, 4, 100).orderBy("seq").collect()
    assert [(r.outcome, r.undo_depth, r.redo_depth, r.bytes_held, r.dropped) for r in got] == [("recorded", 1, 0, 10, 0), ("recorded", 2, 0, 10, 0), ("undone", 0, 0, 0, 1), ("nothing", 0, 0, 0, 1)]


def test_default_bounds_and_a_log_of_one_document(spark):
    """A long log of one document: never more than 32 entries or 256 MiB."""
    rows = [("a", 1, i, "edit", 1 << 20, 1 << 20) for i in range(5000)]
    last = journal.resolved(spark.createDataFrame(rows, SCHEMA), KEYS).orderBy("seq").tail(1)[0]
    assert (last.undo_depth, last.bytes_held, last.generation, last.dropped) == (32, 32 << 20, 5000, 4968)
    large = [("a", 1, i, "edit", 60 << 20, 0) for i in range(9)]
    assert journal.entries(spark.createDataFrame(large, SCHEMA), KEYS).count() == 4


def test_odd_logs(spark):
    assert journal.resolved(spark.createDataFrame([], SCHEMA), KEYS).count() == 0
    assert journal.entries(spark.createDataFrame([], SCHEMA), KEYS).count() == 0
    rows = [(None, None, None, "edit", 7, None), (None, None, 1, None, 3, 3), (None, None, 2, "paint", 3, 3), (None, None, 3, "edit", -5, -5), (None, None, 4, "edit", 7, 9), (None, None, 4, "edit", 7, 9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS outcome", "2 AS generation")
    got = journal.resolved(df, KEYS).orderBy("seq", "generation").collect()
    assert [r.outcome for r in got] == ["recorded", "nothing", "nothing", "recorded", "recorded", "recorded"]
    assert [r.bytes_held for r in got] == [7, 7, 7, 7, 14, 21]
