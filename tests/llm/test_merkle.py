"""The Merkle manifest against a plain tree, and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from gridspark.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and the siblings before and after each node, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            paths[k].append((run[: i % 3], run[i % 3 + 1 :]))
        nodes, at = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: b"" if s is None else b"=" + s.encode())
    order = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    below = {s: tree([leaf(r) for r in order[s]]) for s in names}
    root, upper = tree([below[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, path in zip(order[s], below[s][1], strict=True):
            path = path + upper[k]
            folded = leaf(r)
            if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0:
                folded = leaf((*r[:4], None if r[4] is None else r[4].replace("\n", "")))
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            out.append((r[0], leaf(r), below[s][0], root, sha("".join("".join(b + a) for b, a in path)), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, tmp_path, **extra):
    spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in extra.items()}).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


ODD = [(1, None, None, None, None), (1, None, "", 0, ""), (None, "a", "en", 3, "x\ny"), (None, None, None, None, None), (None, None, None, None, None), (7, "", "é", -5, "ünï\n☃\n\n"), (8, "", "de", 1, "word\n" * 200_000)]


@pytest.mark.parametrize("parts", [merkle.PART_ROWS, 7])
@pytest.mark.parametrize("small", [merkle.SMALL, 2])
def test_manifest_equals_the_plain_tree(spark, tmp_path, monkeypatch, parts, small):
    """Groups of every size up to 30, a hot one, null and empty groups, repeated rows and ids; few rows to a part and levels without shuffles or not."""
    monkeypatch.setattr(merkle, "PART_ROWS", parts)
    monkeypatch.setattr(merkle, "SMALL", small)
    rng = random.Random(parts)
    rows = [(i, f"s{n}", rng.choice(["en", None]), n, "line\n" * rng.randint(0, 3)) for n in range(1, 12) for i in range(n)]
    rows += [(rng.randint(0, 60), "hot", "en", 1, "a\nb") for _ in range(120)] + [(4, "hot", "en", 1, "same")] * 40 + ODD + ODD[:5]
    rng.shuffle(rows)
    assert got(spark, rows, tmp_path, s=1, key="k", digest="d", idx="x", path="p", tie="t") == plain(rows)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_tables(spark, tmp_path, n):
    rows = [(i, "one", "en", 1, "a") for i in range(n)]
    assert got(spark, rows, tmp_path) == (plain(rows) if n else [])


def test_path_tells_any_change(spark):
    """Any other field changed, a null made empty, two fields' bytes moved: the path doesn't lead to the root."""
    rows = [(i, f"s{i % 4}", "en", i, f"text {i}") for i in range(50)] + [(50, "s0", None, None, "1:a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    changes = {
        "own": [F.col(c) for c in merkle.FIELDS],
        "moved": [F.col("doc_id"), F.lit("s9"), F.col("lang"), F.col("n_chars"), F.col("text")],
        "empty": [F.col("doc_id"), F.col("source"), F.coalesce("lang", F.lit("")), F.col("n_chars"), F.col("text")],
        "number": [F.col("doc_id"), F.col("source"), F.col("lang"), F.coalesce(F.col("n_chars") + 1, F.lit(0)), F.col("text")],
    }
    found = merkle.manifest(docs, **{k: merkle.leaf(v) for k, v in changes.items()})
    root = found.select("root").distinct().collect()
    assert len(root) == 1
    same = {k: found.where(merkle.fold(F.col(k), F.col("path")) == F.col("root")).count() for k in changes}
    assert same == {"own": 51, "moved": 0, "empty": 50, "number": 0}
