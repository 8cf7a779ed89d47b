"""Merkle manifest of a table: a tree of digests for each group of rows, one tree over the groups' roots, and a path for each row.

A leaf is the digest of a row's fields. In a group, leaves stand in the order of their id; every ``ARITY`` consecutive nodes become
their parent, the last run of a level may be shorter, until one node remains. The groups' roots, in the order of the groups, make one
tree more in the same way. Its root stands for the whole table; a row's path (its siblings, level by level) is enough to recompute it.

A level is one window: partitioned by group and parent place, ordered by place, over the whole run, so the collected list is the parent's
preimage and holds each node's siblings. Parents, one for each node, are made distinct and are the next level. No window holds more than
``ARITY`` rows, so a group of any size spreads over all tasks; places come from a range sort and each part's counts, not from a window
over the group. The tree's upper levels, of ``SMALL`` nodes at most, take a single task each. Everything runs in the JVM.

Null fields are ``-`` (an empty text is ``0:``); null groups and null ids come first; rows of one id stand in the order of their leaves,
and equal rows have a place each; other columns are ignored, whatever their names; an empty table has no rows and no root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Rows that a part of the range sort holds about, and the nodes of a level that one task does alone.
PART_ROWS, SMALL = 1 << 17, 1 << 13
#: Levels of the tallest tree that fits in 64-bit places.
_MOST_LEVELS = 40

_PATH = "array<struct<place: int, others: string>>"


def digest(text: Column) -> Column:
    """Lowercase hex sha256."""
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value, or as ``-``."""
    text = [c.cast("string") for c in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)))


def placed(rows: DataFrame, group: str, order: list[Column], n: int, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``idx``, the place (from 0) in the order within the group, and ``n``, the group's rows.

    A range sort over all parts; then each part's rows of a group start where the earlier parts' end. ``tie`` spreads equal rows."""
    parts = -(-n // PART_ROWS) or 1
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, F.col(group), *order, F.col("tie"))
    rows = scratch.table(spread.sortWithinPartitions(F.col(group), *order, F.col("tie")).drop("tie").withColumn("row", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("row", 33))
    here = rows.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("row").alias("first"))
    mine = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("here").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = here.select(group, "part", (earlier - F.col("first")).alias("shift"), F.sum("here").over(mine).alias("n"))
    return rows.join(counts, [group, "part"]).withColumn("idx", F.col("row") + F.col("shift")).drop("row", "part", "shift")


def _fit(df: DataFrame, nodes: int) -> DataFrame:
    """A level of few nodes is one task's work and takes no shuffle."""
    return df.coalesce(1) if nodes <= SMALL else df


def _runs(level: DataFrame, nodes: int) -> DataFrame:
    """The nodes of unfinished groups with their parent's place and their whole run."""
    run = Window.partitionBy("g", "up").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _fit(level.where("n > 1"), nodes).withColumn("up", F.expr(f"idx div {ARITY}"))
    return rows.withColumn("run", F.collect_list("digest").over(run))


class Tree:
    """The levels of the trees of all groups, from nodes (g, idx, n, digest): those of level k + 1 are the parents of level k."""

    def __init__(self, nodes: DataFrame, groups: DataFrame, scratch: Scratch, name: str):
        """``groups`` has n, the number of nodes, of each group."""
        # nodes of each level: a group of n has ceil(n / ARITY ** k), as long as the level before had several
        reached = [F.sum(F.when(F.col("n") > ARITY ** (k - 1) if k else F.lit(True), F.ceil(F.col("n") / F.lit(ARITY**k).cast("decimal(20,0)")))) for k in range(_MOST_LEVELS)]
        self.nodes = [int(v) for v in groups.agg(*(c.alias(f"l{k}") for k, c in enumerate(reached))).first() if v]
        self.levels = [nodes]
        for k, size in enumerate(self.nodes[1:]):
            runs = _runs(self.levels[-1], self.nodes[k])
            parents = runs.select("g", F.col("up").alias("idx"), F.expr(f"(n + {ARITY - 1}) div {ARITY}").alias("n"), digest(F.array_join("run", "")).alias("digest")).distinct()
            self.levels.append(scratch.table(_fit(parents, size), f"{name}{k + 1}"))

    def tops(self) -> DataFrame:
        """g, level, digest of each group's root."""
        out = None
        for k, level in enumerate(self.levels):
            top = level.where("n = 1").select("g", F.lit(k).alias("level"), "digest")
            out = top if out is None else out.unionByName(top)
        return out

    def paths(self, tops: DataFrame, carried: list[str]) -> DataFrame:
        """The lowest nodes, with all their columns, the columns ``carried`` of their group's ``tops`` and ``path``, upwards; ``tops`` has g, level, path as well.

        Goes down level by level: a node's path is its siblings and then its parent's path."""
        above = None
        for k in reversed(range(len(self.levels))):
            level, nodes = self.levels[k], self.nodes[k]
            top = _fit(tops.where(F.col("level") == k), nodes)
            done = level.where("n = 1").join(top.select("g", *carried, "path"), "g")
            if above is None:
                above = done
                continue
            place = (F.col("idx") % ARITY).cast("int")
            others = F.array_join(F.filter("run", lambda _, i: i != place), "")
            step = F.array(F.struct(place.alias("place"), others.alias("others")))
            parent = above.select("g", F.col("idx").alias("up"), *carried, F.col("path").alias("rest"))
            open_ = _runs(level, nodes).join(_fit(parent, self.nodes[k + 1]), ["g", "up"])
            open_ = open_.withColumn("path", F.concat(step, "rest")).select(*level.columns, *carried, "path")
            above = _fit(open_.unionByName(done.select(*level.columns, *carried, "path")), nodes)
        return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    step = lambda below, s: digest(F.concat(F.substr(s["others"], F.lit(1), s["place"] * 64), below, F.substr(s["others"], s["place"] * 64 + 1)))
    return F.aggregate(path, leaf, step)


def proof(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda s: s["others"]), ""))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", **more: Column) -> DataFrame:
    """key, group, leaf, idx, subroot, root and path of each row, and the columns ``more`` computed from it.

    ``path`` is an array from the leaf upwards of the node's place in its run and its siblings' digests, one after the other."""
    scratch = Scratch(docs.sparkSession, "merkle")
    # one scan of the whole rows; from here on a row is its digest. The prefix keeps the null group apart, and first
    name = F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit(""))
    hashed = docs.select(name.alias("s"), docs[key].alias("key"), docs[group].alias("group"), leaf([docs[f] for f in fields]).alias("digest"), *(c.alias(f"more_{k}") for k, c in more.items()))
    hashed = scratch.table(hashed, "hashed")
    leaves = placed(hashed, "s", [F.col("key").asc_nulls_first(), F.col("digest")], hashed.count(), scratch, "leaves")
    sources = scratch.table(leaves.where("idx = 0").select("s", F.col("n").alias("rows")), "sources")
    n_sources = sources.count()
    numbered = scratch.table(placed(sources.withColumn("one", F.lit(0)), "one", [F.col("s")], n_sources, scratch, "ordered").select("s", F.col("idx").alias("g"), "rows"), "numbered")
    trees = Tree(leaves.join(numbered.select("s", "g"), "s").drop("s"), numbered.select(F.col("rows").alias("n")), scratch, "level")
    out = ["key AS `" + key + "`", "group AS `" + group + "`", "digest AS leaf", "idx", "subroot", "root", "path", *(f"more_{k} AS `{k}`" for k in more)]
    if not trees.nodes:
        empty = hashed.selectExpr("*", "0L AS idx", "digest AS subroot", "digest AS root", f"CAST(NULL AS {_PATH}) AS path")
        return empty.selectExpr(*out).where("false")
    subroots = scratch.table(trees.tops(), "subroots")
    upper = Tree(subroots.select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("idx"), F.lit(n_sources).cast("bigint").alias("n"), "digest", F.col("level").alias("below")), subroots.groupBy().agg(F.count("*").alias("n")), scratch, "upper")
    root = upper.tops().select("g", "level", F.col("digest").alias("root"), F.array().cast(_PATH).alias("path"))
    above = upper.paths(root, ["root"]).select(F.col("idx").alias("g"), F.col("below").alias("level"), F.col("digest").alias("subroot"), "root", "path")
    result = scratch.table(trees.paths(scratch.table(above, "above"), ["subroot", "root"]).selectExpr(*out), "manifest")
    for k in ("hashed", "leaves", "sources", "ordered", "numbered", "subroots", "above", *(f"level{k + 1}" for k in range(len(trees.levels) - 1)), *(f"upper{k + 1}" for k in range(len(upper.levels) - 1))):
        scratch.forget(k)
    return result


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and what each path says of its document; those of even crc32 of the id have lost their line ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    even = F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % 2 == 0
    shown = [docs[f] for f in FIELDS[:-1]] + [F.when(even, F.replace(docs["text"], F.lit("\n"), F.lit(""))).otherwise(docs["text"])]
    rows = manifest(docs, shown=leaf(shown))
    rows = rows.withColumn("folded_root", fold(F.col("shown"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def oracle() -> str:
    """The same for DuckDB: levels and walks up by recursion; crc32 from its table."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    of = lambda text: "sha256(" + " || ".join([*map(field, FIELDS[:-1]), field(text)]) + ")"
    up = lambda c: f"CAST(floor({c} / {ARITY}) AS BIGINT)"
    level = lambda t: f"SELECT level + 1, g, {up('idx')}, CAST(ceil(any_value(n) / {ARITY}) AS BIGINT), sha256(string_agg(digest, '' ORDER BY idx)) FROM {t} WHERE n > 1 GROUP BY level, g, {up('idx')}"
    walk = lambda w, t: (
        f"SELECT w.one, w.level + 1, w.g, {up('any_value(w.idx)')}, CAST(ceil(any_value(w.n) / {ARITY}) AS BIGINT), sha256(string_agg(CASE WHEN k.idx = w.idx THEN w.shown ELSE k.digest END, '' ORDER BY k.idx)),"
        f" any_value(w.proof) || coalesce(string_agg(k.digest, '' ORDER BY k.idx) FILTER (k.idx <> w.idx), '') FROM {w} w JOIN {t} k ON k.level = w.level AND k.g = w.g AND {up('k.idx')} = {up('w.idx')} WHERE w.n > 1 GROUP BY w.one, w.level, w.g"
    )
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT CAST(range AS UBIGINT), 0, CAST(range AS UBIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
hashed AS (
  SELECT doc_id, source, {of('text')} AS leaf, {of("replace(text, chr(10), '')")} AS without,
    xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(coalesce(CAST(doc_id AS VARCHAR), '')) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS UBIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 2 = 0 AS even
  FROM documents CROSS JOIN crc),
leafs AS (
  SELECT *, row_number() OVER () AS one, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM hashed),
node(level, g, idx, n, digest) AS (SELECT 0, g, idx, n, leaf FROM leafs UNION ALL {level('node')}),
sub AS (SELECT g, digest, count(*) OVER () AS n FROM node WHERE n = 1),
upper(level, g, idx, n, digest) AS (SELECT 0, 0, g, n, digest FROM sub UNION ALL {level('upper')}),
walk(one, level, g, idx, n, shown, proof) AS (SELECT one, 0, g, idx, n, CASE WHEN even THEN without ELSE leaf END, '' FROM leafs UNION ALL {walk('walk', 'node')}),
climb(one, level, g, idx, n, shown, proof) AS (SELECT w.one, 0, 0, w.g, s.n, w.shown, w.proof FROM walk w JOIN sub s ON s.g = w.g WHERE w.n = 1 UNION ALL {walk('climb', 'upper')})
SELECT r.doc_id, r.leaf, s.digest AS subroot, t.digest AS root, sha256(c.proof) AS proof_sha256, c.shown AS folded_root, c.shown = t.digest AS verified
FROM leafs r JOIN sub s ON s.g = r.g JOIN climb c ON c.one = r.one AND c.n = 1 CROSS JOIN (SELECT digest FROM upper WHERE n = 1) t"""
