"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all five-word shingles (lower-cased words). Documents are dealt into chunks;
   a chunk sends each distinct shingle once, so a shingle that most documents share is one row of
   each chunk. What is in two documents or more returns to the chunks that have it.
2. A shingle weighs tf * idf with idf = FLOOR + (1 - FLOOR) * ln(1 + N/df) / ln(1 + N): damped, so that
   what a thousand copies share still counts. A document whose shared shingles make up less than
   the threshold of its weight cannot reach it with any other one and is done: weighted Jaccard is
   at most that share. For the others, all unshared weight acts as one element of their own - no
   other document has it, so similarities are the same.
3. ``BANDS * ROWS`` consistent weighted samples are drawn and banded. Texts of one band value are
   compared to the most central of them, the one with the least unshared weight. In bands whose texts
   are not of one component then, the texts outside the largest one are compared to one of that component and
   to one of their own, which are others in each of ``TURNS`` turns. Most links are found so, by work in proportion
   to the bands' texts. Those that are still outside then meet every text of the band that is of another component, so
   no link between texts that share a band is missed. Banding itself may miss one; the recall is measured in the tests.
4. Pairs count if their exact weighted Jaccard similarity reaches the threshold; classes are
   the connected components.

Equal texts are one class without sampling, empty (null) ones too; texts under five words have one
shingle of all their words. Null doc_ids take part, with null as class only if their class has no
id. Repeated rows are returned as often as they come. Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.llm.common import Scratch, WordHash, mix64, packed, release, shingles, slices, text_bytes, text_of, unpacked, words

SIZE, THRESHOLD, FLOOR = 5, 0.8, 0.75
BANDS, ROWS = 20, 5
#: Turns in which texts outside a band's largest component are compared again, before all that are left are.
TURNS = 3
#: Bytes of text in a chunk and behind a bucket of shingles, whatever the input.
CHUNK_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: Bytes of vectors on either side when all of a band's texts meet.
BLOCK_BYTES = 4 << 20
_NO_ID = 2**63 - 1
_HASH = WordHash(seed=97, lower=True)
_TABLE = 1 << 16


def document_shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each row, in order."""
    starts, ends, rows = words(buf, offsets)
    hashes, rows = shingles(_HASH.of(buf, starts, ends), rows, SIZE)
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    head = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows[head], hashes[head], np.diff(np.r_[head, len(rows)])


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order], head) if len(keys) else counts


def _count_chunk(n_buckets: int):
    shift = np.uint64(64 - (n_buckets - 1).bit_length())

    def run(key, table):
        parts = []
        for _, buf, offsets in slices(table.to_batches()):
            _, hashes, _ = document_shingles(buf, offsets)
            parts.append(np.unique(hashes, return_counts=True))
        hashes, counts = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        bucket = (hashes >> shift).astype(np.int64) if n_buckets > 1 else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
        full = np.flatnonzero(np.diff(edges))
        counts = counts.astype("<u4")
        return pa.table(
            {
                "bucket": pa.array(full.astype(np.int32)),
                "chunk": pa.array(np.full(len(full), key[0].as_py(), np.int32)),
                "hashes": pa.array([packed(hashes[edges[b] : edges[b + 1]]) for b in full], pa.binary()),
                "counts": pa.array([counts[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
            }
        )

    return run


def _share_bucket(key, table):
    chunks = table.column("chunk").to_numpy()
    parts = [unpacked(b) for b in table.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(b, "<u4") for b in table.column("counts").to_pylist()]).astype(np.int64)
    keys, total = _summed(np.concatenate(parts), counts)
    keys, total = keys[total > 1], total[total > 1]
    out = []
    for chunk, mine in zip(chunks.tolist(), parts, strict=True):
        at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
        hit = keys[at] == mine if len(keys) else np.zeros(len(mine), bool)
        if hit.any():
            out.append((chunk, packed(mine[hit]), total[at[hit]].astype("<u4").tobytes()))
    chunk, hashes, df = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"chunk": pa.array(chunk, pa.int32()), "hashes": pa.array(hashes, pa.binary()), "df": pa.array(df, pa.binary())})


class Sampler:
    """Consistent weighted samples of weighted sets; the gamma and uniform variates of an element come from tables by hashes of it."""

    def __init__(self, samples: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.r, self.beta = rng.gamma(2, 1, _TABLE).astype(np.float32), rng.random(_TABLE).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, _TABLE)).astype(np.float32)
        self.salts = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)

    def sample(self, keys: np.ndarray, weight: np.ndarray, head: np.ndarray) -> np.ndarray:
        """One line of sample hashes for each set; sets are runs of elements that begin at ``head``."""
        log_w, size = np.log(weight).astype(np.float32), np.diff(np.r_[head, len(keys)])
        of = np.repeat(np.arange(len(head)), size)
        out = np.empty((len(head), len(self.salts)), np.uint64)
        for k, salt in enumerate(self.salts):
            mixed = (keys ^ (keys >> np.uint64(29))) * salt
            # three draws of an element: two from parts of one product, the third from another one
            i, j = ((mixed >> np.uint64(s)).astype(np.int64) & (_TABLE - 1) for s in (48, 32))
            m = (((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[i], self.beta[j]
            t = np.floor(log_w / r + beta)
            a = self.log_c[m] - r * (t - beta + 1)
            best = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, head), size))
            best = best[np.r_[True, of[best][1:] != of[best][:-1]]]
            out[:, k] = mix64(keys[best] + mix64(t[best].astype(np.int64).view(np.uint64) + salt))
        return out


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    return FLOOR + (1 - FLOOR) * np.log1p(n_docs / df) / np.log1p(max(n_docs, 1))


_VECTORS = "node string, id bigint, hashes binary, weights binary, rest double, apart float, bands array<bigint>"


def _vectors(n_docs: int, threshold: float):
    sampler = Sampler(BANDS * ROWS)
    alone = float(idf(np.array([1.0]), n_docs)[0])

    def run(docs, shared):
        out = []
        known, df = _summed_shared(shared)
        for rows, buf, offsets in slices(docs.to_batches()):
            row, hashes, tf = document_shingles(buf, offsets)
            if not len(row):
                continue
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            weight = tf * np.where(hit, idf(np.where(hit, df[at] if len(df) else 1, 1), n_docs), alone)
            n = len(offsets) - 1
            total, common = np.bincount(row, weight, n), np.bincount(row[hit], weight[hit], n)
            able = (common >= threshold * total - 1e-9) & (common > 0)
            mine = hit & able[row]
            row, hashes, weight = row[mine], hashes[mine], weight[mine]
            if not len(row):
                continue
            which = np.flatnonzero(able)
            nodes = rows.column(1).take(pa.array(which)).to_pylist()
            rest = (total - common)[which]
            # the unshared weight as an element of its own
            own = np.array([int(x[:16], 16) for x in nodes], np.uint64)
            extra = rest > 1e-9
            order = np.argsort(np.r_[row, which[extra]], kind="stable")
            keys, w = np.r_[hashes, own[extra]][order], np.r_[weight, rest[extra]][order]
            of = np.r_[row, which[extra]][order]
            samples = sampler.sample(keys, w, np.flatnonzero(np.r_[True, of[1:] != of[:-1]]))
            bands = np.zeros((len(which), BANDS), np.uint64)
            for k in range(ROWS):
                bands = mix64(bands * np.uint64(0x9E3779B97F4A7C15) + samples[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
            edges = np.searchsorted(row, np.r_[which, n])
            ids = rows.column(2).take(pa.array(which))
            blobs = [(hashes[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            out.append(
                pa.table(
                    {
                        "node": pa.array(nodes, pa.string()),
                        "id": ids,
                        "hashes": pa.array([b[0] for b in blobs], pa.binary()),
                        "weights": pa.array([b[1] for b in blobs], pa.binary()),
                        "rest": pa.array(rest),
                        "apart": pa.array((rest / total[which]).astype(np.float32)),
                        "bands": pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())),
                    }
                )
            )
        if out:
            return pa.concat_tables(out)
        return pa.table({n: pa.array([], t) for n, t in (("node", pa.string()), ("id", pa.int64()), ("hashes", pa.binary()), ("weights", pa.binary()), ("rest", pa.float64()), ("apart", pa.float32()), ("bands", pa.list_(pa.int64())))})

    return run


def _summed_shared(shared: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not len(shared):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([unpacked(b) for b in shared.column("hashes").to_pylist()])
    df = np.concatenate([np.frombuffer(b, "<u4") for b in shared.column("df").to_pylist()]).astype(np.int64)
    order = np.argsort(keys)
    return keys[order], df[order]


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Exact similarity of two vectors (sorted hashes, weights, unshared weight)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    x, y = a[1][i], b[1][j]
    least = float(np.minimum(x, y).sum())
    total = float(a[1].sum() + b[1].sum() + a[2] + b[2])
    return least / (total - least) if total > least else 1.0


def verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b and other columns) whose weighted Jaccard similarity reaches the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for i, (ah, aw, ar, bh, bw, br) in enumerate(zip(*columns, strict=True)):
                one, two = (np.frombuffer(ah, np.uint64), np.frombuffer(aw), ar), (np.frombuffer(bh, np.uint64), np.frombuffer(bw), br)
                if weighted_jaccard(one, two) >= threshold - 1e-9:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in batch.columns[6:]], batch.schema.names[6:])

    left = vectors.select(F.col("node").alias("a"), F.col("hashes").alias("ah"), F.col("weights").alias("aw"), F.col("rest").alias("ar"))
    right = vectors.select(F.col("node").alias("b"), F.col("hashes").alias("bh"), F.col("weights").alias("bw"), F.col("rest").alias("br"))
    both = pairs.join(left, "a").join(right, "b").select("ah", "aw", "ar", "bh", "bw", "br", *pairs.columns)
    return both.mapInArrow(run, pairs.schema)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label: the least node of each connected component; labels pass along edges and jump to their own labels."""
    both = scratch.table(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), f"{name}-labels")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, "a").select("a", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("a").alias("new"), F.col("label").alias("far"))
        labels = scratch.table(met.join(jump, "new").select("a", F.col("label").alias("old"), F.least("new", "far").alias("label")), f"{name}-{turn}")
        if not labels.where("old != label").limit(1).count():
            return labels.select(F.col("a").alias("node"), "label")
        labels = labels.select("a", "label")


def _apart(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (node, band and other columns) of bands whose texts are not all of one component, with label and major: the component that most are of."""
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = rows.groupBy("band", "label").agg(F.count("*").alias("n"))
    major = sizes.groupBy("band").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "label")).alias("most")).where("kinds > 1").select("band", F.col("most.label").alias("major"))
    return rows.join(major, "band")


def _merged(labels: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The labels after links (a, b) between components join these as wholes; a text without links is one of its own."""
    if not found.limit(1).count():
        return labels
    joined = components(found, scratch, f"turn-{name}")
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return scratch.table(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), f"labels-{name}")


def _met(threshold: float):
    """The labels of similar texts of two blocks of one band. A pair meets in the first band that it shares."""

    def run(table: pa.Table) -> pa.Table:
        band, found = table.column("band")[0].as_py(), set()
        sides = []
        for left in (True, False):
            side = table.filter(pc.equal(table.column("left"), left))
            hashes, weights = ([np.frombuffer(v, kind) for v in side.column(c).to_pylist()] for c, kind in (("hashes", np.uint64), ("weights", np.float64)))
            total = np.array([w.sum() for w in weights]) + side.column("rest").to_numpy()
            order = np.argsort(total, kind="stable")
            node, label, bands = (np.array(side.column(c).to_pylist())[order] for c in ("node", "label", "bands"))
            inner = np.array(side.column("inner").to_pylist(), bool)[order]
            sides.append((node, label, bands, inner, [hashes[i] for i in order], [weights[i] for i in order], total[order]))
        (node, label, bands, _, hashes, weights, total), (node2, label2, bands2, inner2, hashes2, weights2, total2) = sides
        if len(node) and len(node2):
            edges = np.r_[0, np.cumsum([len(h) for h in hashes2])]
            of, keys, weight = np.repeat(np.arange(len(node2)), np.diff(edges)), np.concatenate(hashes2), np.concatenate(weights2)
            least = threshold - 1e-9
            for i, (own, own_weight) in enumerate(zip(hashes, weights, strict=True)):
                # no similarity is above the ratio of the weights
                lo, hi = np.searchsorted(total2, (total[i] * least * (1 - 1e-9), total[i] / least * (1 + 1e-9)))
                same = bands2[lo:hi] == bands[i]
                asked = np.zeros(len(node2), bool)
                asked[lo:hi] = (same.any(axis=1) & (bands[i][same.argmax(axis=1)] == band)) & (label2[lo:hi] != label[i]) & (inner2[lo:hi] | (node2[lo:hi] > node[i]))
                if not asked.any():
                    continue
                part = slice(edges[lo], edges[hi])
                mine = asked[of[part]]
                key, w, to = keys[part][mine], weight[part][mine], of[part][mine]
                place = np.minimum(np.searchsorted(own, key), len(own) - 1)
                hit = own[place] == key
                both = np.bincount(to[hit], np.minimum(own_weight[place[hit]], w[hit]), len(node2))
                linked = asked & (both >= least * (total[i] + total2 - both))
                found |= {(str(label[i]), str(v)) for v in label2[linked]}
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return run


def _rest(rows: DataFrame, vectors: DataFrame, threshold: float, block: int) -> DataFrame:
    """a, b: the labels of all similar texts of one band and different components (``rows`` as by ``_apart``).

    Those outside the band's largest component meet all of the band, in blocks of about ``block`` bytes of vectors on either side: a task holds
    two blocks, and the work grows with the texts outside times the texts of the band, as it must if each of these pairs is asked for."""
    size = vectors.select("node", (F.length("hashes") + F.length("weights")).alias("size"))
    rows = rows.select("node", "band", "label", (F.col("label") == F.col("major")).alias("inner")).join(size, "node")
    blocks = lambda v: F.greatest(F.ceil(F.sum(v) / block), F.lit(1))
    held = rows.groupBy("band").agg(blocks(F.when(F.col("inner"), 0).otherwise(F.col("size"))).alias("n_left"), blocks("size").alias("n_right"))
    rows = rows.join(held, "band")
    own = lambda side: F.pmod(F.xxhash64("node"), F.col(f"n_{side}"))
    each = lambda side: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{side}") - 1))
    columns = ["node", "band", "label", "inner"]
    left = rows.where(~F.col("inner")).select(*columns, F.lit(True).alias("left"), own("left").alias("l"), each("right").alias("r"))
    right = rows.select(*columns, F.lit(False).alias("left"), each("left").alias("l"), own("right").alias("r"))
    full = left.unionByName(right).join(vectors.select("node", "bands", "hashes", "weights", "rest"), "node")
    return full.groupBy("band", "l", "r").applyInArrow(_met(threshold), "a string, b string").distinct()


def _links(vectors: DataFrame, threshold: float, scratch: Scratch, turns: int = TURNS, block: int = BLOCK_BYTES) -> DataFrame:
    """node, label of all texts that have near duplicates."""
    members = scratch.table(vectors.select("node", "apart", F.explode("bands").alias("band")), "bands")
    centres = members.groupBy("band").agg(F.min(F.struct("apart", "node")).alias("centre"), F.count("*").alias("n")).where("n > 1").select("band", F.col("centre.node").alias("centre"))
    stars = members.join(centres, "band").where("node != centre").select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct()
    labels = components(scratch.table(verified(stars, vectors, threshold), "edges"), scratch, "first")
    for turn in range(turns):
        # bands that are of one component stay so
        rows = scratch.table(_apart(members, labels), f"open-{turn}")
        order = F.xxhash64("node", "band", F.lit(turn)).cast("float") if turn else F.col("apart")
        one = F.struct(order.alias("order"), "node", "label")
        inner = F.col("label") == F.col("major")
        centres = rows.groupBy("band").agg(F.array(F.min(F.when(inner, one)), F.min(F.when(~inner, one))).alias("centres"))
        met = rows.where(~inner).join(centres, "band").select("node", "label", F.explode("centres").alias("centre")).where("label != centre.label")
        pairs = met.select(F.col("node").alias("a"), F.col("centre.node").alias("b"), F.col("label").alias("a_label"), F.col("centre.label").alias("b_label")).distinct()
        found = scratch.table(verified(pairs, vectors, threshold).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")).distinct(), f"edges-{turn}")
        labels = _merged(labels, found, scratch, str(turn))
        members = rows.select("node", "apart", "band")
    rows = scratch.table(_apart(members, labels), "open-rest")
    return _merged(labels, scratch.table(_rest(rows, vectors, threshold, block), "edges-rest"), scratch, "rest")


def _classes(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """node (of the text), id for each row of ``docs``; node, least id, copies and label (of the class) for each text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dups")
    rows = docs.select(text_of(docs).alias("text"), F.md5(text_of(docs).cast("binary")).alias("node"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("id"))
    members = scratch.table(rows.select("node", "id"), "members")
    nodes = scratch.table(members.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "nodes")
    total, n_docs = text_bytes(docs), members.count()
    n_chunks = -(-total // CHUNK_BYTES) or 1
    n_buckets = 1 << ((-(-total // BUCKET_BYTES) or 1) - 1).bit_length()
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("node", "id"), F.lit(n_chunks)).cast("int"))
    counted = dealt.groupBy("chunk").applyInArrow(_count_chunk(n_buckets), "bucket int, chunk int, hashes binary, counts binary")
    shared = scratch.table(counted.groupBy("bucket").applyInArrow(_share_bucket, "chunk int, hashes binary, df binary"), "shared", compression="none")
    release(spark)
    made = dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_vectors(n_docs, threshold), _VECTORS)
    every = scratch.table(made, "vectors", compression="none")
    release(spark)
    # one vector of each text
    vectors = scratch.table(every.join(nodes.select("node", "id"), ["node", "id"]).dropDuplicates(["node"]), "texts", compression="none")
    scratch.drop("vectors")
    labels = _links(vectors, threshold, scratch)
    classes = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return members, scratch.table(classes, "labelled")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), class_size for each row of ``docs``."""
    members, classes = _classes(docs, threshold)
    found = classes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    of_node = classes.select("node", "label").join(found, "label").select("node", "class_id", "class_size")

    def visible(c):
        return F.when(F.col(c) != _NO_ID, F.col(c))

    return members.join(of_node, "node").select(visible("id").alias("doc_id"), visible("class_id").alias("class_id"), "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each class: of its least doc_id (null only if it has no other), of rows equal in doc_id and text the least one."""
    first = _classes(docs, threshold)[1].groupBy("label").agg(F.min(F.struct("id", "node")).alias("first")).select("first.id", "first.node")
    rows = docs.select(F.struct(*(f"`{f.name}`" for f in docs.schema)).alias("all"), F.md5(text_of(docs).cast("binary")).alias("node"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("id"))
    place = F.row_number().over(Window.partitionBy("node", "id").orderBy("all"))
    kept = rows.join(first.hint("merge"), ["node", "id"], "left_semi").withColumn("place", place).where("place = 1")
    return kept.select([F.col(f"all.`{f.name}`") for f in docs.schema])


def op5_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
