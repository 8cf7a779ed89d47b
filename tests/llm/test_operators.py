"""The operators 1 to 10 against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import decontaminate, hamming, line_dedup, near_dups, packing, ppm, repeats, resampling, token_store, toxicity
from gridspark.llm.common import Scratch, packed, unpacked
from gridspark.llm.tokens import default_vocabulary

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    for name in ("node", "id", "chunk", "hash", "score", "spans", "gone", "_id", "row", "length", "band") if extra else ():
        df = df.withColumn(name, F.lit("x"))
    return df


ODD = [(1, None), (None, "a null id"), (None, None), (2, ""), (3, ""), (4, "short"), (4, "short"), (5, " \n\t "), (6, "ünï ☃ 中文 \x1c x"), (7, "word " * 30000)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    base = [prose(rng, rng.randint(20, 220)).replace(" of ", " of\n") for _ in range(60)]
    rows = list(enumerate(base))
    for i in range(60, 90):  # near copies
        words = base[i % 20].split(" ")
        words[rng.randrange(len(words))] = "edited"
        rows.append((i, " ".join(words)))
    rows += [(i, base[3]) for i in range(90, 100)]  # copies
    return rows


# -- 1 --


@pytest.mark.parametrize("times", [2, 8])
def test_top_k_of_repeated_rows(spark, times):
    """Twenty ids share a code, and each of their rows occurs more than once."""
    rng = np.random.default_rng(times)
    shared = rng.standard_normal(64).tolist()
    rows = [(i, shared) for i in range(20)] * times + [(i, rng.standard_normal(64).tolist()) for i in range(20, 60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.neighbour_id) for r in hamming.top_k(df, F.col("vec_id").isin(0, 7, 19), k=5).where("distance = 0").collect())
    assert got == sorted((q, k + 1, i) for q in (0, 7, 19) for k, i in enumerate([i for i in range(20) if i != q][:5]))


@pytest.mark.parametrize("n", [0, 3, 400])
def test_top_k_is_exact(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(n)]
    rows += [(i, rows[0][1]) for i in range(n, n + 30) if n] + [(n + 50, None), (None, [0.5]), (n + 51, [1.0, float("nan")]), (n + 51, [1.0, float("nan")])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("code", F.lit("clash"))
    got = sorted((r.query_id, r.rank, r.neighbour_id, r.distance) for r in hamming.top_k(df, F.col("vec_id") % 50 == 0, k=5).collect())
    code = {i: sum(1 << k for k, v in enumerate(e[:64]) if v > 0) for i, e in rows if i is not None and e is not None}
    want = []
    for q in (i for i in code if i % 50 == 0):
        near = sorted(((code[q] ^ c).bit_count(), i) for i, c in code.items() if i != q)[:5]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == sorted(want)


# -- 2 --


def test_ppm_counts_and_base_score(spark, corpus):
    rows = [*corpus[:40], *ODD]
    docs = frame(spark, rows, extra=True)
    got = ppm.score(docs, F.expr("doc_id % 3 != 0")).orderBy("doc_id").collect()
    words = lambda t: [w for w in ("".join(c.lower() if c.isascii() else c for c in (t or ""))).replace("\t", " ").replace("\n", " ").split(" ") if w] + [None]
    train = [w for i, t in rows if i is not None and i % 3 for w in words(t)]
    count = {w: train.count(w) for w in set(train)}
    n, v = len(train), len(count)
    want = sorted((i if i is not None else -1, len(words(t)), sum(w in count for w in words(t)), round(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)


def _plain_ppm(training, text, order):
    """log10 probability by the definition: counts of all contexts, escapes by method D, symbols excluded one by one."""
    counts = {}
    for t in training:
        seq = [ppm.EDGE] * order + list(t) + [ppm.EDGE]
        for i in range(order, len(seq)):
            for d in range(order + 1):
                followers = counts.setdefault(tuple(seq[i - d : i]), {})
                followers[seq[i]] = followers.get(seq[i], 0) + 1
    seq, total = [ppm.EDGE] * order + list(text) + [ppm.EDGE], 0.0
    for i in range(order, len(seq)):
        excluded, found = set(), False
        for d in range(order, -1, -1):
            left = {s: c for s, c in counts.get(tuple(seq[i - d : i]), {}).items() if s not in excluded}
            if left:
                below = 2 * sum(left.values())
                if seq[i] in left:
                    total, found = total + np.log10((2 * left[seq[i]] - 1) / below), True
                    break
                total, excluded = total + np.log10(len(left) / below), excluded | left.keys()
        if not found:
            total -= np.log10(ppm.SYMBOLS - len(excluded))
    return total


@pytest.mark.parametrize("order", [2, 5])
def test_ppm_scores_equal_the_plain_way(spark, corpus, order, monkeypatch):
    monkeypatch.setattr(ppm, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 1500)
    rows = [*corpus[:25], *ODD[:-1], (99, "unseen: ~~ \x01\x02 zzzz")]
    training = [(t or "").encode() for i, t in rows if i is not None and i % 3]
    got = ppm.score(frame(spark, rows, extra=True), F.expr("doc_id % 3 != 0"), order=order).collect()
    want = sorted((i if i is not None else -1, round(_plain_ppm(training, (t or "").encode(), order), 2)) for i, t in rows)
    mine = sorted((r.doc_id if r.doc_id is not None else -1, round(r.score, 2)) for r in got)
    assert [x[0] for x in mine] == [x[0] for x in want]
    assert np.allclose([x[1] for x in mine], [x[1] for x in want], atol=0.02)


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 103, 3000).astype(np.uint8)
    keys, _ = ppm.grams(buf, np.array([0, 1000, 3000]), 3)
    keys, n = np.unique(keys, return_counts=True)
    branch = ppm.Branch(keys, n, *ppm.merged([(keys & np.uint64((1 << 18) - 1), n)]), 3)
    for context in (keys >> np.uint64(9))[::40]:
        every = (context << np.uint64(9)) | np.arange(ppm.SYMBOLS, dtype=np.uint64)
        assert abs((10 ** branch.log10(every)).sum() - 1) < 1e-9


def test_ppm_adaptive_learns(spark):
    docs = frame(spark, [(1, "abcabcabc" * 20), (2, "q8#kz0!vw" * 1)])
    got = {r.doc_id: r.score for r in ppm.score(docs, F.lit(True), mode="adaptive").collect()}
    assert got[1] / 180 > got[2] / 9


def test_ppm_empty_training(spark):
    docs = frame(spark, [(1, "some text")])
    got = ppm.score(docs, F.lit(False)).collect()
    assert got[0].train_tokens == 0 and got[0].n_known == 0 and got[0].base_score == 0 and np.isfinite(got[0].score)
    assert ppm.score(docs.where("false"), F.lit(True)).count() == 0


def thue_morse(k):
    """Two words of 2**k letters that polynomial hashes mod 2**64 take for one."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_ppm_tells_structured_words_apart(spark):
    one, other = thue_morse(11)
    got = {r.doc_id: r for r in ppm.score(frame(spark, [(1, f"{one} {other}"), (2, other), (3, f"{one} x")]), F.expr("doc_id = 1")).collect()}
    # one, other and the end occur once each in training
    assert got[1].train_tokens == 3 and got[1].n_known == 3 and got[2].n_known == 2 and got[3].n_known == 2
    assert abs(got[2].base_score - 2 * np.log10(2 / (3 + 3 + 1))) < 1e-9


# -- 3 --


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(18, 60))) for k in range(40)] + [(90, None), (91, ""), (92, items_short := "tiny item here")]
    rows, want = [], set()
    for d in range(200):
        words = prose(rng, rng.randint(60, 300)).split()
        if d % 4 == 0:
            k = d // 4 % 40
            item = items[k][1].split()
            if d % 8 == 0:  # a paraphrase: a fifth of the words replaced
                for j in rng.sample(range(len(item)), len(item) // 5):
                    item[j] = prose(rng, 1)
            at = rng.randrange(len(words))
            words[at:at] = item
            want.add((d, k))
        rows.append((d, " ".join(words)))
    docs = frame(spark, [*rows, *((i, t) for i, t in ODD if i is None or i > 1000)], extra=True)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, bench).collect()}
    assert len(got & want) >= 0.95 * len(want)  # the index's recall
    assert not got - want
    assert items_short


@pytest.mark.parametrize("cosine", [0.4, 2.0])
def test_every_verbatim_leak_is_found(spark, cosine):
    """Short and long items, copied whole at any place; by words alone too, when no cosine is enough."""
    rng = random.Random(15)
    items = [(k, prose(rng, 16 + k % 5)) for k in range(40)] + [(40 + k, prose(rng, 150 + 120 * k)) for k in range(4)]
    rows, want = [], set()
    for d in range(220):
        words = prose(rng, rng.randint(60, 300)).split()
        k = d % 55
        if k < len(items):
            at = rng.randrange(len(words))
            words[at:at] = items[k][1].split()
            want.add((d, k))
        rows.append((d, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(frame(spark, rows), bench, cosine).collect()}
    assert got == want


def test_directions_are_fitted_on_all_documents(spark, monkeypatch):
    seen, fitted = [], decontaminate.latent_basis

    def counted(texts, *args):
        seen.append(sorted((r.text, r.share) for r in texts.collect()))
        return fitted(texts, *args)

    monkeypatch.setattr(decontaminate, "latent_basis", counted)
    docs = spark.range(6500).selectExpr("id AS doc_id", "concat('word', id % 50, ' other', id) AS text")
    bench = spark.createDataFrame([(1, "some words of an item"), (2, "and of another")], "item_id bigint, text string")
    decontaminate.find(docs, bench).count()
    want = [(f"word{i % 50} other{i}", 1.0) for i in range(6500)]
    want += [(r.text, decontaminate.ITEM_SHARE * 6500 / 2) for r in bench.collect()]
    assert seen == [sorted(want)]


def plain_leaks(rows, items):
    """Every passage of every document against every item, on the words themselves."""
    edge = ".,;:!?\"'()[]{}*#&%$-"

    def words_of(text):
        out = []
        for w in (text or "").lower().split():
            for _ in range(3):
                w = w[:-1] if len(w) > 1 and w[-1] in edge else w
            out.append(w[1:] if len(w) > 1 and w[0] in edge else w)
        return out

    docs = [(i, words_of(t)) for i, t in rows]
    runs = [set(w[k : k + 32]) for _, w in docs for k in range(0, len(w), 32)]
    df = {}
    for x in runs:
        for w in x:
            df[w] = df.get(w, 0) + 1
    weight = lambda w: max(0.0, np.log((len(runs) + 20) / (df.get(w, 0) + 1)) - np.log(20))
    found = set()
    for k, text in items:
        item = words_of(text)
        telling = [w for w in item if weight(w) > 0]
        rare = set(sorted(item, key=lambda w: -weight(w))[:5])
        for i, words in docs:
            for at in range(0, len(words), 32):
                more = max(0, len(item) - 32)
                passage = words[max(0, at - more) : at + 64 + more]
                if not rare & set(passage):
                    continue
                if len(telling) < 4:
                    hit = item and decontaminate.common_subsequence(item, passage) > 0.85 * len(item)
                else:
                    hit = decontaminate.common_subsequence(telling, [w for w in passage if weight(w) > 0]) >= 0.55 * len(telling)
                if hit:
                    found.add((i, k))
    return found


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.randint(14, 90))) for k in range(25)]
    rows = []
    for d in range(120):
        words = prose(rng, rng.randint(5, 250)).split()
        if d % 3:
            item = items[d % 25][1].split()
            kept = [w for w in item if rng.random() > (0, 0.2, 0.35, 0.5)[d % 4]]  # words left out, so that some are no leaks
            at = rng.randrange(len(words))
            words[at:at] = kept
        rows.append((d, " ".join(words).title() + "."))
    rows += [(500, rows[1][1]), (501, rows[1][1]), (502, ""), (503, " ".join(rows[4][1] for _ in range(300)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got, want = {(r.doc_id, r.item_id) for r in decontaminate.find(frame(spark, rows), bench).collect()}, plain_leaks(rows, items)
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 50


def test_decontamination_of_nothing(spark):
    docs, bench = frame(spark, []), spark.createDataFrame([(1, "some words")], "item_id bigint, text string")
    assert decontaminate.find(docs, bench).count() == 0
    assert decontaminate.find(frame(spark, ODD), bench.where("false")).count() == 0


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


# -- 4 and 8 --


def encoded(text, end):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(default_vocabulary()).encode(text or "", add_special_tokens=False).ids, end]


def test_token_store_round_trip(spark, corpus):
    rows = [*corpus[:30], *ODD, (99, "<|endoftext|> it's 'll a\x0bb\x85c"), (98, "É é ")]
    path = Scratch(spark, "store").root
    token_store.write_store(frame(spark, rows, extra=True), path, block_bytes=400)
    assert len(spark.read.parquet(f"{path}/dictionary").first().bytes) > 1000
    got = token_store.read_store(spark, path).collect()
    ids = lambda r: np.frombuffer(r.ids, "<u4").tolist()
    assert sorted((str(r.doc_id), ids(r)) for r in got) == sorted((str(i), encoded(t, 1)) for i, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens == len(ids(r))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    some = token_store.read_store(spark, path, [4, 17]).collect()
    assert sorted(r.doc_id for r in some) == sorted(i for i, _ in rows if i in (4, 17))


def test_structured_words_have_their_own_ids(spark):
    one, other = thue_morse(11)
    rows = [(1, one), (2, other), (3, f"{other} {one}"), (4, f"plain {one[:1024]} {other[:1024]}")]
    path = Scratch(spark, "structured").root
    token_store.write_store(frame(spark, rows), path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in token_store.read_store(spark, path).collect()}
    assert got == {i: encoded(t, 1) for i, t in rows} and got[1] != got[2]
    for r in packing.pack(frame(spark, rows)).where("piece = 0").collect():
        assert r.ids_crc32 == zlib.crc32(np.array(encoded(dict(rows)[r.doc_id], 0)[:2048], "<u4").tobytes())


def test_words_of_one_hash_are_compared_as_strings(monkeypatch):
    """With a hash that takes all words for one."""
    from gridspark.llm import tokens

    class Zero:
        def of(self, buf, starts, ends):
            return np.zeros(len(starts), np.uint64)

    texts = [b"some words", b"other words here", b"", b"some"]
    buf, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    want = [encoded(t.decode(), 0)[:-1] for t in texts]
    monkeypatch.setattr(tokens, "_HASH", Zero())
    coder = tokens.WordEncoder(default_vocabulary())
    for _ in range(2):
        flat, counts = coder.encode(buf, offsets)
        at = np.cumsum([0, *counts])
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_token_store_empty(spark):
    path = Scratch(spark, "store").root
    token_store.write_store(frame(spark, []), path)
    assert token_store.read_store(spark, path).count() == 0


def test_packing(spark, corpus):
    rows = [*corpus, *ODD]
    got = packing.pack(frame(spark, rows, extra=True), capacity=256).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    want = []
    for i, t in rows:
        ids = encoded(t, 0)
        want += [(str(i), k, a, len(p), zlib.crc32(np.array(p, "<u4"))) for k, a in enumerate(range(0, len(ids), 256)) for p in [ids[a : a + 256]]]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    total = sum(r.length for r in got)
    assert len(by_sequence) <= total / 256 * 1.02 + 1
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_recipes():
    rng = np.random.default_rng(0)
    for capacity in (8, 64, 300):
        histogram = np.bincount(rng.integers(1, capacity + 1, 5000), minlength=capacity + 1)
        recipe = packing.plan(histogram)
        length, lo, many, sequence, offset = recipe.arrays()
        made = np.zeros(recipe.sequences, int)
        for n, m, s in zip(length, many, sequence, strict=True):
            made[s : s + m] += n
        assert made.max() <= capacity and (np.bincount(length, many, capacity + 1) == np.r_[0, histogram[1:]]).all()
        assert offset.min() == 0 and lo.min() == 0


# -- 5 --


def similarity(rows):
    """Exact weighted Jaccard of all pairs of texts."""
    vectors, df = {}, {}
    for i, t in rows:
        w = (t or "").lower().split()
        grams = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
        vectors[i] = {g: grams.count(g) for g in grams}
        for g in set(grams):
            df[g] = df.get(g, 0) + 1
    idf = {g: float(near_dups.idf(np.array([n]), len(rows))[0]) for g, n in df.items()}
    out = {}
    for a in vectors:
        for b in vectors:
            if a < b:
                keys = vectors[a].keys() | vectors[b].keys()
                lo = sum(min(vectors[a].get(g, 0), vectors[b].get(g, 0)) * idf[g] for g in keys)
                hi = sum(max(vectors[a].get(g, 0), vectors[b].get(g, 0)) * idf[g] for g in keys)
                out[a, b] = lo / hi if hi else 1.0
    return out


def test_near_duplicates_against_all_pairs(spark, corpus):
    pairs = similarity(corpus)
    parent = {i: i for i, _ in corpus}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), s in pairs.items():
        if s >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(frame(spark, corpus, extra=True)).collect()}
    assert got == {i: root(i) for i, _ in corpus}


def test_near_duplicates_odd_rows(spark):
    got = near_dups.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.class_id, r.class_size))
    assert by_id[4] == [(4, 2), (4, 2)] and by_id[2][0] == (1, 4) and by_id[3] == by_id[1] == [(1, 4)]
    assert sorted(by_id[None], key=str) == [(1, 4), (None, 1)]
    assert near_dups.near_duplicates(frame(spark, [])).count() == 0


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = prose(rng, 120).split()
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.sample(range(120), 1):
            w[j] = f"new{i}"
        rows.append((i, " ".join(w)))
    got = near_dups.near_duplicates(frame(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {300}


def test_consistent_samples_follow_the_similarity():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**63, 200, dtype=np.uint64)
    a, b = rng.random(200) + 0.1, rng.random(200) + 0.1
    s = near_dups.Sampler(3000).sample(np.r_[keys, keys], np.r_[a, b], np.array([0, 200]))
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_packed_keys():
    for n in (1, 2, 1000):
        keys = np.sort(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        assert (unpacked(packed(keys)) == keys).all()


# -- 6 --


def test_resampling_draws_for_each_document_without_an_id(spark):
    """Null ids have noise of their own, and as much of it as documents with ids."""
    rows = [(None, f"word{i} and more of the same") for i in range(400)] + [(i, "the same text") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, docs.select("doc_id").limit(0), 800).collect()
    noise = {known: {round(r.key - r.log_weight, 9) for r in got if (r.doc_id is not None) == known} for known in (True, False)}
    assert len(got) == 800 and len(noise[True]) == len(noise[False]) == 400
    assert all(0.3 < np.mean(list(v)) < 0.9 for v in noise.values())


def test_resampling_matches_plain_counts(spark, corpus):
    rows = [*corpus, *ODD]
    docs, good = frame(spark, rows, extra=True), frame(spark, [(i, "") for i in range(20)])
    got = {(r.doc_id, round(r.log_weight, 6)) for r in resampling.resample(docs, good, len(rows)).collect()}
    counts = {"raw": np.zeros(resampling.BUCKETS, int), "target": np.zeros(resampling.BUCKETS, int)}

    def grams(t):
        data = (t or "").encode()
        return resampling.ngram_buckets(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]

    for i, t in rows:
        np.add.at(counts["raw"], grams(t), 1)
        if i is not None and i < 20:
            np.add.at(counts["target"], grams(t), 1)
    ratio = resampling.log_ratio(counts["raw"], counts["target"])
    assert got == {(i, round(float(ratio[grams(t)].sum()), 6)) for i, t in rows}
    few = resampling.resample(docs, good, 25).collect()
    assert len(few) == 25
    keys = sorted((r.key for r in resampling.resample(docs, good, len(rows)).collect()), reverse=True)
    assert sorted((r.key for r in few), reverse=True) == keys[:25]


def test_largest_with_ties(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), (F.floor(F.col("id") / 100)).cast("double").alias("key"))
    got = sorted(r.doc_id for r in resampling.largest(df, 150, "key", together=10, bins=4).collect())
    assert got == [*range(300, 350), *range(400, 500)]
    assert resampling.largest(df, 0, "key").count() == 0 and resampling.largest(df.limit(0), 5, "key").count() == 0


# -- 7 --


def plain_line_dedup(rows):
    seen, out = {}, {}
    order = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows}, key=lambda r: r[0])
    for i, t in order:
        data = t.encode()
        first, end, _, lines = line_dedup.chunk_ranges(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        kept = []
        for a, b, n in zip(first, end, lines, strict=True):
            body = data[a:b].removesuffix(b"\n")
            able = (n >= 2 and len(body) >= line_dedup.LEAST_BYTES) or b - a >= line_dedup.LONG_LINE
            if not able or body not in seen:
                kept.append(data[a:b])
                if able:
                    seen[body] = i
        text = b"".join(kept)
        out[i, t] = (text if len(kept) == len(first) or data.endswith(b"\n") else text.removesuffix(b"\n")).decode()
    return out


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = [prose(rng, rng.randint(3, 14)) for _ in range(300)]
    shared = [prose(rng, 9) for _ in range(12)]
    rows = []
    for i in range(60):
        text = rng.sample(lines, rng.randint(0, 8))
        if i % 3 == 0:
            text[rng.randint(0, len(text)) : 0] = shared
        if i % 10 == 0:
            text.append(prose(random.Random(8), 60))
        rows.append((i, "\n".join(text) + ("\n" if i % 7 == 0 else "")))
    rows += [(70, rows[3][1]), (70, rows[3][1]), *ODD[:9]]
    got = line_dedup.dedup_lines(frame(spark, rows, extra=True).withColumn("text_", F.col("text")))
    assert {"lang", "source", "n_chars", "node", "n_removed"} <= set(got.columns)
    want = plain_line_dedup(rows)
    for r in got.collect():
        assert r.text == want[-(2**63) if r.doc_id is None else r.doc_id, r.text_ or ""]
    removed = got.agg(F.sum("n_removed")).first()[0]
    assert removed > 20 and got.count() == len(rows)
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def plain_passage_dedup(rows):
    """By lists of lines, without the operator's code: later occurrences of repeated runs of 2 lines and 40 bytes or more go."""
    docs = sorted({(-(2**63) if i is None else i, t or "") for i, t in rows})
    lines, places = [], {}
    for d, (_, t) in enumerate(docs):
        mine = t.encode().split(b"\n")
        lines.append(mine if mine[-1] else mine[:-1])
        mine = lines[-1]
        for a in range(len(mine)):
            for b in range(a, min(len(mine), a + 40)):
                body = b"\n".join(mine[a : b + 1])
                if (b > a and len(body) >= 40) or len(body) >= 239:
                    places.setdefault(body, []).append((d, a, b))
    gone = {(d, k) for where in places.values() for d, a, b in where[1:] for k in range(a, b + 1)}
    out = {}
    for d, (i, t) in enumerate(docs):
        kept = b"".join(x + b"\n" for k, x in enumerate(lines[d]) if (d, k) not in gone)
        out[i, t] = (kept if t.endswith("\n") else kept.removesuffix(b"\n")).decode()
    return out


def test_short_passages_go(spark):
    rng = random.Random(14)
    rows, planted = [], []
    for k, (n, words) in enumerate([(2, 28), (3, 20), (4, 15), (6, 12), (8, 7), (2, 26), (5, 4)] * 3):
        passage = [prose(rng, words) for _ in range(n)]
        assert max(map(len, passage)) < line_dedup.LONG_LINE
        planted.append(passage)
        for d in range(5):
            text = [prose(rng, rng.randint(4, 12)) for _ in range(rng.randint(1, 6))]
            at = rng.randint(0, len(text))
            text[at:at] = passage
            rows.append((10 * k + d, "\n".join(text) + "\n" * (d % 2)))
    rows += [(900 + i, f"{prose(rng, 9)}\na common line\n{prose(rng, 9)}") for i in range(4)] + [(950, rows[3][1]), (950, rows[3][1]), (951, "\n\n\n"), *ODD[:9]]
    got = line_dedup.dedup_passages(frame(spark, rows, extra=True).withColumn("text_", F.col("text")))
    assert {"lang", "node", "n_chunks", "n_removed"} <= set(got.columns)
    found, want = got.collect(), plain_passage_dedup(rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.text == want[-(2**63) if r.doc_id is None else r.doc_id, r.text_ or ""]
    left = "\n".join(r.text for r in found).split("\n")
    assert all(left.count(x) == 1 for passage in planted for x in passage)
    assert left.count("a common line") == 4
    assert line_dedup.dedup_passages(frame(spark, [])).count() == 0


# -- 9 --


@pytest.mark.parametrize("length", [16, 60, 400])
def test_repeats_against_brute_force(spark, length):
    rng = random.Random(length)
    passage = prose(rng, 200)
    rows = []
    for i in range(40):
        text = prose(rng, rng.randint(5, 120))
        if i % 3 == 0:
            a = rng.randrange(len(passage) // 2)
            at = rng.randrange(len(text))
            text = text[:at] + passage[a : a + rng.randint(length - 3, len(passage))] + text[at:]
        rows.append((i, text))
    rows += [(50, "ab" * 700), (51, "x" * 900), (52, ("line of text\n" * 80)), (53, passage), (53, passage), (54, None), (None, ""), (None, passage[:length])]
    got = repeats.remove_repeats(frame(spark, rows, extra=True).withColumn("text_", F.col("text")), length)
    import hashlib

    mine = sorted((str(r.doc_id), r.text_ or "", r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got.collect())
    want = repeats.brute_force([(t or "").encode() for _, t in rows], length)
    assert mine == sorted((str(i), t or "", *w) for (i, t), w in zip(rows, want, strict=True))
    assert repeats.remove_repeats(frame(spark, []), length).count() == 0


def thue_morse_letters(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("together", [repeats.TOGETHER, 3])
def test_repeats_of_hot_and_structured_texts(spark, together):
    """One passage in many different surroundings, words that fool polynomial hashes, a very long text; classes of at most three entries, too."""
    rng, length = random.Random(together), 60
    hot = prose(rng, 12)[: length - 7]
    rows = [(i, prose(rng, rng.randint(3, 25)) + rng.choice("ab") + hot + rng.choice("xy") * rng.randint(1, 9) + prose(rng, rng.randint(3, 25))) for i in range(60)]
    one = thue_morse_letters(2048)
    rows += [(100, one), (101, one.translate({97: 98, 98: 97})), (102, prose(rng, 3000)), (103, "é" * 200), (104, rows[0][1] + "é" * 40)]
    got = repeats.remove_repeats(frame(spark, rows), length, together)
    mine = {r.doc_id: (r.n_removed, len(r.spans)) for r in got.collect()}
    want = repeats.brute_force([t.encode() for _, t in rows], length)
    assert mine == {i: w[:2] for (i, _), w in zip(rows, want, strict=True)}


def test_triggers_do_not_depend_on_the_length_of_a_text():
    """Near ties: values that differ in their low bits only."""
    values = (np.uint64(7) << np.uint64(40)) + np.random.default_rng(4).integers(0, 1 << 36, 300).astype(np.uint64)
    alone = repeats.leftmost_least(values, 40)
    for before, after in ((1, 5), (5000, 100_000), (100_000, 3)):
        rest = np.random.default_rng(before).integers(0, 1 << 63, before + after).astype(np.uint64)
        inside = repeats.leftmost_least(np.concatenate([rest[:before], values, rest[before:]]), 40)
        assert (inside[before : before + len(alone)] - before).tolist() == alone.tolist()


def test_leftmost_least():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 500, dtype=np.uint64)
    got = repeats.leftmost_least(values, 37)
    assert got.tolist() == [i + int(np.argmin(values[i : i + 37])) for i in range(464)]


# -- 10 --


def insulting(rng, n):
    rows, labels = [], []
    for i in range(n):
        words, toxic = prose(rng, rng.randint(10, 80)).split(), i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blorgface", "zunkwit", "grumpfool"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = insulting(rng, 600)
    docs = frame(spark, [*rows, *((None if i is None else i + 10000, t) for i, t in ODD)], extra=True)
    known = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, known, F.col("doc_id") < 450))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(got[i] >= 0.5) == bool(y) for i, y in labels if i >= 450]
    assert np.mean(held) > 0.97
    gapped = frame(spark, [(1, f"then blorg.face or in"), (2, "an zunk-wit of"), (3, "on g r u m p f o o l re"), (4, "nothing of the kind"), (5, "IN BLORGFACE")])
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(gapped, model).collect()}
    assert found == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_toxicity_without_labels(spark):
    model = toxicity.fit([])
    assert [r.score for r in toxicity.score(frame(spark, [(1, "text")]), model).collect()] == [pytest.approx(0.5)]
