"""The pipeline's stages, each against a plain version on its own input."""

import duckdb
import pytest

import corpus_pipeline
from gridspark.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_operators import plain_passage_dedup, similarity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        seen.append((name, docs, out))
        docs = out
    return {name: (before, after) for name, before, after in seen}


def test_columns_stay(stages):
    for name in ("toxicity", "line_dedup", "near_dedup", "decontamination"):
        before, after = stages[name]
        assert before.columns == after.columns and before.schema.simpleString() == after.schema.simpleString()


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = before.join(labels.where("toxic = 0"), "doc_id").count()
    assert after.join(labels.where("toxic = 0"), "doc_id").count() >= 0.98 * clean
    assert after.count() < before.count()


def test_lines(stages):
    before, after = stages["line_dedup"]
    want = plain_passage_dedup([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id: r.text for r in after.collect()} == {i: t for (i, _), t in want.items()}


def test_one_of_each_class_stays(stages):
    before, after = stages["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), s in similarity(rows).items():
        if s >= 0.8:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.doc_id for r in after.collect()} == {i for i in parent if root(i) == i}


def test_leaks_go(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before.collect() if any(t in r.text for t in items)}
    assert {r.doc_id for r in before.collect()} - {r.doc_id for r in after.collect()} == leaks


def test_all_documents_are_packed(stages):
    before, after = stages["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    for t in ("documents", "embeddings"):
        duckdb.sql(f"create or replace view {t} as select * from '{SF}/{t}.parquet'")
    want = duckdb.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_rows_without_or_with_shared_ids(spark, tmp_path):
    """Null, repeated and shared doc_ids: each row's own text decides."""
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    item = " ".join(f"item{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leak = f"{text['a']} {item} {text['b']}"

    def after(stage, rows):
        docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id bigint, text string, lang string")
        return sorted(((r.doc_id, r.text, r.lang) for r in stage(spark, docs, str(tmp_path)).collect()), key=repr)

    def want(rows):
        return sorted(((i, t, "en") for i, t in rows), key=repr)

    clean = [(7, text["c"]), (None, text["d"]), (8, text["e"]), (8, text["e"]), (9, None)]
    clean += [(100 + d, " ".join(f"filler{d}x{i}" for i in range(60))) for d in range(200)]  # so that the item's words are rare
    assert after(corpus_pipeline.drop_contaminated, [(None, leak), (7, leak), (3, leak), *clean]) == want([(i, t) for i, t in clean])
    near = text["b"] + " more"
    rows = [(1, text["b"]), (6, near), (6, text["c"]), (None, text["d"]), (None, text["d"]), (5, text["e"]), (5, text["e"]), (2, text["f"]), (None, text["f"])]
    assert after(corpus_pipeline.drop_near_duplicates, rows) == want([(1, text["b"]), (6, text["c"]), (None, text["d"]), (5, text["e"]), (2, text["f"])])


ODD_TEXTS = [(1, None), (None, "a null id"), (None, None), (2, ""), (3, "short"), (3, "short"), (4, " \n\t "), (5, "ünï ☃ 中文"), (6, "long words here " * 7000)]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_clashing_columns(spark, tmp_path, name, stage, empty):
    """Null, empty, repeated and long texts, empty tables, and columns named as those that the stages use; nothing is toxic or leaks here."""
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([] if empty else [(i, t, "x", 0) for i, t in ODD_TEXTS], "doc_id bigint, text string, score string, _id int")
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == (set() if empty else {i for i, _ in ODD_TEXTS})
        return
    assert out.columns == docs.columns
    mine, all_ = sorted(map(tuple, rows), key=repr), sorted(map(tuple, docs.collect()), key=repr)
    if name in ("toxicity", "decontamination"):
        assert mine == all_
    else:  # deduplication leaves one of equal texts, and no text that was not there
        assert {r[0] for r in mine} <= {r[0] for r in all_} and len(mine) <= len(all_) and bool(mine) != empty


def test_without_labels_of_both_kinds_everything_stays(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"clean text number {i}") for i in range(20)], "doc_id bigint, text string")
    for k, labels in enumerate([[], [(i, 1) for i in range(20)], [(i, 0) for i in range(20)]]):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{folder}/labels.parquet")
        assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == 20
