"""The pipeline's stages on nulls, repeats, ties, empty tables and clashing names."""

from __future__ import annotations

import pytest

ROWS = [
    (1, "plain words that nobody minds at all in this short text"),
    (1, "plain words that nobody minds at all in this short text"),
    (2, None),
    (3, ""),
    (None, "a text without an id that says something else again"),
    (4, "one two three four five six seven eight nine ten eleven"),
    (5, "w " * 50_000),
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven"), (2, None), (None, "nobody minds")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"s{k}", "n", "i", "x") for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, lang string, source string, n_words string, items string, sid string")


def kept(spark, docs, tables, name):
    import corpus_pipeline

    out = dict(corpus_pipeline.STAGES)[name](spark, docs, tables)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), tables).collect() == []
    return out


def test_toxicity(spark, docs, tables):
    out = kept(spark, docs, tables, "toxicity")
    assert out.columns == docs.columns and sorted(out.collect(), key=repr) == sorted(docs.collect(), key=repr)


def test_near_duplicates(spark, docs, tables):
    out = kept(spark, docs, tables, "simhash_near_dedup")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 2, 4, 5]


def test_decontamination(spark, docs, tables):
    out = kept(spark, docs, tables, "decontamination")
    assert out.columns == docs.columns
    # the item without an id is one window of two words
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 2, 3, 5]


def test_packing(spark, docs, tables):
    rows = kept(spark, docs, tables, "best_fit_packing").collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, None, 4, 5}
    filled = {}
    for r in rows:
        assert 0 < r["length"] <= 2048
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
