"""Rows that the pipeline's stages define: columns of any name, repeated ids, null ids; and what it leaves behind."""

import glob

import pytest

import corpus_pipeline
from lumenrank.llm import _shared, mixing, queries, toxicity

LONG = " ".join(f"w{i}" for i in range(80))
NEAR = LONG + " more"
CLASH = "doc_id long, text string, lang string, source string, secrets string, __source string, __rate double, __copy int, __votes int, mix_source string, mix_rate double, mix_copy int, toxicity_features int"


@pytest.fixture
def docs(spark):
    rows = [(1, LONG), (2, NEAR), (3, "a short one"), (3, NEAR), (3, "a short one"), (None, LONG), (4, None), (5, ""), (6, 'password = "hunter2222"')]
    return spark.createDataFrame([(i, t, "en", "s", "kept", "a", 0.5, 7, 9, "m", 1.5, 2, 3) for i, t in rows], CLASH)


def test_clashing_columns_come_through(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    before = sorted(map(str, docs.drop("text").collect()))
    assert sorted(map(str, toxicity.keep_clean(docs, labels).drop("text").collect())) == before
    hidden = corpus_pipeline.hide_secrets(spark, docs, "")
    assert hidden.columns == docs.columns and sorted(map(str, hidden.drop("text").collect())) == before
    assert [r.text for r in hidden.collect() if r.doc_id == 6] == ['[assign]"']
    mixed = mixing.mix(docs, queries.MIX_WEIGHTS)
    assert mixed.columns == docs.columns
    assert {str(r) for r in mixed.drop("text").collect()} <= set(before)


def test_rows_of_one_id_are_judged_by_their_texts(spark, docs):
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    # no words at all: 4 and 5 are one group; the copy under 3 goes, the other rows of 3 stay; a null id stays
    assert kept == sorted([(0, LONG), (1, LONG), (3, "a short one"), (3, "a short one"), (4, ""), (6, 'password = "hunter2222"')])


def test_intermediate_tables_are_deleted(spark):
    at = _shared.shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{at}/lumenrank-*"))
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{at}/lumenrank-*")) - before}
    assert left == {"lumenrank-stage-encoding"}
    assert out.count() > 0
