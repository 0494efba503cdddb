"""Queries over texts read them to the end."""

import pytest

from lumenrank.plans import registry

HEAD = "alpha " * 100


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("long"))
    docs = [(1, HEAD + "ending one", "en", "a"), (2, HEAD + "other close", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{at}/documents.parquet")
    asked = "which garden tools are worth the money for a small balcony in "
    turns = [(50, 0, "user", asked + "winter"), (100, 0, "user", asked + "summer"), (150, 0, "user", HEAD + "?")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_cleaned_texts_that_differ_late(spark, long_texts):
    assert len({r.loose for r in registry.QUERIES["text_cleaning"](spark, long_texts).collect()}) == 2


def test_questions_that_differ_late_and_too_long_ones(spark, long_texts):
    rows = registry.QUERIES["question_screening"](spark, long_texts).collect()
    assert sorted(r.text.split()[-1] for r in rows) == ["summer", "winter"]
