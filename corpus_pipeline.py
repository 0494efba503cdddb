"""A corpus cleaned and prepared in five stages, each written as Parquet and read again.

toxicity drops the documents predicted toxic; near_duplicates keeps the smallest id of each
group; secrets replaces what the scan finds in the texts; mixing repeats documents up to their
sources' targets; encoding gives the token ids. All but the last return the columns of documents.

Rows: columns besides doc_id, text, source and lang are carried along, whatever they are called. A null
text counts as empty and stays null. Rows repeating an id are judged each by its own text: toxicity and
near_duplicates may drop one and keep another; rows of the same id and text are one document and stay or go
together, and share their draw in mixing. Of a group of near duplicates the rows of the smallest id stay; rows of a null
id belong to no group and stay. A null source is a source of its own. An empty table gives an empty one.
What a stage wrote besides its result is deleted when the next stage has been written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm import bpe, mixing, secrets, simhash, toxicity
from lumenrank.llm._shared import free_name, materialize, scratch
from lumenrank.llm.queries import MIX_WEIGHTS, RANKS, vocabulary
from lumenrank.sources.tables import read_table

#: Texts within so many bits of one another in fingerprints of their different word pairs are copies,
#: and so are those whose sets of five-word shingles have the Jaccard similarity ALIKE or more.
ALIKE = 0.8
NEAR = {"shingle_words": 2, "radius": 6, "distinct": True, "ignore": simhash.PUNCTUATION}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(docs, **NEAR, least=ALIKE)
    gone = linked.where("id <> component_id").select(F.col("id").alias("gone_id"), F.col("tag").alias("gone_tag")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["gone_id"]) & (simhash.tag_of(docs["text"]) == gone["gone_tag"]), "left_anti")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    spans = free_name(docs, "secrets")
    return secrets.redact(secrets.find_secrets(docs, out_col=spans), spans_col=spans).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.bpe_encode(docs.select("doc_id", "text"), vocabulary(RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Fingerprints, the models and the token ids are beyond SQL; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        made.clear(spark, but=docs)
        if before is not None:
            before.clear(spark)
        before = made
    return docs
