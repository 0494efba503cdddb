"""The queries that deal rows by ranges of ids, with as many shuffle partitions as a cluster has."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from lumenrank.llm import _shared, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def wide(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 1000])
def test_range_of(spark, n):
    draw = random.Random(n)
    bounds = sorted({draw.randrange(-5000, 5000) for _ in range(n)})
    rows = spark.range(-5100, 5100, 7).select("id", _shared.range_of(F.col("id"), bounds).alias("at")).collect()
    assert all(r.at == bisect.bisect_right(bounds, r.id) for r in rows)
    null = spark.range(1).select(_shared.range_of(F.lit(None).cast("long"), bounds).alias("at")).first()
    assert null.at == 0


@pytest.mark.parametrize("name", ["op4_fingerprints", "op5_token_files"])
def test_a_thousand_partitions(spark, name, wide):
    many = sorted(map(tuple, queries.QUERIES[name](wide, SF).collect()))
    wide.conf.set("spark.sql.shuffle.partitions", "4")
    assert many == sorted(map(tuple, queries.QUERIES[name](wide, SF).collect()))
