"""Every query against its SQL in DuckDB on the smallest tables; those without SQL by properties."""

import collections
import math

import duckdb
import pytest

from lumenrank.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    mine = collections.Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    theirs = collections.Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert mine == theirs
    assert mine


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_sql_is_for_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["share_of_voice_profiles", "serp_weakness_assessment", "pick_with_quota", "plan_groups", "competitor_pages"])
def test_partitions_do_not_matter(spark, name):
    rows = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(collections.Counter(map(str, registry.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_shares_of_voice_sum_to_one(spark):
    rows = registry.QUERIES["share_of_voice_profiles"](spark, SF).collect()
    # each share is rounded to three decimals by itself
    assert 0.8 < sum(r.share_of_voice for r in rows) <= 1 + 0.0005 * len(rows)


def test_citability_never_falls(spark):
    for r in registry.QUERIES["citability_index"](spark, SF).collect():
        assert r.now is None or r.after >= r.now


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
