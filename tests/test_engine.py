"""The entry points over a made-up market: reports, views, exports, stored reports."""

import pytest
from pyspark.sql import functions as F

from lumenrank.engine import Engine, Settings
from lumenrank.sources import demo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, Settings("own-garden.example", tracked=["green-corner.example", "never-seen.example"]))


@pytest.fixture(scope="module")
def results(spark):
    return demo.results(spark.createDataFrame([(k,) for k in ("garden tools", "cheap garden tools", "balcony plants", "lawn care")], "keyword string")).cache()


def test_demo_is_the_same_again(spark, results):
    again = demo.results(results.select("keyword").repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, results.collect()))
    words = spark.createDataFrame([(f"w{i}",) for i in range(1000)], "keyword string")
    unknown = demo.volumes(words).where("volume is null").count()
    assert 80 < unknown < 160
    asked = words.select(F.monotonically_increasing_id().alias("question_id"), F.col("keyword").alias("text"))
    rates = {r.engine: r.rate for r in demo.answers(spark, asked).groupBy("engine").agg(F.avg(F.col("cited").cast("int")).alias("rate")).collect()}
    assert all(abs(rates[e] - share) < 0.06 for e, share in demo.CITED.items())


def test_analyze(spark, engine, results):
    judged = results.select("keyword", "url", F.lit("service_page").alias("page_type"), F.lit("transactional").alias("intent"), F.lit(0.5).alias("dedicated"), F.lit(None).cast("double").alias("depth"))
    report = engine.analyze(results, judged)
    assert {r.role for r in report["competitors"].collect()} == {"own", "tracked", "discovered"}
    assert report["assessment"].count() == 4
    assert 0 <= report["observations"].agg(F.max("strength")).first()[0] <= 1
    names = engine.views(report, "demo_")
    assert spark.sql(f"SELECT count(*) AS n FROM {names[0]}").first().n == report["targets"].count()


def test_audit(spark, engine, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("url", "html")
    said = spark.createDataFrame([(1, "alpha", "own garden is good"), (2, "beta", "try green-corner")], "answer_id long, engine string, text string")
    cited = spark.createDataFrame([(2, "beta", 0, "green-corner.example", False)], "answer_id long, engine string, ordinal int, domain string, own boolean")
    report = engine.audit(pages, said, cited)
    assert report["facts"].count() == pages.count()
    assert {r.answer_id: r.status for r in report["answers"].collect()} == {1: "named", 2: "missing"}
    folder = f"file://{tmp_path}/reports"
    engine.save({k: report[k] for k in ("criteria", "engines")}, folder, "r1")
    assert engine.stored(folder) == ["r1"]
    assert engine.load(folder, "r1", ["engines"])["engines"].count() == 2
    engine.export(report["criteria"], "csv", f"file://{tmp_path}/c")
    engine.export(report["engines"], "md", f"file://{tmp_path}/m")
    assert engine.delete(folder, "r1") and engine.stored(folder) == []
    with pytest.raises(ValueError):
        engine.export(report["criteria"], "doc", f"file://{tmp_path}/d")
    assert engine.status()["budgets"]["targets"] == 16
