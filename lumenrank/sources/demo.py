"""A made-up web for trying things out: the same words always give the same results and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws

#: (domain, kind): a small market with one site of our own.
SITES = [
    ("own-garden.example", "own"), ("green-corner.example", "shop"), ("soil-and-seed.example", "shop"), ("balcony-plants.example", "blog"), ("tool-shed.example", "shop"), ("all-gardens.example", "directory"),
    ("ask-growers.example", "forum"), ("plant-guide.example", "blog"), ("best-of-tools.example", "listicle"), ("root-services.example", "service"), ("lawn-masters.example", "service"), ("city-leaf.example", "news"),
]
CITED = {"alpha": 0.27, "beta": 0.31, "gamma": 0.29}
UNKNOWN_VOLUME = 0.12


def drawn(*parts: Column | str, nth: int = 1) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return draws.draw(draws.fnv1a(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])), nth)


def results(keywords: DataFrame, depth: int = 10) -> DataFrame:
    """(keyword, position, url, domain, title): each keyword's sites in the order it draws."""
    sites = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(k).alias("kind")) for d, k in SITES]))
    each = keywords.select("keyword").distinct().select("keyword", sites.alias("s")).select("keyword", "s.domain", "s.kind")
    order = Window.partitionBy("keyword").orderBy(F.desc(drawn("rank", F.col("keyword"), F.col("domain"))), "domain")
    placed = each.withColumn("position", F.row_number().over(order)).where(F.col("position") <= depth)
    slug = F.replace("keyword", F.lit(" "), F.lit("-"))
    return placed.select("keyword", "position", F.concat(F.lit("https://"), "domain", F.lit("/"), slug).alias("url"), "domain", F.concat(F.initcap("keyword"), F.lit(" | "), "domain").alias("title"))


def volumes(keywords: DataFrame) -> DataFrame:
    """(keyword, volume): monthly searches, unknown for about one in eight."""
    one = keywords.select("keyword").distinct()
    share = drawn("volume", F.col("keyword"))
    return one.select("keyword", F.when(share >= UNKNOWN_VOLUME, (F.floor(drawn("volume", F.col("keyword"), nth=2) * 200) * 10 + 10).cast("long")).alias("volume"))


def answers(spark: SparkSession, questions: DataFrame) -> DataFrame:
    """(engine, question_id, cited, latency_ms): what each made-up assistant says to each question."""
    engines = F.explode(F.array(*[F.struct(F.lit(e).alias("engine"), F.lit(s).alias("share")) for e, s in CITED.items()]))
    each = questions.select("question_id", "text", engines.alias("e")).select("question_id", "text", "e.engine", "e.share")
    key = (F.col("engine"), F.col("text"))
    return each.select("engine", "question_id", (drawn("cite", *key) < F.col("share")).alias("cited"), (700 + F.floor(drawn("time", *key) * 3500)).cast("long").alias("latency_ms"))
