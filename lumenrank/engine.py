"""Entry points: a keyword report, a site's audit, exports, stored reports and views for SQL."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers as N
from .functions import text as T
from .functions import urls as U
from .operators import answers, audit, html, phrases, serp
from .sources import reports
from .sources.shared import written


@dataclass
class Settings:
    """What a run is made for and how far it may go."""

    own: str
    market: str = "en"
    tracked: list[str] = field(default_factory=list)
    social: list[str] = field(default_factory=list)
    engines: list[str] = field(default_factory=lambda: ["alpha", "beta", "gamma"])
    deep: int = 10
    targets: int = 16
    pages: int = 100
    questions: int = 60
    engine_calls: int = 150


class Engine:
    """Reports over tables that are there already; nothing is fetched."""

    def __init__(self, spark: SparkSession, settings: Settings):
        self.spark, self.settings = spark, settings

    def status(self) -> dict:
        """How this engine is set up."""
        return {"spark": self.spark.version, "budgets": {k: v for k, v in asdict(self.settings).items() if isinstance(v, int)}, "engines": list(self.settings.engines), "market": self.settings.market}

    def analyze(self, results: DataFrame, judgments: DataFrame | None = None, pages: DataFrame | None = None) -> dict[str, DataFrame]:
        """A report on keywords from results (keyword, position, url, domain, title).

        ``judgments`` is (keyword, url, page_type, intent, dedicated, depth); ``pages`` (url, html).
        """
        s = self.settings
        out = {
            "targets": serp.select_targets(results, s.own, s.deep, s.targets), "dominance": serp.topical_dominance(results), "competitors": serp.competitor_profiles(results, s.own, s.tracked),
        }
        if judgments is not None:
            met = results.join(judgments, ["keyword", "url"], "left").join(out["dominance"].select("domain", "dominance"), "domain", "left")
            title = T.coverage(T.keyword_terms(F.col("keyword")), T.terms(F.coalesce("title", F.lit(""))))
            met = met.withColumn("fit", serp.type_fit(F.col("page_type"), F.col("intent"))).withColumn("title", title)
            strength = serp.result_strength(F.col("fit"), F.col("dedicated"), F.col("title"), F.col("dominance"), F.col("depth"))
            out["observations"] = met.withColumn("strength", strength)
            out["assessment"] = serp.assess(out["observations"])
            out["vulnerable"] = serp.vulnerable_keywords(out["observations"])
        if pages is not None:
            facts = written(html.page_facts(pages, self._now()).select("url", "facts.*"), "facts")
            ours = results.select("keyword", "url").join(facts, "url")
            out["facts"] = facts
            out["length"] = ours.where("words >= 100").groupBy("keyword").agg(F.median("words").alias("median"), F.count(F.lit(1)).alias("pages")).where("pages >= 3")
            headings = ours.select(F.col("keyword").alias("scope"), F.col("url").alias("doc"), F.posexplode("headings").alias("ordinal", "h")).select("scope", "doc", F.col("ordinal").cast("long").alias("ordinal"), F.col("h.text").alias("heading"))
            out["subtopics"] = phrases.subtopics(headings)
        return out

    def audit(self, pages: DataFrame, said: DataFrame | None = None, citations: DataFrame | None = None) -> dict[str, DataFrame]:
        """A site's audit from pages (url, html), and answers (answer_id, engine, text) with their
        citations (answer_id, engine, ordinal, domain, own) where assistants were asked."""
        facts = written(html.page_facts(pages, self._now()).select("url", U.host(F.col("url")).alias("site"), "facts.*"), "facts")
        out = {"facts": facts}
        at = lambda c: F.to_timestamp(F.col(c))
        f = {c: F.col(c) for c in ("external_domains", "registration", "about_link", "address", "faq_schema", "faq_section", "tables", "lists", "links_in", "words")}
        none = F.lit(None).cast("double")
        f |= {"answer": none, "facts": none, "cites": none, "identity": none, "author_hint": F.col("author"), "faq_questions": F.size("faq_questions"), "question_heads": F.lit(0)}
        f["age_months"] = audit.age_months(at("modified_at"), at("published_at"), F.col("latest_year"), F.current_timestamp())
        out["criteria"] = facts.select("url", *[v.cast("double").alias(k) for k, v in audit.criteria(f).items()])
        if said is not None and citations is not None:
            brands = self.spark.createDataFrame([(d, d == self.settings.own) for d in dict.fromkeys([self.settings.own, *self.settings.tracked])], "domain string, own boolean")
            out["answers"] = answers.analyse(said, citations, answers.mentions(said, brands))
            records = said.join(out["answers"], "answer_id").select("engine", "answer_id", F.lit(False).alias("failed"), "status", F.length("text").cast("long").alias("tokens"))
            out["engines"] = answers.summarize_engines(records)
            out["overall"] = out["engines"].agg(N.r3(F.avg("rate")).alias("rate"))
        return out

    @staticmethod
    def _now():
        from datetime import datetime, timezone

        return datetime.now(timezone.utc)

    def views(self, report: dict[str, DataFrame], prefix: str = "") -> list[str]:
        """The report's tables as views for SQL."""
        names = []
        for name, df in report.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def export(self, df: DataFrame, kind: str, path: str, most: int = 1000) -> None:
        """One table as json, csv (for spreadsheets) or md."""
        if kind == "json":
            df.write.json(path)
        elif kind == "csv":
            reports.write_csv(df, path)
        elif kind == "md":
            reports.markdown_table(df, [F.col(df.columns[0])], most).coalesce(1).write.text(path)
        else:
            raise ValueError(f"no such format: {kind}")

    def save(self, report: dict[str, DataFrame], folder: str, report_id: str) -> None:
        """Each table under the report's id; an earlier one of the id goes."""
        for name, df in report.items():
            df.write.mode("overwrite").parquet(f"{folder}/{report_id}/{name}")

    def load(self, folder: str, report_id: str, tables: list[str]) -> dict[str, DataFrame]:
        return {t: self.spark.read.parquet(f"{folder}/{report_id}/{t}") for t in tables}

    def delete(self, folder: str, report_id: str) -> bool:
        """Whether there was such a report."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{report_id}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def stored(self, folder: str) -> list[str]:
        """Ids of the reports, by name."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in store.listStatus(path) if f.isDirectory()) if store.exists(path) else []

    def cancel(self, group: str) -> None:
        """Stop the jobs of a group, as ``spark.sparkContext.setJobGroup`` names them."""
        self.spark.sparkContext.cancelJobGroup(group)
