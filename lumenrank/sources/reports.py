"""Report tables and their index, and sinks that quote and escape what they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def csv_cell(c: Column, is_text: bool = True) -> Column:
    """Quoted where needed; text that a spreadsheet would take for a formula gets an apostrophe."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    if is_text:
        s = F.when(s.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), s)).otherwise(s)
    return F.when(s.rlike("[\",;\n\r]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column ``line``: the cells of each row; written as text with CRLF and a byte-order mark first."""
    cells = [csv_cell(F.col(n), t == "string") for n, t in df.dtypes]
    return df.select(F.concat_ws(",", *cells).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    head = df.sparkSession.createDataFrame([("﻿" + ",".join(df.columns),)], "line string")
    head.unionByName(csv_lines(df)).coalesce(1).write.option("lineSep", "\r\n").text(path)


def markdown_text(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " "), r"([\\`*_{}\[\]()#+|<>!~-])", r"\\$1")


def markdown_url(c: Column) -> Column:
    safe = F.replace(F.replace(F.replace(c, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit(" "), F.lit("%20"))
    return F.when(c.rlike("^(?i:https?)://"), safe).otherwise("")


def markdown_table(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """One column ``line``: a table of the first rows."""
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    rows = df.orderBy(*order).limit(most)
    body = rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[markdown_text(F.col(c)) for c in df.columns]), F.lit(" |")).alias("line"))
    return df.sparkSession.createDataFrame([(x,) for x in head], "line string").unionByName(body)


def save_report(df: DataFrame, folder: str, kind: str) -> None:
    """Rows with ``created_at`` as Parquet under kind and day; an earlier run of the day goes."""
    out = df.withColumn("kind", F.lit(kind)).withColumn("created_date", F.to_date("created_at"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "created_date").parquet(folder)


def list_reports(reports: DataFrame) -> DataFrame:
    """The index, newest first: a projection, never stored."""
    return reports.select("id", "kind", "created_at", "keyword").orderBy(F.desc("created_at"), "id")


def update_settings(current: DataFrame, patch: DataFrame) -> DataFrame:
    """One row: what the patch defines, else what was."""
    cols = current.columns
    both = current.alias("a").crossJoin(F.broadcast(patch.alias("b")))
    return both.select(*[F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in patch.columns else F.col(f"a.{c}") for c in cols])


def add_competitor(tracked: DataFrame, new: DataFrame, most: int = 100) -> DataFrame:
    """By domain, the first to be added stays; at most ``most``."""
    fresh = new.join(tracked, "domain", "left_anti")
    both = tracked.unionByName(fresh)
    return both.groupBy("domain").agg(F.min("added_at").alias("added_at")).orderBy("added_at", "domain").limit(most)


def remove_competitor(tracked: DataFrame, domain: str) -> DataFrame:
    return tracked.where(F.col("domain") != domain)
