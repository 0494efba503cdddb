"""Registrable domains by a public suffix list given as a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U


def parse_suffix_list(lines: DataFrame, line_col: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """(rule, private) from the lines of a list in its published form: comments, blank lines, and the marks that open and close the
    section of private domains, by their place. A rule is a line up to its first white space."""
    line = F.trim(F.col(line_col))
    marks = lines.select(F.col(ordinal).alias("at"), line.alias("line")).where(F.col("line").contains("===BEGIN PRIVATE DOMAINS===") | F.col("line").contains("===END PRIVATE DOMAINS==="))
    # one row: where the private section is
    section = marks.agg(F.min(F.when(F.col("line").contains("BEGIN"), F.col("at"))).alias("opens"), F.max(F.when(F.col("line").contains("END"), F.col("at"))).alias("closes"))
    rules = lines.where((line != "") & ~F.startswith(line, F.lit("//"))).select(F.col(ordinal).alias("at"), F.lower(F.regexp_extract(line, r"^(\S+)", 1)).alias("rule"))
    inside = F.col("opens").isNotNull() & (F.col("at") > F.col("opens")) & (F.col("closes").isNull() | (F.col("at") < F.col("closes")))
    return rules.crossJoin(F.broadcast(section)).select("rule", inside.alias("private")).distinct()


def with_registrable(hosts: DataFrame, rules: DataFrame, host_col: str = "host", private: bool = True) -> DataFrame:
    """``hosts`` with ``suffix`` and ``registrable``, by rules (rule, private): an exception wins, else the rule of the most labels, else the last label is the
    suffix. Private rules count if ``private``. Registrable is null for a host that is itself a suffix; addresses of numbers have both null, and so has
    what is no host. Only the different hosts meet the rules, by an equality of a host's own endings; the rules, as a table, are handed out if Spark finds them small."""
    h = F.lower(F.regexp_replace(F.col("h"), r"\.$", ""))
    asked = hosts.select(F.col(host_col).alias("h")).where(F.col("h").isNotNull()).distinct()
    named = asked.withColumn("clean", h).where(~F.col("clean").rlike(r"^[\d.]+$|^\[|^$|^\.|\.\.|\.$"))
    keys = named.select("h", "clean", F.explode(U.own_suffixes(F.col("clean"))).alias("k")).select("h", "clean", "k.*")
    used = (rules if private else rules.where("not private")).select(F.lower("rule").alias("key")).distinct()
    best = keys.join(used, "key").groupBy("h").agg(F.max(F.struct("exception", "n")).alias("best"))
    n = F.coalesce("best.n", F.lit(1))
    labels = F.split("clean", r"\.")
    last = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    found = named.join(best, "h", "left").select("h", F.when(n > 0, last(n)).alias("suffix"), F.when(F.size(labels) > n, last(n + 1)).alias("registrable"))
    out = hosts.drop("suffix", "registrable").withColumn("__h", F.col(host_col))
    return out.join(found.withColumnRenamed("h", "__h"), "__h", "left").drop("__h")
