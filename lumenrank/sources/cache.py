"""A cache as a keyed table: put, get, overwrite, expire by namespace, prune by compaction.

A cache is a folder of segments, tables of (namespace, key, value, expires_at, version). A put writes one segment, under another
name until it is whole; the newest version of a key counts, also when it has expired. Compaction writes what still holds as one segment
in place of those before it, which are deleted then, so a reader sees either. Writers of one cache take turns; readers need not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
#: How long entries of a namespace hold, in milliseconds, where that is not the default.
LIFETIMES = {"volume": 7 * 24 * HOUR}
_SCHEMA = "namespace string, key string, value string, expires_at long, version long"
_NAME = re.compile(r"(put|whole)-(\d{10})$")


def search_key(provider: str, market: Column, depth: Column, keyword: Column) -> Column:
    return F.concat_ws("|", F.lit("serp"), F.lit(provider), market, depth.cast("string"), F.lower(F.trim(keyword)))


class Cache:
    """``default`` is how long entries hold, in milliseconds; nothing is kept or found where it is 0 or less."""

    def __init__(self, spark: SparkSession, folder: str, default: int, lifetimes: dict[str, int] | None = None):
        self.spark, self.folder, self.default, self.lifetimes = spark, folder.rstrip("/"), default, LIFETIMES if lifetimes is None else lifetimes
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _segments(self) -> list[tuple[int, str]]:
        """(version, name) of the segments that count: the last whole one and the puts after it."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = sorted((int(m[2]), m[0]) for s in self._fs.listStatus(self._path(self.folder)) if (m := _NAME.match(s.getPath().getName())))
        whole = max((v for v, n in found if n.startswith("whole")), default=-1)
        return [(v, n) for v, n in found if v > whole or n.startswith("whole") and v == whole]

    def _write(self, rows: DataFrame, name: str) -> None:
        spare = f"{self.folder}/_{name}"
        rows.write.mode("overwrite").parquet(spare)
        self._fs.rename(self._path(spare), self._path(f"{self.folder}/{name}"))

    def _rows(self) -> DataFrame:
        names = [f"{self.folder}/{n}" for _, n in self._segments()]
        return self.spark.read.schema(_SCHEMA).parquet(*names) if names else self.spark.createDataFrame([], _SCHEMA)

    def _newest(self) -> DataFrame:
        return self._rows().groupBy("namespace", "key").agg(F.max_by(F.struct("value", "expires_at", "version"), "version").alias("e")).select("namespace", "key", "e.*")

    def put(self, entries: DataFrame, now: int, order: Column | None = None) -> None:
        """Entries (namespace, key, value) over those of the same key; of several of a key the last by ``order``. Null keys are none."""
        life = F.lit(self.default)
        for name, ms in self.lifetimes.items():
            life = F.when(F.col("namespace") == name, ms).otherwise(life)
        version = max((v for v, _ in self._segments()), default=0) + 1
        last = entries.where("namespace is not null and key is not null").groupBy("namespace", "key").agg(F.max_by("value", F.col("value") if order is None else order).alias("value"))
        rows = last.withColumn("life", life.cast("long")).where(F.col("life") > 0).select("namespace", "key", "value", (F.lit(now) + F.col("life")).alias("expires_at"), F.lit(version).cast("long").alias("version"))
        if self.default > 0:
            self._write(rows, f"put-{version:010d}")

    def get(self, asked: DataFrame, now: int) -> DataFrame:
        """``asked(namespace, key, ...)`` with ``value`` and ``hit``."""
        held = self._newest().where((F.col("expires_at") > now) & F.lit(self.default > 0)).select("namespace", "key", "value", F.lit(True).alias("hit"))
        return asked.join(held, ["namespace", "key"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def within_budget(self, asked: DataFrame, now: int, order: list[Column], budget: int) -> DataFrame:
        """``get`` with ``outcome``: a hit costs nothing; of the keys that are not held the first ``budget`` by order may be bought, each once."""
        found = self.get(asked, now)
        missing = found.where("not hit").groupBy("namespace", "key").agg(F.min(F.struct(*order)).alias("o")).orderBy("o", "namespace", "key").limit(budget).select("namespace", "key", F.lit(True).alias("bought"))
        return found.join(missing, ["namespace", "key"], "left").withColumn("outcome", F.when(F.col("hit"), "hit").when(F.col("bought"), "bought").otherwise("over_budget")).drop("bought", "hit")

    def prune(self, now: int) -> int:
        """Compaction: only the newest entry of each key that still holds is left; how many rows went."""
        old = self._segments()
        if not old:
            return 0
        before, version = self._rows().count(), max(v for v, _ in old) + 1
        self._write(self._newest().where(F.col("expires_at") > now).select("namespace", "key", "value", "expires_at", "version"), f"whole-{version:010d}")
        for _, name in old:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)
        return before - self._rows().count()
