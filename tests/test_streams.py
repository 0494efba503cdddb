"""The sliding limit as a stream: the same as over the table, file by file, over a restart, with keys forgotten."""

import random

from pyspark.sql import functions as F

from lumenrank.streaming import limits

SCHEMA = "user_id long, event_id long, ts timestamp"


def events(n, users, span):
    draw = random.Random(n)
    at = sorted(1_700_000_000_000_000 + draw.choice([0, 1, 500_000]) + 1_000_000 * draw.randrange(span) for _ in range(n))
    return [(draw.choice([*range(users), None]), i, t) for i, t in enumerate(at)]


def saved(spark, rows, folder):
    df = spark.createDataFrame(rows, "user_id long, event_id long, t long")
    df.select("user_id", "event_id", F.timestamp_micros("t").alias("ts")).coalesce(1).write.mode("append").parquet(folder)


def found(df):
    return sorted((r.event_id, r.n, r.retry_after) for r in df.collect())


def test_stream_equals_table_over_a_restart(spark, tmp_path):
    rows, folder, checkpoint = events(300, 6, 4000), str(tmp_path / "events"), str(tmp_path / "checkpoint")
    plan = lambda s: limits.sliding_limit_stream(s, "user_id", 300, 3, "10 seconds")
    out = []
    for lo in (0, 150):  # the second run goes on where the first ended
        for k in range(lo, lo + 150, 75):
            saved(spark, rows[k : k + 75], folder)
        out += found(limits.run_available(spark, folder, spark.read.parquet(folder).schema, plan, "append", checkpoint, files_at_once=1))
    table = limits.sliding_count(spark.read.parquet(folder), "user_id", 300, 3)
    assert sorted(out) == found(table)
    assert any(r[2] for r in out)


def test_late_events_and_idle_keys(spark, tmp_path):
    folder = str(tmp_path / "events")
    second = 1_000_000
    parts = [[(1, 0, 0), (2, 1, 5 * second)], [(1, 2, 3 * second)], [(3, 3, 900 * second)], [(3, 4, 901 * second)], [(1, 5, 902 * second), (2, 6, 5 * second)]]
    for rows in parts:
        saved(spark, [(u, i, 1_700_000_000 * second + t) for u, i, t in rows], folder)
        import time

        time.sleep(1.1)  # files are read in the order of their times
    out = limits.run_available(spark, folder, spark.read.parquet(folder).schema, lambda s: limits.sliding_limit_stream(s, "user_id", 60, 2, "20 seconds"), "append", files_at_once=1)
    got = found(out)
    # event 2 is 2 s late and counted; event 6 is 897 s late and left out; user 1 starts anew
    assert got == [(0, 1, None), (1, 1, None), (2, 2, 57), (3, 1, None), (4, 2, 59), (5, 1, None)]


def test_no_files(spark, tmp_path):
    folder = str(tmp_path / "events")
    saved(spark, [], folder)
    out = limits.run_available(spark, folder, spark.read.schema(SCHEMA).parquet(folder).schema, lambda s: limits.sliding_limit_stream(s, "user_id", 60, 2), "append")
    assert out.collect() == []
