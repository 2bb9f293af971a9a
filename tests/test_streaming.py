"""The same rows as a stream and as a table."""

import pytest
from pyspark.sql import functions as F

from tallymark.streaming import windows


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


@pytest.fixture
def events(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 00:50:00", 2.0), ("b", "2024-01-01 01:20:00", 5.0), ("a", "2024-01-02 03:00:00", 7.0)], "k string, t string, value double").select("k", F.col("t").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(str(tmp_path / "e"))
    return spark.read.parquet(str(tmp_path / "e")), spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))


def test_windows(events):
    table, stream = events
    want = {tuple(r) for r in windows.tumbling(table, "ts", "1 hour", ["k"]).collect()}
    assert {tuple(r) for r in run(windows.tumbling(stream, "ts", "1 hour", ["k"]), "w1", "complete").collect()} == want
    assert {(r["k"], r["n"]) for r in windows.sessions(table, "ts", "1 hour", ["k"]).collect()} == {("a", 2), ("b", 1), ("a", 1)}
    assert sum(r["n"] for r in windows.sliding(table, "ts", "2 hours", "1 hour", ["k"]).collect()) == 8


def test_lifecycle(spark, tmp_path):
    wishes = [("c1", 1, "receiving"), ("c1", 2, "uploaded"), ("c1", 3, "pending"), ("c1", 4, "pending"), ("c1", 5, "done"), ("c2", 1, "uploaded"), ("c2", 2, "receiving")]
    rows = spark.createDataFrame(wishes, "check_id string, s int, wanted string").select("check_id", F.timestamp_seconds("s").alias("ts"), "wanted")
    rows.coalesce(1).write.parquet(str(tmp_path / "c"))
    want = {tuple(r) for r in windows.lifecycle(rows).collect()}
    assert want == {("c1", "done", 4, 1), ("c2", "receiving", 1, 1)}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c"))
    assert {tuple(r) for r in run(windows.lifecycle_stream(stream), "w2", "update").collect()} == want


def test_lifecycle_of_one_large_check(spark):
    """Most events are of one check: they are folded in several tasks, and give what one fold in order gives."""
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b"]), rng.randrange(2500), rng.choice([*windows.TRANSITIONS, "pending", "other", None])) for _ in range(4000)]
    rows += [("hot", 1300, "error")] * 50 + [(None, 1, "receiving"), (None, 2, "receiving"), ("late", None, "error"), ("late", 3, "receiving")]
    events = spark.createDataFrame(rows, "check_id string, s int, wanted string").select("check_id", F.timestamp_seconds("s").alias("ts"), "wanted")
    last = lambda x: (x is None, x or "")
    want = set()
    for check in {r[0] for r in rows}:
        own = sorted(((s is None, s or 0), last(w)) for c, s, w in rows if c == check)
        want.add((check, *windows.follow(None, [None if w[0] else w[1] for _, w in own])))
    assert {tuple(r) for r in windows.lifecycle(events).collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = [r["rows"] for r in windows.pieces(events).where("check_id = 'hot'").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(hot) >= 3 and max(hot) <= 0.5 * sum(hot)


def test_state_rules(spark):
    checks = spark.createDataFrame([("a", "pending", "2024-01-01 00:00:00"), ("b", "pending", "2024-01-01 00:09:00")], "id string, status string, t string").withColumn("changed_at", F.col("t").cast("timestamp")).withColumn("created_at", F.col("changed_at"))
    assert {r["id"]: r["status"] for r in windows.stale(checks, "2024-01-01 00:10:00").collect()} == {"a": "error", "b": "pending"}
    assert windows.expired(checks, "2024-01-08 00:05:00").count() == 1
    reviews = spark.createDataFrame([("c", 1, 1, "ok", ""), ("c", 1, 2, None, ""), ("c", 2, 1, "no", "x")], "check_id string, finding int, ts int, verdict string, comment string")
    assert [(r["finding"], r["verdict"]) for r in windows.latest_reviews(reviews).collect()] == [(2, "no")]
