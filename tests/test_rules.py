"""Rules over time: file streams in several batches, with late rows, give what the tables give."""

import random

import pytest
from pyspark.sql import functions as F

from tallymark.streaming import rules, windows


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, rules.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def streamed(spark, tmp_path, rows, files):
    """The rows as a stream of so many files, one a batch."""
    path = str(tmp_path / "in")
    for i in range(files):
        rows.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.drop("_file").schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(df, name):
    """All rows that come out, with the batch they came in."""
    out = []
    q = df.writeStream.foreachBatch(lambda b, i: out.extend((i, *r) for r in b.collect())).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return out


def test_stale_checks(rocks, tmp_path):
    """a: pending for too long; b: done in time, told late; c: pending, but not for long; d: turned to error by the timer."""
    said = [("a", 0, "pending", 0), ("b", 10, "pending", 0), ("d", 20, "uploaded", 0), ("b", 200, "done", 1), ("b", 20, "uploaded", 1), ("d", 60, "pending", 1), ("e", 5000, "uploaded", 2), ("c", 4900, "pending", 2), (None, 1, "pending", 0)]
    rows = rocks.createDataFrame(said, "check_id string, s int, status string, _file int").select("check_id", F.timestamp_seconds(F.col("s") + 10_000).alias("ts"), "status", "_file")
    got = run(rules.stale(streamed(rocks, tmp_path, rows, 3), late="30 seconds"), "stale")
    last = {r[1]: r[2] for r in got}
    latest = rows.where("check_id is not null").groupBy("check_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("changed_at"))
    now = rocks.range(1).select(F.timestamp_seconds(F.lit(14_970))).first()[0]
    assert last == {r["check_id"]: r["status"] for r in windows.stale(latest, now).collect()} == {"a": "error", "b": "done", "c": "pending", "d": "error", "e": "uploaded"}


def test_retention(rocks, tmp_path):
    day = 86_400
    made = [("a", 60, 0), ("b", 3 * day, 0), ("a", day, 1), ("c", 9 * day, 1), ("d", 10 * day + 7200, 2)]
    rows = rocks.createDataFrame(made, "check_id string, s int, _file int").select("check_id", F.timestamp_seconds("s").alias("created_at"), "_file")
    got = run(rules.retention(streamed(rocks, tmp_path, rows, 3), 7), "retention")
    want = {("a", 7 * day + 60), ("b", 10 * day)}
    assert {(r[1], int(r[2].timestamp())) for r in got} == want
    first = rows.groupBy("check_id").agg(F.min("created_at").alias("created_at"))
    now = rocks.range(1).select(F.timestamp_seconds(F.lit(10 * day + 3600))).first()[0]
    assert {r["check_id"] for r in windows.expired(first, now).collect()} == {"a", "b"}


def taken(rows, most):
    out, by = {}, {}
    for email, s, request, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[2])):
        recent = by[email] = [t for t in by.get(email, []) if t > s - 86_400]
        out[email, request] = len(recent) < most
        if len(recent) < most:
            recent.append(s)
    return out


def test_rate_limit(rocks, tmp_path):
    """Only requests that were taken count; most requests are of one address; table and stream agree."""
    rng = random.Random(5)
    times = sorted(rng.randrange(5 * 86_400) for _ in range(300))
    said = [(rng.choice(["hot"] * 5 + ["a", "b"]), t, i, i // 100) for i, t in enumerate(times)] + [(None, 5, 900, 0)]
    rows = rocks.createDataFrame(said, "email string, s int, request long, _file int").select("email", F.timestamp_seconds("s").alias("ts"), "request", "_file")
    want = taken(said, 5)
    assert {(r[1], r[2]): r[3] for r in run(rules.rate_limit(streamed(rocks, tmp_path, rows, 3)), "limit")} == want and not all(want.values())
    assert {(r["email"], r["request"]): r["taken"] for r in windows.requests_taken(rows).collect()} == want


def test_reviews(rocks, tmp_path):
    said = [("c", 1, 1, "ok", "", 0), ("c", 5, 2, "no", "x", 0), ("c", 3, 1, None, "", 1), ("c", 2, 1, "late", "", 1), ("c", 4, 2, "older", "", 1), ("d", 1, 1, None, "words", 1), ("c", 9, 3, "ok", "", 2), ("d", 2, 1, "yes", None, 2)]
    rows = rocks.createDataFrame(said, "check_id string, s int, finding long, verdict string, comment string, _file int").select("check_id", F.timestamp_seconds("s").alias("ts"), "finding", "verdict", "comment", "_file")
    got = {}
    for r in run(rules.reviews(streamed(rocks, tmp_path, rows, 3)), "reviews"):
        got[r[1], r[2]] = r[3:]
    kept = {k: (v[0], v[1]) for k, v in got.items() if not v[2]}
    table = {(r["check_id"], r["finding"]): (r["verdict"], r["comment"] or "") for r in windows.latest_reviews(rows.drop("_file")).collect()}
    assert kept == table == {("c", 2): ("no", "x"), ("c", 3): ("ok", ""), ("d", 1): ("yes", "")}
