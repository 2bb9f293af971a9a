"""Exact copies: brute force, odd rows, and groups that only long prefixes tell apart."""

import hashlib
import random

from pyspark.sql import functions as F

from tallymark.llm import exact_dedup as D


def brute(rows):
    out = {}
    for i, t in rows:
        out.setdefault(t or "", []).append(i)
    return {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in out.items() for i in g}


def groups(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return [tuple(r) for r in D.exact_groups(df).collect()]


def test_radix_groups():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 9))) * rng.randrange(1, 9) for _ in range(500)]
    got = sorted(sorted(g) for g in D.radix_groups(texts, 2))
    want = {}
    for i, t in enumerate(texts):
        want.setdefault(t, []).append(i)
    assert got == sorted(want.values())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "FLUSH_BYTES", 4096)  # several passes in a task
    monkeypatch.setattr(D, "LEAST_BUCKET_BYTES", 512)  # and prefixes that must be split
    rng = random.Random(1)
    long = "the same beginning of many documents " * 40
    rows = [(i, rng.choice(["", "a", "A", "ä", long, long + str(i % 7), long * 3 + "end", f"own {i}"])) for i in range(600)]
    got = groups(spark, rows)
    assert len(got) == 600 and set(got) == brute(rows)


def test_odd_rows(spark):
    got = groups(spark, [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "x"), (None, None), (None, "y")])
    assert len(got) == 7
    assert sum(r[3] for r in got) == 3  # one of each text, however often a row repeats
    assert {r[1] for r in got if r[2] == 3 and r[4] == hashlib.sha256(b"x").hexdigest()} == {3}
    assert {r[1] for r in got if r[4] == hashlib.sha256(b"").hexdigest()} == {2}
    assert groups(spark, []) == []


def test_kept_rows_with_all_columns(spark):
    df = spark.createDataFrame([(1, "a", 7, "p"), (2, "a", 8, "q"), (3, None, 9, None), (4, "", 1, "r")], "doc_id long, text string, group_size int, `a b` string")
    got = sorted(map(tuple, D.drop_exact_copies(df).collect()))
    assert got == [(2, "a", 8, "q"), (4, "", 1, "r")]
    alone = df.where("doc_id = 3")
    assert [tuple(r) for r in D.drop_exact_copies(alone).collect()] == [(3, None, 9, None)]


def test_columns_of_any_name_and_long_texts(spark):
    names = ["_text", "_n", "_uid", "_bucket", "_null", "_rep", "c0", "c1", "kept"]
    long = "word " * 200_000
    df = spark.createDataFrame([(1, long, *range(9)), (2, long, *range(9)), (3, long + "!", *range(9))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = D.drop_exact_copies(df)
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == [2, 3]
    assert all([r[n] for n in names] == list(range(9)) for r in got.collect())
    assert sorted((r["doc_id"], r["group_size"]) for r in D.exact_groups(df).collect()) == [(1, 2), (2, 2), (3, 1)]
    assert D.drop_exact_copies(df.limit(0)).count() == 0


def test_copies_of_a_hot_text_are_merged_before_they_meet(spark, monkeypatch):
    """Half of all rows have one text: few of its representatives are left where groups end."""
    monkeypatch.setattr(D, "FLUSH_BYTES", 512)  # many representatives of one text
    monkeypatch.setattr(D, "BUCKET_BYTES", 1024)
    monkeypatch.setattr(D, "LEAST_BUCKET_BYTES", 256)
    rng = random.Random(7)
    hot = "the text that is everywhere " * 4
    rows = [(i, hot if i % 2 else rng.choice(["", "x", f"own {i}", hot + str(i % 5)])) for i in range(3000)] + [(None, hot), (2999, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(60)
    reps, key, _ = D._representatives(docs, "doc_id", "text")
    reps = reps.where("_n > 0").select(key, "_uid", "_text", "_n")
    placed, gone = D._placed(reps, key)
    of_hot = lambda df: df.where(F.col("_text") == F.lit(hot).cast("binary"))
    before, after = of_hot(reps).count(), of_hot(placed)
    assert after.count() < before / 4 and gone.count() >= before - after.count() and after.agg(F.sum("_n")).first()[0] == sum(t == hot for _, t in rows)
    got = [tuple(r) for r in D.exact_groups(docs).collect()]
    plain = [r for r in rows if r[0] is not None][:-1]
    assert {r for r in got if r[0] is not None} >= {(i, k, n + (2 if k == 2999 and n > 1000 else 0), kept, sha) for i, k, n, kept, sha in brute(plain)} - {r for r in brute(plain) if r[0] == 2999}
    assert len(got) == len(rows) and sum(r[3] for r in got) == len({t for _, t in rows})
    kept = D.drop_exact_copies(docs).collect()
    assert sorted(r["text"] for r in kept) == sorted({t for _, t in rows})
