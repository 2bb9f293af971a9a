"""Shards of a k-d tree: every row once, equal texts together, bytes nearly equal, gapless slots, odd rows."""

import random
import zlib
from collections import Counter, defaultdict

from tallymark.llm import kd_shards as K

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def holds(rows, got, shards):
    """What must be right of any sharding; bytes of each shard."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, where, size = defaultdict(list), defaultdict(set), Counter({s: 0 for s in range(shards)})
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        where[r.text_crc32].add(r.shard)
        size[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in where.values())
    return size


def some(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = f"{i} " + "w" * int(rng.paretovariate(1.2) * 20 % 900)
        rows.append((i, text, rng.choice(["en", "en", "en", "de", None]), f"src{rng.randrange(20)}", len(text)))
    return rows


def test_nearly_equal_bytes(spark, monkeypatch):
    monkeypatch.setattr(K, "BINS", 16)  # several rounds of histograms
    rows = some(3000)
    for shards in (1, 5, 8):
        size = holds(rows, K.shard_table(table(spark, rows), shards).collect(), shards)
        mean = sum(size.values()) / shards
        assert max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean


def test_hot_text_has_a_shard_of_its_own(spark):
    rows = some(900) + [(i, "the same text everywhere " * 20, "en", f"src{i % 3}", 500) for i in range(900, 1300)]
    size = holds(rows, K.shard_table(table(spark, rows), 4).collect(), 4)
    own = 400 * (25 * 20 + 1)
    assert own in size.values()
    others = [s for s in size.values() if s != own]
    assert max(others) < 1.05 * sum(others) / 3


def test_splits_along_the_widest_dimension(spark):
    rows = [(i, f"text {i:03}", "en", "a" if i % 2 else "z", 10 if i < 60 else 12) for i in range(120)]
    got = {r.doc_id: r.shard for r in K.shard_table(table(spark, rows), 2, dims=["source"]).collect()}
    assert len({got[i] for i in range(0, 120, 2)}) == 1 and len({got[i] for i in range(1, 120, 2)}) == 1
    got = {r.doc_id: r.shard for r in K.shard_table(table(spark, rows), 2, dims=["n_chars"]).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[0] != got[60]


def test_target_bytes(spark):
    rows = some(1000)
    docs = table(spark, rows)
    path = K.fresh_path(spark, "target")
    K.write_shards(docs, path, target_bytes=9000)
    size = Counter()
    for r in K.read_shards(spark, path, docs.schema).collect():
        size[r.shard] += len(r.text) + 1
    assert len(size) == -(-sum(size.values()) // 9000) and max(size.values()) < 10_500


def test_odd_rows(spark):
    assert K.shard_table(table(spark, [], 1), 3).count() == 0
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "x", "y", -1), (2, "ж" * 40_000, "x", None, 9), (3, "a", None, "y", 1)]
    holds(rows, K.shard_table(table(spark, rows), 4).collect(), 4)
    clash = table(spark, rows).selectExpr("*", "1 as shard", "2 as slot", "3 as _digest", "4 as _shard", "double('nan') as w")
    holds(rows, K.shard_table(clash, 2, dims=["lang", "w", "_digest"]).collect(), 2)
