"""Importance resampling: CRCs against zlib, n-grams and the draw against brute force, odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tallymark.llm import importance as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, shortest, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least, shortest, longest, buckets, seed):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    of = {i: grams(t, shortest, longest) for i, t in rows}
    s = Counter(bucket(g) for _, gs in of.values() for g in gs)
    t = Counter(bucket(g) for x in target for g in grams(x, shortest, longest)[1])
    raw, wanted = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (raw + buckets) / ((s[b] + 1.0) * (wanted + buckets)))) for b in range(buckets)]
    out = {}
    for i, (n, gs) in of.items():
        weight = sum(gain[bucket(g)] for g in gs) // len(gs) if gs else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i in out if out[i][0] >= least), key=lambda i: (-out[i][3], i))
    for k, i in enumerate(able[: len(able) * percent // 100]):
        out[i][4] = k + 1
    return {i: tuple(x) for i, x in out.items()}


def test_crcs_compose(monkeypatch):
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 48, 49, 700]))) for _ in range(200)]
    crc = np.array([zlib.crc32(p) for p in parts], np.uint32)
    size = np.array([len(p) for p in parts])
    got = M.Shift()(crc[:-1], size[1:]) ^ crc[1:]
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[1:])]


def texts():
    rng = random.Random(5)
    some = ["Alpha", "beta", "ÄRA", "ära", "x" * 60, "7", "日本", "B2B", "it's", "über-all"]
    made = [" ".join(rng.choices(some, k=rng.randrange(0, 60))) + rng.choice(["", ".", "\n"]) for _ in range(300)]
    return [*made, None, "", "...", "word " * 3000, "Alpha\x00beta\x7fgamma"]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 1000)  # long texts come in slices
    rows = list(enumerate(texts()))
    target = ["beta ära 7 beta", None, "日本 Alpha"]
    for shortest, longest in ((1, 1), (1, 3), (2, 2)):
        docs = spark.createDataFrame([(i, "clash", t) for i, t in rows], "doc_id long, rank string, text string").repartition(3)
        goal = spark.createDataFrame([(t,) for t in target], "text string")
        got = {r[0]: tuple(r[1:]) for r in M.resample(docs, goal, 25, 5, shortest, longest, 97, 11).collect()}
        assert got == brute(rows, target, 25, 5, shortest, longest, 97, 11)
        assert sum(x[4] is not None for x in got.values()) > 20


def test_odd_rows(spark):
    schema = "doc_id long, text string"
    goal = spark.createDataFrame([("a b",)], "text string")
    assert M.resample(spark.createDataFrame([], schema), goal).count() == 0
    docs = spark.createDataFrame([(None, "a " * 30), (4, "a " * 30), (4, "a " * 30), (5, None)], schema)
    got = M.resample(docs, goal.limit(0), percent=100).collect()
    assert sorted(r["rank"] or 0 for r in got) == [0, 1, 2, 3]
