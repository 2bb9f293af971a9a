"""Collocations: brute force over pieces, prefixes split where heavy, texts over several blocks, odd rows."""

import random
import re
from collections import Counter

import pytest

from tallymark.llm import phrases as P


def brute(rows, least, longest, covered, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    often = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda s, t: any(t[i : i + len(s)] == s for i in range(len(t) - len(s) + 1))
    out = {}
    for (lang, key), a in often.items():
        if any(o == lang and len(t) > len(key) and 100 * b >= covered * a and inside(key, t) for (o, t), b in often.items()):
            continue
        cuts = [(2000000 * a // (f[lang, key[:k]] + f[lang, key[k:]]), k) for k in range(1, len(key))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(key).encode(), f[lang, key[:k]], f[lang, key[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = ["the", "of", "Über", "naïve", "a", "New", "york", "city", "x\x00y", "日本", "it's", "a\xa0b"]
    rows = []
    for _ in range(n):
        made = []
        for _ in range(rng.randrange(0, 40)):
            made += rng.choice([["New", "York", "city"], ["the", "end"], [rng.choice(words)]])
            made[-1] += rng.choice(["", "", "", ".", ",", "\n", "\t", "  "])
        rows.append((" ".join(made), rng.choice(["en", "en", "de", None])))
    return [*rows, (None, "en"), ("", None), ("...!", "fr"), ("one two " * 2000, "en")]


def mined(spark, rows, *args):
    docs = spark.createDataFrame([(t, lang, 7) for t, lang in rows], "text string, lang string, rank int").repartition(3)
    return {tuple(r) for r in P.collocations(docs, *args).collect()}


def test_against_brute_force(spark):
    rows = corpus(400)
    for args in ((5, 4, 80, 2000), (8, 3, 50, 12), (5, 2, 80, 2000), (4, 5, 90, 2000)):
        want = brute(rows, *args)
        assert len(want) > 20 and mined(spark, rows, *args) == want


def test_heavy_prefixes_are_split(spark, monkeypatch):
    monkeypatch.setattr(P, "PREFIX_ROWS", 3)
    rows = corpus(400)
    assert mined(spark, rows, 5, 4, 80, 2000) == brute(rows, 5, 4, 80, 2000)


def test_blocks_of_a_text_go_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(P, "BLOCK_WORDS", 7)
    monkeypatch.setattr(P, "SLICE", 11)
    rows = corpus(60)
    batches = [pa.RecordBatch.from_pydict({"text": [t for t, _ in rows], "lang": [lang or "und" for _, lang in rows]})]
    seen = Counter()
    for block, again in P._blocks(iter(batches), 4):
        numbers, own = P._starts(block, again)
        _, langs = block.keys(0)
        for i in range(own):
            window = numbers[i : i + 4].tolist()
            window = window[: window.index(0)] if 0 in window else window
            for m in range(1, len(window) + 1):
                seen[langs[window[0]], tuple(block.words[w].decode() for w in window[:m])] += 1
    want = brute_counts(rows)
    assert seen == want


def brute_counts(rows):
    f = Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(words)):
                for m in range(1, min(4, len(words) - i) + 1):
                    f[lang or "und", tuple(words[i : i + m])] += 1
    return f


def test_shared_hashes_change_the_seed(spark, monkeypatch):
    real = P.xxhash.xxh3_64_intdigest

    class Weak:
        @staticmethod
        def xxh3_64_intdigest(data, seed):
            return real(data, seed) if seed else len(data)

    monkeypatch.setattr(P, "xxhash", Weak)
    words = spark.createDataFrame([("ab cd ab cd", "en")], "text string, lang string")
    keys = P.Block()
    keys.add("en", [b"ab", b"cd"])
    assert len(set(keys.keys(0)[0].tolist())) == 2 and len(set(keys.keys(1)[0].tolist())) == 3
    assert words.count() == 1


@pytest.mark.parametrize("rows", [[], [(None, None)], [(" . ", "en")]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert P.collocations(docs, 1).count() == 0
