"""Gradients against differences, scores of whole texts, and accuracy on rows held out."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tallymark.llm import toxicity as X


def test_gradients():
    rng = np.random.default_rng(0)
    net = X.Network({"aa": 1, "bb": 2}, {"a": 2, "b": 3, "c": 4})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net._layers()
    windows = np.full((5, X.WINDOW), -1)
    for i in range(5):
        windows[i, : i + 2] = rng.integers(0, 4, i + 2)
    batch = (windows, ["aa", "bb", "abc", "cabbage"], np.array([0, 0, 1, 1, 2]), np.array([1, 0, 1]))
    _, grads = net.step(*batch)
    for name, values in net.p.items():
        at = tuple(rng.integers(0, s) for s in values.shape)
        values[at] += 1e-4
        up = net.step(*batch)[0]
        values[at] -= 2e-4
        down = net.step(*batch)[0]
        values[at] += 1e-4
        assert abs((up - down) / 2e-4 / 3 - grads[name][at]) < 2e-4, name


def sample(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["la", "mi", "to", "ne", "ru", "sa"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(5, 150))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "vekk" + rng.choice(["o", "as", "ilo", "une", "iss"])
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_learns_stems_and_finds_them_anywhere(monkeypatch):
    monkeypatch.setattr(X, "RANDOM_UPDATES", 200)
    monkeypatch.setattr(X, "WORST_UPDATES", 200)
    net = X.train(*sample(300, 1))
    texts, labels = sample(150, 2)
    scores = X.Scorer(net).scores(texts)
    assert np.mean((scores >= X.THRESHOLD) == np.array(labels)) > 0.93
    clean, toxic = [t for t, y in zip(texts, labels, strict=True) if not y], next(t for t, y in zip(texts, labels, strict=True) if y and len(t.split()) < 20)
    long = " ".join(clean[:30]) + " " + toxic
    assert X.Scorer(net).scores([long])[0] >= X.THRESHOLD  # at the very end of a long text
    assert X.Scorer(net).scores([None, "", " \n"]).tolist() == [0, 0, 0]


def test_windows_cover_every_word():
    for n in range(0, 200):
        seen = {k for s in X.window_starts(n) for k in range(s, min(s + X.WINDOW, n))}
        assert seen == set(range(n))


def test_scores_do_not_depend_on_company():
    net = X.Network({}, {c: i + 2 for i, c in enumerate("abcdefghijklmnop")})
    texts = ["abc def " * 40, "x", "ponm lkj", "a" * 5000, "..."]
    together = X.Scorer(net).scores(texts)
    alone = [X.Scorer(net).scores([t])[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-6) and ((together >= 0) & (together <= 1)).all()


def plain_scores(net, texts):
    """The worst window of each text by the network's own layers, one window at a time."""
    out = []
    for words in map(X.words_of, (t or "" for t in texts)):
        best = 0.0
        for start in X.window_starts(len(words)):
            cut = words[start : start + X.WINDOW]
            chars = np.concatenate([net.char_vectors([w]) for w in cut])
            x = np.concatenate([net.p["Ew"][[net.words.get(w, 0) for w in cut]], chars], axis=1)[:, None, :]
            mask = np.ones((len(cut), 1), np.float32)
            pooled, _ = net.word_att.forward(net.word_gru.forward(x, mask)[0], mask)
            best = max(best, float(X.sigmoid(pooled @ net.p["o"] + net.p["ob"][0])[0]))
        out.append(best)
    return out


def test_the_query_against_the_network_window_by_window(spark, monkeypatch, tmp_path):
    from tallymark.llm import queries

    monkeypatch.setattr(X, "RANDOM_UPDATES", 30)
    monkeypatch.setattr(X, "WORST_UPDATES", 10)
    monkeypatch.setattr(X, "TOGETHER_CHARS", 3000)
    texts, labels = sample(60, 5)
    texts += [None, "", " \n ", "x" * 5000, " ".join(texts[:12]), "... !!!"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nets, inner = [], X.train
    monkeypatch.setattr(X, "train", lambda *a: nets.append(inner(*a)) or nets[-1])
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    want = plain_scores(nets[0], texts)
    assert len(got) == len(texts) and max(abs(got[i]["score"] - s) for i, s in enumerate(want)) < 1e-5
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.3)


def test_one_label_only():
    net = X.train(["a b c", "d e f"], [0, 0])
    assert X.Scorer(net).scores(["a b c"])[0] < X.THRESHOLD


def test_columns_and_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(40)] + [(None, None, "y")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    texts, said = X.labelled_sample(docs, labels, toxic=5, clean=5)
    assert sum(said) == 5 and len(said) == 10 and all(zlib.crc32(t.split()[1].encode()) % 4 != 2 for t in texts)
    many = docs.unionByName(spark.createDataFrame([(1, "a" * 300_000, "x")] + [(1, f"again {k}", "x") for k in range(50)], docs.schema))
    assert len(X.labelled_sample(many, labels, toxic=1000, clean=1000)[0]) == len(X.labelled_sample(docs, labels, toxic=1000, clean=1000)[0])
    monkeypatch.setattr(X, "SAMPLE_TOTAL", 50)
    assert 0 < sum(map(len, X.labelled_sample(docs, labels)[0])) <= 50
    monkeypatch.undo()
    clash = docs.withColumnRenamed("score", "_scored").withColumn("c0", F.lit(7)).withColumn("_score", F.lit("y"))
    row = X.with_scores(clash, X.Network({}, {}), clash.columns, "score").orderBy("doc_id").collect()[-1]
    assert (row["_scored"], row["c0"], row["_score"]) == ("x", 7, "y") and 0 <= row["score"] <= 1
    out = X.with_scores(docs, X.Network({}, {}), docs.columns, "_toxicity")
    assert out.count() == 41 and out.columns == ["doc_id", "text", "score", "_toxicity"]
    assert X.with_scores(docs.limit(0), X.Network({}, {}), ["doc_id"]).count() == 0
