"""Stages against brute force, each on what its predecessor kept; the first one really trains and scores."""

import os
import random

import corpus_pipeline
from tallymark.llm import toxicity
from tallymark.llm.common import shared_dir

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def run_stages(spark, folder, rows, labels, schema=COLUMNS):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is None, i or 0)))
        if name != "packing":
            assert docs.columns == columns
    return kept, docs


def texts(rng, n):
    """Labelled prose; toxic texts hold a word of one stem."""
    words = ["".join(rng.choice(["la", "mi", "to", "ne", "ru", "sa"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 120))]
        if i % 3 == 0:
            w[rng.randrange(len(w))] = "vekk" + rng.choice(["o", "as", "ilo", "une", "iss"])
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


def test_stages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "RANDOM_UPDATES", 200)
    monkeypatch.setattr(toxicity, "WORST_UPDATES", 200)
    rng = random.Random(3)
    made = texts(rng, 300)
    rows = [(i, t, "en", "s", 1) for i, (t, _) in enumerate(made)]
    base = " ".join(f"lami{i}" for i in range(100))
    rows += [(1001, base, "en", "s", 1), (1002, base, "en", "s", 1), (1003, base + " sa", "en", "s", 1), (1005, "mi", None, None, None), (1006, None, "en", "s", 0), (1007, "", "en", "s", 0), (1008, "mi " * 50_000, "en", "s", 9), (None, "to to", "en", "s", 9)]
    kept, packed = run_stages(spark, str(tmp_path), rows, [(i, y) for i, (_, y) in enumerate(made)])
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    net = toxicity.train(*toxicity.labelled_sample(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))))
    scores = dict(zip([r[0] for r in rows], toxicity.Scorer(net).scores([r[1] for r in rows]), strict=True))
    clean = [r for r in rows if scores[r[0]] < toxicity.THRESHOLD]
    order = lambda ids: sorted(ids, key=lambda i: (i is None, i or 0))
    assert kept[0] == order(r[0] for r in clean)
    toxic = {i for i, (_, y) in enumerate(made) if y}
    assert len(toxic & set(kept[0])) <= 10 and len(set(range(300)) - toxic - set(kept[0])) <= 10
    largest = {}
    for r in clean:
        largest[r[1] or ""] = max(largest.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert kept[1] == order(r[0] for r in clean if (-1 if r[0] is None else r[0]) == largest[r[1] or ""])
    assert 1006 not in kept[1] and 1007 in kept[1] and 1001 not in kept[1]
    assert kept[2] == [i for i in kept[1] if i != 1003 or 1002 not in kept[1]]
    assert order(set(kept[3])) == kept[2]
    whole = packed.groupBy("sequence_id").agg({"length": "sum"}).toDF("s", "n").toPandas()
    assert whole["n"].max() <= 4096


def test_clashing_columns_and_no_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "RANDOM_UPDATES", 5)
    monkeypatch.setattr(toxicity, "WORST_UPDATES", 5)
    names = ["_toxicity", "_text", "_uid", "class_id", "c0", "_scored", "sequence_id"]
    schema = COLUMNS + "".join(f", `{n}` int" for n in names)
    rows = [(i, f"text of its own {i}", "en", "s", 1, *range(7)) for i in range(6)]
    kept, _ = run_stages(spark, str(tmp_path / "a"), rows, [(0, 0)], schema)
    assert kept == [list(range(6))] * 4
    kept, _ = run_stages(spark, str(tmp_path / "b"), [], [], schema)
    assert kept == [[]] * 4


def test_intermediate_tables_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(toxicity, "RANDOM_UPDATES", 5)
    monkeypatch.setattr(toxicity, "WORST_UPDATES", 5)
    spark.createDataFrame([(i, f"text of its own {i}", "en", "s", 1) for i in range(6)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 6
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES}
