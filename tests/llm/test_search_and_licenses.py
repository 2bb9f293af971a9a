"""Nearest neighbours against brute force, licences against DuckDB."""

import random
import textwrap

import duckdb
import numpy as np

from tallymark.llm import licenses, routed_search


def brute(ids, vectors, queries, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        score = unit @ unit[i]
        score[ids == q] = -9
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -score))[:k]]
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    vectors = centres[rng.integers(0, 12, 1500)] + 0.7 * rng.normal(size=(1500, 24))
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = routed_search.search(table, table.where("vec_id % 50 = 0")).toPandas()
    kept = np.array(vectors, np.float32).astype(float)
    want = brute(np.arange(1500), kept, range(0, 1500, 50), 5)
    hits = [len(set(want[q]) & set(g["vec_id"])) for q, g in got.groupby("query_id")]
    assert sum(hits) / (5 * len(want)) >= 0.9
    for r in got.itertuples():
        a, b = kept[r.query_id], kept[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert (got.sort_values(["query_id", "rank"]).groupby("query_id")["score"].apply(lambda s: (s.diff().dropna() <= 0).all())).all()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], "a"), (50, [1.0, 0.0], "b"), (1, [0.0, 0.0], "c"), (2, None, "d"), (3, [1.0, None], "e"), (4, [float("nan"), 1.0], "f"), (5, [float("inf"), 1.0], "g"), (7, [1.0, 0.0], "h"), (6, [1.0, 0.0], "i"), (8, [1.0], "j"), (None, [1.0, 1.0], "k"), (9, [0.5, 0.5], "l")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = routed_search.search(table, table.where("vec_id % 50 = 0"))
    lists = {}
    for r in sorted(got.collect(), key=lambda r: (r["query_id"], r["rank"])):
        lists.setdefault(r["query_id"], []).append(r["vec_id"])
    assert lists == {0: [6, 7, 50, 9], 50: [0, 6, 7, 9]}
    assert routed_search.search(table.limit(0), table.limit(0)).count() == 0
    assert routed_search.search(table.where("vec_id = 0"), table.where("vec_id = 0")).count() == 0


def test_ties_and_repeated_ids_in_a_slice(spark):
    """500 equal vectors: the smallest ids win. An id repeated 20 times with near vectors takes one place."""
    rng = np.random.default_rng(8)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(i, hot) for i in rng.permutation(np.arange(500, 1000)).tolist()] + [(0, [2 * x for x in hot])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = routed_search.search(table, table.where("vec_id = 0"), probes=1000).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [500, 501, 502, 503, 504]
    rows = [(0, [1.0, 0.0])] + [(7, [1.0, 1e-3 * i]) for i in range(20)] + [(7, [1.0, 0.0])] * 20 + [(10 + i, [1.0, 1.0 + i]) for i in range(6)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = routed_search.search(table, table.where("vec_id = 0"), probes=1000).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [7, 10, 11, 12, 13]


def test_each_part_has_its_own_slices(spark, monkeypatch):
    """One part holds most rows and queries: no slice and no block grows with it."""
    monkeypatch.setattr(routed_search, "BLOCK_BYTES", 5000)
    of = lambda n, hot: spark.range(n).selectExpr("id", f"cast(if(id < {hot}, 3, id % 16) as int) as part", "cast(string(id) as binary) as v")
    index, wanted = routed_search.dealt(of(2000, 1500), of(300, 200))
    per = lambda df: [r["count"] for r in df.groupBy("part", "slice", "block").count().collect()]
    assert max(per(index)) <= 100 and max(per(wanted)) <= 100
    assert index.select("id").distinct().count() == 2000 and wanted.select("id").distinct().count() == 300
    pairs = index.alias("i").join(wanted.alias("w"), ["part", "slice", "block"]).selectExpr("i.id as a", "w.id as b")
    assert pairs.count() == pairs.distinct().count() == of(2000, 1500).alias("i").join(of(300, 200).alias("w"), "part").count()


def test_huge_and_tiny_components_and_other_lengths(spark):
    """Components of 1e200 and 1e-200 don't run out of range; vectors of other lengths meet their own kind."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) * 10.0 ** (400 * (i % 2) - 200) for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=4)]) for i in range(30)] + [(2000, [1.0]), (2001, [-2.0]), (3000, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as slice", "3 as id", "4 as v")
    got = routed_search.search(table, table.where("vec_id % 50 = 0"), probes=1000).toPandas()
    for n in (6, 4, 1):
        ids = np.array([i for i, v in rows if len(v) == n])
        vectors = np.array([[x / max(map(abs, v)) for x in v] for _, v in rows if len(v) == n])
        want = brute(ids, vectors, [i for i in ids if i % 50 == 0], 5)
        for q, expected in want.items():
            assert got[got.query_id == q].sort_values("rank")["vec_id"].tolist() == [i for i in expected if i != q]
    assert np.isfinite(got["score"]).all() and (got["score"].abs() <= 1 + 1e-12).all()


def test_queries_whose_parts_hold_too_little_look_in_all(spark, monkeypatch):
    """One probe in many small parts: every query gets its k rows all the same; samples keep within their bytes."""
    monkeypatch.setattr(routed_search, "FEWEST_PARTS", 64)
    monkeypatch.setattr(routed_search, "SAMPLE_BYTES", 8 * 6 * 1100)
    monkeypatch.setattr(routed_search, "CELLS", 5000)
    seen, inner = [], routed_search.learn
    monkeypatch.setattr(routed_search, "learn", lambda sample, *a: seen.append(len(sample)) or inner(sample, *a))
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(1200)] + [(5000, [1.0] * 9)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = routed_search.search(table, table.where("vec_id % 10 = 0 and vec_id < 5000"), k=40, probes=1).groupBy("query_id").count().collect()
    assert seen == [1100] and len(got) == 120 and {r["count"] for r in got} == {40}


def test_parts_grow_with_rows():
    assert [routed_search.wanted_parts(n) for n in (100, 10**6, 10**9, 10**12)] == [8, 125, 3953, 4096]


def test_balanced_parts():
    rng = np.random.default_rng(2)
    vectors = routed_search.unit(rng.normal(size=(800, 10)))
    part = routed_search.balanced_parts(vectors, routed_search.neighbour_graph(vectors, 8), 8)
    assert np.bincount(part, minlength=8).max() <= 1.1 * 100 + 2


def test_licenses_and_oracle(spark):
    texts = dict(licenses.licence_texts())
    mit = texts["MIT"]
    wrapped = "\n".join(textwrap.wrap("Prose before it. " + texts["GPL-3.0"] + " and the licence goes on " + "with many more words " * 300, 60))
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, "Licensed under CC BY-NC 4.0."), (3, None), (4, ""), (5, "nothing of the kind, only prose about a licence"), (6, mit + "\n\nand more"), (6, mit + "\n\nand more"), (7, "  LICENSED   under the\tApache License,\nVersion 2.0"), (8, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License"), (9, "a " * 40000)]
    rows += [(10, "The code is Licensed under CC BY 4.0, see the file for details and contact the authors."), (11, "Some\nprose, then licensed under\n the MIT\nlicense and more"), (12, "# tool\n" + texts["BSD-2-Clause"]), (13, texts["BSD-3-Clause"]), (14, wrapped), (15, texts["Apache-2.0"].upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as _b", "3 as _id")
    got = sorted(map(str, (tuple(r) for r in licenses.scan(docs).collect())))
    names = {r["doc_id"]: r["license"] for r in licenses.scan(docs).collect()}
    assert names == {1: "MIT", 2: "CC-BY-NC-4.0", 3: None, 4: None, 5: None, 6: "MIT", 7: "Apache-2.0", 8: "GPL-3.0", 9: None, 10: "CC-BY-4.0", 11: "MIT", 12: "BSD-2-Clause", 13: "BSD-3-Clause", 14: "GPL-3.0", 15: "Apache-2.0"}
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert got == sorted(map(str, con.execute(licenses.oracle()).fetchall()))
    assert licenses.scan(docs.limit(0)).count() == 0


def test_licences_quoted_from_anywhere_and_every_start(spark):
    """Middles and ends of long licences are found; every passage is scored, as plain sets of each start say."""
    texts = dict(licenses.licence_texts())
    own = {n: licenses.words(t) for n, t in texts.items()}
    quotes = [(n, w[s : s + 260]) for n, w in own.items() if len(w) > 1000 for s in (331, len(w) // 2 + 7, len(w) - 260)]
    rows = [(i, "before it " * 7 + " ".join(w) + " after it" * 9) for i, (_, w) in enumerate(quotes)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, quoted) in enumerate(quotes):
        assert got[i]["dice"] >= 0.99
        said = " ".join(quoted[:40]) in " ".join(own[got[i]["license"]])  # another licence may hold the same passage
        assert got[i]["license"] == name or said or got[i]["n_licenses"] > 1
    rng = random.Random(4)
    few = [("A", "a b c d e f g"), ("B", "c d e f"), ("C", "g f e d c b a g f e d c"), ("D", "x")]
    matcher = licenses.Matcher(few, 0.6)
    pairs = lambda w: list(zip(w, w[1:]))
    for _ in range(400):
        w = [rng.choice("abcdefgz") if rng.random() < 0.4 else "abcdefg"[i % 7] for i in range(rng.randrange(0, 30))]
        best = {}
        for name, text in few:
            t = pairs(text.split())
            if t and len(w) > 1:
                p = pairs(w)
                scores = [2 * len(set(x) & set(t)) / (len(set(x)) + len(set(t))) for s in range(max(len(p) - len(t), 0) + 1) for x in [p[s : s + len(t)]]]
                if max(scores) >= 0.6:
                    best[name] = max(scores)
        want = (None, None, 0) if not best else (min(n for n, v in best.items() if v == max(best.values())), max(best.values()), len(best))
        assert matcher.best(" ".join(w)) == want
