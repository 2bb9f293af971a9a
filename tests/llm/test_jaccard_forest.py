"""The forest join against all pairs, with crowded nodes and odd rows."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tallymark.llm import jaccard_forest as J


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return J.classes(df).collect()


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for g in range(25):
        base = [f"t{rng.randrange(3000)}" for _ in range(rng.choice([4, 30, 120, 400]))]
        rows += [(len(rows) + k, edited(rng, base, rng.choice([0, 0, 1, 2, 5]))) for k in range(6)]
    got = found(spark, rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)


def test_crowded_nodes_lose_no_class(spark, monkeypatch):
    """Many texts share a passage without being similar, and copies hide among them."""
    monkeypatch.setattr(J, "SMALL_NODE", 2)
    monkeypatch.setattr(J, "BLOCK_ROWS", 8)
    monkeypatch.setattr(J, "GROUP_ROWS", 64)
    rng = random.Random(3)
    passage = [f"p{k}" for k in range(90)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    rows += [(100 + i, edited(rng, rows[i][1].split(), 1)) for i in range(40)]
    rows += [(200 + i, edited(rng, [f"hot{k}" for k in range(150)], 1)) for i in range(60)]
    got = found(spark, rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)


def links(rows):
    """Links of each row's text to different texts, by all pairs."""
    sets = {i: frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows if (w := t.lower().split())}
    kinds = set(sets.values())
    return {i: sum(a != b and len(a & b) >= 0.8 * len(a | b) for b in kinds) for i, a in sets.items()}


def near_copies(rng):
    rows = [(i, edited(rng, [f"hot{k}" for k in range(150)], 1)) for i in range(100)]
    passage = [f"p{k}" for k in range(120)]
    rows += [(200 + i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(rng.choice([15, 60]))])) for i in range(40)]
    rows += [(300 + i, edited(rng, [f"few{k}" for k in range(100)], 2)) for i in range(4)]
    return rows + [(400, rows[0][1]), (401, rows[150 - 10][1])]


def test_all_links_of_crowded_nodes_are_counted(spark, monkeypatch):
    rows = near_copies(random.Random(5))
    for size in (512, 16):
        monkeypatch.setattr(J, "BLOCK_ROWS", size)
        got = found(spark, rows)
        assert {r["doc_id"]: r["n_links"] for r in got} == links(rows)
        assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    assert min(links(rows)[i] for i in range(100)) > 80


def test_a_task_holds_one_pair_of_blocks(spark, monkeypatch):
    """240 texts that share a passage and aren't similar: no group grows with the node."""
    inner = J._near

    def bounded(rows, threshold):
        assert len(rows) <= 64, len(rows)
        return inner(rows, threshold)

    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    monkeypatch.setattr(J, "_near", bounded)
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(90)]
    rows = [(i, " ".join(passage + [f"o{rng.randrange(10**6)}" for _ in range(60)])) for i in range(240)]
    assert {r["n_links"] for r in found(spark, rows)} == {0}


def test_blocks_find_links(spark):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, 200).astype(np.uint64)) for _ in range(4)]
    sets.append(np.unique(np.r_[sets[0][:195], sets[1][:3]]))
    sig = [s.tobytes() for s in J._packed(J.signatures(sets, J.TREES * J.DEPTH))]
    crowded = spark.createDataFrame([(1, i, 200) for i in range(5)], "node long, id long, n int")
    signed = spark.createDataFrame([(i, bytearray(s)) for i, s in enumerate(sig)], "id long, sig binary")
    shingles = spark.createDataFrame([(i, s.view(np.int64).tolist()) for i, s in enumerate(sets)], "id long, shingles array<long>")
    got = J._in_blocks(crowded, J._met(crowded), signed, shingles, 0.8).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 4), (1, 0, 1), (1, 4, 1)]


def test_the_trie_does_not_depend_on_batches():
    rng = np.random.default_rng(4)
    count, deepest, floor = 600, 4, 2
    keys = sorted((int(rng.integers(0, 2)), rng.integers(0, 2, deepest).astype(">u2").tobytes() if rng.random() < 0.3 else rng.integers(0, 5, deepest).astype(">u2").tobytes()) for _ in range(count))
    columns = [pa.array([t for t, _ in keys], pa.int8()), pa.array([k for _, k in keys], pa.binary()), pa.array(np.arange(count)), pa.array(np.full(count, 9, np.int32))]
    whole = pa.RecordBatch.from_arrays(columns, names=["tree", "key", "id", "n"])

    def made(size):
        out = [r for b in J._trie(floor, deepest, 0.8)(whole.slice(i, size) for i in range(0, count, size)) for r in b.to_pylist()]
        return {(r["a"], r["b"]) for r in out if r["kind"] == 0}, {(r["depth"], r["node"]) for r in out if r["kind"] == 1}

    name = lambda i, d: bytes([keys[i][0]]) + keys[i][1][: 2 * d]
    sizes = {d: Counter(name(i, d) for i in range(count)) for d in range(floor, deepest + 1)}
    ends = {(d, name(i, d)) for d in sizes for i in (0, count - 1)}
    want_crowded = {(d, k) for d, c in sizes.items() for k, n in c.items() if n > J.SMALL_NODE} | ends
    small = set()
    for i, j in itertools.combinations(range(count), 2):
        shared = max((d for d in sizes if name(i, d) == name(j, d)), default=0)
        if shared and sizes[shared][name(i, shared)] <= J.SMALL_NODE and (shared, name(i, shared)) not in ends:
            small.add((i, j))
    for size in (count, 1, 2, 3, 7, 50):
        pairs, crowded = made(size)
        assert crowded == want_crowded and small <= pairs
        assert all(name(i, floor) == name(j, floor) for i, j in pairs)


def test_prefixes_are_shortened_until_the_share_is_met():
    assert J.shortened({}, 6) == 6
    assert J.shortened({0.97: 1000}, 6) == 8  # close copies meet at full depth
    assert J.shortened({0.8: 1000}, 6) == 6
    assert J.shortened({0.83: 1000}, 6) == 7
    assert abs(J.measured_share({0.8: 10}, 8, 6) - J.meeting(0.8, 8)) < 1e-12


def test_deep_prefixes_find_what_short_ones_find(spark):
    """Close copies: crowded nodes stay at full depth, and all links are counted."""
    rng = random.Random(11)
    rows = [(100 * g + i, edited(rng, [f"g{g}k{k}" for k in range(400)], 2)) for g in range(6) for i in range(12)]
    got = found(spark, rows)
    assert {r["doc_id"]: (r["n_links"], r["class_id"]) for r in got} == {i: (links(rows)[i], c) for i, c in brute(rows).items()}


def test_odd_rows(spark):
    got = {(r["doc_id"], r["class_id"], r["copies"]) for r in found(spark, [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a  B"), (5, "a b"), (6, "one two three four five"), (7, "one two three four five six")])}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 3), (5, 4, 3), (6, 6, 1), (7, 7, 1)}
    assert found(spark, []) == []


def test_one_of_each_class_stays(spark):
    df = spark.createDataFrame([(3, "a b c d e f", 1), (2, "A b c d e f", 2), (9, None, 3), (None, "a b c d e f", 4)], "doc_id long, text string, class_id int")
    assert sorted(r["class_id"] for r in J.drop_near_copies(df).collect()) == [2, 3, 4]


def test_prefix_depth():
    assert J.prefix_depth(0.8, 32, 8, 0.9999) == 6 and J.prefix_depth(0.8, 1, 8, 0.9999) == 1


def test_one_id_with_two_texts(spark):
    """Sets are nodes, whatever their ids: A and B both have id 1, A' and B' are near copies of either."""
    rng = random.Random(12)
    a, b = ([f"{n}{k}" for k in range(80)] for n in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, edited(rng, a, 1)), (3, edited(rng, b, 1)), (4, "alone " * 9), (1, " ".join(b))]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in found(spark, rows))
    assert got == [(1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1, 1, 1), (3, 1, 1, 1), (4, 4, 0, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "no id", "x")], "doc_id long, text string, h string")
    kept = J.drop_near_copies(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["h"]) for r in kept) == sorted([(0, "no id", "x"), (1, rows[0][1], "x"), (1, rows[1][1], "x"), (1, rows[1][1], "x"), (4, rows[4][1], "x")])


def test_each_crowded_node_is_shortened_by_its_own_matches(spark):
    """Close copies in great number don't hide that matches of another node are near the threshold."""
    assert J.depths(6)[98] == 8 and J.depths(6)[83] == 7 and J.depths(6)[80] == 6
    rng = random.Random(21)
    rows = [(i, edited(rng, [f"hot{k}" for k in range(400)], 1)) for i in range(150)]
    for g in range(12):  # groups whose texts are 0.80 to 0.86 alike, crowded at the floor
        base = [f"g{g}x{k}" for k in range(200)]
        rows += [(1000 + 100 * g + i, edited(rng, base, 2)) for i in range(9)]
    got = found(spark, rows)
    assert {r["doc_id"]: r["class_id"] for r in got} == brute(rows)
    want, have = links(rows), {r["doc_id"]: r["n_links"] for r in got}
    some = [i for i in want if i >= 1000]
    assert sum(have[i] for i in some) >= 0.999 * sum(want[i] for i in some) and all(have[i] <= want[i] for i in want)
