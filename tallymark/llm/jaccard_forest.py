"""Similarity join on word shingles by a MinHash LSH forest of sorted prefix tries, with exact verification.

Every text becomes the set of its runs of five words (lower case, cut at white space; a shorter text is one run). Equal
sets are one node with a number of its own, whatever ids their texts have. A set's MinHash signature is cut into keys of `DEPTH` numbers, one a
tree. All keys are sorted as bytes, so each tree is a sorted trie: texts that share a prefix lie side by side, and nodes
of every depth are runs of the same order, read in one pass.

Prefixes are shortened from full depth. Small nodes of every depth down to the floor (where even two texts at the
threshold meet with the target probability) give their few pairs at once; they are verified on whole shingle sets. Each
text of a crowded node is verified with its neighbour in one tree as well. The least similar match so found in a crowded
node of the floor says how far that node has to be shortened: from full depth until two texts that similar meet with the
target probability. Nodes of close copies stay deep; nodes with matches near the threshold, and nodes in which no match
was found, go down to the floor.

Rows of a crowded node are cut into blocks of bounded rows and shingles. A task compares the short signatures of one
pair of blocks; only texts that pass with some partner get their sets, and a second task of the same pair of blocks gives
edges that join its texts and each text's number of links, so pairs of a node are never rows. A pair that stands in
several crowded nodes is compared in the least of them only. So all links of all nodes are counted, once each.

Texts without words have no shingles and link to nothing; null texts count as empty. Rows without an id are left out of
`classes`. Repeated rows are copies, which is a tie that needs no rule. Very long texts are taken whole. An empty table
gives no rows. Columns beyond id and text are ignored by `classes` and kept by `drop_near_copies`, whatever their names.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, written

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH, TARGET = 32, 8, 0.9999
#: Rows of a node up to which it is small.
SMALL_NODE = 5
SMALL_TABLE_ROWS = 50_000
#: Rows and shingles of each of the two blocks of a node that a task compares; distinct values that are counted at once.
BLOCK_ROWS, BLOCK_SHINGLES, GROUP_ROWS = 1024, 1 << 19, 2048
KNOWN_WORDS = 400_000
#: Bytes of a number in a tree's key: the low ones, most significant first.
NUMBER = 2


def meeting(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two texts share a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def prefix_depth(threshold: float, trees: int, deepest: int, target: float) -> int:
    """The floor: the deepest prefix that two texts at the threshold share in some tree with the target probability."""
    for depth in range(deepest, 1, -1):
        if meeting(threshold, depth, trees) >= target:
            return depth
    return 1


def measured_share(matches: dict[float, int], depth: int, floor: int) -> float:
    """The share of all matches that meets at a depth, from the number of matches of each similarity that met at the floor."""
    there = {s: n / meeting(s, floor) for s, n in matches.items()}
    return sum(n * meeting(s, depth) for s, n in there.items()) / sum(there.values())


def shortened(matches: dict[float, int], floor: int, deepest: int = DEPTH, target: float = TARGET) -> int:
    """Shorten prefixes from full depth until the measured share reaches the target; no matches: to the floor."""
    depth = deepest
    while depth > floor and (not matches or measured_share(matches, depth, floor) < target):
        depth -= 1
    return depth


class WordHashes(dict):
    """64-bit hashes of words met before."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], width: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the runs of words of each text."""
    lists = [t.lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in lists], np.int64)
    flat = np.fromiter((h for w in lists for h in map(_words.__getitem__, w)), np.uint64, int(counts.sum()))
    runs = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for k in range(width):
        runs += flat[k : k + len(runs)] * _FACTORS[k % 5] + np.uint64(k)
    runs = _mixed(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            short = flat[at : at + n]
            out.append(_mixed(np.array([(short * _FACTORS[np.arange(n) % 5]).sum() + np.uint64(n * 7919)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(sets: list[np.ndarray], size: int, seed: int = 5) -> np.ndarray:
    """MinHash signatures of non-empty sets, one row each."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 31, size, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    shift = rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    flat = np.concatenate(sets)
    low = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), size), np.uint32)
    buffer = np.empty_like(low)
    for k in range(size):
        np.multiply(low, factor[k], out=buffer)
        np.bitwise_xor(buffer, shift[k], out=buffer)
        out[:, k] = np.minimum.reduceat(buffer, starts)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and h, a number by which rows of one id and different texts are told apart."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("h")).where("id is not null")


def _packed(signed: np.ndarray) -> np.ndarray:
    """The low bytes of each number, most significant first, so that bytes sort as a trie."""
    return (signed & np.uint32(0xFFFF)).astype(">u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, h, digest of the set (null: no words), size, signature."""
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            sets = shingle_sets(part.column(1).to_pylist())
            full = [s for s in sets if len(s)]
            made = iter(_packed(signatures(full, TREES * DEPTH)) if full else [])
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            signed = [next(made).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(signed, pa.binary())], names=["id", "h", "digest", "n", "sig"])


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, the digest wanted, the digest found, shingles of the whole text."""
    for batch in batches:
        for low in range(0, batch.num_rows, 512):
            part = batch.slice(low, 512)
            sets = shingle_sets(part.column(1).to_pylist())
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digests, pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["id", "want", "digest", "shingles"])


_NO_PAIRS = tuple(np.zeros(0, np.int64) for _ in range(2))


class _Level:
    """Nodes of one depth in a stream of sorted rows: pairs that part right below a small node, and crowded nodes.

    Rows are a dict of arrays: tree, key, id, n, and the node of each depth by a number. What a run's ends cut off counts
    as crowded, whatever its size.
    """

    def __init__(self, depth: int, deepest: int, threshold: float):
        self.depth, self.deepest, self.threshold = depth, deepest, threshold
        self.held: dict | None = None
        self.crowd: int | None = None  # the crowded node that goes on

    def _pairs(self, rows: dict, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, ids, n = rows[self.depth], rows["id"], rows["n"]
        left, right = [], []
        for k in range(1, SMALL_NODE):
            i = np.arange(max(0, len(node) - k))
            i = i[(node[i] == node[i + k]) & keep[i] & (ids[i] != ids[i + k])]
            if self.depth < self.deepest:
                below = rows[self.depth + 1]
                i = i[below[i] != below[i + k]]
            i = i[np.minimum(n[i], n[i + k]) >= self.threshold * np.maximum(n[i], n[i + k])]
            left.append(np.minimum(ids[i], ids[i + k]))
            right.append(np.maximum(ids[i], ids[i + k]))
        return np.concatenate(left), np.concatenate(right)

    def feed(self, rows: dict) -> tuple[tuple[np.ndarray, np.ndarray], list[bytes], np.ndarray]:
        """Pairs, crowded nodes, and which of the given rows are in one."""
        given = len(rows["id"])
        crowded = [] if self.held is not None else [self._name(rows, 0)]
        if self.held is not None:
            rows = {k: np.concatenate([self.held[k], v]) for k, v in rows.items()}
        node = rows[self.depth]
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        length = np.diff(np.r_[starts, len(node)])
        big = length > SMALL_NODE
        big[0] |= self.crowd is not None and int(node[0]) == self.crowd
        end = len(node) if big[-1] else int(starts[-1])
        inside = np.repeat(big, length)
        pairs = self._pairs({k: v[:end] for k, v in rows.items()}, ~inside[:end])
        crowded += [self._name(rows, i) for i in starts[big].tolist()]
        self.crowd = int(node[-1]) if big[-1] else None
        self.held = {k: v[end:] for k, v in rows.items()}
        return pairs, crowded, inside[len(node) - given :]

    def close(self) -> list[bytes]:
        return [self._name(self.held, -1)] if self.held is not None and len(self.held["id"]) else []

    def _name(self, rows: dict, i: int) -> bytes:
        return bytes([rows["tree"][i]]) + rows["key"][i].tobytes()[: NUMBER * self.depth]


def _trie(floor: int, deepest: int, threshold: float):
    """Streams sorted (tree, key, id, n): candidate pairs (kind 0) and crowded nodes of every depth (kind 1)."""

    def batch_of(pairs, nodes, depth):
        a, b = pairs
        kind = np.r_[np.zeros(len(a), np.int32), np.ones(len(nodes), np.int32)]
        padded = lambda x: pa.array(np.r_[x, np.zeros(len(nodes), np.int64)].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(kind), padded(a), padded(b), pa.array(np.full(len(kind), depth, np.int32)), pa.array([None] * len(a) + nodes, pa.binary())], names=["kind", "a", "b", "depth", "node"])

    def rows_of(batch: pa.RecordBatch) -> dict:
        keys = b"".join(batch.column(1).to_pylist())
        numbers = np.frombuffer(keys, ">u2").reshape(batch.num_rows, deepest).astype(np.uint64)
        rows = {"tree": batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), "key": np.frombuffer(keys, f"V{NUMBER * deepest}"), "id": batch.column(2).to_numpy(zero_copy_only=False), "n": batch.column(3).to_numpy(zero_copy_only=False)}
        node = _mixed(rows["tree"].astype(np.uint64) + np.uint64(1))
        for d in range(deepest):
            node = _mixed(node * np.uint64(0x9E3779B97F4A7C15) + numbers[:, d])
            if d + 1 >= floor:
                rows[d + 1] = node
        return rows

    def neighbours(rows: dict, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text of a crowded node with its neighbour, in one tree."""
        ids, node = rows["id"], rows[floor]
        i = np.arange(max(0, len(ids) - 1))
        own = _mixed(ids.astype(np.uint64)) % np.uint64(TREES) == rows["tree"].astype(np.uint64)
        i = i[crowded[i] & own[i] & (node[i] == node[i + 1]) & (ids[i] != ids[i + 1])]
        n = rows["n"]
        i = i[np.minimum(n[i], n[i + 1]) >= threshold * np.maximum(n[i], n[i + 1])]
        return np.minimum(ids[i], ids[i + 1]), np.maximum(ids[i], ids[i + 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = [_Level(d, deepest, threshold) for d in range(floor, deepest + 1)]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = rows_of(batch)
            for level in levels:
                pairs, nodes, inside = level.feed(rows)
                yield batch_of(pairs, nodes, level.depth)
                if level.depth == floor:
                    yield batch_of(neighbours(rows, inside), [], floor)
        for level in levels:
            yield batch_of(_NO_PAIRS, level.close(), level.depth)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough, and how similar."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb") - both).alias("all"))
    return met.where(F.col("both") >= threshold * F.col("all")).select("a", "b", (F.col("both") / F.col("all")).alias("similarity"))


def _short_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each of a signature's numbers."""
    for batch in batches:
        short = [s[NUMBER - 1 :: NUMBER] for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["id", "short"])


def _in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each left and each right set have in common."""
    out = np.zeros((len(left), len(right)), np.int64)
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(values):
        return out
    sides = []
    for sets in (left, right):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        place = np.minimum(np.searchsorted(values, flat), len(values) - 1)
        row, place = row[values[place] == flat], place[values[place] == flat]
        order = np.argsort(place, kind="stable")
        sides.append((row[order], place[order], len(sets)))
    for low in range(0, len(values), GROUP_ROWS):
        dense = []
        for row, place, n in sides:
            i, j = np.searchsorted(place, [low, low + GROUP_ROWS])
            dense.append(np.zeros((n, min(GROUP_ROWS, len(values) - low)), np.float32))
            dense[-1][row[i:j], place[i:j] - low] = 1
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def _near(rows: pd.DataFrame, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left rows, right rows and which pairs of a pair of blocks may be similar and are compared here.

    Pairs whose short signatures agree in less than similar texts' do, less eight deviations, are left out, and so are
    those that are compared in a lesser node.
    """
    least = threshold - 8 * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    block = rows["block"].to_numpy()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    sizes = rows["n"].to_numpy()
    near = np.zeros((len(left), len(right)), bool)
    if near.size:
        short = np.frombuffer(b"".join(rows["short"]), np.uint8).reshape(len(rows), -1)
        for k, i in enumerate(left.tolist()):
            other = np.flatnonzero(np.minimum(sizes[right], sizes[i]) >= threshold * np.maximum(sizes[right], sizes[i]))
            if x == y:
                other = other[other > k]
            near[k, other] = np.count_nonzero(short[right[other]] == short[i], axis=1) >= least * short.shape[1]
    left, right, near = _kept(left, right, near)
    if len(left):
        met = rows["met"].to_numpy()
        near &= _in_common(list(met[left]), list(met[right])) == 0
        left, right, near = _kept(left, right, near)
    return left, right, near


def _kept(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    some, others = near.any(axis=1), near.any(axis=0)
    return left[some], right[others], near[some][:, others]


def _passing(threshold: float):
    """The texts of a pair of blocks that may be similar to some partner, with all that is known of them but their sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _near(rows, threshold)
        return rows.iloc[np.union1d(left, right)]

    return run


def _compared(threshold: float):
    """All links of a pair of blocks: edges (kind 0) that join its texts, and how many links (kind 1) each text has."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right, near = _near(rows, threshold)
        if not len(left):
            return pd.DataFrame(columns=["kind", "a", "b"], dtype="int64")
        ids, sizes, sets = rows["id"].to_numpy(), rows["n"].to_numpy(), rows["shingles"].to_numpy()
        both = _in_common(list(sets[left]), list(sets[right]))
        near &= both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both)
        i, j = np.nonzero(near)
        i, j = left[i], right[j]
        texts, counts = np.unique(np.r_[i, j], return_counts=True)
        top, edges = list(range(len(rows))), []
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            a, b = p, q
            while top[a] != a:
                top[a] = a = top[top[a]]
            while top[b] != b:
                top[b] = b = top[top[b]]
            if a != b:
                top[b] = a
                edges.append((0, min(ids[p], ids[q]), max(ids[p], ids[q])))
        return pd.DataFrame(edges + [(1, ids[t], c) for t, c in zip(texts.tolist(), counts.tolist(), strict=True)], columns=["kind", "a", "b"], dtype="int64")

    return run


def _in_blocks(crowded: DataFrame, met: DataFrame, signed: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges and numbers of links (kind, a, b) of crowded nodes. A group is one pair of blocks of one node."""
    count = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    blocks = crowded.groupBy("node").agg(count.alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m")
    known = signed.join(met, "id").select("id", "sig").mapInArrow(_short_signatures, "id long, short binary").join(met, "id")
    rows = crowded.select("node", "id", "n").join(blocks, "node").join(known, "id").withColumn("met", F.expr("filter(met, m -> m < node)"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("node", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "met", "short")
    passed = written(rows.groupBy("node", "x", "y").applyInPandas(_passing(threshold), rows.schema), "passing")
    return passed.join(sets, "id").groupBy("node", "x", "y").applyInPandas(_compared(threshold), "kind long, a long, b long")


def _met(crowded: DataFrame) -> DataFrame:
    """The crowded nodes that each text stands in."""
    return crowded.groupBy("id").agg(F.collect_set("node").alias("met"))


def components(edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that edges lead to. Labels spread to neighbours and jump along themselves."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        spread = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(spread, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = new.alias("x").join(labels.select(F.col("id").alias("label"), F.col("label").alias("far")), "label", "left")
        moved = written(jump.select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        changed = moved.where("old <> label").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels


def _leaves(same: DataFrame, depth: int) -> DataFrame:
    """id, n and the node of each tree at a depth, by a number."""
    nodes = F.array(*[F.xxhash64(_node_name(t, depth)) for t in range(TREES)])
    return same.select("id", "n", F.explode(nodes).alias("node"))


def _node_name(tree: int, depth: int):
    return F.concat(F.lit(bytearray([tree])), F.substring("sig", NUMBER * DEPTH * tree + 1, NUMBER * depth))


def _standing_in(nodes: DataFrame, same: DataFrame, depth: int) -> DataFrame:
    """node, id, n of the rows of the given nodes of a depth."""
    few = nodes.count() <= SMALL_TABLE_ROWS
    return _leaves(same, depth).join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "id", "n")


def depths(floor: int) -> dict[int, int]:
    """The depth that each similarity, in hundredths, is shortened to."""
    return {s: shortened({s / 100: 1} if s else {}, floor) for s in range(101)}


def _shortened_nodes(found: DataFrame, same: DataFrame, links: DataFrame, crowded: DataFrame, floor: int) -> DataFrame:
    """node, id, n of crowded nodes, each floor node's own matches having said how deep it stays."""
    side = lambda c: crowded.select("node", F.col("id").alias(c))
    inside = links.join(side("a"), "a").join(side("b"), ["b", "node"])
    least = inside.groupBy("node").agg(F.floor(F.min("similarity") * 100).cast("int").alias("s"))
    table = F.create_map(*[F.lit(x) for pair in depths(floor).items() for x in pair])
    chosen = written(least.select(F.col("node").alias("root"), F.element_at(table, F.col("s")).alias("d")).where(F.col("d") > floor), "depths")
    out = crowded.join(chosen.select(F.col("root").alias("node")), "node", "left_anti")
    names = found.where((F.col("kind") == 1) & (F.col("depth") > floor)).select("depth", F.xxhash64("node").alias("node"), F.xxhash64(F.substring("node", 1, 1 + NUMBER * floor)).alias("root"))
    deeper = written(names.join(chosen, "root").where(F.col("depth") == F.col("d")).select("depth", "node").distinct(), "nodes")
    for depth in range(floor + 1, DEPTH + 1):
        out = out.unionByName(_standing_in(deeper.where(F.col("depth") == depth).select("node"), same, depth))
    return written(out, "crowded")


def _classed(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """A row for each row with an id: id, h, class_id, n_links, copies, first (whether its set stands for its class)."""
    rows = _rows(docs, id_col, text_col)
    sketch = written(rows.mapInArrow(_sketch, "id long, h long, digest binary, n int, sig binary"), "sketch")
    same = sketch.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min_by("sig", "id").alias("sig"))
    same = written(same.withColumn("id", F.monotonically_increasing_id()), "sets")  # a set's number; kept as written

    floor = prefix_depth(threshold, TREES, DEPTH, TARGET)
    keys = F.array(*[F.struct(F.lit(t).cast("byte").alias("tree"), F.substring("sig", NUMBER * DEPTH * t + 1, NUMBER * DEPTH).alias("key")) for t in range(TREES)])
    leaves = same.select("id", "n", F.explode(keys).alias("t")).select("t.tree", "t.key", "id", "n")
    order = ["tree", "key", "id"]
    found = written(leaves.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_trie(floor, DEPTH, threshold), "kind int, a long, b long, depth int, node binary"), "candidates")
    pairs = written(found.where("kind = 0").select("a", "b").distinct(), "pairs")
    at_floor = written(found.where((F.col("kind") == 1) & (F.col("depth") == floor)).select(F.xxhash64("node").alias("node")).distinct(), "nodes")
    crowded = written(_standing_in(at_floor, same, floor), "crowded")

    # shingles of those sets only that have a candidate or stand in a crowded node, from one of their texts
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(crowded.select("id")).distinct()
    wanted = wanted.join(same, "id").select(F.col("id").alias("set"), F.col("rep").alias("id"), "digest")
    sets = rows.join(wanted, "id").select("set", "text", F.col("digest").alias("want")).mapInArrow(_wanted_sets, "id long, want binary, digest binary, shingles array<long>").where("want = digest").drop("want", "digest").dropDuplicates(["id"])
    sets = written(sets, "shingles")
    links = written(_verified(pairs, sets, threshold), "links")

    crowded = _shortened_nodes(found, same, links, crowded, floor)
    met = written(_met(crowded), "met")
    # links of texts that stand in a crowded node together are counted there
    of = lambda c: met.select(F.col("id").alias(c), F.col("met").alias(f"met_{c}"))
    alone = ~F.coalesce(F.arrays_overlap("met_a", "met_b"), F.lit(False))
    links = written(links.join(of("a"), "a", "left").join(of("b"), "b", "left").where(alone).select("a", "b"), "links-alone")
    blocks = written(_in_blocks(crowded, met, same.select("id", "sig"), sets, threshold), "blocks")
    labels = components(links.union(blocks.where("kind = 0").select("a", "b")).distinct())

    one = F.lit(1).cast("long").alias("links")
    each = links.select("a", one).union(links.select("b", one)).union(blocks.where("kind = 1").select("a", F.col("b").alias("links"))).toDF("id", "links")
    degrees = each.groupBy("id").agg(F.sum("links").alias("n_links"))
    of_set = same.select("digest", "id", "rep", "copies").join(labels, "id", "left").join(degrees, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of_set = written(of_set, "labelled")
    heads = of_set.groupBy("label").agg(F.min(F.struct("rep", "id")).alias("head"))
    of_set = of_set.join(heads, "label").select("digest", F.col("head.rep").alias("class_id"), (F.col("head.id") == F.col("id")).alias("first"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "copies")
    out = sketch.select("id", "h", "digest").join(of_set, "digest", "left")
    return out.select("id", "h", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.coalesce("first", F.lit(True)).alias("first"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, class_id (smallest id of the class), n_links, copies.

    n_links: verified links of the document's text to different texts. copies: rows with the same shingles, the row
    itself included. Rows of one id and different texts are documents of their own.
    """
    return _classed(docs, threshold, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "n_links", "copies")


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of each class, with all their columns; rows without an id stay."""
    gone = _classed(docs, threshold, id_col, text_col).where(~(F.col("first") & (F.col("id") == F.col("class_id")))).select("id", "h").distinct()
    mine = by_place(docs)
    key, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    kept = mine.join(gone, (key.cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_anti")
    return kept.toDF(*docs.columns)
