"""Approximate nearest neighbours over learned partitions.

A bounded sample of vectors is joined into its neighbour graph; the graph is cut into parts of equal size that keep
neighbours together; a small classifier, trained in numpy, learns the part of a vector. The classifier then gives every
row of the index its part, and each query the few parts that are likeliest to hold its neighbours. Candidates of those
parts are ranked by their exact cosine in double precision.

Search runs in blocks: rows and queries are counted by part, and each part is dealt over as many slices of bounded bytes
as its own rows need, its queries likewise. Slices and blocks are of one size and parts grow in number with the root of
the rows, so a part's queries nearly always are one block, and its rows are sent once. Each task multiplies one slice
with one block of queries, a bounded square at a time, and keeps the k best of each query by exact score and id.

Vectors that are null, empty, zero or hold null or non-finite components take no part. The router learns from vectors of
the sample's commonest length; those of any other length are a part of their own, and are compared with vectors of their
length alone, all of them. Vectors are scaled by a power of two before norms, which changes no score and keeps huge and
tiny components from running out of range. Rows with equal ids count as one candidate, their best. A query isn't its own
candidate. Ties go to the smaller id. Queries whose likeliest parts hold fewer than k candidates look in all parts. An empty table gives no rows. Columns beyond id and vector are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bounds of the sample that partitions are learned from (rows, and rows for each part), and of the classifier.
SAMPLE, MOST_SAMPLE, SAMPLE_OF_PART, NEIGHBOURS, REFINE, HIDDEN, STEPS, HELD_ROWS = 6000, 100_000, 24, 10, 12, 64, 500, 2000
#: Bytes of the sample, and cells of a matrix of similarities that is held at once.
SAMPLE_BYTES, CELLS = 64 << 20, 4 << 20
#: What one task holds of either side, and how many rows of each it multiplies at once.
BLOCK_BYTES, SQUARE = 16 << 20, 1024
#: Parts: as many as the root of so many rows; the most are what the largest sample can teach. Parts for other lengths.
PART_ROWS, FEWEST_PARTS, MOST_PARTS, OTHER_PARTS = 64, 8, 4096, 64
#: Recall that the number of probes is chosen for, on vectors that the router hasn't learned from, and their share.
TARGET_RECALL, HELD_OUT = 0.95, 0.2
#: By how much products of matrices may differ from exact scores.
TOLERANCE = 1e-9


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component under one."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each row of the sample by cosine, the row itself not among them."""
    out = np.empty((len(vectors), k), np.int64)
    high = max(1, CELLS // len(vectors))
    for low in range(0, len(vectors), high):
        near = vectors[low : low + high] @ vectors.T
        near[np.arange(len(near)), np.arange(low, low + len(near))] = -2
        out[low : low + high] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, seed: int = 3) -> np.ndarray:
    """Parts of nearly equal size with few edges cut: halved along main axes, then vertices move to where most of
    their neighbours are, as far as the balance allows."""
    rng = np.random.default_rng(seed)
    n = len(vectors)
    part = np.zeros(n, np.int64)
    groups = [(np.arange(n), 0, parts)]
    while groups:
        rows, first, count = groups.pop()
        part[rows] = first
        if count == 1 or len(rows) < 2:
            continue
        centred = vectors[rows] - vectors[rows].mean(0)
        axis = rng.normal(size=vectors.shape[1])
        for _ in range(12):
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-30
        half = count // 2
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(order) * half // count
        groups += [(order[:cut], first, half), (order[cut:], first + half, count - half)]
    limit = int(np.ceil(1.1 * n / parts)) + 1
    here, there = np.repeat(np.arange(n), graph.shape[1]), graph.reshape(-1)
    here, there = np.r_[here, there], np.r_[there, here]
    size = np.bincount(part, minlength=parts)
    for _ in range(REFINE):
        pair, votes = np.unique(here * parts + part[there], return_counts=True)  # neighbours of each vertex in each part
        vertex, candidate = pair // parts, pair % parts
        order = np.lexsort((candidate, -votes, vertex))
        first = order[np.r_[True, vertex[order][1:] != vertex[order][:-1]]]
        want, best, own = part.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
        want[vertex[first]], best[vertex[first]] = candidate[first], votes[first]
        inside = candidate == part[vertex]
        own[vertex[inside]] = votes[inside]
        gain, moved = best - own, 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[want[i]] < limit:
                size[part[i]] -= 1
                part[i] = want[i]
                size[want[i]] += 1
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A classifier with one hidden layer: a vector's likeliest parts."""

    def __init__(self, vectors: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, seed: int = 5):
        """Learns half each row's own part, half the share of its neighbours in each part."""
        rng = np.random.default_rng(seed)
        d = vectors.shape[1]
        self.p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
        inputs = vectors * np.sqrt(d)
        first, second = [np.zeros_like(w) for w in self.p], [np.zeros_like(w) for w in self.p]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(vectors), min(256, len(vectors)))
            x, y = inputs[at], np.zeros((len(at), parts))
            np.add.at(y, (np.repeat(np.arange(len(at)), graph.shape[1]), part[graph[at]].reshape(-1)), 0.5 / graph.shape[1])
            y[np.arange(len(at)), part[at]] += 0.5
            hidden = np.maximum(x @ self.p[0] + self.p[1], 0)
            logits = hidden @ self.p[2] + self.p[3]
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            out = (prob - y) / len(at)
            back = (out @ self.p[2].T) * (hidden > 0)
            for i, g in enumerate([x.T @ back, back.sum(0), hidden.T @ out, out.sum(0)]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                rate = 0.01 * (1 - step / (STEPS + 1)) + 1e-4
                self.p[i] -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)

    def ranked(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The likeliest parts of each vector, likeliest first."""
        x = unit(vectors) * np.sqrt(vectors.shape[1])
        logits = np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]
        return np.argsort(-logits, axis=1, kind="stable")[:, :count]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (doubles) of rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def learn(sample: np.ndarray, rows: int, k: int) -> tuple[Router, int, int] | None:
    """Router, number of parts and number of probes. Parts grow with the square root of the table's rows.

    Probes are the fewest that find the target share of the k nearest of vectors held out, among the sample. In the
    whole table neighbours are nearer, so the share found there is higher.
    """
    parts = int(min(wanted_parts(rows), max(1, len(sample) // 16)))
    vectors = unit(sample)
    held = max(1, min(HELD_ROWS, int(HELD_OUT * len(vectors))))
    test, vectors = vectors[:held], vectors[held:]
    neighbours = min(NEIGHBOURS, len(vectors) - 1)
    if parts < 2 or neighbours < 1:
        return None
    graph = neighbour_graph(vectors, neighbours)
    part = balanced_parts(vectors, graph, parts)
    router = Router(vectors, part, graph, parts)
    own, ranked = router.ranked(vectors, 1)[:, 0], router.ranked(test, parts)
    high = max(1, CELLS // len(vectors))
    nearest = np.concatenate([np.argsort(-(test[low : low + high] @ vectors.T), axis=1)[:, :k] for low in range(0, held, high)])
    place = np.argsort(ranked, axis=1)  # of each part in each test vector's ranking
    found = np.take_along_axis(place, own[nearest], axis=1)
    share = np.cumsum(np.bincount(found.reshape(-1), minlength=parts)) / found.size
    return router, parts, int(np.searchsorted(share, TARGET_RECALL)) + 1


def wanted_parts(rows: int) -> int:
    return int(min(MOST_PARTS, max(FEWEST_PARTS, round(np.sqrt(rows / PART_ROWS)))))


def _routed(router: Router | None, count: int, width: int, many: bool):
    """Adds the part (one row) or the likeliest parts (a row each); parts below 0 hold vectors of other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids, lists = part.column(0).to_pylist(), part.column(1).to_pylist()
                alike = [i for i, x in enumerate(lists) if len(x) == width]
                other = [i for i, x in enumerate(lists) if len(x) != width]
                out: list[tuple[int, int, bytes]] = [(ids[i], -1 - len(lists[i]) % OTHER_PARTS, np.array(lists[i], "<f8").tobytes()) for i in other]
                if alike:
                    v = np.array([lists[i] for i in alike], np.float64)
                    ranked = router.ranked(v, count if many else 1) if router else np.zeros((len(v), 1), np.int64)
                    for i, row, parts in zip(alike, v.astype("<f8"), ranked.tolist(), strict=True):
                        raw = row.tobytes()
                        out += [(ids[i], p, raw) for p in parts]
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["id", "part", "v"])

    return run


def _best(k: int):
    """One slice of candidates against one block of queries: the k best of each query, within each length of vectors."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def of_length(ids: np.ndarray, c: np.ndarray, raw: np.ndarray, queries: np.ndarray, q: np.ndarray) -> list[tuple]:
        order = np.argsort(ids, kind="stable")
        ids, c, raw = ids[order], c[order], raw[order]
        seen: dict[bytes, int] = {}
        vector = np.array([seen.setdefault(v, len(seen)) for v in raw])  # equal vectors, one number
        first = np.unique(vector, return_index=True)[1]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        names, many = ids[starts], len(starts) < len(ids)
        unit_c, unit_q, c, q = unit(c), unit(q), scaled(c), scaled(q)
        out = []
        high = max(1, SQUARE * SQUARE // len(ids))
        for low in range(0, len(queries), high):
            near = unit_q[low : low + high] @ unit_c.T
            for i, row in enumerate(near, low):
                top = np.maximum.reduceat(row, starts) if many else row  # of each id
                top = np.where(names == queries[i], -np.inf, top)
                least = np.partition(top, -k)[-k] - TOLERANCE if k < len(top) else -2.0
                some = np.flatnonzero((row >= least) & (ids != queries[i]))
                if not len(some):
                    continue
                which, at = np.unique(vector[some], return_inverse=True)
                exact = np.array([np.dot(q[i], c[j]) / (np.linalg.norm(q[i]) * np.linalg.norm(c[j])) for j in first[which]])
                score = exact[at]
                ranked = np.lexsort((ids[some], -score))
                if many:
                    ranked = ranked[np.sort(np.unique(ids[some][ranked], return_index=True)[1])]
                out += [(queries[i], ids[some[j]], float(score[j])) for j in ranked[:k]]
        return out

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty
        sides, out = [], []
        for side in (left, right):
            raw = side["v"].to_numpy()
            sides.append((side["id"].to_numpy(), raw, np.array([len(v) for v in raw])))
        (ids, of_row, row_bytes), (queries, of_query, query_bytes) = sides
        for n in np.unique(query_bytes).tolist():
            rows, asked = np.flatnonzero(row_bytes == n), np.flatnonzero(query_bytes == n)
            if len(rows):
                c, q = (np.frombuffer(b"".join(v), "<f8").reshape(-1, n // 8) for v in (of_row[rows], of_query[asked]))
                out += of_length(ids[rows], c, of_row[rows], queries[asked], q)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]) if out else empty

    return run


def dealt(index: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and queries with part, slice and block, in as many slices and blocks as each part's own bytes need."""
    count = lambda df, name: df.groupBy("part").agg(F.ceil(F.sum(F.length("v") + 100) / BLOCK_BYTES).cast("int").alias(name))
    # one row a part: MOST_PARTS and OTHER_PARTS rows at most
    of_part = written(count(index, "slices").join(count(wanted, "blocks"), "part"), "parts")
    place = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index, wanted = (df.join(F.broadcast(of_part), "part") for df in (index, wanted))
    index = index.withColumn("slice", place("slices")).withColumn("block", every("blocks"))
    wanted = wanted.withColumn("block", place("blocks")).withColumn("slice", every("slices"))
    columns = ["part", "slice", "block", "id", "v"]
    return index.select(*columns), wanted.select(*columns)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each query."""
    base, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    spark = vectors.sparkSession
    lengths = written(base.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")), "lengths")
    rows = lengths.agg(F.sum("n")).first()[0]
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, alike = lengths.orderBy(F.desc("n"), "length").select("length", "n").first()
    size = int(max(1, min(MOST_SAMPLE, max(SAMPLE, SAMPLE_OF_PART * wanted_parts(rows)), SAMPLE_BYTES // (8 * width))))
    common = base.where(F.size("v") == width)
    # about twice as many rows as are drawn reach the ordering, however large the table is
    drawn = common.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 2 * size / max(1, alike))))
    taken = lambda df: df.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toArrow().column("v").combine_chunks()
    sample = taken(drawn)
    if len(sample) < size // 4 and alike > len(sample):  # few ids, many rows of each
        sample = taken(common)
    sample = np.asarray(sample.flatten()).reshape(-1, width)
    router, parts, count = learn(sample, rows, k) or (None, 1, 1)
    count = min(parts, probes or count)
    kinds = "id long, part int, v binary"
    # repeated rows count once, wherever they are many
    index = written(base.mapInArrow(_routed(router, 1, width, False), kinds).distinct(), "routed")

    def found_in(some: DataFrame, most: int, name: str) -> DataFrame:
        wanted = written(some.mapInArrow(_routed(router, most, width, True), kinds).distinct(), name)
        left, right = dealt(index, wanted)
        keys = ["part", "slice", "block"]
        best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")
        return best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = written(found_in(asked, count, "asked"), "found")
    if count < parts:  # queries whose parts hold too few candidates look in all parts
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        lacking = written(asked.join(enough, F.col("id") == F.col("query_id"), "left_anti"), "lacking")
        if lacking.limit(1).count():
            more = found_in(lacking, parts, "asked-again")
            found = found.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    nearest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    ranked = found.groupBy("query_id").agg(nearest.alias("n")).select("query_id", F.posexplode("n").alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))
