"""Phrases of several words, by growing frequent prefixes to the right (as PrefixSpan does, for words in a row).

A text is lower-cased (A-Z only), cut into pieces at punctuation and line ends and into words at blanks. A phrase lies
within a piece; all its occurrences count, overlapping ones as well. Languages are counted apart.

1. Words: tasks count blocks of texts by local numbers of words; sums by a 64-bit hash of language and word. Only words
   whose hash is frequent are then read as texts. A frequent hash that two words share is detected, and then another seed
   is taken, so hashes stand for words exactly.
2. Projection on one word: a block's occurrences are pointers, positions in its array of words. Of frequent words they are
   extended by the next word, equal pairs are summed in the block, and again over all blocks: frequent prefixes of two.
3. Projection on frequent prefixes: the pointers at which one begins. Where it can go on (the next pair is frequent too),
   an occurrence leaves the block as the words after its prefix, up to the longest phrase; equal ones of a block are summed.
4. One task has all occurrences of a prefix, sorted, and extends it word by word depth first as long as it stays frequent.
   A prefix with more occurrences than a task should read rows isn't put in one: it is extended by one word through
   an aggregation, and its frequent children become prefixes of their own.

Every task knows which words or pairs may be frequent from a set of bits of fixed size (`FILTER_BITS`); what it lets through
by chance is dropped after the exact sums. Whatever grows with the data stays a table.

Null texts count as empty and null languages as `und`. Very long texts are read whole, block by block. Repeated rows count
each. An empty table gives no phrases. Columns beyond text and language are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

BLOCK_WORDS = 3_000_000
SLICE = 4 << 20
#: Rows that a task hands to Spark at once, and places of a block that it looks at together.
OUT_ROWS, TOGETHER = 50_000, 1 << 18
FILTER_BITS = 26
#: Rows of one prefix that a task may read.
PREFIX_ROWS = 1_000_000
END = b"\xff"  # no byte of UTF-8
#: A-Z to a-z, tab to space, ends of pieces to a mark.
BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + END * 10)


class _Numbers(dict):
    """Local numbers of words from 1, in order of meeting; 0 ends a piece."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self[END] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        return number


class Block:
    """An array of local word numbers, the words, and each word's language."""

    def __init__(self) -> None:
        self.words: list[bytes] = [END]
        self.of: dict[str, _Numbers] = {}
        self.langs: list[tuple[int, str]] = []  # from this number of words on, which language was added to
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.of.get(lang)
        if numbers is None:
            numbers = self.of[lang] = _Numbers(self.words)
        if not self.langs or self.langs[-1][1] != lang:
            self.langs.append((len(self.words), lang))
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def array(self) -> np.ndarray:
        return np.concatenate([*self.parts, np.zeros(1, np.int32)])

    def keys(self, seed: int) -> tuple[np.ndarray, list[str]]:
        """Hash and language of each word; 0 and "" for the end of a piece."""
        langs, hashes = [""], np.zeros(len(self.words), np.uint64)
        for (low, lang), (high, _) in zip(self.langs, [*self.langs[1:], (len(self.words), "")], strict=True):
            head = lang.encode() + b"\xff"
            hashes[low:high] = np.fromiter((xxhash.xxh3_64_intdigest(head + w, seed) or 1 for w in self.words[low:high]), np.uint64, high - low)
            langs += [lang] * (high - low)
        return hashes, langs


def _words(text: str) -> Iterator[list[bytes]]:
    """Words and ends of pieces of a text, a slice at a time."""
    raw = text.encode().translate(BYTES)
    low = 0
    while low < len(raw):
        high = raw.find(b" ", low + SLICE) if len(raw) - low > SLICE else -1
        high = high if high >= 0 else len(raw)
        yield raw[low:high].replace(END, b" \xff ").split()
        low = high
    yield [END]


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Block, int]]:
    """Blocks of texts, and how many words at the end of each come again as the next one's beginning."""
    block = Block()
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            recent: list[bytes] = []
            for words in _words(text or ""):
                block.add(lang, words)
                recent = [*recent, *words][-(longest - 1) :] if longest > 1 else []
                if block.size >= BLOCK_WORDS:
                    going_on = [] if recent and recent[-1] == END else recent
                    yield block, len(going_on)
                    block = Block()
                    if going_on:
                        block.add(lang, going_on)
    if block.size:
        yield block, 0


def _starts(block: Block, again: int) -> tuple[np.ndarray, int]:
    """The block's array, and how many of its positions are its own beginnings of phrases."""
    numbers = block.array()
    return numbers, len(numbers) - 1 - again


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _place(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where a pair of hashes is in the set of bits; `_place_of` is the same on columns."""
    return (first ^ (second << np.uint64(21)) ^ (second >> np.uint64(43))) & np.uint64((1 << FILTER_BITS) - 1)


def _place_of(first: Column, second: Column) -> Column:
    mixed = first.bitwiseXOR(F.shiftleft(second, 21)).bitwiseXOR(F.shiftrightunsigned(second, 43))
    return mixed.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def _bits(spark: SparkSession, places: DataFrame):
    """A broadcast set of 2^FILTER_BITS bits: at most a row for each 64 of them comes to the driver."""
    rows = places.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _is_in(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _over_blocks(texts: DataFrame, longest: int, columns: list[str], rows_of: Callable) -> DataFrame:
    """rows_of(block, words that come again) of every block, in parts: columns of longs (or strings that end in :s)."""
    names = [c.removesuffix(":s") for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, again in _blocks(batches, longest):
            for part in rows_of(block, again):
                yield pa.RecordBatch.from_arrays(part, names=names)

    return texts.mapInArrow(run, ", ".join(f"{n} {'string' if c.endswith(':s') else 'long'}" for n, c in zip(names, columns, strict=True)))


def _parts(rows: np.ndarray) -> Iterator[np.ndarray]:
    """At most OUT_ROWS rows each, so that neither side of a task holds a whole block's output."""
    return (rows[low : low + OUT_ROWS] for low in range(0, len(rows), OUT_ROWS))


def _counted(block: Block, again: int) -> np.ndarray:
    """How often each word of a block is there."""
    numbers, own = _starts(block, again)
    counts = np.bincount(numbers[:own], minlength=len(block.words))
    counts[0] = 0
    return counts


def word_counts(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """lang, h (hash), word, f of frequent words; lang, n of all words; the seed with which frequent words have hashes of
    their own."""
    for seed in range(64):

        def hashes_of(block: Block, again: int, seed: int = seed) -> Iterator[list]:
            counts, (hashes, _) = _counted(block, again), block.keys(seed)
            for some in _parts(np.flatnonzero(counts)):
                yield [_signed(hashes[some]), pa.array(counts[some], pa.int64())]

        often = written(_over_blocks(texts, 1, ["h", "n"], hashes_of).groupBy("h").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "frequent-hashes")
        known = _bits(texts.sparkSession, often.select(_place_of(F.col("h"), F.lit(0).cast("long")).alias("place")))

        def words_of(block: Block, again: int, seed: int = seed, known=known) -> Iterator[list]:
            counts, (hashes, langs) = _counted(block, again), block.keys(seed)
            for some in _parts(np.flatnonzero((counts > 0) & _is_in(known.value, _place(hashes, np.zeros_like(hashes))))):
                picked = some.tolist()
                yield [_signed(hashes[some]), pa.array([langs[i] for i in picked], pa.string()), pa.array([block.words[i].decode() for i in picked], pa.string()), pa.array(counts[some], pa.int64())]
            for (low, lang), (high, _) in zip(block.langs, [*block.langs[1:], (len(block.words), "")], strict=True):  # all words: no hash
                yield [pa.array([None], pa.int64()), pa.array([lang], pa.string()), pa.array([None], pa.string()), pa.array([counts[low:high].sum()], pa.int64())]

        key = F.struct("lang", "word")
        rows = _over_blocks(texts, 1, ["h", "lang:s", "word:s", "n"], words_of).groupBy("h", F.when(F.col("h").isNull(), F.col("lang")).alias("all"))
        found = written(rows.agg(F.sum("n").alias("f"), F.min(key).alias("k"), F.max(key).alias("other")).where(F.col("h").isNull() | (F.col("f") >= least)), "words")
        words = found.where(F.col("h").isNotNull())
        if not words.where(F.col("k") != F.col("other")).limit(1).count():
            return words.select("k.lang", "h", "k.word", "f"), found.where(F.col("h").isNull()).select(F.col("all").alias("lang"), F.col("f").alias("n")), seed
    raise RuntimeError("no seed tells all frequent words apart")


def _pairs(texts: DataFrame, known, longest: int, seed: int) -> DataFrame:
    """h1, h2, n: pairs of words that may be frequent, summed in blocks."""

    def rows_of(block: Block, again: int) -> Iterator[list]:
        numbers, own = _starts(block, again)
        hashes, _ = block.keys(seed)
        often = _is_in(known.value, _place(hashes, np.zeros_like(hashes)))
        often[0] = False
        at = np.flatnonzero(often[numbers[:own]] & often[numbers[1 : own + 1]])
        pairs, counts = np.unique(numbers[at].astype(np.int64) * len(hashes) + numbers[at + 1], return_counts=True)
        for some in _parts(np.arange(len(pairs))):
            yield [_signed(hashes[pairs[some] // len(hashes)]), _signed(hashes[pairs[some] % len(hashes)]), pa.array(counts[some], pa.int64())]

    return _over_blocks(texts, longest, ["h1", "h2", "n"], rows_of)


def _projections(texts: DataFrame, known, longest: int, seed: int) -> DataFrame:
    """h1, h2, ..., n: what follows frequent prefixes of two, up to the longest phrase (then 0), summed in blocks."""
    columns = [f"h{i + 1}" for i in range(longest)]

    def rows_of(block: Block, again: int) -> Iterator[list]:
        numbers, own = _starts(block, again)
        hashes, _ = block.keys(seed)
        goes_on = np.zeros(len(numbers) + longest, bool)
        for low in range(0, len(numbers) - 1, TOGETHER):
            one, two = numbers[low : min(low + TOGETHER, len(numbers) - 1)], numbers[low + 1 : low + TOGETHER + 1]
            goes_on[low : low + len(one)] = (one > 0) & (two > 0) & _is_in(known.value, _place(hashes[one], hashes[two]))
        pointers = np.flatnonzero(goes_on[:own] & goes_on[1 : own + 1])  # occurrences of a prefix that has a next word
        padded = np.concatenate([numbers, np.zeros(longest, np.int32)])
        alive, keys = np.ones(len(pointers), bool), []  # two words in each key
        for i in range(longest):
            if i > 1:
                alive &= goes_on[pointers + i - 1]
            word = np.where(alive, padded[pointers + i], 0)
            if i % 2:
                keys[-1] = keys[-1] << 32 | word
            else:
                keys.append(word.astype(np.int64))
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for key in keys:
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        first = np.flatnonzero(new)
        counts = np.diff(np.append(first, len(order)))
        for some in _parts(np.arange(len(first))):
            at = order[first[some]]
            words = [keys[i // 2][at] >> 32 if i % 2 == 0 and i + 1 < longest else keys[i // 2][at] & 0xFFFFFFFF for i in range(longest)]
            yield [*[_signed(hashes[w]) for w in words], pa.array(counts[some], pa.int64())]

    return _over_blocks(texts, longest, [*columns, "n"], rows_of)


def _depth_first(columns: list[str], length: int, least: int) -> Callable:
    """Extends the prefixes of `length` words of a partition whose rows come sorted; yields frequent longer phrases."""
    longest = len(columns)

    def grow(words: np.ndarray, upto: np.ndarray, low: int, high: int, depth: int, out: list) -> None:
        """Rows low to high share `depth` words; upto: running sums of their counts."""
        if depth == longest:
            return
        inside = words[low:high, depth]
        cuts = np.concatenate([[0], np.flatnonzero(inside[1:] != inside[:-1]) + 1, [high - low]]) + low
        sums = upto[cuts[1:]] - upto[cuts[:-1]]
        for k in np.flatnonzero((sums >= least) & (words[cuts[:-1], depth] != 0)).tolist():
            out.append((*words[cuts[k], : depth + 1].tolist(), *[0] * (longest - depth - 1), int(sums[k])))
            grow(words, upto, int(cuts[k]), int(cuts[k + 1]), depth + 1, out)

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        words, upto, out = rows[:, :longest], np.concatenate([[0], np.cumsum(rows[:, longest])]), []
        new = np.concatenate([[True], (words[1:, :length] != words[:-1, :length]).any(axis=1)])
        edges = np.append(np.flatnonzero(new), len(rows))
        big = np.flatnonzero(upto[edges[1:]] - upto[edges[:-1]] >= least)
        for k in big.tolist():
            grow(words, upto, int(edges[k]), int(edges[k + 1]), length, out)
        made = np.array(out, np.int64).reshape(-1, longest + 1)
        return pa.RecordBatch.from_arrays([pa.array(made[:, i]) for i in range(longest + 1)], names=[*columns, "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(i).to_numpy() for i in range(longest + 1)], axis=1)
            if sum(map(len, held)) >= PREFIX_ROWS:
                other = np.flatnonzero((rows[:, :length] != held[-1][-1, :length]).any(axis=1))
                if len(other):
                    yield emit([*held, rows[: other[0]]])
                    held, rows = [], rows[other[0] :]
            held.append(rows)
        if held:
            yield emit(held)

    return run


def _grown(rows: DataFrame, length: int, longest: int, least: int, heavy: DataFrame | None = None) -> list[DataFrame]:
    """h1, ..., a: frequent phrases longer than their prefix of `length` words.

    heavy: prefixes that may have more rows than a task should read; without it rows are a table, and are counted.
    """
    columns = [f"h{i + 1}" for i in range(longest)]
    prefix = columns[:length]
    schema = ", ".join(f"{c} long" for c in [*columns, "a"])
    is_table = heavy is None
    if is_table:
        heavy = written(rows.groupBy(*prefix).agg(F.count("*").alias("rows")).where(F.col("rows") > PREFIX_ROWS).drop("rows"), "heavy-prefixes")
    if not heavy.limit(1).count():
        return [rows.repartition(*prefix).sortWithinPartitions(*columns).mapInArrow(_depth_first(columns, length, least), schema)]
    heavy = F.broadcast(heavy)  # a row for each PREFIX_ROWS of words at most
    light = rows.join(heavy, prefix, "left_anti").select(rows.columns)
    done = light.repartition(*prefix).sortWithinPartitions(*columns).mapInArrow(_depth_first(columns, length, least), schema)
    hot = rows.join(heavy, prefix, "left_semi").where(F.col(columns[length]) != 0).select(rows.columns)
    if not is_table:
        hot = written(hot.groupBy(*columns).agg(F.sum("n").alias("n")), "hot")
    children = written(hot.groupBy(*columns[: length + 1]).agg(F.sum("n").alias("a")).where(F.col("a") >= least), "children")
    found = children.select(*columns[: length + 1], *[F.lit(0).cast("long").alias(c) for c in columns[length + 1 :]], "a")
    if length + 1 == longest:
        return [done, found]
    rest = written(hot.join(children.drop("a"), columns[: length + 1], "left_semi").select(rows.columns), "projected")
    return [done, found, *_grown(rest, length + 1, longest, least)]


def frequent_phrases(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, h, word, f) and phrases of 2 words and more (key: array of hashes, a) that are frequent, and all words'
    number (lang, n)."""
    texts = docs.select(F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    words, totals, seed = word_counts(texts, least)
    known = _bits(spark, words.select(_place_of(F.col("h"), F.lit(0).cast("long")).alias("place")))
    pairs = _pairs(texts, known, longest, seed).groupBy("h1", "h2").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    pairs = written(pairs, "pairs")
    columns = [f"h{i + 1}" for i in range(longest)]
    found = pairs.select("h1", "h2", *[F.lit(0).cast("long").alias(c) for c in columns[2:]], "a")
    if longest > 2:
        known = _bits(spark, pairs.select(_place_of(F.col("h1"), F.col("h2")).alias("place")))
        # a prefix has no more rows than occurrences, so rows go to their tasks as blocks give them, and are no table
        heavy = written(pairs.where(F.col("a") > PREFIX_ROWS).select("h1", "h2"), "heavy-prefixes")
        for more in _grown(_projections(texts, known, longest, seed), 2, longest, least, heavy):
            found = found.unionByName(more)
    key = F.filter(F.array(*columns), lambda h: h != 0)
    return words, written(found.select(key.alias("key"), "a"), "phrases"), totals


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases.

    A phrase's score is that of its lowest cut, floor(2000000 * a / (l + r)). Phrases inside a longer frequent one with
    `covered` hundredths of their occurrences are dropped.
    """
    often, found, totals = frequent_phrases(docs, least, longest, text_col, lang_col)
    wide = lambda x: F.col(x).cast("decimal(20,0)")
    counts = found.select("key", F.col("a").alias("f")).unionByName(often.select(F.array("h").alias("key"), "f"))

    inner = found.where(F.size("key") > 2).select(
        F.col("a").alias("_longer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("key") - m + 1), lambda s: F.slice("key", s, m))))).alias("key")
    )
    most = inner.groupBy("key").agg(F.max("_longer").alias("_longer"))
    kept = found.join(most, "key", "left").where(F.col("_longer").isNull() | (100 * wide("_longer") < covered * wide("a"))).drop("_longer")

    cuts = kept.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.select("key", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("left"), F.slice("key", F.col("k") + 1, F.size("key") - F.col("k")).alias("right"))
    side = lambda name, f: counts.select(F.col("key").alias(name), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    score = F.expr("cast(cast(2000000 as decimal(8,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    lowest = cuts.groupBy("key", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spelled = lowest.select("key", F.posexplode("key").alias("pos", "h")).join(often.select("h", "word", "lang"), "h")
    spelled = spelled.groupBy("key").agg(F.min("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # `longest` words
    rows = lowest.join(spelled, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= top)
    salted = first(rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "_salt")  # so one language isn't one task's
    return first(salted.drop("rank", "_salt"), "lang").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000) -> str:
    """The same rows in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lead = lambda m: "w" + "".join(f" || ' ' || lead(w, {i}) over o" for i in range(1, m))  # noqa: E731  null past the end
    grams = ", ".join(f"{lead(m)} as g{m}" for m in range(1, longest + 1))
    unions = " union all ".join(f"select lang, g{m} as key, {m} as m from t" for m in range(1, longest + 1))
    return rf"""
        with p as (select row_number() over () as piece, lang, w from (
                select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from (
                select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) as piece from documents))),
        s as (select piece, lang, unnest(w) as w, generate_subscripts(w, 1) as i from p),
        t as (select lang, {grams} from s window o as (partition by piece order by i)),
        c as materialized (select lang, key, m, count(*)::hugeint as f from (
            {unions}) where key is not null group by all),
        n as (select lang, sum(f) as n from c where m = 1 group by lang),
        q as materialized (select lang, m, string_split(key, ' ') as w, key, f as a from c where m > 1 and f >= {least}),
        sub as (select lang, array_to_string(w[x : x + y - 1], ' ') as key, a from q, range(1, {longest + 1}) u(x), range(2, {longest + 1}) v(y) where y < m and x + y - 1 <= m),
        most as (select lang, key, max(a) as longer from sub group by all),
        kept as (select q.* from q left join most using (lang, key) where longer is null or 100 * longer < {covered} * a),
        cut as (select lang, key, a, k, array_to_string(w[1 : k], ' ') as lk, array_to_string(w[k + 1 : m], ' ') as rk from kept, range(1, {longest}) z(k) where k < m),
        lc as materialized (select cut.*, f as l from cut join c on cut.lang = c.lang and cut.lk = c.key),
        sc as (select lc.*, f as r, (2000000 * a) // (l + f) as score from lc join c on lc.lang = c.lang and lc.rk = c.key),
        low as (select *, row_number() over (partition by lang, key order by score, k) as o from sc),
        ranked as (select lang, key as phrase, a, l, r, score, row_number() over (partition by lang order by score desc, a desc, encode(key)) as rank from low where o = 1)
        select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join n using (lang) where rank <= {top}"""
