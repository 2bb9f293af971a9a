"""Byte-level BPE in our own code: merges by a priority queue of ranks over a doubly linked list of symbols.

Decoding concatenates the vocabulary's strings. The tokenizer file is only read, never trained.

Null texts count as empty; empty texts have no ids and decode to empty texts; null ids decode as none. Rows pass through one
by one, so repeated rows give repeated rows and ties need no rule; rows without an id keep none. Very long texts, words of
any length among them, are encoded whole: a merge takes the logarithm of a word's length. An empty table gives no rows.
Columns beyond id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenization import CHUNK, ODD, WORD, Chunks, byte_letters

#: White space as Unicode has it, and how a byte-level tokenizer cuts a text.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^@\p{L}\p{N}]+|[@]+(?![^@])|[@]+".replace("@", SPACE)


class ByteBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.of_byte = [self.vocab[c] for c in self.letters]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        byte_of = {c: bytes([b]) for b, c in enumerate(self.letters)}
        self.strings = [b""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for token, i in [*self.vocab.items(), *self.added.items()]:
            whole = all(c in byte_of for c in token)
            self.strings[i] = b"".join(byte_of[c] for c in token) if whole else token.encode()
        self.known = Chunks(self._chunk)

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours by rank, ties to the left, until no pair has a rank."""
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges, queue = self.merges, []
        for i in range(n - 1):
            if found := merges.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, found[1], symbols[i], symbols[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, made, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # stale: one of the two has been merged since
            symbols[i], symbols[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, symbols[k])):
                    heapq.heappush(queue, (found[0], i, found[1], made, symbols[k]))
            h = before[i]
            if h >= 0 and (found := merges.get((symbols[h], made))):
                heapq.heappush(queue, (found[0], h, found[1], symbols[h], made))
        return [s for s in symbols if s >= 0]

    def _chunk(self, chunk: str) -> bytes:
        out = bytearray()
        for word in [chunk] if WORD.fullmatch(chunk) else self.words.findall(chunk):
            for i in self.merge([self.of_byte[b] for b in word.encode()]):
                out += i.to_bytes(4, "little")
        return bytes(out)

    def _span(self, text: str) -> bytes:
        if ODD.search(text):
            return self._chunk(text)
        return b"".join(map(self.known.__getitem__, CHUNK.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if self.cut_added is None or not any(t in text for t in self.added):
            return self._span(text)
        return b"".join(self.added[s].to_bytes(4, "little") if s in self.added else self._span(s) for s in self.cut_added.split(text))

    def decode(self, ids: bytes) -> bytes:
        """The vocabulary's strings in a row, as UTF-8; broken sequences become U+FFFD."""
        raw = b"".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            ids = [memoryview(bpe.encode(t or "")).cast("I").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        bpe = coder(tokenizer)
        for batch in batches:
            texts = [bpe.decode(array.array("I", ids or []).tobytes()).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    picked = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode what was encoded, and keep a digest of each: id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(tokenizer)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
