"""Our chunked encoding and our own BPE against the tokenizers library."""

import array
import hashlib

import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymark.llm import bpe
from tallymark.llm.bpe import coder
from tallymark.llm.tokenization import Chunks, encoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTES, WORDS)}

#: Text in which words, white space and signs meet in many ways.
texts = st.text(alphabet=st.sampled_from(list("abEé.,,  \n\n\t\r'sß!%1²½ªº\xa0\x85\x1c ​́ΣσİŒœ中🙂<|>#")), max_size=40) | st.lists(st.sampled_from(["word", " word", "The", ".", ",", "\n", " ", "  ", "don't", "%%%", "é", "<|endoftext|>", "x.y", "...", "idiot", "3.14", "\n\n", "été"]), max_size=20).map("".join)


def ids(raw: bytes) -> list[int]:
    return array.array("I", raw).tolist()


@settings(max_examples=600, deadline=None)
@given(texts)
@example("")
@example("a\n\nThen  b. ,c")
@example("it's <|endoftext|> x")
def test_same_ids_as_the_library(text):
    assert ids(encoder(BYTES).encode(text)) == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
    assert ids(encoder(WORDS, drops_space=True).encode(text)) == LIBRARY[WORDS].encode(text, add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(texts)
@example("a<|endoftext|>  <|endoftext|>b")
def test_own_bpe_and_decoding(text):
    raw = coder(BYTES).encode(text)
    want = LIBRARY[BYTES].encode(text, add_special_tokens=False).ids
    assert ids(raw) == want
    assert coder(BYTES).decode(raw).decode() == LIBRARY[BYTES].decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("some", [[128], [50256], [0, 255, 200], []])
def test_decoding_of_broken_bytes(some):
    assert coder(BYTES).decode(array.array("I", some).tobytes()).decode() == LIBRARY[BYTES].decode(some, skip_special_tokens=False)


def test_long_text_without_space():
    text = "ab" * 5000
    assert ids(coder(BYTES).encode(text)) == LIBRARY[BYTES].encode(text, add_special_tokens=False).ids


def test_cache_is_bounded():
    cache = Chunks(lambda c: c.encode(), limit=10)
    for i in range(1000):
        assert cache[str(i % 37)] == str(i % 37).encode()
    assert len(cache) <= 10 and len(cache.older) <= 10


def test_tables_of_texts(spark):
    """Nulls, repeated rows, long texts, clashing columns and empty tables, through encode, decode and the round trip."""
    rows = [(1, "The quick\n brown"), (2, None), (3, ""), (1, "The quick\n brown"), (None, "no id"), (4, "x" * 30_000 + " é中🙂 " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as id", "'a' as ids", "1 as n_tokens").repartition(2)
    library = LIBRARY[BYTES]
    want = {(i, t): library.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    encoded = bpe.encode(docs, BYTES)
    got = sorted(((r["doc_id"] or 0, r["ids"]) for r in encoded.collect()), key=str)
    assert got == sorted(((i or 0, want[i, t]) for i, t in rows), key=str)
    back = sorted(((r["doc_id"] or 0, r["text"]) for r in bpe.decode(encoded.selectExpr("*", "1 as text"), BYTES).collect()), key=str)
    assert back == sorted(((i or 0, t or "") for i, t in rows), key=str)
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, BYTES).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == {(i, len(v), sha(array.array("I", v).tobytes()), sha((t or "").encode())) for (i, t), v in want.items()}
    assert bpe.round_trip(docs, BYTES).count() == 6 and bpe.round_trip(docs.limit(0), BYTES).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTES).first()["text"] == ""
