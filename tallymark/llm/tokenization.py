"""Whole texts to token ids with the tokenizers library, each distinct chunk of text encoded once per worker.

Both tokenizers cut a text before any merge: always between a visible character and white space after it, and between
letters and other visible characters. So a text's ids are the ids of its chunks, one after another, and a chunk of
plain letters is one word for the library's model. Workers keep the ids of chunks
they have seen, in two generations of bounded size. Texts with characters on which Python and the library disagree
about white space, or with something like a special token, are encoded as they are.
"""

from __future__ import annotations

import re

CACHE_CHUNKS = 400_000

#: White space to Python but not to the tokenizers, and the start of special tokens.
ODD = re.compile("[\x1c-\x1f]|<\\|")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
WORD = re.compile(f" ?[{LETTERS}]+")
#: A word of plain letters with the space before it, if a stop, comma or white space follows; stops and commas after
#: such a word; a line feed between a visible character and a word; anything else up to the next white space.
CHUNK = re.compile(rf" ?[{LETTERS}]++(?![^.,\s])|[.,]++(?!\S)|\n(?=[{LETTERS}])|\s*\S+|\s+")
#: The same where white space gives no ids.
CHUNK_NO_SPACE = re.compile(rf"[{LETTERS}]++(?![^.,\s])|[.,]++(?!\S)|\S+")


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte: itself if it is visible in Latin-1, else the next one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Chunks(dict):
    """Chunk to ids as little-endian unsigned 32-bit bytes; what isn't there is made. Two generations, each bounded."""

    def __init__(self, make, limit: int = CACHE_CHUNKS):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """A tokenizer file of the library. `drops_space`: white space gives no ids, so words are the chunks."""

    def __init__(self, path: str, drops_space: bool = False):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.drops_space = drops_space
        letters = byte_letters()
        self.model = self.tokenizer.model
        self.as_bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.chunk = CHUNK_NO_SPACE if drops_space else CHUNK
        self.known = Chunks(self._made)

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def _made(self, chunk: str) -> bytes:
        if not WORD.fullmatch(chunk):
            return self._plain(chunk)
        # one word to the library's model: nothing is left for the steps before it but case and bytes
        word = (chunk.lower() if self.drops_space else chunk).translate(self.as_bytes)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(word)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes."""
        if ODD.search(text):
            return self._plain(text)
        if self.drops_space and text.isascii():
            text = text.lower()
        return b"".join(map(self.known.__getitem__, self.chunk.findall(text)))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, drops_space: bool = False) -> Encoder:
    """One encoder per worker process, with what it knows."""
    key = (path, drops_space)
    if key not in _encoders:
        _encoders[key] = Encoder(path, drops_space)
    return _encoders[key]
