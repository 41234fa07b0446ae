"""BPE encoding by backtracking over longest token matches, and decoding from
an offset table.

A word is cut into tokens from the left.  An Aho-Corasick automaton over the
vocabulary gives the tokens that start at each place, longest first.  A token
is accepted if it is compatible with the one before it: merging the two tokens'
symbols side by side must give just these two tokens.  If none fits, the place
is marked dead and the token before it is replaced by its next shorter match.
A sequence whose neighbours are all compatible is the one the merges produce,
and no place is tried twice, so the work is linear in the word.

Compatibility of (s, t) follows from the merge tree of each token alone.  On
the border stand a node of the right spine of s and one of the left spine of
t.  Each node exists from the merge that makes it to the merge that consumes
it; the pair is incompatible if two nodes that exist at the same time form a
merge that comes before either is consumed.  Answers are kept in a table.
"""
from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rivulet.llm.common import documents_only, kept, with_text_columns

#: Fixed values of the tokenizer format: white space, word pattern.
SPACE = "\t-\r \x85\xa0  -     　"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNKS = regex.compile(f"[^{SPACE}]+")
#: Python's split() also cuts at these, which are not white space here.
ODD_SPACE = re.compile("[\x1c-\x1f]")
END = ""  # stands for the word end inside the automaton
#: Entries of each half of a worker's caches.
CACHE = 200_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the
    next letter from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Recent(dict):
    """A cache of at most twice ``CACHE`` entries: when the younger half is full
    it becomes the older one, from which entries in use come back."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
            if len(key) > 64:
                return value
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class PairTable:
    """Which tokens can stand side by side in an encoding."""

    def __init__(self, merges: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], born: dict[int, int]):
        self.merges, self.parts, self.born = merges, parts, born
        self.known: dict[tuple[int, int], bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """(node, time made, time consumed) from the token inwards."""
        out, dies = [], float("inf")
        while True:
            made = self.born.get(token, -1)
            out.append((token, made, dies))
            if token not in self.parts:
                return out
            token, dies = self.parts[token][side], made

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        found = self.known.get(pair)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[pair] = self._check(left, right)
        return found

    def _check(self, left: int, right: int) -> bool:
        # of merges of one rank the left one goes first: a left node lives
        # before a right one that is made at its own end only if that end is later
        for a, a_made, a_dies in self._spine(left, 1):
            for b, b_made, b_dies in self._spine(right, 0):
                rank = self.merges.get((a, b))
                if rank is not None and a_made <= b_dies and b_made < a_dies and rank < a_dies and rank <= b_dies:
                    return False
        return True


class BpeCodec:
    """Encoder and decoder of a tokenizer file whose merges have word ends."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        merges, parts, born = {}, {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merges[vocab[a], vocab[b]] = rank
            made = vocab[a + b]
            if made not in parts:
                parts[made], born[made] = (vocab[a], vocab[b]), rank
        self.pairs = PairTable(merges, parts, born)
        self.automaton = ahocorasick.Automaton()
        keys = {}
        for token, i in vocab.items():
            if token not in self.special:
                keys[token.removesuffix(suffix) + END if token.endswith(suffix) else token] = i
        #: of each token its length, and its longest proper prefix that is a token
        self.sizes, self.shorter = {}, {}
        for key, i in keys.items():
            self.automaton.add_word(key, i)
            self.sizes[i] = len(key)
            self.shorter[i] = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1)
        self.automaton.make_automaton()
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words, self.chunks = Recent(self._word), Recent(self._chunk)
        # the offset table: every token's text and a space after it, end to end
        texts = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        size = max(texts) + 1
        pieces = [texts.get(i, "").encode() + b" " for i in range(size)]
        self.blob = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        self.lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def encode_word(self, letters: str) -> list[int]:
        """Token ids of one word, given as byte letters without the word end."""
        text = letters + END
        end, at = len(text), 0
        dead = bytearray(end + 1)
        dead[end - 1] = 1  # the word end alone is no token
        known, check = self.pairs.known, self.pairs.compatible
        sizes, shorter, longest = self.sizes, self.shorter, self.automaton.iter_long
        ids: list[int] = []
        before = -1
        token = next(longest(text, at))[1]
        while True:
            while token >= 0:
                to = at + sizes[token]
                if not dead[to]:
                    if before < 0:
                        break
                    fits = known.get((before, token))
                    if fits or fits is None and check(before, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if to == end:
                    return ids
                at, before = to, token
                token = next(longest(text, at))[1]
            elif ids:  # a dead place: the token before it must be shorter
                dead[at] = 1
                token = ids.pop()
                at -= sizes[token]
                before = ids[-1] if ids else -1
                token = shorter[token]
            else:
                raise ValueError("the vocabulary does not cover the word")

    def _word(self, word: str) -> bytes:
        ids = self.encode_word(word.encode().decode("latin-1").translate(self.letters))
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space and special tokens."""
        if chunk.isascii():
            text = chunk.lower()
        else:
            text = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        words = self.words
        if text.isalpha():
            return words[text]
        if text[-1] in ".," and text[:-1].isalpha():
            return words[text[:-1]] + words[text[-1]]
        return b"".join([words[w] for w in WORDS.findall(text)])

    def _plain(self, text: str) -> bytes:
        chunks = CHUNKS.findall(text) if ODD_SPACE.search(text) else text.split()
        known = self.chunks
        return b"".join([known[c] for c in chunks])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, end to end."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at:m.start()]), struct.pack("<I", self.special[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """Token texts with a space between two, in UTF-8."""
        numbers = np.frombuffer(ids, dtype="<u4")
        out = []
        for i in range(0, len(numbers), 1 << 16):
            part = numbers[i:i + (1 << 16)]
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            shift = np.repeat(self.offsets[part] - (ends - sizes), sizes)
            out.append(self.blob[shift + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


def codec(path: str) -> BpeCodec:
    """The codec of a tokenizer file, made once for a worker's tasks of a step."""
    return kept(("bpe", path), lambda: BpeCodec(path))


def with_ids(docs: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """All rows and columns of ``docs`` plus the ids of the text (binary)."""
    def factory():
        c = codec(path)
        return lambda raw: [pa.array([c.encode(t.decode()) for t in raw], pa.binary())]
    return with_text_columns(docs, "text", [T.StructField(column, T.BinaryType())], factory)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Whole texts; a null text is empty and has no tokens (digests of nothing).
    Repeated rows and null ids stay; an empty table gives none.  Strings of the
    special tokens in a text become these tokens.  ``path`` must be readable on
    every executor.
    """
    def factory():
        c = codec(path)

        def digests(raw: list[bytes]) -> list[pa.Array]:
            n, ids_sha, text_sha = [], [], []
            for t in raw:
                ids = c.encode(t.decode())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)]
        return digests

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
              T.StructField("decoded_sha256", T.StringType())]
    return with_text_columns(documents_only(docs), "text", fields, factory).drop("text")
