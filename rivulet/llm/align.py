"""Cross-tokenizer alignment, counts by minimal perfect hashing.

Two tokenizers cut the same bytes (a space and the text).  Where tokens of both
end, a group ends; tokens whose byte ranges overlap are linked.

A text is cut at single spaces between two characters that are not white space.
Neither tokenizer has a token over such a place, so pieces are encoded and
aligned one by one, and a piece that stands in many texts only once a worker.
Should a piece's tokens not give its bytes back, the whole text is encoded.

First pass: the documents of a task give distinct (A id, B id) pairs, one
32-bit key each, with the number of documents that hold them.  The distinct
keys of each of ``PIECES`` key ranges get a minimal perfect hash and stand in
its order, so a lookup is verified.  Tasks add their counts to dense vectors in
that order, the vectors are summed in a tree (by key range and salt, then by
key range).  Second pass: documents are aligned anew and look their pairs up.
The ``HOT_PAIRS`` most frequent pairs at most are broadcast; what a document
holds besides goes to the pair's key range, is looked up there and summed back.
"""
from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.bpe import byte_letters
from rivulet.llm.common import documents_only, store, text_slices

#: Key ranges.  A key has 32 bits, ids of both tokenizers multiplied; no range
#: can hold more than the id pairs of the two vocabularies in it.
PIECES = 256
#: Tasks that share one key range on the first level of the tree.
SALTS = 8
#: Most pairs that are broadcast (12 bytes each, and 3 bits of hash).
HOT_PAIRS = 1 << 20
#: Pairs that a task gathers before it hands them on.
FLUSH_PAIRS = 1 << 20
#: Aligned pieces, and links in them, beyond which a worker starts its store anew.
STORED_PIECES, STORED_LINKS = 400_000, 4_000_000
#: Where neither tokenizer can have a token on both sides.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value of the byte-level format: how it cuts a text before merging.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that are encoded at once.
JOINED = 2_000


# --- minimal perfect hashing ---------------------------------------------------

def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def piece_of(keys: np.ndarray) -> np.ndarray:
    """The key range of each key: high bits of its hash."""
    return (_mixed(keys, 99) >> np.uint64(56)).astype(np.int32) % PIECES


class PerfectHash:
    """Levels of bit arrays: a key that is alone at its place of a level is
    numbered there, by the bits before it; the others go on to the next."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.cumsum([0, *sizes])
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def over(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct."""
        sizes, words, left = [], [np.zeros(0, np.uint64)], keys
        while len(left):
            size = (len(left) // 64 + 1) * 64
            place = (_mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[place]]
        return cls(sizes, np.concatenate(words))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A number under the count of keys; that of another key is arbitrary,
        -1 if no level has it."""
        out = np.full(len(keys), -1, np.int64)
        open_, left = np.arange(len(keys)), keys
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            place = (_mixed(left, level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = (self.before[place >> 6] + below)[hit]
            open_, left = open_[~hit], left[~hit]
        return out

    def to_bytes(self) -> bytes:
        return np.array([len(self.sizes), *self.sizes], "<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        return cls(np.frombuffer(raw, "<i8", n, 8).tolist(), np.frombuffer(raw, "<u8", offset=8 + 8 * n))


class PairTable:
    """Counts of keys in the order of their perfect hash, beside the keys."""

    def __init__(self, hashing: PerfectHash, keys: np.ndarray, counts: np.ndarray):
        self.hashing, self.keys, self.counts = hashing, keys, counts

    @classmethod
    def over(cls, keys: np.ndarray, counts: np.ndarray) -> PairTable:
        hashing = PerfectHash.over(keys)
        order = np.argsort(hashing.numbers(keys))
        return cls(hashing, keys[order], counts[order])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands; -1 for keys that are not in the table."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = self.hashing.numbers(keys)
        return np.where((at >= 0) & (self.keys[at] == keys), at, -1)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Counts; 0 for keys that are not in the table."""
        at = self.places(keys)
        return np.where(at >= 0, self.counts[at] if len(self.keys) else 0, 0)


# --- alignment of texts --------------------------------------------------------

class Aligner:
    """Both tokenizers, and the pieces aligned so far: numbered, with their
    sizes (tokens of A and of B, groups, links), with ``written`` their groups in
    writing, and keys of their links one after the other.  Between calls the
    store is bounded."""

    def __init__(self, a_path: str, b_path: str, written: bool = True):
        self.written = written
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        byte_at = {letter: byte for byte, letter in enumerate(byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte_at[x] for x in token) if all(x in byte_at for x in token) else token.encode()
        self.ascii = self._ascii_encoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces) or max(len(self.a_bytes), len(pieces)) > 1 << 16:
            raise ValueError("B must have no piece over a space, and both at most 65536 ids")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        # ids in writing, each with what can come after it
        self.a_written = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.a_bytes))], object)
        self.b_written = np.array([f"{i}{end}" for end in ",;" for i in range(len(pieces))], object)
        self._clear()

    def _ascii_encoder(self, path: str):
        """The same merges by rank, four times as fast; for ASCII, where no two
        libraries can differ about classes of characters.  Only for byte-level
        files whose ids are the ranks of their merges.  (A token that its own
        text gives is merged at the same moment by either way.)"""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            j = json.load(file)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in j["model"]["merges"]]
        pre, vocab = j["pre_tokenizer"] or {}, j["model"]["vocab"]
        if j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or [vocab[m] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {token: i for i, token in enumerate(self.a_bytes[:256 + len(merges)])}
        return tiktoken.Encoding("ascii", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _clear(self) -> None:
        self.number: dict[str | tuple[str], int] = {}  # -1: not to be used
        self.stored = 0
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.keys = np.zeros(0, np.uint32)
        self.calls = np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def _trim(self) -> None:
        """Of a full store the pieces stay that came in more than one call."""
        kept = np.flatnonzero(self.calls > 1)
        n = self.sizes[kept, 3]
        if len(kept) > STORED_PIECES // 2 or n.sum() > STORED_LINKS // 2:
            return self._clear()
        starts = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        self.keys = self.keys[np.repeat(starts[kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        now = np.full(self.stored, -1)
        now[kept] = np.arange(len(kept))
        now = now.tolist()
        self.number = {p: now[i] for p, i in self.number.items() if i >= 0 and now[i] >= 0}
        self.groups = [self.groups[i] for i in kept.tolist()] if self.written else []
        self.stored = len(kept)
        self.sizes, self.calls = self.sizes[kept], np.ones(len(kept), np.int64)

    def _tokens(self, pieces: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each piece on its own; None where they do not
        give a space and the piece."""
        raw = [f" {p}" for p in pieces]
        by_rank = self.ascii is not None and all(map(str.isascii, raw))
        if by_rank:
            a = list(map(self.ascii.encode_ordinary, raw))
        else:
            a = [x.ids for x in self.a.encode_batch_fast(raw, add_special_tokens=False)]
        b = self.b.encode(pieces, num_threads=1)
        # merging by rank splits the bytes there are, so its tokens give them back
        return [(np.array(x, np.int64), np.array(y, np.int64))
                if self._bytes(y, self.b_bytes) == r.encode() and (by_rank or self._bytes(x, self.a_bytes) == r.encode()) else None
                for r, x, y in zip(raw, a, b, strict=True)]

    @staticmethod
    def _bytes(ids: list[int], entries: list[bytes]) -> bytes:
        return b"".join(map(entries.__getitem__, ids))

    def _add(self, pieces: list[str]) -> None:
        """Align pieces and number them; -1 for one that its tokens do not give.
        The pieces have no white space at their ends: they are written after one
        another and encoded at once, tokens end at their borders as in any text."""
        pieces = sorted(pieces, key=str.isascii)
        first = bisect(pieces, False, key=str.isascii)
        for start, end in [*((i, min(i + JOINED, first)) for i in range(0, first, JOINED)),
                           *((i, i + JOINED) for i in range(first, len(pieces), JOINED))]:
            part = pieces[start:end]
            tokens = self._tokens([" ".join(part)])[0]
            if tokens is None:
                self._add_alone([(p,) for p in part])
                self.number.update((p, self.number[p,]) for p in part)
            else:
                self._align(part, *tokens, np.cumsum([len(p.encode()) + 1 for p in part]))

    def _add_alone(self, pieces: list[tuple[str]]) -> None:
        tokens = self._tokens([p for p, in pieces]) if pieces else []
        self.number.update((p, -1) for p, t in zip(pieces, tokens) if t is None)
        good = [(p, t) for p, t in zip(pieces, tokens) if t is not None]
        if good:
            self._align([p for p, _ in good], *(np.concatenate([t[i] for _, t in good]) for i in (0, 1)),
                        np.cumsum([len(p.encode()) + 1 for (p,), _ in good]))

    def _align(self, pieces: list[str], a: np.ndarray, b: np.ndarray, borders: np.ndarray) -> None:
        """Store pieces whose tokens stand one after the other in ``a`` and
        ``b``; ``borders`` are the ends of the pieces in bytes."""
        end_a, end_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        # the ranges between neighbouring ends of either are the links
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last_a, last_b = end_a[at_a] == ends, end_b[at_b] == ends
        group_ends = ends[last_a & last_b]
        n_a, n_b, n_links, n_groups = (np.diff(np.searchsorted(e, borders, "right"), prepend=0)
                                       for e in (end_a, end_b, ends, group_ends))
        first = self.stored
        self.stored += len(borders)
        self.number.update(zip(pieces, range(first, self.stored)))
        self.new.append((np.stack([n_a, n_b, n_groups, n_links], 1), (a[at_a] << 16 | b[at_b]).astype(np.uint32)))
        if self.written:
            # within a group its tokens of A, then those of B
            group_a, group_b = np.searchsorted(group_ends, end_a), np.searchsorted(group_ends, end_b)
            order = np.argsort(np.r_[group_a, group_b], kind="stable")
            ids = np.concatenate([self.a_written[a + len(self.a_bytes) * (group_ends[group_a] == end_a)],
                                  self.b_written[b + len(self.b_bytes) * (group_ends[group_b] == end_b)]])[order].tolist()
            edges = np.r_[0, np.cumsum(n_a + n_b)].tolist()
            self.groups += ["".join(ids[s:e])[:-1] for s, e in zip(edges, edges[1:])]

    def _settle(self) -> None:
        """What was stored since the last call, beside what was there."""
        self.sizes = np.concatenate([self.sizes, *[s for s, _ in self.new]])
        self.keys = np.concatenate([self.keys, *[k for _, k in self.new]])
        self.calls = np.r_[self.calls, np.zeros(len(self.sizes) - len(self.calls), np.int64)]
        self.new = []

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts, and how many each text has: none
        for one without tokens."""
        if self.stored > STORED_PIECES or len(self.keys) > STORED_LINKS:
            self._trim()
        cut = [t.split(" ") if t else [] for t in texts]
        # in most texts every space can be cut; in the others some piece is empty or has white space at an end
        new = set(chain.from_iterable(cut)) - self.number.keys()
        uneven = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        self.number.update(dict.fromkeys(uneven, -1))
        self._add(list(new - uneven))
        lengths = np.array([len(parts) for parts in cut], np.int64)
        flat = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(lengths.sum()))
        odd = np.unique(np.repeat(np.arange(len(cut)), lengths)[flat < 0])
        if len(odd):
            parts = np.split(flat, np.cumsum(lengths)[:-1])
            for i in odd.tolist():
                parts[i] = np.array(self._uneven(texts[i]), np.int64)
                lengths[i] = len(parts[i])
            flat = np.concatenate(parts)
        self._settle()
        self.calls += np.bincount(flat, minlength=self.stored) > 0
        return flat, lengths

    def _uneven(self, text: str) -> list[int]:
        """Numbers of a text's pieces, cut where that is safe; as a whole if
        the tokens of a piece do not give it back."""
        parts = [(p,) for p in CUT.split(text)]  # named apart from pieces between any two spaces
        self._add_alone([p for p in dict.fromkeys(parts) if p not in self.number])
        numbers = [self.number[p] for p in parts]
        if -1 in numbers:
            tokens = self._tokens([text])[0]
            numbers = [] if tokens is None else [self.stored]
            if tokens is not None:
                self._align([], *tokens, np.array([len(text.encode()) + 1]))
        return numbers

    def links(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, links) of each document's distinct pairs, in order."""
        if not len(flat):
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        at, held = np.unique(doc * self.stored + flat, return_counts=True)
        doc, piece = at // self.stored, at % self.stored
        n = self.sizes[piece, 3]
        starts = np.cumsum(self.sizes[:, 3]) - self.sizes[:, 3]
        take = np.repeat(starts[piece] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.repeat(doc.astype(np.uint64) << np.uint64(32), n) | self.keys[take].astype(np.uint64)
        order = np.argsort(both, kind="stable")
        both, held = both[order], np.repeat(held, n)[order]
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        return ((both[first] >> np.uint64(32)).astype(np.int64), (both[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                np.add.reduceat(held, first))


@lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, written: bool) -> Aligner:
    """One for all tasks of a worker and pass."""
    return Aligner(a_path, b_path, written)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    np.add.at(out, at, np.concatenate(counts))
    return distinct, out


# --- Spark: counts of pairs ----------------------------------------------------

def _by_piece(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key range, places in ``keys``) of each range that has keys."""
    piece = piece_of(keys)
    order = np.argsort(piece, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(piece[order]) != 0]) if len(keys) else []
    for part in np.split(order, starts[1:]) if len(keys) else []:
        yield int(piece[part[0]]), part


def partial_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """First pass: distinct keys of a task's documents with the number of these
    documents that hold them, by key range (piece, keys, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path, False)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def rows() -> Iterator[pa.RecordBatch]:
            if keys:
                k, c = _summed(keys, counts)
                rows_ = [(p, k[at].tobytes(), c[at].tobytes()) for p, at in _by_piece(k)]
                for start in range(0, len(rows_), 32):
                    part = rows_[start:start + 32]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), *[
                        pa.array([r[i] for r in part], pa.binary()) for i in (1, 2)]], names=["piece", "keys", "counts"])

        for _, raw in text_slices(batches, "text"):
            _, key, _ = align.links(*align([r.decode() for r in raw]))
            k, c = np.unique(key, return_counts=True)
            keys.append(k)
            counts.append(c)
            if sum(map(len, keys)) > FLUSH_PAIRS:
                k, c = _summed(keys, counts)
                keys, counts = [k], [c]
                if len(k) > FLUSH_PAIRS // 2:
                    yield from rows()
                    keys, counts = [], []
        yield from rows()

    return docs.select("text").mapInArrow(run, "piece int, keys binary, counts binary")


class _Group:
    """What a task does with the rows of one group, which come one by one."""

    def add(self, row: dict) -> Iterator[dict]:
        """Takes a row; may give columns of rows at once, as arrays."""
        return iter(())

    def end(self, key: tuple) -> Iterator[dict]:
        return iter(())


def _streamed(df: DataFrame, by: list[str], group: Callable[[], _Group], schema: str) -> DataFrame:
    """The rows of each ``by`` in the order of ``kind``, given to a ``group()``.
    No more than its state and one batch is held, however many rows it has."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() for j, c in enumerate(columns)}
                now = tuple(row[c] for c in by)
                if now != key:
                    if key is not None:
                        yield from map(pa.RecordBatch.from_pydict, state.end(key))
                    key, state = now, group()
                yield from map(pa.RecordBatch.from_pydict, state.add(row))
        if key is not None:
            yield from map(pa.RecordBatch.from_pydict, state.end(key))

    dealt = df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("kind",) if c in columns])
    return dealt.mapInArrow(run, schema)


def _keys(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def _one(*values: tuple[str, pa.DataType, object]) -> dict:
    return {name: pa.array([value], kind) for name, kind, value in values}


class _Distinct(_Group):
    """All distinct keys of a group, of a whole key range in the order of the hash."""

    def __init__(self, salted: bool):
        self.salted, self.found, self.size = salted, [], 0

    def add(self, row: dict) -> Iterator[dict]:
        self.found.append(_keys(row["keys"]))
        self.size += len(self.found[-1])
        if self.size > 2 * len(self.found[0]) + FLUSH_PAIRS:
            self._merge()
        return iter(())

    def _merge(self) -> None:
        self.found = [np.unique(np.concatenate(self.found))]
        self.size = len(self.found[0])

    def end(self, key: tuple) -> Iterator[dict]:
        self._merge()
        keys = self.found[0]
        if self.salted:
            yield _one(("piece", pa.int32(), key[0]), ("keys", pa.binary(), keys.tobytes()))
        else:
            table = PairTable.over(keys, np.zeros(len(keys), np.int64))
            yield _one(("piece", pa.int32(), key[0]), ("hash", pa.binary(), table.hashing.to_bytes()),
                       ("keys", pa.binary(), table.keys.tobytes()))


class _Vector(_Group):
    """Adds partial counts to a dense vector in the order of the hash."""

    def add(self, row: dict) -> Iterator[dict]:
        if row["kind"] == 0:
            keys = _keys(row["keys"])
            self.table = PairTable(PerfectHash.from_bytes(row["hash"]), keys, np.zeros(len(keys), np.int64))
        else:
            at = self.table.places(_keys(row["keys"]))
            if (at < 0).any():
                raise ValueError("a key is missing in its perfect hash")
            np.add.at(self.table.counts, at, np.frombuffer(row["counts"], "<i8"))
        return iter(())

    def end(self, key: tuple) -> Iterator[dict]:
        yield _one(("piece", pa.int32(), key[0]), ("counts", pa.binary(), self.table.counts.tobytes()))


class _Total(_Group):
    """Adds the dense vectors of a key range."""

    def add(self, row: dict) -> Iterator[dict]:
        if row["kind"] == 0:
            self.hash, self.keys, self.total = row["hash"], row["keys"], np.zeros(len(row["keys"]) // 4, np.int64)
        else:
            self.total += np.frombuffer(row["counts"], "<i8")
        return iter(())

    def end(self, key: tuple) -> Iterator[dict]:
        yield _one(("piece", pa.int32(), key[0]), ("hash", pa.binary(), self.hash), ("keys", pa.binary(), self.keys),
                   ("counts", pa.binary(), self.total.tobytes()))


def _beside(rows: DataFrame, tables: DataFrame, salted: bool) -> DataFrame:
    """``rows`` (kind 1) and, before them in each group, its table (kind 0)."""
    first = tables.withColumn("kind", F.lit(0))
    if salted:
        first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return first.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)


def pair_counts(partial: DataFrame) -> DataFrame:
    """The dense count vectors (piece, hash, keys, counts), stored."""
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)).cast("int"))
    some = _streamed(salted.drop("counts"), ["piece", "salt"], lambda: _Distinct(True), "piece int, keys binary")
    hashed = store(_streamed(some, ["piece"], lambda: _Distinct(False), "piece int, hash binary, keys binary"), "pair-hash")
    vectors = _streamed(_beside(salted, hashed, True), ["piece", "salt"], _Vector, "piece int, counts binary")
    total = _streamed(_beside(vectors, hashed, False), ["piece"], _Total,
                      "piece int, hash binary, keys binary, counts binary")
    return store(total, "pair-counts")


def best_counts(tables: DataFrame) -> np.ndarray:
    """The highest count of each A id: as many numbers as A can have ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                best = np.zeros(1 << 16, np.int64)
                np.maximum.at(best, _keys(keys) >> 16, np.frombuffer(counts, "<i8"))
                ids = np.flatnonzero(best)
                yield pa.RecordBatch.from_pydict({"a": pa.array(ids, pa.int32()), "best": pa.array(best[ids], pa.int64())})

    best = np.zeros(1 << 16, np.int64)
    rows = tables.select("keys", "counts").mapInArrow(run, "a int, best long").groupBy("a").agg(F.max("best").alias("best"))
    found = rows.toArrow()
    best[found["a"].to_numpy()] = found["best"].to_numpy()
    return best


def hot_pairs(tables: DataFrame, limit: int) -> tuple[PairTable, int]:
    """The most frequent pairs, by powers of two of their count, ``limit`` of
    them at most, and how many pairs there are."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column(0).to_pylist():
                n = np.bincount(np.frexp(np.frombuffer(counts, "<i8").astype(float))[1], minlength=64)
                yield pa.RecordBatch.from_pydict({"power": pa.array(np.arange(len(n)), pa.int32()), "n": pa.array(n, pa.int64())})

    n = np.zeros(65, np.int64)
    for row in tables.select("counts").mapInArrow(sizes, "power int, n long").groupBy("power").agg(F.sum("n").alias("n")).collect():
        n[row["power"]] = row["n"]
    above = np.cumsum(n[::-1])[::-1]
    power = int(np.argmax(above <= limit))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = np.frombuffer(counts, "<i8")
                take = np.frexp(c.astype(float))[1] >= power
                yield pa.RecordBatch.from_pydict(_one(("keys", pa.binary(), _keys(keys)[take].tobytes()),
                                                      ("counts", pa.binary(), c[take].tobytes())))

    rows = tables.select("keys", "counts").mapInArrow(chosen, "keys binary, counts binary").collect()
    keys = np.concatenate([np.zeros(0, np.uint32), *[_keys(bytes(r["keys"])) for r in rows]])
    counts = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(bytes(r["counts"]), "<i8") for r in rows]])
    return PairTable.over(keys, counts), int(n.sum())


# --- Spark: second pass --------------------------------------------------------

ALIGNED = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string, cold_keys binary, cold_links binary")


def _aligned(docs: DataFrame, a_path: str, b_path: str, hot: PairTable, best: np.ndarray) -> DataFrame:
    """Every document with the counts of its hot pairs, and the pairs left."""
    shared = docs.sparkSession.sparkContext.broadcast((hot, best))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path, True)
        hot, best = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch, raw in text_slices(batches, "text"):
            flat, lengths = align([r.decode() for r in raw])
            doc, key, links = align.links(flat, lengths)
            distinct, at = np.unique(key, return_inverse=True)
            count = hot.lookup(distinct)
            top = (count == best[distinct >> 16]) & (count > 0)
            count, top = count[at], top[at]
            n_best, count_sum = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
            np.add.at(n_best, doc, links * top)
            np.add.at(count_sum, doc, links * count)
            cold = np.flatnonzero(count == 0)
            starts = np.searchsorted(doc[cold], np.arange(len(raw) + 1))
            cuts = [cold[s:e] for s, e in zip(starts[:-1], starts[1:])]
            sizes = np.zeros((len(raw), 4), np.int64)
            np.add.at(sizes, np.repeat(np.arange(len(raw)), lengths), align.sizes[flat])
            edges = np.r_[0, np.cumsum(lengths)].tolist()
            groups = list(map(align.groups.__getitem__, flat.tolist()))
            digests = [hashlib.sha256(";".join(groups[s:e]).encode()).hexdigest() if e > s else "" for s, e in zip(edges, edges[1:])]
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(raw)), pa.int64()), ids, *[pa.array(sizes[:, i]) for i in range(4)],
                 pa.array(n_best), pa.array(count_sum), pa.array(digests, pa.string()),
                 pa.array([key[c].tobytes() or None for c in cuts], pa.binary()),
                 pa.array([links[c].tobytes() or None for c in cuts], pa.binary())],
                names=[f.split()[0] for f in ALIGNED.split(", ")])
            row += len(raw)

    return docs.mapInArrow(run, ALIGNED)


class _Lookup(_Group):
    """Pairs of documents, looked up in the table of their key range."""

    def __init__(self, best: np.ndarray):
        self.best = best

    def add(self, row: dict) -> Iterator[dict]:
        if row["kind"] == 0:
            self.table = PairTable(PerfectHash.from_bytes(row["hash"]), _keys(row["keys"]), np.frombuffer(row["counts"], "<i8"))
            return
        keys, links = _keys(row["cold_keys"]), np.frombuffer(row["cold_links"], "<i8")
        count = self.table.lookup(keys)
        if not count.all():
            raise ValueError("a pair is missing in the counts")
        rows, at = np.unique(np.frombuffer(row["rows"], "<i8"), return_inverse=True)
        n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(n_best, at, links * (count == self.best[keys >> 16]))
        np.add.at(count_sum, at, links * count)
        yield {"row": pa.array(rows), "more_best": pa.array(n_best), "more_sum": pa.array(count_sum)}


def _cold_counts(aligned: DataFrame, tables: DataFrame, best: np.ndarray) -> DataFrame:
    """(row, more_best, more_sum) of the pairs that the hot table does not have."""
    shared = aligned.sparkSession.sparkContext.broadcast(best)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_keys, raw_links = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            keys, links = _keys(b"".join(raw_keys)), np.frombuffer(b"".join(raw_links), "<i8")
            rows = np.repeat(batch.column(0).to_numpy(), [len(k) // 4 for k in raw_keys])
            salt = batch.column(0)[0].as_py() // 1000 % SALTS
            found = [(p, salt, keys[at].tobytes(), links[at].tobytes(), rows[at].tobytes()) for p, at in _by_piece(keys)]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)],
                                             names=["piece", "salt", "cold_keys", "cold_links", "rows"])

    cold = aligned.where("cold_keys IS NOT NULL").select("row", "cold_keys", "cold_links") \
        .mapInArrow(blocks, "piece int, salt int, cold_keys binary, cold_links binary, rows binary")
    found = _streamed(_beside(cold, tables, True), ["piece", "salt"], lambda: _Lookup(shared.value),
                      "row long, more_best long, more_sum long")
    return found.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))


def aligned_digests(docs: DataFrame, a_path: str, b_path: str, hot_limit: int = HOT_PAIRS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens of A or of B do not give a space
    and the text, has no tokens: zeros and an empty digest.  Repeated rows are
    documents of their own and count each.  Other columns take no part; an empty
    table gives none.  ``hot_limit`` bounds the pairs that are broadcast, not
    the result.
    """
    docs = documents_only(docs)
    tables = pair_counts(store(partial_counts(docs, a_path, b_path), "pair-parts"))
    best = best_counts(tables)
    hot, n_pairs = hot_pairs(tables, hot_limit)
    aligned = store(_aligned(docs, a_path, b_path, hot, best), "aligned")
    if len(hot.keys) < n_pairs:
        more = _cold_counts(aligned, tables, best)
        aligned = aligned.join(more, "row", "left") \
            .withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))) \
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", F.lit(0)))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
