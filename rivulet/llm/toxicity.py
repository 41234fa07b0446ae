"""Toxicity scores from a small recurrent network.

A bidirectional gated recurrent network reads windows of words.  The input of
a word is a learned word vector beside the mean vector of its runs of three and
five characters, so words never seen in training are read by their characters.
Attention pools the states of a window to one logit; a text's score is that of
its highest window.  Overlapping windows cover each text to its end.

The network is trained in numpy on the driver, on a bounded sample of the
labelled rows (``SAMPLE`` documents a class, ``SAMPLE_WINDOWS`` windows spread
evenly over each).  A document's label says nothing of where its toxic part
stands, so training alternates: the highest windows of toxic documents are the
positive examples, random and the highest windows of clean ones the negative.
Scoring runs as one map over the table.
"""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.llm.common import documents_only, fresh, give_back, with_text_columns

WINDOW, STRIDE = 48, 40
HIDDEN, WORD_DIM, CHAR_DIM, CHAR_ROWS, WORD_BYTES = 8, 4, 8, 1 << 14, 24
#: Bounds of the training sample: documents of each class, windows of each.
SAMPLE = {1: 1200, 0: 2400}
SAMPLE_WINDOWS = 32
VOCABULARY = 50_000
#: Windows read at a time.
BATCH = 1024
#: Words a worker keeps the gate inputs of.
KNOWN_WORDS = 150_000

#: A-Z to lower case, other ASCII signs but the apostrophe to a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Lower-cased words; those over ``WORD_BYTES`` bytes are cut in pieces of
    that size, each an input of its own."""
    words = raw.translate(_LETTERS).split()
    if len(raw) > WORD_BYTES and max(map(len, words), default=0) > WORD_BYTES:
        words = [w[i:i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


def window_starts(n: int) -> np.ndarray:
    """First words of the windows of a text of n words; the last ends with it."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), dtype=np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def char_rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed rows of every run of three and five characters of ``^word$`` and
    their weights (1 / count)."""
    chars = np.array([b"^" + w + b"$" for w in words], dtype=f"S{WORD_BYTES + 2}").view(np.uint8)
    chars = chars.reshape(len(words), -1).astype(np.uint64)
    three = chars[:, :-2] | chars[:, 1:-1] << 8 | chars[:, 2:] << 16
    five = three[:, :-2] | three[:, 2:] << 16
    code = np.concatenate([three, five], axis=1)
    there = np.concatenate([chars[:, 2:] > 0, chars[:, 4:] > 0], axis=1)
    rows = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)).astype(np.int32)
    return rows, (there / np.maximum(there.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def shrunken_odds(toxic: np.ndarray, clean: np.ndarray, prior: float, weight: float = 4.0) -> np.ndarray:
    """Log odds of the toxic class among documents with a feature, against the
    prior; few documents say little."""
    rate = (toxic + weight * prior) / (toxic + clean + weight)
    return np.clip(np.log(rate / (1 - rate)) - np.log(prior / (1 - prior)), -3, 3)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights; the leading axis of 2 is the direction of reading."""
    vocabulary: dict[bytes, int]  # row 0: unknown word
    word: np.ndarray
    char: np.ndarray
    enter: np.ndarray  # (2, inputs, 3 * hidden): update, reset, candidate
    enter_bias: np.ndarray
    gates: np.ndarray  # (2, hidden, 2 * hidden)
    candidate: np.ndarray  # (2, hidden, hidden)
    attend: np.ndarray  # (2 * hidden,)
    out: np.ndarray
    shift: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.word, self.char, self.enter, self.enter_bias, self.gates, self.candidate, self.attend, self.out]

    def inputs(self, words: list[bytes], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if known is None:
            known = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        if len(words) > 1 << 14:  # in parts; the last two are for training alone
            parts = [self.inputs(words[i:i + (1 << 14)], known[i:i + (1 << 14)])[0] for i in range(0, len(words), 1 << 14)]
            return np.concatenate(parts), known, np.zeros(0), np.zeros(0)
        rows, weights = char_rows(words)
        chars = np.zeros((len(words), CHAR_DIM), dtype=np.float32)
        for j in range(rows.shape[1]):
            use = np.flatnonzero(weights[:, j])
            if len(use) == 0:
                continue
            chars[use] += self.char[rows[use, j]] * weights[use, j, None]
        return np.concatenate([self.word[known], chars], axis=1), known, rows, weights

    def enter_gates(self, inputs: np.ndarray) -> np.ndarray:
        """(words, inputs) -> (2, words, 3 * hidden)."""
        return inputs @ self.enter + self.enter_bias

    def read(self, gates: np.ndarray, windows: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, ...]:
        """Logits of windows of rows of ``gates`` (-1: after the text's end)."""
        there = windows >= 0
        n, steps = windows.shape
        h = np.zeros((2, n, HIDDEN), dtype=np.float32)
        g = np.empty((2, n, 3 * HIDDEN), dtype=np.float32)
        states = np.empty((steps, n, 2 * HIDDEN), dtype=np.float32)
        short = [np.flatnonzero(~there[:, t]) for t in range(steps)]
        for t in range(steps):
            back = steps - 1 - t
            np.take(gates[0], windows[:, t], axis=0, out=g[0], mode="wrap")
            np.take(gates[1], windows[:, back], axis=0, out=g[1], mode="wrap")
            gate = h @ self.gates
            gate += g[..., :2 * HIDDEN]
            gate *= 0.5
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[..., :HIDDEN], gate[..., HIDDEN:]
            c = (r * h) @ self.candidate
            c += g[..., 2 * HIDDEN:]
            np.tanh(c, out=c)
            after = h - c
            after *= z
            after += c
            for d, at in ((0, t), (1, back)):  # states do not move where there is no word
                if len(short[at]):
                    after[d, short[at]] = h[d, short[at]]
            if keep is not None:
                keep.append((h, z, r, c))
            h = after
            states[t, :, :HIDDEN] = h[0]
            states[back, :, HIDDEN:] = h[1]
        score = np.where(there.T, states @ self.attend, -np.inf)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return pooled @ self.out[:-1] + self.out[-1], states, weight, pooled

    def gradients(self, words: list[bytes], known: np.ndarray, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, for ``parameters()``; backpropagation in time."""
        x, known, rows, weights = self.inputs(words, known)
        gates = self.enter_gates(x)
        kept: list = []
        logit, states, weight, pooled = self.read(gates, windows, kept)
        there, (n, steps) = windows >= 0, windows.shape
        d_logit = ((_sigmoid(logit) - label) / n).astype(np.float32)
        d_out = np.append(d_logit @ pooled, d_logit.sum())
        d_pooled = d_logit[:, None] * self.out[:-1]
        d_weight = np.einsum("nh,tnh->tn", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * self.attend
        d_attend = np.einsum("tn,tnh->h", d_score, states)
        d_gates_w, d_cand_w = np.zeros_like(self.gates), np.zeros_like(self.candidate)
        d_enter = np.zeros((2, n, steps, 3 * HIDDEN), dtype=np.float32)
        dh = np.zeros((2, n, HIDDEN), dtype=np.float32)
        for t in reversed(range(steps)):
            h, z, r, c = kept[t]
            dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
            live = np.stack([there[:, t], there[:, steps - 1 - t]])[..., None]
            d_new = np.where(live, dh, 0)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_rh = d_c @ self.candidate.transpose(0, 2, 1)
            d_r = d_rh * h * r * (1 - r)
            d_gate = np.concatenate([d_z, d_r], axis=-1)
            d_gates_w += h.transpose(0, 2, 1) @ d_gate
            d_cand_w += (r * h).transpose(0, 2, 1) @ d_c
            d_step = np.concatenate([d_gate, d_c], axis=-1)
            d_enter[0, :, t], d_enter[1, :, steps - 1 - t] = d_step[0], d_step[1]
            dh = np.where(live, d_new * z + d_rh * r + d_gate @ self.gates.transpose(0, 2, 1), dh)
        flat = windows.ravel()
        order = np.argsort(flat, kind="stable")
        order = order[np.searchsorted(flat[order], 0):]
        uniq, first = np.unique(flat[order], return_index=True)
        d_words = np.zeros((2, len(words), 3 * HIDDEN), dtype=np.float32)
        d_words[:, uniq] = np.add.reduceat(d_enter.reshape(2, -1, 3 * HIDDEN)[:, order], first, axis=1)
        d_x = (d_words @ self.enter.transpose(0, 2, 1)).sum(axis=0)
        d_word, d_char = np.zeros_like(self.word), np.zeros_like(self.char)
        np.add.at(d_word, known, d_x[:, :WORD_DIM])
        d_word[:, 0] = 0  # first components stay what they were counted to be
        use = weights > 0
        spread = np.broadcast_to(d_x[:, None, WORD_DIM:], (*use.shape, CHAR_DIM))[use] * weights[use][:, None]
        for j in range(CHAR_DIM):
            d_char[:, j] = np.bincount(rows[use], spread[:, j], minlength=CHAR_ROWS)
        d_char[:, 0] = 0
        return [d_word, d_char, x.T @ d_words, d_words.sum(axis=1, keepdims=True), d_gates_w, d_cand_w, d_attend, d_out]


def _start(words: list[list[bytes]], label: list[int], rng: np.random.Generator) -> Network:
    """Random weights over the sample's words; first components still 0."""
    both = Counter(w for ws in words for w in set(ws))
    listed = sorted((w for w, n in both.items() if n >= 2), key=lambda w: (-both[w], w))[:VOCABULARY - 1]
    word = rng.normal(0, 0.05, (len(listed) + 1, WORD_DIM)).astype(np.float32)
    char = rng.normal(0, 0.3, (CHAR_ROWS, CHAR_DIM)).astype(np.float32)
    word[:, 0], char[:, 0] = 0, 0

    def noise(*shape):
        return (rng.normal(0, 1, shape) / np.sqrt(shape[-2])).astype(np.float32)

    bias = np.zeros((2, 1, 3 * HIDDEN), dtype=np.float32)
    return Network({w: i + 1 for i, w in enumerate(listed)}, word, char,
                   noise(2, WORD_DIM + CHAR_DIM, 3 * HIDDEN), bias, noise(2, HIDDEN, 2 * HIDDEN), noise(2, HIDDEN, HIDDEN),
                   rng.normal(0, 0.3, 2 * HIDDEN).astype(np.float32),
                   np.append(rng.normal(0, 0.3, 2 * HIDDEN), 0).astype(np.float32))


def _odds(net: Network, words: list[list[bytes]], label: np.ndarray, rows: np.ndarray, used: np.ndarray,
          index: dict[bytes, int], use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First components: log odds of words and of runs of characters over the
    documents ``use``."""
    prior = np.clip(label[use].mean() if len(use) else 0.5, 0.01, 0.99)
    of_word, of_char = np.zeros((2, len(net.word))), np.zeros((2, CHAR_ROWS))
    for d in use:
        own = set(words[d])
        of_word[label[d], [net.vocabulary.get(w, 0) for w in own]] += 1
        at = np.fromiter((index[w] for w in own), dtype=np.int64, count=len(own))
        there = np.zeros(CHAR_ROWS, dtype=bool)
        there[rows[at][used[at]]] = True
        of_char[label[d]] += there
    word = shrunken_odds(of_word[1], of_word[0], prior)
    word[0] = 0
    return word.astype(np.float32), (3 * shrunken_odds(of_char[1], of_char[0], prior)).astype(np.float32)


def train(windows: list[list[list[bytes]]], label: list[int], steps: int = 150, rounds: int = 2, batch: int = 256,
          seed: int = 7) -> Network | None:
    """A network from each document's windows and label; None without both labels."""
    if len(set(label)) < 2:
        return None
    rng = np.random.default_rng(seed)
    words = [[w for win in doc for w in win] for doc in windows]
    net = _start(words, label, rng)
    index: dict[bytes, int] = {}
    owner, y = np.repeat(np.arange(len(windows)), [len(doc) for doc in windows]), np.array(label)
    table = np.full((len(owner), WINDOW), -1, dtype=np.int32)
    for row, win in zip(table, (win for doc in windows for win in doc)):
        row[:len(win)] = [index.setdefault(w, len(index)) for w in win]
    listed = list(index)
    known = np.array([net.vocabulary.get(w, 0) for w in listed])
    # a document is read with the odds that the other half of the sample gives,
    # in training and when the border is drawn: else its own words would tell
    half = np.zeros(len(y), dtype=np.int64)
    for c in (0, 1):
        half[y == c] = np.arange((y == c).sum()) % 2
    parts = [char_rows(listed[i:i + 8192]) for i in range(0, len(listed), 8192)]
    every = np.concatenate([p[0].astype(np.int16) for p in parts]), np.concatenate([p[1] > 0 for p in parts])
    del parts
    odds = [_odds(net, words, y, *every, index, np.flatnonzero(half != f)) for f in (0, 1)]
    in_half = [np.flatnonzero(half[owner] == f) for f in (0, 1)]

    def look(f: int) -> None:
        net.word[:, 0], net.char[:, 0] = odds[f]

    value = np.zeros(len(owner))
    for f in (0, 1):  # before training: a window's three most telling words
        look(f)
        telling = np.append(net.word[known, 0] + net.inputs(listed, known)[0][:, WORD_DIM], -99)
        value[in_half[f]] = np.sort(telling[table[in_half[f]]], axis=1)[:, -3:].sum(axis=1)
    moment = [[np.zeros_like(p), np.zeros_like(p)] for p in net.parameters()]
    step = 0
    for _ in range(rounds):
        order = np.lexsort((-value, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        top = order[place < 2]
        clean = np.flatnonzero(y[owner] == 0)
        negative = np.union1d(top[y[owner[top]] == 0], rng.choice(clean, min(3 * int((y == 0).sum()), len(clean)), replace=False))
        positive = top[y[owner[top]] == 1]
        for _ in range(steps):
            f = step % 2
            mine = [part[half[owner[part]] == f] for part in (positive, negative)]
            chosen = np.concatenate([rng.choice(part, batch // 2) for part in mine if len(part)])
            look(f)
            part = table[chosen]
            uniq, inverse = np.unique(part, return_inverse=True)
            inverse = inverse.reshape(part.shape) - int(uniq[0] < 0)
            uniq = uniq[uniq >= 0]
            rows_known = np.where(rng.random(len(uniq)) < 0.3, 0, known[uniq])  # so that characters count, too
            grads = net.gradients([listed[u] for u in uniq], rows_known, inverse, y[owner[chosen]])
            step += 1
            for p, g, (m, v) in zip(net.parameters(), grads, moment):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (0.01 * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
        for f in (0, 1):
            look(f)
            gates = net.enter_gates(net.inputs(listed, known)[0])
            for i in range(0, len(in_half[f]), 4096):
                at = in_half[f][i:i + 4096]
                value[at] = net.read(gates, table[at])[0]
    net.word[:, 0], net.char[:, 0] = _odds(net, words, y, *every, index, np.arange(len(y)))
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, value)
    # the border between the classes that has the best F1 on the sample, halfway to the next lower score
    order = np.argsort(-best, kind="stable")
    hits = np.cumsum(y[order])
    k = int(np.argmax(2 * hits / (np.arange(1, len(order) + 1) + y.sum())))
    below = best[order[k + 1]] if k + 1 < len(order) and np.isfinite(best[order[k + 1]]) else best[order[k]] - 1
    net.shift = float((best[order[k]] + below) / 2)
    return net


class Scorer:
    """Scores whole texts; keeps the gate inputs of recent words."""

    def __init__(self, net: Network | None):
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.gates = np.zeros((2, 1 << 14, 3 * HIDDEN), dtype=np.float32)

    def _learn(self, words: list[bytes]) -> None:
        at = len(self.index) - len(words)
        while len(self.index) > self.gates.shape[1]:
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)], axis=1)
        for i in range(0, len(words), 1 << 14):
            part = words[i:i + (1 << 14)]
            self.gates[:, at + i:at + i + len(part)] = self.net.enter_gates(self.net.inputs(part)[0])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        if self.net is None:
            return out
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        index, new, flat, starts, ends, owner, at = self.index, [], [], [], [], [], 0
        for d, raw in enumerate(texts):
            words = words_of(raw)
            for w in words:
                if w not in index:
                    index[w] = len(index)
                    new.append(w)
            flat.append(np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words)))
            s = window_starts(len(words))
            starts.append(s + at)
            ends.append(np.full(len(s), at + len(words)))
            owner.append(np.full(len(s), d))
            at += len(words)
        if new:
            self._learn(new)
        ids, start = np.concatenate([*flat, np.zeros(WINDOW, dtype=np.int32)]), np.concatenate(starts)
        end, owner = np.concatenate(ends), np.concatenate(owner)
        best = np.full(len(texts), -np.inf)
        for i in range(0, len(start), BATCH):
            place = start[i:i + BATCH, None] + np.arange(WINDOW)
            windows = np.where(place < end[i:i + BATCH, None], ids[place], -1)
            np.maximum.at(best, owner[i:i + BATCH], self.net.read(self.gates, windows)[0])
        read = np.isfinite(best)
        out[read] = _sigmoid(best[read] - self.net.shift)
        return out


def sample_documents(docs: DataFrame, labels: DataFrame, learn: "F.Column") -> tuple[list[list[list[bytes]]], list[int]]:
    """Windows and labels of the bounded sample.  ``learn``: condition on doc_id
    of the rows that may be learned from.  A label that is null or neither 0
    nor 1 is not one; of several labels of a doc_id the highest counts, of
    several texts of a doc_id the one whose windows come first in order."""
    marked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    picked = None
    for value, n in SAMPLE.items():
        part = marked.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = part if picked is None else picked.union(part)
    few = F.broadcast(picked.withColumnRenamed("doc_id", "label_id"))  # at most sum(SAMPLE) rows
    texts = documents_only(docs).join(few, F.col("doc_id") == F.col("label_id")).select("label_id", "toxic", "text")

    def cut(raw: list[bytes]) -> list[pa.Array]:
        out = []
        for t in raw:
            words = words_of(t)
            starts = window_starts(len(words))
            if len(starts) > SAMPLE_WINDOWS:
                starts = starts[np.linspace(0, len(starts) - 1, SAMPLE_WINDOWS).astype(int)]
            out.append([b" ".join(words[s:s + WINDOW]) for s in starts])
        return [pa.array(out, pa.list_(pa.binary()))]

    field = T.StructField("windows", T.ArrayType(T.BinaryType()))
    # one row for each sampled doc_id, however often its row is repeated
    rows = (with_text_columns(texts, "text", [field], lambda: cut).where(F.size("windows") > 0)
            .groupBy("label_id").agg(F.first("toxic").alias("toxic"), F.min("windows").alias("windows")).collect())
    rows = sorted((r.toxic, [bytes(w) for w in r.windows]) for r in rows)
    one: dict[bytes, bytes] = {}  # of equal words one object is enough
    return [[[one.setdefault(w, w) for w in win.split()] for win in ws] for _, ws in rows], [y for y, _ in rows]


def held_out(doc_id: str = "doc_id", folds: int = 5, fold: int = 0) -> "F.Column":
    """Whether a row is kept from training; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def with_score(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """All rows and columns of ``docs`` plus the score.  Trains at once.

    Scores lie in 0 to 1; a null text is empty, and a text without words scores
    0.  Without labelled rows of both classes every score is 0.
    """
    windows, label = sample_documents(docs, labels, ~held_out())
    net = train(windows, label)
    del windows, label
    give_back()

    def factory():
        scorer = Scorer(net)
        return lambda raw: [pa.array(scorer.scores(raw), pa.float64())]
    return with_text_columns(docs, "text", [T.StructField(column, T.DoubleType())], factory)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (score >= 0.5).

    Only rows that are not held out are learned from; the score comes from the
    whole text alone.  Repeated rows stay; an empty table gives none.
    """
    scored = with_score(documents_only(docs), labels, "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, all columns."""
    score = fresh(docs, "score")
    return with_score(docs, labels, score).where(F.col(score) < 0.5).drop(score)
