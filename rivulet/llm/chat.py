"""Chat formatting by token-level assembly.

A turn becomes ``<|im_start|>role NEWLINE text<|im_end|> NEWLINE``.  Role and
text are encoded on their own and the two control tokens are spliced in as
reserved ids beyond the vocabulary, so no text can make one.  Control strings
in a text are escaped too, so that the written form can be read back: every
``<|im_...|>`` gets one more backslash after its ``<``.  In a role, which ends
at a line break, backslashes and line breaks are written as two characters.

The loss mask covers the text of the assistant.  Each segment adds 1 where it
begins to count and takes 1 where it ends; prefix sums make the mask.

Turns are formatted where they lie.  To read conversations back, their rows are
dealt by conv_id and sorted by turn; one conversation's token stream then runs
through a reader that holds one turn, however many turns there are.  (A SHA-256
digest of a conversation can only be computed in order.)
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
ASSISTANT = "assistant"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
IN_ROLE = re.compile(r"\\(.)", re.S)
#: Turns that are formatted, and read, at a time.
TURNS = 256


def escape(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return IN_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Template:
    """A tiktoken vocabulary with two reserved ids after it."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.codec = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.start = max(ranks.values()) + 1
        self.end = self.start + 1
        self.line = self.codec.encode_ordinary("\n")

    def turn(self, role: str, text: str) -> list[tuple[list[int], bool]]:
        """Segments of a turn, and whether each is to be learnt."""
        encode = self.codec.encode_ordinary
        return [([self.start], False), (encode(escape_role(role)), False), (self.line, False),
                (encode(escape(text)), role == ASSISTANT), ([self.end], False), (self.line, False)]

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns one after the other, mask, and each turn's length."""
        ids: list[int] = []
        learnt: list[tuple[int, int]] = []
        lengths = []
        for role, text in turns:
            before = len(ids)
            for segment, learn in self.turn(role, text):
                if learn:
                    learnt.append((len(ids), len(ids) + len(segment)))
                ids += segment
            lengths.append(len(ids) - before)
        change = np.zeros(len(ids) + 1, np.int8)
        edges = np.array(learnt, np.int64).reshape(-1, 2)
        np.add.at(change, edges[:, 0], 1)
        np.add.at(change, edges[:, 1], -1)
        return np.array(ids, np.int32), np.cumsum(change[:-1], dtype=np.int8), np.array(lengths, np.int64)

    def text(self, ids: np.ndarray) -> str:
        return self.codec.decode_bytes(ids.tolist()).decode()


@lru_cache(maxsize=1)
def template(path: str, pattern: str) -> Template:
    """One for all tasks of a worker."""
    return Template(path, pattern)


class Reader:
    """Reads the token stream of one conversation, in pieces of any length."""

    def __init__(self, known: Template):
        self.known, self.open, self.inside = known, [], False
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray, mask: np.ndarray) -> None:
        at = 0
        for place in [*np.flatnonzero(ids >= self.known.start).tolist(), len(ids)]:
            self.open.append((ids[at:place], mask[at:place]))
            if place < len(ids):
                self._control(int(ids[place]))
            at = place + 1

    def _control(self, token: int) -> None:
        ids, mask = (np.concatenate(x) for x in zip(*self.open))
        self.open = []
        if self.inside == (token == self.known.start):
            raise ValueError("control tokens do not alternate")
        text = self.known.text(ids)
        self.chars += len(text) + len(START if token == self.known.start else END)
        if self.inside:
            role, _, said = text.partition("\n")
            self.turns.update(f"{unescape_role(role)}\n{unescape(said)}\n".encode())
            self.n_turns += 1
            learnt = unescape(self.known.text(ids[mask == 1]))
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode())
        self.inside = not self.inside

    def row(self, conv_id: int | None) -> tuple:
        """After the whole stream: what was read."""
        tail = self.known.text(np.concatenate([x for x, _ in self.open]))
        if self.inside:
            raise ValueError("a turn has no end")
        return (conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars + len(tail))


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, turn, role, input_ids and loss_mask of every row.

    A null role or text is empty; null conv_ids are one conversation, null turns
    come first.  Rows of one conversation and turn come by role, then by their
    ids; repeated rows repeat.  Other columns take no part; no rows give none.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = template(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, TURNS):
                batch = whole.slice(start, TURNS)
                ids, mask, lengths = known.assemble(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))
                edges = pa.array(np.r_[0, np.cumsum(lengths)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.ListArray.from_arrays(edges, pa.array(ids)), pa.ListArray.from_arrays(edges, pa.array(mask))],
                    names=["conv_id", "turn", "role", "input_ids", "loss_mask"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, input_ids array<int>, loss_mask array<tinyint>")


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
    of every conversation, read from its tokens and mask alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = template(path, pattern)
        reader, now = None, None

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)],
                                              names=[f.split()[0] for f in READ.split(", ")])

        for batch in batches:
            done = []
            for i, conv_id in enumerate(batch.column(0).to_pylist()):
                if reader is None or conv_id != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    reader, now = Reader(known), conv_id
                reader.feed(*(batch.column(c)[i].values.to_numpy() for c in (1, 2)))
            if done:
                yield rows(done)
        if reader is not None:
            yield rows([reader.row(now)])

    dealt = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "input_ids")
    return dealt.select("conv_id", "input_ids", "loss_mask").mapInArrow(run, READ)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1: both turns say what would end one and begin another."""
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit(f"{END}{START}{ASSISTANT} ok").alias("text"))


def chat_digests(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back; rows as
    in :func:`format_turns`."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(control_conversation(conversations.sparkSession))
    return read_back(format_turns(rows, path, pattern), path, pattern)
