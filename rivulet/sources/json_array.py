"""One large JSON array, read by many tasks (S1, S3, S9, S10) and written
(K6, K11).

Spark reads a file that is one JSON array with one task.  Here the file is read
as text that is cut after every ``}``, so Spark splits it by bytes as
it does lines.  Where a record begins cannot be told from the middle of a file:
whether a brace counts hangs on the quotes before it.  So each split is summed
up first, once as if it began outside of a string and once inside (one small row
a split); with the splits in order that gives every split's true state.  Then
each split is walked again: a record that lies in it comes out whole, parts of
one that lies over a border are put together by their record's number.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.session import checkpoint_dir

#: What matters outside of strings.
SIGNS = re.compile(r'["{}\[\]]')


class Walk:
    """Goes through pieces of a file.  ``depth`` counts open braces and brackets
    outside of strings; a record is what stands at ``level`` of them."""

    def __init__(self, depth: int, inside: bool, level: int):
        self.depth, self.inside, self.level = depth, inside, level

    def step(self, text: str) -> Iterator[tuple[int, bool]]:
        """(place, ends) where a record begins, and after which it ends."""
        at = self._string(text, 0) if self.inside else 0
        while found := SIGNS.search(text, at):
            c, at = found[0], found.end()
            if c == '"':
                self.inside = True
                at = self._string(text, at)
            elif c in "{[":
                self.depth += 1
                if self.depth == self.level + 1 and c == "{":
                    yield at - 1, False
            else:
                self.depth -= 1
                if self.depth == self.level and c == "}":
                    yield at, True

    def _string(self, text: str, at: int) -> int:
        """The place after the string's end; pieces end after a bracket, never
        within an escape."""
        while True:
            quote, escape = text.find('"', at), text.find("\\", at)
            if quote < 0 and escape < 0:
                return len(text)
            if 0 <= escape and (quote < 0 or escape < quote):
                at = escape + 2
                continue
            self.inside = False
            return quote + 1


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, ord, text) of the file cut after every ``}``."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("ord"), F.col("value"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """((file, split), text of a piece), in the order of the file."""
    for b in batches:
        yield from zip(zip(b.column("file").to_pylist(), b.column("split").to_pylist()), b.column("value").to_pylist())


def _summaries(pieces: DataFrame) -> DataFrame:
    """What each split makes of each state it can begin in, and its first sign:
    a row a split."""
    def run(batches):
        now, walks, root = None, None, ""

        def row():
            return pa.RecordBatch.from_pylist([{"file": now[0], "split": now[1], "root": root, **{
                f"{name}_{k}": v for k, w in enumerate(walks) for name, v in (("depth", w.depth), ("inside", w.inside))}}])

        for key, text in _runs(batches):
            if key != now:
                if now is not None:
                    yield row()
                now, walks, root = key, [Walk(0, False, 1 << 30), Walk(0, True, 1 << 30)], ""
            root = root or text.lstrip("\ufeff \t\r\n")[:1]
            for w in walks:
                for _ in w.step(text + "}"):
                    pass
        if now is not None:
            yield row()

    return pieces.mapInArrow(run, "file string, split long, root string, depth_0 long, inside_0 boolean, depth_1 long, inside_1 boolean")


def _states(summaries: DataFrame) -> dict[tuple[str, int], tuple[int, bool]]:
    """(depth, inside) at the beginning of each split: a fold over the splits,
    a row each.  Raises for a file that ends before its array does."""
    out, ends = {}, {}
    for r in sorted(summaries.collect(), key=lambda r: (r["file"], r["split"])):
        depth, inside, root = ends.get(r["file"], (0, False, r["root"]))
        out[r["file"], r["split"]] = depth, inside
        ends[r["file"]] = depth + r[f"depth_{int(inside)}"], r[f"inside_{int(inside)}"], root
    for file, (depth, inside, root) in ends.items():
        # one more brace is counted after the last piece, unless the file ends with one
        if inside or not (depth == -1 or depth == 0 and root == "{"):
            raise ValueError(f"{file} is not one whole JSON value")
    return out


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, *, level: int = 1) -> DataFrame:
    """The records of files that are one JSON array each (``level`` 1), or whose
    records stand deeper, as in ``{"data": [...]}`` (``level`` 2): all objects
    under that many open brackets.  ``file`` and ``place`` (bytes and a number
    that rises) give their order.  Text that is no JSON record raises."""
    pieces = _pieces(spark, path)
    shared = spark.sparkContext.broadcast(_states(_summaries(pieces)))

    def run(batches):
        now, walk, held, number = None, None, [], 0

        def part(kind: str, last: bool = False):
            text = "".join(held)
            return pa.RecordBatch.from_pylist([{"file": now[0], "split": now[1], "number": number, "kind": kind, "value": text}])

        def begins():
            return "tail" if opened else "middle"

        opened = False  # whether the record in hand began in this split
        for key, text in _runs(batches):
            if key != now:
                if now is not None and held and walk.depth > level:
                    yield part(begins())
                now, held, number, opened = key, [], 0, False
                walk = Walk(*shared.value[key], level)
            text += "}"
            cut = 0
            for at, ends in walk.step(text):
                if ends:
                    held.append(text[cut:at])
                    yield part("whole" if opened else "head")
                    held, opened, number = [], False, number + 1
                else:
                    held, opened = [], True
                cut = at
            if walk.depth > level:
                held.append(text[cut:])
        if now is not None and held and walk.depth > level:
            yield part(begins())

    found = pieces.mapInArrow(run, "file string, split long, number long, kind string, value string")
    path_ = f"{checkpoint_dir(spark).rstrip('/')}/rivulet-json-{uuid.uuid4().hex}"
    found.write.parquet(path_)
    found = spark.read.parquet(path_)
    whole = found.where("kind = 'whole'").select("file", "split", "number", "value")
    # a record over borders: its tail in one split, middles, its head in a later one.  One row a split at most of each kind
    first = {}
    for r in sorted(found.where("kind <> 'whole'").select("file", "split", "number", "kind").collect(), key=lambda r: (r["file"], r["split"], r["number"])):
        if r["kind"] == "tail":
            begun = (r["split"], r["number"])
        first[r["file"], r["split"], r["kind"]] = begun
    if first:
        where = spark.createDataFrame([(*k, *v) for k, v in first.items()], "file string, split long, kind string, b_split long, b_number long")
        over = found.where("kind <> 'whole'").join(where, ["file", "split", "kind"]).groupBy("file", "b_split", "b_number") \
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda x: x["value"]), "").alias("value"))
        whole = whole.unionByName(over.select("file", F.col("b_split").alias("split"), F.col("b_number").alias("number"), "value"))
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    record = F.from_json("value", kind, {"mode": "FAILFAST"})
    return whole.select(record.alias("r"), "file", F.struct("split", "number").alias("place")).select("r.*", "file", "place")


def write_array(df: DataFrame, path: str, *, parts: int | None = None, key: str | None = None) -> None:
    """Each file of the folder ``path`` is one JSON array, with ``key``
    an object that holds it under this key, and a file appears only when its
    task is done and the job commits.  ``parts=1`` gives one array; its rows
    then go through one task, one at a time."""
    first, last = ("[", "]") if key is None else (f'{{"{key}": [', "]}")
    df = df if parts is None else df.coalesce(parts)
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        before = first
        for b in batches:
            values = b.column(0).to_pylist()
            if values:
                yield pa.RecordBatch.from_pydict({"value": [(before if i == 0 else ",") + v for i, v in enumerate(values)]})
                before = ","
        yield pa.RecordBatch.from_pydict({"value": [first + last if before == first else last]})

    rows.mapInArrow(run, "value string").write.mode("overwrite").text(path)
