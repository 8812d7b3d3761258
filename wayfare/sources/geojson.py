"""Features of large GeoJSON collections, read in splits by several tasks.

Spark's text source, told that records end at a closing brace, splits files of any size. Where a split stands in the
file's nesting can't be told from the split alone, since braces may stand in strings. So a first pass goes through
each split in both cases, begun outside and inside a string, and gives the change of depth and the case at its end: one
row a split. Their running combination over a file tells where each split begins. The second pass then cuts out the
objects at the depth of features; those that span splits come in pieces, which are joined. A task holds one
split's record and the feature that it is in.

Session setting ``spark.sql.files.maxPartitionBytes`` is the size of a split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.durable import materialize

#: Outside of strings: a whole string, a string that the record's end leaves open, or a bracket.
_OUTSIDE = re.compile(r'"(?:[^"\\]|\\.)*"|"(?:[^"\\]|\\.)*\Z|[{}\[\]]', re.S)
#: Inside of a string: up to its end, if the record has it.
_INSIDE = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
#: Depth within which features are objects: the collection and its array.
_WITHIN = 2


def _brackets(record: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """(position after it, change of depth) of each bracket outside of strings, and whether the end is inside one."""
    at, out = 0, []
    if inside:
        end = _INSIDE.match(record)
        if end is None:
            return out, True
        at = end.end()
    inside = False
    for m in _OUTSIDE.finditer(record, at):
        token = m[0]
        if token[0] == '"':
            inside = len(token) == 1 or not _closed(token)
        else:
            out.append((m.end(), 1 if token in "{[" else -1))
    return out, inside


def _closed(token: str) -> bool:
    """Whether a string token ends with a quotation mark that no backslash escapes."""
    if token[-1] != '"':
        return False
    slashes = len(token) - 1 - len(token[:-1].rstrip("\\"))
    return slashes % 2 == 0


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], str]]:
    """(file and split, record with its brace), in the order of each split."""
    for batch in batches:
        for file, block, record in zip(*(batch.column(k).to_pylist() for k in ("file", "block", "value")), strict=True):
            yield (file, block), record + "}"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: for each split, by whether it begins in a string, the change of depth and whether it ends in one."""

    def told(split: tuple[str, int], depth: list[int], inside: list[bool]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": split[0], "block": split[1], "out_depth": depth[0], "out_in": inside[0], "in_depth": depth[1], "in_in": inside[1]}], schema=_CHANGES)

    split, depth, inside = None, [0, 0], [False, True]
    for now, record in _records(batches):
        if now != split:
            if split:
                yield told(split, depth, inside)
            split, depth, inside = now, [0, 0], [False, True]
        same = inside[0] == inside[1]
        for k in (0, 1):
            if k and same:  # the cases have met
                depth[1], inside[1] = depth[1] + change, inside[0]
                continue
            found, inside[k] = _brackets(record, inside[k])
            change = sum(c for _, c in found)
            depth[k] += change
    if split:
        yield told(split, depth, inside)


_CHANGES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("out_depth", pa.int64()), ("out_in", pa.bool_()), ("in_depth", pa.int64()), ("in_in", pa.bool_())])
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("opens", pa.bool_()), ("ends", pa.bool_()), ("text", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch], starts: dict[tuple[str, int], tuple[int, bool]]) -> Iterator[pa.RecordBatch]:
    """Pass 2: whole features, and the pieces of those that begin or end in another split."""

    def told(split: tuple[str, int], part: int, opens: bool, ends: bool, text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": split[0], "block": split[1], "part": part, "opens": opens, "ends": ends, "text": "".join(text)}], schema=_PIECES)

    split, held, opens, part, depth, inside = None, [], False, 0, 0, False
    for now, record in _records(batches):
        if now != split:
            if held:
                yield told(split, part, opens, False, held)
            split, part, opens = now, 0, False
            depth, inside = starts[now]
            held = [""] if depth > _WITHIN else []
        at = 0
        found, inside = _brackets(record, inside)
        for end, change in found:
            depth += change
            if change > 0 and depth == _WITHIN + 1 and record[end - 1] == "{":
                held, opens, at = [""], True, end - 1
            elif change < 0 and depth == _WITHIN and held:
                yield told(split, part, opens, True, [*held, record[at:end]])
                held, opens, part = [], False, part + 1
        if held:
            held.append(record[at:])
    if held:
        yield told(split, part, opens, False, held)


def features_text(spark: SparkSession, path: str) -> DataFrame:
    """feature: the JSON text of each object in the arrays of the collections at a path."""
    records = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    changes = materialize(records.mapInArrow(_changes, "file string, block long, out_depth long, out_in boolean, in_depth long, in_in boolean"), "splits")
    # one row a split: running case and depth of a file's splits, in order
    splits = changes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("block", "out_depth", "out_in", "in_depth", "in_in"))).alias("s"))
    begun: dict[tuple[str, int], tuple[int, bool]] = {}
    for row in splits.toLocalIterator():
        depth, inside = 0, False
        for s in row["s"]:
            begun[(row["file"], s["block"])] = (depth, inside)
            depth, inside = depth + (s["in_depth"] if inside else s["out_depth"]), s["in_in"] if inside else s["out_in"]
    starts = spark.sparkContext.broadcast(begun)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pieces(batches, starts.value)

    pieces = materialize(records.mapInArrow(cut, "file string, block long, part int, opens boolean, ends boolean, text string"), "pieces")
    whole = pieces.filter("opens and ends").select(F.col("text").alias("feature"))
    broken = pieces.filter("not (opens and ends)")
    # at most two rows a split, without texts, are numbered: a piece belongs to the feature that was opened last
    order = Window.partitionBy("file").orderBy("block", "part")
    numbered = broken.select("file", "block", "part", F.count_if("opens").over(order).alias("number"))
    grouped = broken.join(numbered, ["file", "block", "part"]).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("texts"))
    return whole.unionByName(grouped.select(F.array_join(F.transform("texts", lambda x: x["text"]), "").alias("feature")))
