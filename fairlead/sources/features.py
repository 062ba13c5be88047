"""One JSON document read by many tasks: the features of a FeatureCollection, or the objects of an array.

Spark cuts a file into blocks at closing braces (the text source's line separator), so every block begins behind one. A
block alone can't tell whether it begins inside a string, nor how deep. So a first pass sums each block up for both
cases: how much deeper it ends, whether it ends in a string, and which containers it opened last at each depth. The sums
of a file's blocks, one short row each, are put one after another, which gives every block its beginning. A second pass
then cuts each block into features; what is left over at its ends goes to the features that span blocks, which are put
together from their pieces. Strings may hold braces, quotes and escapes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairlead.operators.shared import written

#: Blocks whose beginnings may be broadcast, some tens of bytes each. Blocks of 128 MB make that 256 TB.
MOST_BLOCKS = 2_000_000
_TOKEN = re.compile(r'"(?:[^"\\]++|\\.)*+"|[{}\[\]]|"', re.S)
_STRING_END = re.compile(r'(?:[^"\\]++|\\.)*+"', re.S)
_FEATURES = re.compile(r'(?<!\\)"features"\s*:\s*$')


def brackets(text: str, in_string: bool) -> tuple[list[tuple[int, str]], bool]:
    """Places of brackets outside strings, and whether the text ends in a string. It doesn't end in an escape."""
    at = 0
    if in_string:
        end = _STRING_END.match(text)
        if end is None:
            return [], True
        at = end.end()
    found = []
    for m in _TOKEN.finditer(text, at):
        c = text[m.start()]
        if c != '"':
            found.append((m.start(), c))
        elif m.end() - m.start() == 1:
            return found, True
    return found, False


def opens_features(text: str, at: int) -> bool:
    """Whether the bracket at ``at`` opens the list named features; name and bracket are in one piece."""
    return text[at] == "[" and _FEATURES.search(text, max(0, at - 200), at) is not None


class Summary:
    """Of a block for one kind of beginning: the change of depth, and for each depth (from the block's beginning) the
    kind of the container opened last there: 2 for features, 1 for another list, 0 for an object."""

    def __init__(self, in_string: bool):
        self.in_string, self.depth, self.last = in_string, 0, {}

    def feed(self, text: str) -> None:
        found, self.in_string = brackets(text, self.in_string)
        for at, c in found:
            if c in "[{":
                self.last[self.depth] = 2 if opens_features(text, at) else int(c == "[")
                self.depth += 1
            else:
                self.depth -= 1


class Cutter:
    """Cuts a block into objects of the wanted list, from a known beginning. ``kinds``: of the containers opened last at
    depth 0 and 1, as far as known."""

    def __init__(self, in_string: bool, depth: int, kinds: tuple[int, int]):
        self.in_string, self.depth, self.kinds = in_string, depth, list(kinds)
        self.parts: list[str] = []
        self.open = self._inside()
        self.first = self.open  # begun in an earlier block

    def _level(self) -> int | None:
        """The depth of the wanted list's objects: 1 in a list at the root, 2 in the root's features."""
        return 1 if self.kinds[0] == 1 else 2 if self.kinds[0] == 0 and self.kinds[1] == 2 else None

    def _inside(self) -> bool:
        level = self._level()
        return level is not None and self.depth > level

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """``whole`` objects, and a ``head`` that ends what an earlier block began."""
        found, self.in_string = brackets(text, self.in_string)
        start = 0
        for at, c in found:
            if c in "[{":
                if not self.open and c == "{" and self.depth == self._level():
                    self.open, start = True, at
                if self.depth < 2:
                    self.kinds[self.depth] = 2 if self.depth == 1 and opens_features(text, at) else int(c == "[")
                    if self.depth == 0:
                        self.kinds[1] = 0
                self.depth += 1
            else:
                self.depth -= 1
                if self.open and self.depth == self._level():
                    self.parts.append(text[start : at + 1])
                    yield "head" if self.first else "whole", "".join(self.parts)
                    self.parts, self.open, self.first = [], False, False
        if self.open:
            self.parts.append(text[start:])

    def rest(self) -> tuple[str, str] | None:
        """What a later block ends: a ``tail``, or a ``middle`` that began before this block."""
        return ("middle" if self.first else "tail", "".join(self.parts)) if self.open else None


def _runs(frames: Iterator) -> Iterator[tuple[tuple, str, dict]]:
    """``(path, start), text, row`` of consecutive pieces of a block in a batch."""
    for b in frames:
        rows = b.to_pylist()
        a = 0
        for i in range(1, len(rows) + 1):
            if i == len(rows) or (rows[i]["path"], rows[i]["start"]) != (rows[a]["path"], rows[a]["start"]):
                text = "}".join(r["value"] for r in rows[a:i]) + "}"
                if rows[a]["start"] == 0:
                    text = text.removeprefix("﻿")
                yield (rows[a]["path"], rows[a]["start"]), text, rows[a]
                a = i


def _summaries(frames: Iterator) -> Iterator:
    import pyarrow as pa

    def row(key, both):
        cases = [{"in_string": s.in_string, "depth": s.depth, "last": list(s.last.items())} for s in both]
        kind = pa.struct([("in_string", pa.bool_()), ("depth", pa.int32()), ("last", pa.map_(pa.int32(), pa.int32()))])
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([cases], pa.list_(kind))], ["path", "start", "cases"])

    last, both = None, []
    for key, text, _ in _runs(frames):
        if key != last:
            if last is not None:
                yield row(last, both)
            last, both = key, [Summary(False), Summary(True)]
        for s in both:
            s.feed(text)
    if last is not None:
        yield row(last, both)


def _beginnings(frame):
    """The beginning of each block of a file, from the sums of those before."""
    import pandas as pd

    in_string, depth, kinds, out = False, 0, [-1, -1], []
    for r in frame.sort_values("start").itertuples():
        out.append((r.path, r.start, in_string, depth, *kinds))
        case = r.cases[int(in_string)]
        for at, kind in dict(case["last"]).items():
            if 0 <= depth + at < 2:
                kinds[depth + at] = kind
        depth, in_string = depth + case["depth"], case["in_string"]
    return pd.DataFrame(out, columns=["path", "start", "in_string", "depth", "kind0", "kind1"])


def _cut(frames: Iterator) -> Iterator:
    import pyarrow as pa

    def rows(key, found):
        n = len(found)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([t for _, t in found], pa.string())], ["path", "start", "kind", "text"])

    last, cutter = None, None
    for key, text, row in _runs(frames):
        if key != last:
            if cutter is not None and cutter.rest():
                yield rows(last, [cutter.rest()])
            last, cutter = key, Cutter(row["in_string"], row["depth"], (row["kind0"], row["kind1"]))
        found = list(cutter.feed(text))
        if found:
            yield rows(key, found)
    if cutter is not None and cutter.rest():
        yield rows(last, [cutter.rest()])


def objects(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: each object of a document's wanted list as JSON text. The list is the root's ``features``, or the
    root itself. Blocks are as large as ``spark.sql.files.maxPartitionBytes``; documents that can't be split (compressed
    ones) are blocks as a whole. A document with neither list gives no rows."""
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    kind = "path string, start long, cases array<struct<in_string:boolean,depth:int,last:map<int,int>>>"
    sums = written(text.mapInArrow(_summaries, kind), "blocks")
    if sums.count() > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} blocks: read fewer files at a time")
    known = written(sums.groupBy("path").applyInPandas(_beginnings, "path string, start long, in_string boolean, depth int, kind0 int, kind1 int"), "beginnings")
    pieces = written(text.join(F.broadcast(known), ["path", "start"]).mapInArrow(_cut, "path string, start long, kind string, text string"), "features")
    order = Window.partitionBy("path").orderBy("start", F.col("kind") != "head")
    parts = pieces.where("kind <> 'whole'").withColumn("number", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    spanning = parts.groupBy("path", "number").agg(F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"), F.count_if(F.col("kind") == "head").alias("ends"))
    put = spanning.where("ends = 1").select("path", F.array_join(F.col("p.text"), "").alias("text"))
    return pieces.where("kind = 'whole'").select("path", "text").unionByName(put)
