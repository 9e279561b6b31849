"""Elements of an array in a large JSON document, read in blocks by many tasks.

A string of JSON holds no line break, so every line begins outside of strings, and how deep it lies is the sum of brackets before it.
Each block says how far it goes down or up and which key it saw last at each depth; summed up block by block that tells where each one
begins. Then every task cuts its blocks into elements; those that reach over a border come as fragments and are put
together in Spark. A document may also lie in several files, one behind the other by name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..common import importable
from . import quoted

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"(\s*:)?|[{}\[\]]')


def _tokens(line: str, depth: int) -> Iterator[tuple[int, int, int, str | None]]:
    """(start, end, depth behind it, key) of each bracket and key of a line."""
    for m in _TOKEN.finditer(line):
        c = line[m.start()]
        if c == '"':
            if m[1]:
                yield m.start(), m.end(), depth, m[0][: -len(m[1])]
        else:
            depth += 1 if c in "{[" else -1
            yield m.start(), m.end(), depth, None


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, how much deeper it ends, and the last key seen at each depth (relative to its start)."""
    now: dict[tuple[int, int], list] = {}
    for b in batches:
        for key, lines in quoted._runs(b):
            state = now.setdefault(key, [0, {}])
            for line in lines:
                for _, _, state[0], name in _tokens(line, state[0]):
                    if name is not None:
                        state[1][state[0]] = json.loads(name)
    columns = [pa.array([k[i] for k in now], pa.int64()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] for s in now.values()], pa.int64()), pa.array([json.dumps(s[1]) for s in now.values()])], names=["file", "block", "deeper", "keys"])


def _begins(ends: list[tuple[int, int, int, str]]) -> dict[tuple[int, int], tuple[int, str | None]]:
    """(depth, key of the root map) at which each block begins, from all blocks in order."""
    out, depth, key = {}, 0, None
    for file, block, deeper, keys in ends:
        out[file, block] = depth, key
        key = json.loads(keys).get(str(1 - depth), key)
        depth += deeper
    return out


def _cut(batches: Iterator[pa.RecordBatch], begins: dict, name: str) -> Iterator[tuple[tuple[int, int], str, str]]:
    """("element", text) of each whole element in a block; ("head", text) up to the end of one that began before, ("tail", text) of one
    that goes on behind."""
    block, text, inside, head, depth, root = None, [], False, False, 0, None

    def rest():
        if inside:
            yield block, "head" if head else "tail", "\n".join(text)

    for b in batches:
        for key, lines in quoted._runs(b):
            if key != block:
                yield from rest()
                if key not in begins:
                    raise RuntimeError("the file's blocks changed between two passes")
                block, (depth, root) = key, begins[key]
                inside = head = depth > 2 and root == name
                text = []
            for line in lines:
                at = 0
                for start, end, deep, found in _tokens(line, depth):
                    if found is not None and deep == 1:
                        root = json.loads(found)
                    elif found is None and root == name:
                        if deep == 3 and depth == 2:
                            inside, head, at, text = True, False, start, []
                        elif deep == 2 and depth == 3 and inside:
                            yield block, "head" if head else "element", "\n".join([*text, line[at:end]])
                            inside = head = False
                    depth = deep
                if inside:
                    text.append(line[at:])
    yield from rest()


def elements(spark: SparkSession, path: str, name: str, schema: T.StructType | str, block: int = quoted.BLOCK) -> DataFrame:
    """Rows of the objects in the array ``name`` of a JSON document's root."""
    importable(spark)
    lines = quoted._lines(spark, path, block)
    ends = lines.mapInArrow(_ends, "file long, block long, deeper long, keys string").toArrow().to_pylist()
    # files are one behind the other by name
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path")).collect())
    known = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, nth int").select(F.xxhash64("path").alias("file"), "nth") if files else spark.createDataFrame([], "file long, nth int")
    order = {r["file"]: r["nth"] for r in known.collect()}
    ranked = sorted((order[e["file"]], e["block"], e["file"], e["deeper"], e["keys"]) for e in ends)
    begins = _begins([(f, b, d, k) for _, b, f, d, k in ranked])
    places = {(f, b): i for i, (_, b, f, _, _) in enumerate(ranked)}
    broken = {k for k, (depth, root) in begins.items() if depth > 2 and root == name}

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for _, part, text in _cut(batches, begins, name):
            if part == "element":
                got.append(text)
            if len(got) == 1024:
                yield pa.RecordBatch.from_arrays([pa.array(got)], names=["text"])
                got = []
        yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["text"])

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, text in _cut(batches, begins, name):
            if part != "element":
                yield pa.RecordBatch.from_arrays([pa.array([places[key]], pa.int64()), pa.array([part == "tail"]), pa.array([text])], names=["place", "tail", "text"])

    texts = lines.mapInArrow(whole, "text string")
    if broken:
        # blocks with an element over their start or end are read once more; as few rows as there are such blocks meet in order
        near = broken | {(f, b) for (f, b), i in places.items() if any(places[k] == i + 1 for k in broken)} if len(broken) < 64 else set(begins)
        keys = spark.createDataFrame(sorted(near), "file long, block long")
        pieces = lines.join(F.broadcast(keys), ["file", "block"], "left_semi").select("file", "block", "value").mapInArrow(border, "place long, tail boolean, text string")
        nth = F.sum(F.col("tail").cast("int")).over(Window.orderBy("place", "tail"))
        joined = pieces.withColumn("nth", nth).groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("place", "tail", "text"))).alias("x"))
        texts = texts.unionAll(joined.select(F.array_join("x.text", "\n").alias("text")))
    return texts.select(F.from_json("text", schema).alias("r")).select("r.*")
