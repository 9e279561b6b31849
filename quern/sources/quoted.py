"""CSV with quoted cells that hold line breaks, read in blocks by many tasks.

Whether a line begins a record depends on all quotes before it. Each block of a file therefore says where it ends for both
ways it could begin (between records, or inside a cell); composed block by block that tells how each one does begin. It is
one small row for each block. Then every task cuts its blocks into records by itself. A record that reaches over a border comes as
fragments, which are put together in Spark and parsed as any other.

Both passes must see the same blocks, so files are read through a session of their own whose split size nobody else changes.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..common import importable

BLOCK = 64 << 20
#: Tasks for small blocks, where there are so many.
TASKS = 64

# A field is quoted (with doubled quotes, and whatever follows up to the comma) or plain; a quote inside a plain one is a character.
_OPEN = re.compile(r'(?:(?:"(?:[^"]++|"")*+"[^,]*+|[^",][^,]*+)?+,)*+"(?:[^"]++|"")*+\Z')
_CLOSE = re.compile(r'(?:[^"]++|"")*+"[^,]*+(?:,|\Z)')


def ends_open(line: str, begins_open: bool) -> bool:
    """Whether the end of a line lies inside a quoted cell."""
    if '"' not in line:
        return begins_open
    at = 0
    if begins_open:
        if not (m := _CLOSE.match(line)):
            return True
        at = m.end()
        if at == len(line):
            return False
    return _OPEN.match(line, at) is not None


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """((file, block), lines) of each run of rows of one block."""
    keys = list(zip(b.column("file").to_pylist(), b.column("block").to_pylist(), strict=True))
    lines, at = b.column("value").to_pylist(), 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[at]:
            yield keys[at], lines[at:i]
            at = i


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, block, and whether it ends open from a closed and from an open beginning."""
    now: dict[tuple[int, int], list[bool]] = {}
    for b in batches:
        for key, lines in _runs(b):
            state = now.setdefault(key, [False, True])
            for line in lines:
                if '"' in line:
                    state[:] = [ends_open(line, s) for s in state] if state[0] != state[1] else [ends_open(line, state[0])] * 2
    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in now], pa.int64()) for i in (0, 1)] + [pa.array([s[i] for s in now.values()], pa.bool_()) for i in (0, 1)], names=["file", "block", "closed", "open"])


def _borders(ends: list[tuple[int, int, bool, bool]]) -> tuple[dict[tuple[int, int], bool], set[tuple[int, int]]]:
    """(whether each block begins open, the blocks that end open) from all blocks' ends in order."""
    begins, tails, file, state = {}, set(), None, False
    for f, block, closed, opened in ends:
        state = state if f == file else False
        begins[f, block] = state
        file, state = f, opened if state else closed
        if state:
            tails.add((f, block))
    return begins, tails


def _cut(batches: Iterator[pa.RecordBatch], begins: dict[tuple[int, int], bool]) -> Iterator[tuple[tuple[int, int], str, list]]:
    """Of each block: ("head", lines before its first record), ("row", fields) of each record, ("tail", lines of one that stays open)."""
    key, carry, head, inside = None, [], [], False

    def rows(lines: list[str], last: bool):
        """Records of these lines; the lines of the last one are kept back unless the block ends here."""
        nonlocal carry
        reader, begin, previous = csv.reader(line + "\n" for line in lines), 0, None
        for row in reader:
            if previous is not None:
                yield key, "row", previous
            previous, start, begin = row, begin, reader.line_num
        if previous is None:
            carry = []
        elif ends_open("\n".join(lines[start:]), False):
            carry = [] if last else lines[start:]
            if last:
                yield key, "tail", lines[start:]
        else:
            carry = []
            yield key, "row", previous

    for b in batches:
        for this, lines in _runs(b):
            if this != key:
                if head:
                    yield key, "head", head
                yield from rows(carry, True)
                if this not in begins:
                    raise RuntimeError("the file's blocks changed between two passes")
                key, carry, head, inside = this, [], [], begins[this]
            at = 0
            while inside and at < len(lines):
                head.append(lines[at])
                inside = ends_open(lines[at], True)
                at += 1
            if not inside:
                if head:
                    yield key, "head", head
                    head = []
                yield from rows(carry + lines[at:], False)
    if head:
        yield key, "head", head
    yield from rows(carry, True)


def _fields(rows: Iterator[list[str]], width: int, places: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of the wanted fields; records with too many fields are dropped, missing and empty ones are null."""
    got: list[list[str | None]] = []
    for row in rows:
        if row and len(row) <= width:
            got.append([row[i] or None if i < len(row) else None for i in places])
        if len(got) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got, strict=True)], schema=schema)
            got = []
    if got:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*got, strict=True)], schema=schema)


def _lines(spark: SparkSession, path: str, block: int) -> DataFrame:
    """file, block, value: lines in blocks of ``block`` bytes, whatever this session's settings and executors are.

    A task takes several small blocks, one behind the other: each task is sent what is known of all blocks, so their number must
    not grow with that of the blocks.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    own.conf.set("spark.sql.files.minPartitionNum", "1")
    raw = own.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    raw = spark.createDataFrame([], raw.schema).unionAll(raw)
    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return raw.coalesce(max(tasks, -(-raw.rdd.getNumPartitions() * block // BLOCK)))


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in the first record of a CSV."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The columns (all, or those named) of a CSV with a header as strings; empty fields are null.

    Blank lines are skipped, records with more fields than the header are dropped, those with fewer are filled with nulls. A quote
    within a plain cell is a character; a cell that is never closed ends with its file.
    """
    importable(spark)
    names = header(spark, path)
    wanted = names if columns is None else columns
    places, width = [names.index(c) for c in wanted], len(names)
    lines = _lines(spark, path, block)
    ends = lines.mapInArrow(_ends, "file long, block long, closed boolean, open boolean").toArrow().sort_by([("file", "ascending"), ("block", "ascending")])
    begins, tails = _borders(list(zip(*(ends[c].to_pylist() for c in ends.column_names), strict=True)))
    schema = pa.schema([(f"c{i}", pa.string()) for i in range(len(wanted))])
    kind = ", ".join(f"c{i} string" for i in range(len(wanted)))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        last = None

        def rows():
            nonlocal last
            for key, part, row in _cut(batches, begins):
                header = key[1] == 0 and key != last
                last = key
                if part == "row" and not header:
                    yield row

        yield from _fields(rows(), width, places, schema)

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for key, part, text in _cut(batches, begins):
            if part != "row":
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([part == "tail"]), pa.array(["\n".join(text)])], names=["file", "block", "tail", "text"])

    out = lines.mapInArrow(whole, kind)
    if tails:
        # the few blocks with a border inside a record are read once more
        keys = spark.createDataFrame(sorted({k for k, v in begins.items() if v} | tails), "file long, block long")
        some = lines.join(F.broadcast(keys), ["file", "block"], "left_semi").select("file", "block", "value")
        pieces = some.mapInArrow(border, "file long, block long, tail boolean, text string")
        nth = F.sum(F.col("tail").cast("int")).over(Window.partitionBy("file").orderBy("block", "tail"))
        parts = pieces.withColumn("nth", nth).groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "tail", "text"))).alias("x"))
        texts = parts.select(F.array_join("x.text", "\n").alias("text"))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            csv.field_size_limit(sys.maxsize)
            yield from _fields((row for b in batches for t in b.column("text").to_pylist() for row in csv.reader(line + "\n" for line in t.split("\n"))), width, places, schema)

        out = out.unionAll(texts.mapInArrow(joined, kind))
    return out.toDF(*wanted)
