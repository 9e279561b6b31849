"""Compressing vectors to codes of a few bytes: Lloyd's method on integers with Yinyang's bounds.

Components become integers, vectors are cut into equal parts, and each part position has a codebook. A part's nearest entry is
found without trying all: entries are clustered into groups once, and each part keeps one lower bound for each group on its
distance to the group's entries (but its own). When entries move, a group's bound falls by the longest way any of its entries
went; only groups whose bound does not exceed the distance to the part's own entry are scanned. Bounds are floating-point and
rounded down; what is scanned is decided by squared distances in exact integers, so ties always go to the lower index and the
result is that of the plain method, whatever the bounds let through.

Each round is one pass: tasks read the vectors with their entries and bounds, write them anew, and write the sums and counts of
their parts by entry beside them (a bounded number of rows for each task), which Spark adds up. Codebooks (entries x components)
are all that the driver holds.

Arithmetic: while components stay within :func:`safe` (2 million for parts of 16), squared distances are exact in double
precision and rows are handled together; entries too far away to be anyone's nearest are left out there. Other rows are
handled in Python's integers and scan everything.

Defined cases: vectors that are null or hold null or non-finite components are dropped; a component beyond a long is the
nearest long, and so is an error; vectors of each number of components have codebooks of their own (the first parts are longer where
it is no multiple of the parts; empty vectors are at distance 0 of entry 0); rows without vec_id are coded, but start no codebook; of
repeated rows of a vec_id the least starts one, and all are coded; where no row has a vec_id nothing can be coded and no
row comes back; fewer rows than entries make a smaller codebook; null labels are one label; other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import drop, keep, lean, workers
from .pq import kmeans, nearest

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUP = 32  # entries that a group holds on average
#: Up to so many different labels their totals are broadcast; beyond it each is sent to SALTS shares of its rows.
FEW_LABELS, SALTS = 20_000, 32
LONG = (1 << 63) - 1


def safe(m: int) -> int:
    """The largest component of parts of ``m`` whose distances to all entries that matter are exact in double precision."""
    return int(2**26 / (math.sqrt(m) * (2 + 2 * math.sqrt(m)))) if m else 1


class Codebook:
    """Entries of one part position, as Python integers, with their groups and how far each group has moved last."""

    def __init__(self, entries: list[tuple[int, ...]], seed: int):
        self.entries, m = entries, len(entries[0])
        x = np.array(entries, float).reshape(len(entries), m)
        self.group = nearest(x, kmeans(x, -(-len(entries) // GROUP), seed)) if m else np.zeros(len(entries), np.int64)
        self.groups = int(self.group.max()) + 1
        self._fit(np.zeros(self.groups))

    def _fit(self, drift: np.ndarray) -> None:
        self.drift = drift
        self.exact = np.array([list(e) for e in self.entries], object).reshape(len(self.entries), -1)
        m = self.exact.shape[1]
        most = np.array([max(map(abs, e), default=0) for e in self.entries], object)
        far = most > safe(m) * (1 + 2 * math.sqrt(m)) + 1
        far = far.astype(bool)
        self.near = np.flatnonzero(~far) if min(most) <= safe(m) else np.zeros(0, np.int64)
        self.far_groups = np.unique(self.group[far])
        self.plain = self.exact[self.near].astype(float)

    def moved(self, sums: dict[int, tuple[int, list[int]]]) -> None:
        """Replace entries by the floored means of ``sums`` (entry: count, sums)."""
        old, self.entries = self.entries, list(self.entries)
        drift = np.zeros(self.groups)
        for e, (n, total) in sums.items():
            self.entries[e] = tuple(t // n for t in total)
            way = math.sqrt(sum((a - b) ** 2 for a, b in zip(old[e], self.entries[e], strict=True))) * (1 + 1e-12)
            drift[self.group[e]] = max(drift[self.group[e]], way)
        self._fit(drift)

    def assign(self, x: np.ndarray, own: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(entry, squared distance, lower bounds, distances computed) of each of ``x`` (integers as doubles within safe), from its last
        entry and bounds."""
        back = np.full(len(self.entries), -1)
        back[self.near] = np.arange(len(self.near))
        c, group = self.plain, self.group[self.near]
        at = np.where(back[own] < 0, 0, back[own])  # an entry that went far is no one's nearest
        best = ((x - c[at]) ** 2).sum(1)
        lower = lower - self.drift
        lower[back[own] < 0] = 0
        ask = lower <= (np.sqrt(best) * (1 + 1e-9))[:, None]
        square, half, tried = (x**2).sum(1), (c**2).sum(1), len(x)
        for g in range(self.groups):
            members = np.flatnonzero(group == g)
            rows = np.flatnonzero(ask[:, g])
            if not len(members) or not len(rows):
                continue
            far = square[rows, None] - 2 * (x[rows] @ c[members].T) + half[members]
            tried += far.size
            mine = np.flatnonzero(group[at[rows]] == g)
            far[mine, np.searchsorted(members, at[rows[mine]])] = np.inf  # a group's bound is on all but the own entry
            first = far.argmin(1)
            least = far[np.arange(len(rows)), first]
            far[np.arange(len(rows)), first] = np.inf
            second = far.min(1)
            win = (least < best[rows]) | (least == best[rows]) & (members[first] < at[rows])
            lower[rows, g] = np.sqrt(np.where(win, second, least))
            won = rows[win]
            # the entry that loses its part counts for its group again; where that is this group it is no less than the winner
            lost = group[at[won]]
            lower[won, lost] = np.minimum(lower[won, lost], np.sqrt(best[won]))
            at[won], best[won] = members[first[win]], least[win]
        lower[:, self.far_groups] = 0
        return self.near[at], best, lower, tried

    def assign_exactly(self, x: list[int]) -> tuple[int, int]:
        d = ((self.exact - np.array(x, object)) ** 2).sum(1) if len(x) else np.zeros(len(self.entries), object)
        least = min(d)
        return next(i for i, v in enumerate(d) if v == least), int(least)


def _cuts(size: int, parts: int) -> list[np.ndarray]:
    return np.array_split(np.arange(size), parts)


def _coded(b: pa.RecordBatch, books: list[Codebook], parts: int):
    """(entries of each part, errors as Python integers or longs, bounds, integers, rows handled together) for rows of one size."""
    n, size = b.num_rows, len(b.column("ints")[0])
    ints = b.column("ints").flatten().to_numpy().reshape(n, size)
    had = "own" in b.schema.names
    width = [k.groups for k in books]
    lower = b.column("lower").flatten().to_numpy().reshape(n, sum(width)).astype(float) if had else np.zeros((n, sum(width)))
    own = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64) if had else np.zeros((n, parts), np.int64)
    error, new, bounds = np.zeros(n, object), np.zeros((n, parts), np.int64), np.zeros((n, sum(width)))
    most = np.maximum(ints.max(1), -(ints.min(1) + 1)) if size else np.zeros(n, np.int64)
    cuts, together = _cuts(size, parts), most < safe(-(-size // parts))
    together &= all(len(k.near) for k in books)
    rows = np.flatnonzero(together)
    for p, (cut, book) in enumerate(zip(cuts, books, strict=True)):
        to = sum(width[: p + 1])
        mine = slice(to - width[p], to)
        if len(rows):
            new[rows, p], d, bounds[rows, mine], _ = book.assign(ints[np.ix_(rows, cut)].astype(float), own[rows, p], lower[rows, mine])
            error[rows] += d.astype(np.int64)
        for i in np.flatnonzero(~together):
            new[i, p], d = book.assign_exactly(ints[i, cut].tolist())
            error[i] += d
    return new, error, bounds, ints, together


def _rounded_down(lower: np.ndarray) -> np.ndarray:
    low = np.minimum(lower, 1e30).astype(np.float32)
    return np.nextafter(low, np.float32(-np.inf))


def _sizes(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = pc.list_value_length(b.column("ints")).to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        yield b.filter(pa.array(size == n))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])), pa.array(x.ravel(), kind))


def _round(books: dict[int, list[Codebook]], parts: int, schema: pa.Schema):
    """A pass: rows with their new entries and bounds, and at the end sums by size, part and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for whole in batches:
            for b in _sizes(whole):
                size = len(b.column("ints")[0])
                new, _, bounds, ints, together = _coded(b, books[size], parts)
                if size not in sums:
                    sums[size] = [(np.zeros(len(k.entries), np.int64), np.zeros((len(k.entries), len(c)), object)) for k, c in zip(books[size], _cuts(size, parts), strict=True)]
                for p, (cut, (count, total)) in enumerate(zip(_cuts(size, parts), sums[size], strict=True)):
                    count += np.bincount(new[:, p], minlength=len(count))
                    some = np.zeros(total.shape, np.int64)
                    np.add.at(some, new[together, p], ints[np.ix_(together, cut)])
                    total += some
                    for i in np.flatnonzero(~together):
                        total[new[i, p]] += np.array(ints[i, cut].tolist(), object)
                none = pa.nulls(b.num_rows)
                columns = [b.column("vec_id"), b.column("label"), b.column("ints"), pa.array([x.tobytes() for x in new.astype(np.uint8)]), _lists(_rounded_down(bounds), pa.float32())]
                yield pa.RecordBatch.from_arrays([*columns, *[none.cast(f.type) for f in list(schema)[5:]]], schema=schema)
        for size, each in sums.items():
            for p, (count, total) in enumerate(each):
                used = np.flatnonzero(count)
                rows = [size] * len(used), [p] * len(used), used, count[used], [[Decimal(int(v)) for v in total[e]] for e in used]
                none = pa.nulls(len(used))
                yield pa.RecordBatch.from_arrays([*[none.cast(f.type) for f in list(schema)[:5]], *[pa.array(r, f.type) for r, f in zip(rows, list(schema)[5:], strict=True)]], schema=schema)

    return run


def _start(rows: DataFrame, entries: int, parts: int) -> dict[int, list[Codebook]]:
    """For each size the codebooks of the ``entries`` smallest vec_ids."""
    books = {}
    named = rows.where("vec_id is not null").withColumn("size", F.size("ints"))
    for size in sorted(r["size"] for r in named.groupBy("size").count().collect()):
        mine = named.where(F.col("size") == size)
        ids = [r[0] for r in mine.select("vec_id").orderBy("vec_id").limit(entries).collect()]
        if len(set(ids)) < len(ids) == entries:  # repeated ids among them
            ids = [r[0] for r in mine.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
        # a comparison reaches the scan; one row for each of the ids
        first = mine.where(F.col("vec_id") <= ids[-1]).groupBy("vec_id").agg(F.min("ints").alias("ints")).collect()
        vectors = [r["ints"] for r in sorted(first, key=lambda r: r["vec_id"])]
        books[size] = [Codebook([tuple(v[i] for i in cut) for v in vectors], p) for p, cut in enumerate(_cuts(size, parts))]
    return books


def _move(books: dict[int, list[Codebook]], state: DataFrame) -> None:
    each = state.where("part is not null").select("size", "part", "entry", "n", F.posexplode_outer("total").alias("at", "t"))
    summed = each.groupBy("size", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    sums: dict[tuple[int, int], dict[int, tuple[int, list[int]]]] = {}
    for r in sorted(summed, key=lambda r: r["at"] or 0):
        _, total = sums.setdefault((r["size"], r["part"]), {}).setdefault(r["entry"], (r["n"], []))
        if r["at"] is not None:
            total.append(int(r["t"]))
    for size, each in books.items():
        for p, book in enumerate(each):
            book.moved(sums.get((size, p), {}))


def digest(books: list[Codebook]) -> str:
    """The SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(v) for k in books for e in k.entries for v in e).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, list[Codebook]]]:
    """(vec_id, label, size, code, error for each row of ``vectors`` (vec_id, embedding and perhaps label) that is kept, the codebooks by
    size). ``entries`` is 256 at most, as an index is one byte."""
    if not 0 < entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    spark = vectors.sparkSession
    workers(spark)
    label = F.col("`label`") if "label" in vectors.columns else F.lit(None).cast("string")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), label.alias("label"), F.col("`embedding`").cast("array<double>").alias("embedding")).where(finite)
    rows = rows.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * scale)).alias("ints"))
    books = _start(rows, entries, parts)
    rows = rows.where(F.size("ints").isin(*books)) if books else rows.limit(0)
    kind = rows.schema["label"].dataType
    shape = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("ints", T.ArrayType(T.LongType())), T.StructField("own", T.BinaryType()), T.StructField("lower", T.ArrayType(T.FloatType())), T.StructField("size", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DecimalType(38, 0)))])
    arrow = to_arrow_schema(shape)
    state = None
    for _ in range(rounds):
        before, state = state, keep(rows.mapInArrow(lean(_round(books, parts, arrow)), shape))
        if before is not None:
            drop(before)
        _move(books, state)
        rows = state.where("part is null").select("vec_id", "label", "ints", "own", "lower")
    last = T.StructType([*shape.fields[:2], T.StructField("size", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names = last.fieldNames()

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _sizes(whole):
                size = len(b.column("ints")[0])
                new, error, *_ = _coded(b, books[size], parts)
                columns = [b.column("vec_id"), b.column("label"), pa.array([size] * b.num_rows, pa.int32()), pa.array([x.tobytes().hex() for x in new.astype(np.uint8)]), pa.array([min(int(e), LONG) for e in error], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    coded = keep(rows.mapInArrow(lean(final), last))
    if state is not None:
        drop(state)
    return coded, books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors of all rows of its label (null is one) summed, a long at most."""
    totals = keep(coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")))
    named = totals.withColumnRenamed("label", "_label")
    if totals.count() <= FEW_LABELS:
        return coded.join(F.broadcast(named), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    # many labels, and any of them may hold a third of all rows: its rows are dealt over shares, its total goes to each
    salted = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    every = named.withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(every, (F.col("_salt") == F.col("_to")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_label", "_salt", "_to")


def encoded(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that is kept."""
    coded, books = compress(vectors, parts, entries, rounds, scale)
    book = F.lit(None).cast("string")
    for size, each in books.items():
        book = F.when(F.col("size") == size, digest(each)).otherwise(book)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", book.alias("codebooks_sha256"))
