"""Near-duplicates by b-bit MinHash.

One pass over the texts makes, for each document, the minima of ``BANDS * ROWS`` hash functions over its set of word
shingles; bands of whole minima are hashed into keys, and of each minimum only the lowest ``BITS`` bits are kept, packed
into longs. Documents that share a band key are candidates; the bits that agree, corrected for chance agreement, give
an estimate that throws out clear misses; what is left is confirmed on full shingle sets.

Groups of copies: documents with equal sets become one class first (one row, whatever its size). In each band key's
bucket all are held against the bucket's smallest and largest id alone, which joins a group of near copies by links
that grow with its size. In buckets that then still hold several components, those outside the bucket's largest one are
held against the rest: by signatures in buckets of at most ``SMALL`` documents, and in larger ones by their differences
from that component's first document (see ``_by_difference``), which is exact and does not compare all with all.
Nothing is capped: a pair of similarity s is a candidate with probability 1 - (1 - s**6)**42 (0.999997 at 0.8).

Defined cases: null and wordless texts have empty sets, link with nothing and are kept; a text of fewer words than a
shingle is one shingle; rows that share a doc_id are one node; a row without doc_id links with nothing, has a null
component and is kept; other columns play no part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.select import global_rank
from . import textnum
from .common import drop, keep, lean, numbered, only, workers
from .components import components

BANDS, ROWS, BITS = 42, 6, 2
SMALL = 64
#: Bits that stand for a document's differences while pairs are looked for.
SKETCH = 2048
MASK_BITS = 1 << 26  # of the filter that keeps texts without candidates out of the shuffle: 8 MB at most
SLICE = 1 << 20
#: The estimate's standard deviation at similarity 0.8 is 0.03; four of them below the threshold.
MARGIN = 0.12

_RANDOM = np.random.default_rng(20240607)
_MULTIPLY = _RANDOM.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingles in ascending order, and where each row's start."""
    number, at = textnum.words(texts, textnum.SPACED)
    got, at = textnum.shingles(number, at, k)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    return got[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(at) - 1))])


def signatures(got: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed low bits, band keys) of each row; rows must not be empty."""
    n = len(at) - 1
    low = (got ^ (got >> textnum.U(32))).astype(np.uint32)
    least = np.empty((BANDS * ROWS, n), np.uint32)
    room = np.empty_like(low)
    for j in range(BANDS * ROWS):
        np.multiply(low, _MULTIPLY[j], out=room)
        np.add(room, _ADD[j], out=room)
        np.minimum.reduceat(room, at[:-1], out=least[j])
    keys = np.empty((n, BANDS), textnum.U)
    for b in range(BANDS):
        key = np.full(n, b + 1, textnum.U)
        for r in range(ROWS):
            key = textnum.mix(key * textnum.U(0xD6E8FEB86659FD93) + least[b * ROWS + r])
        keys[:, b] = key
    bits = (textnum.mix(least.astype(textnum.U)) & textnum.U((1 << BITS) - 1)).T
    per = 64 // BITS
    packed = np.zeros((n, -(-BANDS * ROWS // per)), textnum.U)
    for j in range(BANDS * ROWS):
        packed[:, j // per] |= bits[:, j] << textnum.U(j % per * BITS)
    return packed.view(np.int64), keys.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, fp1 long, fp2 long, sig array<long>, bands array<long>"


def _lists(x: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """An Arrow list column of ``n`` rows; those not in ``rows`` are empty."""
    size = np.zeros(n, np.int32)
    size[rows] = x.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(x.ravel()))


def sign(docs: DataFrame, k: int) -> DataFrame:
    """A row of _SIGNED for each row of ``docs`` (doc_id, text)."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textnum.slices(whole, "text", SLICE):
                got, at = sets(b.column("text"), k)
                n, count = b.num_rows, np.diff(at)
                full = np.flatnonzero(count)
                starts = at[:-1][full]
                fp1, fp2 = np.zeros(n, textnum.U), np.zeros(n, textnum.U)
                packed, keys = np.zeros((0, 1), np.int64), np.zeros((0, 1), np.int64)
                if len(full):
                    fp1[full] = np.add.reduceat(got, starts)
                    fp2[full] = np.add.reduceat(textnum.mix(got + textnum.U(7)), starts)
                    packed, keys = signatures(got, np.append(starts, len(got)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(fp1.view(np.int64)), pa.array(fp2.view(np.int64)), _lists(packed, full, n), _lists(keys, full, n)],
                    names=["doc_id", "n_shingles", "fp1", "fp2", "sig", "bands"],
                )

    return docs.mapInArrow(lean(run), _SIGNED)


def _estimate(a, b):
    """Similarity estimated from two packed signatures, corrected for bits that agree by chance."""
    longs = -(-BANDS * ROWS * BITS // 64)
    differ = None
    for i in range(longs):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        any_ = x
        for s in range(1, BITS):
            any_ = any_.bitwiseOR(F.shiftrightunsigned(x, s))
        lanes = sum(1 << j for j in range(0, 64, BITS))
        count = F.bit_count(any_.bitwiseAND(F.lit(lanes)))
        differ = count if differ is None else differ + count
    by_chance = 1 / (1 << BITS)
    return (F.lit(1.0) - differ / F.lit(float(BANDS * ROWS)) - F.lit(by_chance)) / F.lit(1 - by_chance)


def _mask(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id, in an array of at most MASK_BITS bits."""
    h = F.pmod(F.xxhash64("id"), F.lit(MASK_BITS))
    words = ids.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits"))
    out = np.zeros(MASK_BITS >> 6, np.int64)
    for b in words.toLocalIterator():
        out[b["word"]] = b["bits"]
    return out


def _full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles of the documents in ``ids`` (id) and, by chance of a hash, a few more, as a written table."""
    mask = docs.sparkSession.sparkContext.broadcast(_mask(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            h = whole.column("h").to_numpy(zero_copy_only=False)
            bit = (mask.value[h >> 6] >> (h & 63)) & 1
            chosen = whole.filter(pa.array(bit.astype(bool)))
            for b in textnum.slices(chosen, "text", SLICE):
                got, at = sets(b.column("text"), k)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got.view(np.int64)))], names=["doc_id", "shingles"])

    hashed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MASK_BITS)).alias("h"))
    out = keep(hashed.mapInArrow(lean(run), "doc_id long, shingles array<long>"))
    mask.destroy()
    return out


def _with_sets(docs: DataFrame, edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (a, b and others) with of_a and of_b, the full shingle sets; and the table to drop after use."""
    full = _full_sets(docs, edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))), k)
    of = lambda name: full.select(F.col("doc_id").alias(name), F.col("shingles").alias(f"of_{name}"))
    return edges.join(of("b"), "b").join(of("a"), "a"), full


def _confirm(docs: DataFrame, edges: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``edges`` (a, b) whose full shingle sets are similar enough, as a written table."""
    both, full = _with_sets(docs, edges, k)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    good = F.lit(100) * shared >= F.lit(percent) * (F.size("of_a") + F.size("of_b") - shared)
    out = keep(both.where(good).select("a", "b"))
    drop(full)
    return out


def _likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose signatures' estimate is not clearly below the threshold, as a written table."""
    of = lambda name: reps.select(F.col("rep").alias(name), F.col("sig").alias(f"of_{name}"))
    near = pairs.distinct().join(of("b"), "b").join(of("a"), "a").where(_estimate(F.col("of_a"), F.col("of_b")) >= percent / 100 - MARGIN)
    return keep(near.select("a", "b").distinct())


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of buckets that hold several components and more than their two centres, with each row's component and
    the one (``main``) that holds most of the bucket, as a written table."""
    of = comps.select(F.col("node").alias("rep"), "comp")
    now = keep(members.where("size > 3").join(of, "rep", "left").select("key", "rep", "n", "size", F.coalesce("comp", "rep").alias("comp"), F.expr("rep in (c1, c2)").alias("centre")))
    parts = now.groupBy("key", "comp").agg(F.count("*").alias("count"))
    main = keep(parts.groupBy("key").agg(F.max(F.struct("count", -F.col("comp"))).alias("most"), F.count("*").alias("comps")).where("comps > 1").select("key", (-F.col("most.col2")).alias("main")))
    return keep(now.where("not centre").join(main, "key").select("key", "rep", "n", "comp", "main", "size"))


def _by_signature(mixed: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Likely pairs (a, b) of different components in buckets of at most SMALL documents. Signatures are compared
    inside the join, so only likely pairs leave it, and a row meets SMALL others at most."""
    rows = keep(mixed.where(F.col("size") <= SMALL).select("key", "rep", "n", "comp", (F.col("comp") != F.col("main")).alias("out")).join(reps.select("rep", "sig"), "rep"))
    left = rows.where("out").select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("sig").alias("sx"))
    right = rows.select(F.col("key").alias("key_y"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), "out", F.col("sig").alias("sy"))
    new = F.expr(f"cx <> cy and (not out or x < y) and 100 * least(nx, ny) >= {percent} * greatest(nx, ny)")
    near = _estimate(F.col("sx"), F.col("sy")) >= percent / 100 - MARGIN
    pairs = left.join(right, (F.col("key") == F.col("key_y")) & new & near)
    return keep(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def _sketched(each: DataFrame) -> DataFrame:
    """``each`` (with a list ``d`` of longs) and ``sketch``: SKETCH bits as longs, one set for each element's hash."""
    out = each.select("*", F.array().cast("array<long>").alias("sketch")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.column("d")
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(d).to_numpy(zero_copy_only=False))
            bit = textnum.mix(d.flatten().to_numpy().view(textnum.U)) & textnum.U(SKETCH - 1)
            bits = np.zeros((b.num_rows, SKETCH // 64), textnum.U)
            np.bitwise_or.at(bits, (row, (bit >> textnum.U(6)).astype(np.int64)), textnum.U(1) << (bit & textnum.U(63)))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(bits.view(np.int64), np.arange(b.num_rows), b.num_rows)], names=[*b.schema.names, "sketch"])

    return each.mapInArrow(lean(run), out)


def _by_difference(docs: DataFrame, mixed: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between different components in buckets of over SMALL documents, without holding all against all.

    Let c be the first document of the bucket's main component and d(x) the symmetric difference of x's shingles and
    c's. Those that link with c itself are found at once. Two documents are linked if |d(x) ^ d(y)| <= t (|x| + |y|),
    t = (1 - s) / (1 + s), that is if d(x) and d(y) share at least (|d(x)| + |d(y)| - t (|x| + |y|)) / 2 shingles. Where
    x does not link with c, |d(x)| > t (|x| + |c|), so y must share more than h(y) = (|d(y)| + t (|c| - |y|)) / 2 of its
    own, and one of them is among the first |d(y)| - floor(h(y)) in any common order. The rarest come first, and near
    copies rarely share those. A row of that join has a sketch of fixed size, a bit for each difference's hash: bits that
    one has alone are differences that it has alone, so pairs that share too few for a link stay inside (lists of
    differences are kept once for each document, and decide on what comes out).
    """
    t = (100 - percent) / (100 + percent)

    def similar(total, apart):  # 100 * intersection >= percent * union, of sizes' sum and difference
        return F.lit(100) * (total - apart) >= F.lit(percent) * (total + apart)

    pairs = keep(mixed.where(F.col("size") > SMALL).select(F.col("main").alias("a"), F.col("rep").alias("b"), "comp").where("a <> b").distinct())
    both, full = _with_sets(docs, pairs, k)
    diff = F.concat(F.array_except("of_a", "of_b"), F.array_except("of_b", "of_a"))
    each = both.select("a", "b", "comp", F.size("of_a").alias("nc"), F.size("of_b").alias("n"), diff.alias("d")).withColumn("size", F.size("d"))
    each = each_ = keep(_sketched(each.withColumn("out", ~similar(F.col("n") + F.col("nc"), F.col("size")))))
    direct = each.where("not out and comp <> a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    single = each.withColumn("first", F.col("size") - F.floor((F.col("size") + t * (F.col("nc") - F.col("n"))) / 2)).withColumn("e", F.explode("d")).drop("d", "nc")
    # how many documents have a shingle: sums before the shuffle, and a join whose sides are plain shuffles, so that a
    # shingle which all near copies share is no task of its own
    often = keep(single.groupBy("a", "e").agg(F.count("*").alias("often")).where("often > 1"))
    # one that a document has alone cannot be shared; those come first in its order all the same
    shared = single.join(often, ["a", "e"])
    mine = Window.partitionBy("a", "b")  # a document's own shingles
    lone = F.col("size") - F.count("*").over(mine)
    shared = shared.withColumn("rank", lone + F.row_number().over(mine.orderBy("often", "e"))).where("out or rank <= first")
    ranked = keep(shared.select("a", "e", "b", "out", "comp", "n", "size", (F.col("rank") <= F.col("first")).alias("early"), "sketch"))
    x = ranked.where("out").select("a", "e", *[F.col(c).alias(f"{c}_x") for c in ("b", "comp", "early", "n", "size", "sketch")])
    y = ranked.where("early").select(F.col("a").alias("a2"), F.col("e").alias("e2"), *[F.col(c).alias(f"{c}_y") for c in ("b", "comp", "out", "n", "size", "sketch")])
    alone = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda s, n: s + n)
    both = F.least(F.col("size_x") - alone(F.col("sketch_x"), F.col("sketch_y")), F.col("size_y") - alone(F.col("sketch_y"), F.col("sketch_x")))  # at most
    new = F.expr("a = a2 and e = e2 and comp_x <> comp_y and (not out_y or early_x and b_x < b_y)")
    met = x.join(y, new & similar(F.col("n_x") + F.col("n_y"), F.col("size_x") + F.col("size_y") - 2 * both))
    met = keep(met.select("a", "b_x", "b_y").distinct())
    of = lambda c: each.select(F.col("a").alias(f"a_{c}"), F.col("b").alias(f"to_{c}"), *[F.col(v).alias(f"{v}_{c}") for v in ("n", "size", "d")])
    sure = met.join(of("x"), F.expr("a = a_x and b_x = to_x")).join(of("y"), F.expr("a = a_y and b_y = to_y"))
    apart = F.col("size_x") + F.col("size_y") - 2 * F.size(F.array_intersect("d_x", "d_y"))
    sure = sure.where(similar(F.col("n_x") + F.col("n_y"), apart))
    out = keep(sure.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).unionAll(direct).distinct())
    drop(full, pairs, each_, often, ranked, met)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text), as a lazy join of written tables.

    Links: pairs of documents with 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.
    """
    docs = only(docs, doc_id="long", text="string")
    signed = keep(sign(docs, k))
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = keep(real.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("rep")))
    named = real.withColumnRenamed("doc_id", "rep")
    reps = keep(named.join(classes, ["rep", "fp1", "fp2", "n_shingles"]).select("rep", F.col("n_shingles").alias("n"), "sig", "bands"))
    hits = reps.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    shared = keep(hits.groupBy("key").agg(F.min("rep").alias("c1"), F.max("rep").alias("c2"), F.count("*").alias("size")).where("c1 <> c2"))
    members = keep(hits.join(shared, "key"))
    to = lambda c: members.where(F.col("rep") != F.col(c)).select(F.least("rep", c).alias("a"), F.greatest("rep", c).alias("b"))
    links = _confirm(docs, _likely(to("c1").unionAll(to("c2")), reps, percent), k, percent)
    comps = components(links)
    mixed = _mixed(members, comps)
    found = [links]
    if not mixed.where(F.col("size") <= SMALL).isEmpty():
        found.append(_confirm(docs, _by_signature(mixed, reps, percent), k, percent))
    if not mixed.where(F.col("size") > SMALL).isEmpty():
        found.append(_by_difference(docs, mixed, k, percent))
    if len(found) > 1:
        comps = components(functools.reduce(DataFrame.unionAll, found))
    drop(members, shared, reps, mixed, *found)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("fp1", "fp2", F.col("n_shingles").alias("n"), F.coalesce("comp", "rep").alias("comp"))
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("fp1")).alias("f1"), F.col("fp2").alias("f2"))
    found = rows.join(named, (F.col("f1") == F.col("fp1")) & (F.col("f2") == F.col("fp2")) & (F.col("n_shingles") == F.col("n")), "left")
    comp = F.coalesce("comp", "doc_id")
    return found.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def _nodes(named: DataFrame) -> DataFrame:
    """``named`` (doc_id, text and others) with ``node``, one number for each doc_id and text, in the order of doc_id: it
    is the doc_id where no two texts share one; else all pairs are numbered."""
    mark = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    if named.groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").isEmpty():
        return named.withColumn("node", F.col("doc_id").cast("long"))
    ids = global_rank(named.select("doc_id", mark.alias("mark")).distinct(), F.col("doc_id"), F.col("mark")).withColumnRenamed("rank", "node")
    return keep(named.withColumn("mark", mark).join(ids, ["doc_id", "mark"]).drop("mark"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group (the smallest doc_id; of different texts under it, the smallest md5) with all its
    columns; rows without doc_id stay. Different texts under one doc_id are documents of their own; of rows that share
    both, the one with the smallest hash of all columns stays."""
    plain = numbered(docs, "doc_id", "text")
    nodes = _nodes(plain.where("doc_id is not null"))
    kept = near_duplicates(nodes.select(F.col("node").alias("doc_id"), "text"), k, percent).where("kept").select(F.col("doc_id").alias("node")).distinct()
    rows = nodes.join(kept, "node", "left_semi")
    order = F.xxhash64(*[F.to_json(F.struct(c)) if re.search("map<|variant", kind) else F.col(c) for c, kind in plain.dtypes])
    named = rows.groupBy("node").agg(F.min_by(F.struct(*plain.columns), order).alias("row")).select("row.*")
    return named.unionByName(plain.where("doc_id is null")).select(*plain.columns).toDF(*docs.columns)
