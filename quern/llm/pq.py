"""Embedding near-duplicates by product quantisation.

Vectors are scaled by powers of two inside Arrow tasks (which rounds nothing and keeps squares within range); those that are equal
then are one class, searched once, so a group of exact copies of any size costs one row. Vectors of each number of components are searched by themselves, with an index of
their own. Coarse centres (k-means) cut them into inverted lists; what is left of each vector after its centre is coded by
subspace codebooks. Both are fitted on a bounded sample (``SAMPLE`` vectors of a dimension); every vector is indexed.
A search looks a query's distances up in one table per subspace (asymmetric: the query is not coded) and reranks what comes near by the
cosine in double precision: the dot product over the product of the norms, of the components as given, so that a cosine of exactly
the threshold is a link.

A query probes the ``probes`` lists with the nearest centres (8 found all 616,930 links of 51,282 vectors in 200 lists,
4 all of them too, 1 99.97 %; tests measure recall on neighbours that are hardly within reach, in many small lists). With
``probes`` None all lists are probed, which is exact. A link that only one end's probes find is counted
at both: vectors carry their probes and queries their list. Within a probed list nothing is lost: a vector is reranked if its table distance is at most
the link distance plus its own quantisation error, which the triangle inequality asks for.

Work is dealt in cells: a list of any size is cut into blocks of about ``BLOCK`` vectors and its queries into parts of
about ``PART`` by hashes of ids, and a task holds a part against a block, so a list that holds a third of all rows is
many tasks. A vector is sent to its list once for each part, and a query once for each block: as lists grow beyond a block
(there are one for each 8 vectors of the sample at most), so does what is sent for each vector. A task returns a count for
each query and a spanning forest of its links, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept;
vectors of different numbers of components never link; repeated rows of a vec_id are one vector (the
smallest by its scaled numbers); rows without vec_id link with nothing, have a null component and are kept; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, lean, only, workers
from .components import components

SAMPLE = 20_000
LIST = 256  # vectors a list should hold, by which the number of centres grows, up to one for each 8 of the sample
PROBES = 8
SUBSPACES, CODES = 8, 64
ROUNDS = 8
BLOCK, PART = 16_384, 8_192
SLACK = 1e-6  # of rounding


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres after ROUNDS of Lloyd's method; first centres are drawn without repeats."""
    draw = np.random.default_rng(seed)
    k = min(k, len(x))
    centre = x[draw.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centre)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[count > 0] = total[count > 0] / count[count > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Index:
    """Coarse centres and codebooks of the residuals' subspaces."""

    def __init__(self, sample: np.ndarray, rows: int):
        lists = int(np.clip(rows // LIST, 1, max(1, SAMPLE // 8)))
        self.centre = kmeans(sample, lists, 1)
        rest = sample - self.centre[nearest(sample, self.centre)]
        self.cut = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.book = [kmeans(rest[:, c], CODES, 2 + i) for i, c in enumerate(self.cut)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, quantisation error) of each vector."""
        own = nearest(x, self.centre)
        rest = x - self.centre[own]
        codes = np.stack([nearest(rest[:, c], b) for c, b in zip(self.cut, self.book, strict=True)], 1).astype(np.uint8)
        error = np.sqrt(sum(((rest[:, c] - b[codes[:, i]]) ** 2).sum(1) for i, (c, b) in enumerate(zip(self.cut, self.book, strict=True))))
        return own, codes, error

    def probes(self, x: np.ndarray, most: int | None) -> np.ndarray:
        """(queries, probes): the lists with the nearest centres, ``most`` or all."""
        near = (self.centre**2).sum(1) / 2 - x @ self.centre.T
        n = min(most or near.shape[1], near.shape[1])
        return np.argpartition(near, n - 1, axis=1)[:, :n]

    def estimates(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """(queries, vectors) of one list: asymmetric distances, by a table for each subspace."""
        rest = queries - self.centre[list_]
        out = np.zeros((len(queries), len(codes)))
        for i, (c, b) in enumerate(zip(self.cut, self.book, strict=True)):
            part = rest[:, c]
            table = (part**2).sum(1)[:, None] + (b**2).sum(1) - 2 * part @ b.T
            out += table[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links (rows of two ids, the smaller first) that join the same ids as all of (a, b), one fewer than ids in each group."""
    a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    ids, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    over = list(range(len(ids)))

    def top(i: int) -> int:
        while over[i] != i:
            over[i] = i = over[over[i]]
        return i

    out = []
    for i, j in zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True):
        i, j = top(i), top(j)
        if i != j:
            over[max(i, j)] = min(i, j)
            out.append((int(ids[min(i, j)]), int(ids[max(i, j)])))
    return np.array(out, np.int64).reshape(-1, 2)


_VECTOR = "vec_id long, vector array<double>, d1 long, d2 long"


def _scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors of about length 1) of the rows of one number of components that can link."""
    x = _matrix(column)
    good = np.flatnonzero(np.isfinite(x).all(1) & (x != 0).any(1))
    x = x[good]
    return good, np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _norm(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


def _units(vectors: DataFrame) -> DataFrame:
    """_VECTOR for all rows that can link: the scaled vector and a digest of it, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column("embedding")), 0).to_numpy(zero_copy_only=False)
            size = np.where(b.column("vec_id").is_null().to_numpy(zero_copy_only=False), 0, size)
            for n in np.unique(size[size > 0]):
                mine = b.filter(pa.array(size == n))
                # a null component is no number either
                raw = pa.FixedSizeListArray.from_arrays(pc.fill_null(mine.column("embedding").flatten(), float("nan")), int(n))
                good, x = _scaled(raw)
                if len(good):
                    digest = np.frombuffer(b"".join(hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x), np.int64).reshape(-1, 2)
                    at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(n)
                    yield pa.RecordBatch.from_arrays([mine.column("vec_id").take(pa.array(good)), pa.ListArray.from_arrays(pa.array(at), pa.array(x.ravel())), pa.array(digest[:, 0]), pa.array(digest[:, 1])], names=["vec_id", "vector", "d1", "d2"])

    units = keep(only(vectors, vec_id="long", embedding="array<double>").mapInArrow(lean(run), _VECTOR))
    again = units.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    if again.isEmpty():
        return units
    # few as a rule: the arrays of repeated ids alone are sorted
    again = keep(again)
    first = units.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("vector", "d1", "d2")).alias("x")).select("vec_id", "x.*")
    out = keep(units.join(again, "vec_id", "left_anti").unionAll(first))
    drop(units, again)
    return out


def _classes(units: DataFrame) -> DataFrame:
    """vec_id (the class's smallest), vector, many: a row for each class of equal vectors, as a written table."""
    n = F.size("vector").alias("size")
    classes = keep(units.groupBy("d1", "d2", n).agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")))
    if classes.where("many > 1").isEmpty():
        drop(classes)
        return keep(units.select("vec_id", "vector", F.lit(1).cast("long").alias("many")))
    out = keep(units.select("vec_id", "vector").join(classes.select("rep", "many"), F.col("vec_id") == F.col("rep")).select("vec_id", "vector", "many"))
    drop(classes)
    return out


def _indices(vectors: DataFrame, counts: dict[int, int]) -> dict[int, tuple[int, Index]]:
    """For each dimension of ``counts``: the number of its first list, and its index."""
    out, first = {}, 0
    for n, rows in sorted(counts.items()):
        share = min(1 << 20, 2 * SAMPLE * (1 << 20) // rows + 1)
        mine = vectors.where(F.size("vector") == n)
        picked = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share).select("vector").limit(SAMPLE)
        sample = np.array([r["vector"] for r in picked.toLocalIterator()] or [mine.first()["vector"]])
        index = Index(sample / _norm(sample)[:, None], rows)
        out[n] = (first, index)
        first += len(index.centre)
    return out


def _search(least: float, index):
    """A function for the rows of one pair of blocks: counts of each query's links, and a forest of them as rows (a, b)."""
    reach = float(np.sqrt(2 - 2 * least))
    shape = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return shape.empty_table()
        first, model = index.value[len(left.column("vector")[0])]
        q, qid = _matrix(left.column("vector").combine_chunks()), left.column("vec_id").to_numpy()
        v, vid = _matrix(right.column("vector").combine_chunks()), right.column("vec_id").to_numpy()
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(len(v), -1)
        error, list_ = right.column("error").to_numpy(), right.column("list")[0].as_py() - first
        home, probed = left.column("home").to_numpy(), _matrix(right.column("probes").combine_chunks())
        mine, theirs = left.column("many").to_numpy(), right.column("many").to_numpy()  # how many vectors each stands for
        long_q, long_v = _norm(q), _norm(v)
        from_query, from_vector = np.zeros(len(q), np.int64), np.zeros(len(v), np.int64)
        forest = np.zeros((0, 2), np.int64)
        for i in range(0, len(q), 256):
            for j in range(0, len(v), 2048):
                some, these = slice(i, i + 256), slice(j, j + 2048)
                x, y = np.nonzero(model.estimates(q[some] / long_q[some, None], list_, codes[these]) <= reach + error[these] + SLACK)
                for s in range(0, len(x), 1 << 15):
                    at, to = x[s : s + (1 << 15)] + i, y[s : s + (1 << 15)] + j
                    near = ((q[at] * v[to]).sum(1) / (long_q[at] * long_v[to]) >= least) & (qid[at] != vid[to])
                    at, to = at[near], to[near]
                    np.add.at(from_query, at, theirs[to])
                    blind = (probed[to] != home[at, None]).all(1)  # these do not look where the query lies
                    np.add.at(from_vector, to[blind], mine[at[blind]])
                    forest = np.concatenate([forest, np.stack([qid[at], vid[to]], 1)])
            forest = _forest(forest[:, 0], forest[:, 1])
        ids, count = np.concatenate([qid, vid]), np.concatenate([from_query, from_vector])
        ids, count = ids[count > 0], count[count > 0]
        return pa.table({"a": np.append(ids, forest[:, 0]), "b": pa.array(np.append(np.zeros(len(ids), np.int64), forest[:, 1]), mask=np.arange(len(ids) + len(forest)) < len(ids)), "n": np.append(count, np.zeros(len(forest), np.int64))}, schema=shape)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, probes: int | None = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding), linked at cosine ``least``."""
    spark = vectors.sparkSession
    workers(spark)
    all_, units = only(vectors, vec_id="long"), _units(vectors)
    reps = _classes(units)
    counts = {r["n"]: r["count"] for r in reps.groupBy(F.size("vector").alias("n")).count().collect()}
    if not counts:
        return all_.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = spark.sparkContext.broadcast(_indices(reps, counts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = pc.list_value_length(whole.column("vector")).to_numpy(zero_copy_only=False)
            for n in np.unique(size):
                mine = whole.filter(pa.array(size == n))
                first, model = index.value[int(n)]
                for at in range(0, mine.num_rows, 1024):
                    b = mine.slice(at, 1024)
                    x = _matrix(b.column("vector"))
                    x = x / _norm(x)[:, None]
                    (own, codes, error), probed = model.encode(x), model.probes(x, probes)
                    lists = pa.array(list((probed + first).astype(np.int32)), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), b.column("many"), pa.array((own + first).astype(np.int32)), pa.array([c.tobytes() for c in codes]), pa.array(error), lists], names=["vec_id", "vector", "many", "list", "codes", "error", "probes"])

    # written, so that both sides of the search read the same lists
    coded = keep(reps.mapInArrow(lean(encode), "vec_id long, vector array<double>, many long, list int, codes binary, error double, probes array<int>"))
    drop(reps)
    asked = coded.select("vec_id", "vector", "many", F.col("list").alias("home"), F.explode("probes").alias("list"))

    def shares(df: DataFrame, most: int):
        """In how many shares a row's list is cut; at most as many lists as centres."""
        sizes = df.groupBy("list").count().collect()
        return F.element_at(F.create_map(*[F.lit(int(x)) for r in sizes for x in (r["list"], -(-r["count"] // most))]), F.col("list"))

    blocks, parts = shares(coded, BLOCK), shares(coded.select(F.explode("probes").alias("list")), PART)
    share = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n.cast("long")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = asked.withColumn("part", share(parts, 1)).withColumn("block", every(blocks))
    right = coded.where(parts.isNotNull()).withColumn("block", share(blocks, 2)).withColumn("part", every(parts))
    on = ["list", "block", "part"]
    found = keep(left.where("block is not null").groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_search(least, index), "a long, b long, n long"))
    index.destroy()
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    named = coded.select(F.col("vec_id").alias("id"), "many").join(links, "id", "left").join(comps, "id", "left")
    named = keep(named.select("id", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n"), F.coalesce("comp", "id").alias("comp"), "many"))
    drop(coded, found)
    if named.where("many > 1").isEmpty():
        each = named.select("id", "n", "comp")
    else:  # each vector by its class's smallest
        size = F.size("vector")
        reps = units.groupBy("d1", "d2", size.alias("size")).agg(F.min("vec_id").alias("rep"))
        each = units.select("vec_id", "d1", "d2", size.alias("size")).join(reps, ["d1", "d2", "size"]).select(F.col("vec_id").alias("id"), "rep")
        each = each.join(named.select(F.col("id").alias("rep"), "n", "comp"), "rep").select("id", "n", "comp")
    out = all_.join(each, F.col("vec_id") == F.col("id"), "left")
    comp = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
