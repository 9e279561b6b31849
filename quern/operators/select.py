"""Deterministic selection: quotas, top-up, splits, limits."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..common import drop, keep


def shuffled(key: Column, seed: int | str = 42) -> Column:
    """An order that looks random and repeats: the md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def _prefix(order: Column) -> Column:
    return F.substring(order, 1, 4)


def _cuts(df: DataFrame, group: Column, order: Column, needs: dict[str, int]) -> dict[str, tuple[str, int]]:
    """For each group that has as many rows as it needs, the prefix of ``order`` at which it has them, and how many rows come before it.

    Rows are counted by the first four digits (65,536 counts at most a group meet), and a row a group comes to the driver.
    """
    counts = df.groupBy(group.alias("g"), _prefix(order).alias("p")).agg(F.count("*").alias("n"))
    need = F.element_at(F.create_map(*[F.lit(x) for pair in needs.items() for x in pair]), F.col("g"))
    running = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("g").orderBy("p"))).where(F.col("upto") >= need)
    return {r["g"]: (r["cut"]["p"], r["cut"]["before"]) for r in running.groupBy("g").agg(F.min(F.struct("p", (F.col("upto") - F.col("n")).alias("before"))).alias("cut")).collect()}


def first_by(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` by ``order`` (hexadecimal text, evenly spread, as of :func:`shuffled`) and ``key``.

    Counts by prefix say where the cut falls: whole prefixes below it are a filter, and only the rows of the one prefix that is cut are
    sorted. ``df`` is read twice, so it should be a table or cheap.
    """
    if n <= 0:
        return df.limit(0)
    found = _cuts(df, F.lit(""), order, {"": n})
    if not found:
        return df
    cut, before = found[""]
    prefix = _prefix(order)
    return df.where(prefix < cut).unionAll(df.where(prefix == cut).orderBy(order, key).limit(n - before))


def _heads(df: DataFrame, group: Column, order: Column, needs: dict[str, int], distinct) -> DataFrame:
    """``distinct`` of the rows that come first in each group, written: at least as many as the group needs, or all that it has.

    Rows are counted as they are. Where some are equal so that too few are left, four times as many are taken, so all rows are never
    shuffled unless they are needed. ``distinct`` gives rows with their group, ``g``.
    """
    most = dict(needs)
    while True:
        cuts = _cuts(df, group, order, most)
        cut = F.element_at(F.create_map(*[F.lit(x) for g, (p, _) in cuts.items() for x in (g, p)]), group) if cuts else F.lit(None)
        out = keep(distinct(df.where(cut.isNull() | (_prefix(order) <= cut)).withColumn("g", group)))
        have = {r["g"]: r["count"] for r in out.groupBy("g").count().collect()}
        short = [g for g in cuts if have.get(g, 0) < needs[g]]
        if not short:
            return out
        drop(out)
        most |= {g: 4 * most[g] for g in short}


def quota_select(candidates: DataFrame, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """``candidates`` (id, constraint) with each id once: constraints in the order of ``quotas`` take up to their number
    of ids that none before has taken, in shuffled order.

    Those before a constraint can take no more of its ids than they may take in all, so of each constraint only as many first pairs matter
    as its own quota and those before it make. These are written (two passes over ``candidates``, or a copy of it), and turns read them
    alone. A turn counts its pairs by prefix and writes what it takes: two jobs, and plans that do not grow.
    """
    needs, sum_ = {}, 0
    for constraint, n in quotas.items():
        sum_ += max(0, n)
        needs[constraint] = sum_
    if not needs:
        return candidates.select("id", "constraint").limit(0)
    order = shuffled(F.concat("constraint", F.lit(":"), F.col("id").cast("string")), seed)
    table = candidates if hasattr(candidates, "_quern_path") else keep(candidates.where(F.col("constraint").isin(list(needs))).select("id", "constraint"))
    mine = table.where(F.col("constraint").isin(list(needs)))
    pairs = _heads(mine, F.col("constraint"), order, needs, lambda x: x.select("id", "constraint", "g", order.alias("_h")).distinct())
    if table is not candidates:
        drop(table)
    taken = None
    for constraint in needs:
        mine = pairs.where(F.col("constraint") == constraint)
        if taken is not None:
            mine = mine.join(taken.select("id"), "id", "left_anti")
        got = keep(first_by(mine, F.col("_h"), "id", quotas[constraint]).select("id", "constraint"))
        taken = got if taken is None else taken.unionAll(got)
    drop(pairs)
    return taken


def top_up(candidates: DataFrame, taken: DataFrame, short: int, order: list[str], seed: int = 42) -> DataFrame:
    """``short`` more ids (id, constraint), of those not taken, each with its first constraint in ``order``.

    Only the ids that come first, as many as are taken and wanted, are grouped and compared with those taken.
    """
    if short <= 0 or not order:
        return candidates.select("id", "constraint").limit(0)
    rank = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("constraint"))
    hash_ = shuffled(F.concat(F.lit("top-up:"), F.col("id").cast("string")), seed)
    table = candidates if hasattr(candidates, "_quern_path") else keep(candidates.where(rank > 0).select("id", "constraint"))
    need = short + taken.select("id").distinct().count()
    first = _heads(table.where(rank > 0), F.lit(""), hash_, {"": need}, lambda x: x.groupBy("id", "g").agg(F.min(rank).alias("rank")))
    if table is not candidates:
        drop(table)
    left = first.join(taken.select("id"), "id", "left_anti")
    named = left.select("id", F.element_at(F.array(*[F.lit(c) for c in order]), F.col("rank").cast("int")).alias("constraint"), hash_.alias("_h"))
    return first_by(named, F.col("_h"), "id", short).select("id", "constraint")


def quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    return {c: max(1, int(total * s)) for c, s in shares.items()}


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 1 in a total order, without a window over all rows in one task.

    Rows are range-partitioned, sorted and written once with their partition and place in it: each partitioning samples
    bounds of its own, so counts and rows must come from one. Each partition's row count shifts the next ones' ranks; the
    counts (one per partition) are all that meets in one place.
    """
    names = df.columns
    keyed = df.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    keys = [f"_o{i}" for i in range(len(order))]
    parts = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    parts = keep(parts.select(*names, "_p", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)).alias("_r")))
    before = parts.groupBy("_p").agg(F.count("*").alias("n"))
    shift = before.select("_p", (F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).alias("_s"))
    return parts.join(shift, "_p").select(*names, (F.col("_r") + F.coalesce("_s", F.lit(0))).alias("rank"))


def split(df: DataFrame, key: str, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: the first max(1, int(n * (1 - valid))) rows in shuffled order are train, the rest valid."""
    n = df.count()
    cut = max(1, int(n * (1 - valid)))
    ranked = df.withColumn("_h", shuffled(F.col(key), seed))
    # the train part is a prefix of the order: find its last key by a top-n on the shorter side
    ranked = global_rank(ranked, F.col("_h"), F.col(key))
    return ranked.withColumn("split", F.when(F.col("rank") <= cut, "train").otherwise("valid")).drop("_h", "rank")


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(max(0, n))


def until_target(df: DataFrame, kept: Column, target: int, *order: Column) -> DataFrame:
    """Rows in order up to the one with which ``target`` kept ones are reached."""
    ranked = global_rank(df.withColumn("_kept", F.coalesce(kept, F.lit(False))), *order)
    last = ranked.where("_kept").orderBy("rank").select("rank").limit(target).agg(F.max("rank").alias("last"), F.count("*").alias("n"))
    return ranked.crossJoin(F.broadcast(last)).where((F.col("n") < target) | (F.col("rank") <= F.col("last"))).drop("_kept", "last", "n", "rank")


def in_waves(df: DataFrame, work, kept: Column, target: int, *order: Column, first: int | None = None, spare: float = 1.1) -> DataFrame:
    """What :func:`until_target` keeps of ``work(df)``, without doing the work on rows behind the target.

    ``work`` takes rows of ``df`` with their ``rank`` and gives them back, changed but one for one, with whatever ``kept`` needs. Rows go
    through it in waves by rank. The first has ``first`` rows (the target by default); each next one as many as should reach the
    target by the share kept so far, and ``spare`` times that, at most four times the last. A wave's results are written before the next one
    begins, so nothing is done twice, and rows of the last wave behind the target are cut off.
    """
    ranked = global_rank(df, *order)
    total, done, have, size, waves = ranked.count(), 0, 0, first or target, []
    while done < total and have < target:
        end = min(total, done + max(1, size))
        part = work(ranked.where((F.col("rank") > done) & (F.col("rank") <= end)))
        wave = keep(part.withColumn("_kept", F.coalesce(kept, F.lit(False))))
        got = wave.where("_kept").count()
        if have + got >= target:
            last = wave.where("_kept").orderBy("rank").select("rank").limit(target - have).agg(F.max("rank")).first()[0] if target > have else done
            wave = wave.where(F.col("rank") <= last)
        waves.append(wave)
        share = (have + got) / end
        size = min(4 * (end - done), math.ceil((target - have - got) / share * spare) if share else 4 * (end - done))
        done, have = end, have + got
    if not waves:
        return work(ranked.limit(0)).drop("rank")
    return functools.reduce(DataFrame.unionAll, waves).drop("_kept", "rank")


def unseen(pool: DataFrame, *done: DataFrame, key: str = "id") -> DataFrame:
    """``pool`` without the rows whose key is in any of ``done`` (resume)."""
    seen = None
    for d in done:
        part = d.where(F.col(key).isNotNull()).select(key)
        seen = part if seen is None else seen.unionAll(part)
    return pool if seen is None else pool.join(seen.distinct(), key, "left_anti")


def largest_file(files: DataFrame, name: str = "recipe") -> DataFrame:
    """Of ``files`` (path, length) the largest CSV whose name holds ``name``, else the largest CSV."""
    csv = files.where(F.lower("path").endswith(".csv"))
    liked = F.contains(F.lower(F.element_at(F.split("path", "/"), -1)), F.lit(name))
    return csv.orderBy(F.desc(liked), F.desc("length"), "path").limit(1)
