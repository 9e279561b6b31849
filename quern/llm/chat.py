"""Chat formatting with repair of roles at least cost.

A legal conversation is an optional system turn, then user and assistant turns in alternation, tool turns between two
assistant turns, and an assistant turn last. Each turn of a conversation is written in some role (another than its own
costs ``RELABEL``) or joined to the one before it if that was written in the same role (``MERGE``); empty turns may be
inserted anywhere, at the end too (``INSERT`` each). Dynamic programming over the automaton's states finds the cheapest
repair, which is then rendered.

Turns are sorted into a written table, and a conversation of any length is cut into chunks of at most ``CHUNK`` turns by
their positions in it, whatever their numbers are. A chunk is a table of least costs from each
state to each other one, and tables combine by (min, +) products, level by level ``FAN`` at a time, up to one for the
conversation; states at the borders are then settled from the top down, and each chunk is repaired by itself between
its two states. So nothing that is collected holds more than a chunk or ``FAN`` tables.

One row comes back for each turn, with ``piece``: the rendered text that it adds, marks before it and, behind the last
turn, the end included. The pieces of a conversation in the order of ``turn`` (then role and text) make its rendered text.

The sort ranges on the first ``PREFIX`` characters of roles and texts (bounds are sampled to the driver), so rows of a
conversation that agree in turn number, role and those are sorted by one task, on disk if they have to be.

Defined cases: unknown and null roles must be relabelled; null text is empty; turns are ordered by number (null
counts as -1), role and text; repeated rows are turns of their own; rows without conv_id make one conversation; other columns play
no part; equal costs are settled by the order of states and of moves, so results repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, keep, lean, only, workers

ROLES = ("system", "user", "assistant", "tool")
STATES = ("start", *ROLES)
#: From each state, the roles that may follow.
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)}
LAST = "assistant"
MERGE, RELABEL, INSERT = 1, 2, 3
CHUNK, FAN = 256, 256
PREFIX = 64
NEVER = 1 << 40
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@lru_cache(None)
def inserts(start: str, role: str) -> tuple[str, ...] | None:
    """The fewest empty turns that make ``role`` legal after ``start`` (first found in the order of NEXT)."""
    seen, front = {start}, [(start, ())]
    while front:
        ahead = []
        for state, path in front:
            if role in NEXT[state]:
                return path
            for r in NEXT[state]:
                if r not in seen:
                    seen.add(r)
                    ahead.append((r, (*path, r)))
        front = ahead
    return None


@lru_cache(None)
def move(state: str, role: str | None, to: str) -> tuple[int, bool, tuple[str, ...]]:
    """The cheapest way (cost, merged, inserted) to write a turn of ``role`` as ``to`` after ``state``."""
    if to == "start":
        return NEVER, False, ()
    cost = 0 if role == to else RELABEL
    ways = [(cost + MERGE, True, ())] if state == to else []
    if (path := inserts(state, to)) is not None:
        ways.append((cost + INSERT * len(path), False, path))
    return min(ways, key=lambda w: w[0]) if ways else (NEVER, False, ())


def ending(state: str) -> tuple[str, ...]:
    """Empty turns that must follow so that the conversation may end."""
    return () if state == LAST else (*inserts(state, LAST), LAST)


#: Least costs of one turn from each state to each, by its role's place in ROLES (any other role: the last).
SINGLE = np.array([[[move(s, r, t)[0] for t in STATES] for s in STATES] for r in (*ROLES, None)], np.int64)


def codes(roles: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(roles, pa.array(ROLES)), len(ROLES)).to_numpy(zero_copy_only=False)


def products(tables: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(groups, states, states): the (min, +) product of each group's tables, which are those from ``at[i]`` to
    ``at[i + 1]``. All groups go on together, a table at a time."""
    length, n = np.diff(at), len(STATES)
    out = np.where(np.eye(n, dtype=bool), 0, NEVER)[None].repeat(len(length), 0)
    for t in range(int(length.max(initial=0))):
        live = np.flatnonzero(length > t)
        out[live] = np.minimum((out[live][:, :, :, None] + tables[at[live] + t][:, None]).min(2), NEVER)
    return out


def paths(tables: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The state after each table, on a cheapest way of each group from ``first`` to ``last`` (ties: the state that comes
    first)."""
    length, groups = np.diff(at), np.arange(len(at) - 1)
    most = int(length.max(initial=0))
    best = np.full((most + 1, len(groups), len(STATES)), NEVER)
    best[0, groups, first] = 0
    for t in range(most):
        live = np.flatnonzero(length > t)
        best[t + 1, live] = np.minimum((best[t, live][:, :, None] + tables[at[live] + t]).min(1), NEVER)
    now, out = np.array(last), np.zeros(len(tables), np.int64)
    for t in range(most, 0, -1):
        live = np.flatnonzero(length >= t)
        out[at[live] + t - 1] = now[live]
        into = tables[at[live] + t - 1][np.arange(len(live)), :, now[live]]
        now[live] = (best[t - 1, live] + into).argmin(1)
    return out


def final(whole: np.ndarray) -> np.ndarray:
    """The state in which each conversation should end."""
    after = np.array([0, *(INSERT * len(ending(s)) for s in STATES[1:])])
    return (whole[:, 0, 1:] + after[1:]).argmin(1) + 1


_PLACED = "conv_id long, turn long, role string, text string, slice int, pos long, i long, lead boolean"


def _placed(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with pos: each one's place in its conversation, from 0; a written table.

    Slices of the sorted rows are numbered each by itself. Of a slice's conversations only the first can have begun
    before, so one number for each slice shifts that one's places.
    """
    spark = turns.sparkSession
    turns = turns.withColumn("at", F.coalesce("turn", F.lit(-1)))
    head = [F.substring(c, 1, PREFIX) for c in ("role", "text")]
    slices = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = turns.repartitionByRange(slices, "conv_id", "at", *head).sortWithinPartitions("conv_id", "at", "role", "text", "turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen, first, done = None, 0, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("conv_id")
            none = ids.is_null().to_numpy(zero_copy_only=False)
            value = ids.fill_null(0).to_numpy(zero_copy_only=False)
            if first is None:
                first = before = (bool(none[0]), int(value[0]))
            new = np.append((bool(none[0]), int(value[0])) != before, (none[1:] != none[:-1]) | (value[1:] != value[:-1]))
            start = np.flatnonzero(new)
            at = np.arange(b.num_rows)
            run_ = np.searchsorted(start, at, "right")  # 0: goes on from the batch before
            pos = np.where(run_ > 0, at - np.append(0, start)[run_], at + seen)
            before, seen = (bool(none[-1]), int(value[-1])), int(pos[-1]) + 1
            lead = (none == first[0]) & (value == first[1])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "turn", "role", "text", "slice")], pa.array(pos), pa.array(at + done), pa.array(lead)], names=[x.split()[0] for x in _PLACED.split(", ")])
            done += b.num_rows

    local = keep(ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("slice")).mapInArrow(lean(run), _PLACED))
    ends = local.groupBy("slice").agg(F.min_by(F.struct("conv_id"), "i").alias("first"), F.max_by(F.struct("conv_id", "pos"), "i").alias("last"))
    shift, before, count = {}, None, 0
    for r in sorted(ends.collect(), key=lambda r: r["slice"]):
        first, last = r["first"]["conv_id"], r["last"]["conv_id"]
        if before is not None and first == before[0]:
            shift[r["slice"]] = count
        count = r["last"]["pos"] + 1 + (shift.get(r["slice"], 0) if first == last else 0)
        before = (last,)
    if not shift:
        return local
    by = F.element_at(F.create_map(*[F.lit(x) for pair in shift.items() for x in pair]).cast("map<int,long>"), F.col("slice"))
    return local.withColumn("pos", F.col("pos") + F.when(F.col("lead"), F.coalesce(by, F.lit(0))).otherwise(0))


_PART = "conv_id long, part long, costs array<long>"


def _tables(turns: DataFrame) -> DataFrame:
    """_PART: the table of each chunk, from its roles in order."""
    turn = F.struct("pos", "role")
    chunks = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", "part", F.transform("turns", lambda t: t["role"]).alias("roles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column("roles")
            yield _part(b, products(SINGLE[codes(roles.flatten())], _offsets(roles)))

    return chunks.mapInArrow(lean(run), _PART)


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each row's entries start in the flattened column, with the end behind."""
    return np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)


def _part(b: pa.RecordBatch, tables: np.ndarray) -> pa.RecordBatch:
    """_PART of a batch's conv_id and part."""
    at = np.arange(len(tables) + 1, dtype=np.int32) * np.int32(len(STATES) ** 2)
    return pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("part"), pa.ListArray.from_arrays(pa.array(at), pa.array(tables.ravel()))], names=["conv_id", "part", "costs"])


def _square(parts: pa.Array) -> np.ndarray:
    """The tables of a column of parts, one behind the other."""
    return parts.flatten().field("costs").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATES), len(STATES))


def _above():
    """The next level's part."""
    return F.expr(f"part div {FAN}")


def _grouped(parts: DataFrame, more: list[str]) -> DataFrame:
    """Parts that meet in one of the next level, in order: conv_id, part (the next level's), parts."""
    return parts.groupBy("conv_id", _above().alias("up")).agg(F.array_sort(F.collect_list(F.struct("part", *more))).alias("parts")).withColumnRenamed("up", "part")


def _up(parts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _part(b, products(_square(b.column("parts")), _offsets(b.column("parts"))))

    return _grouped(parts, ["costs"]).mapInArrow(lean(run), _PART)


_BORDERS = "conv_id long, part long, first int, last int, head boolean, tail boolean"


def _down(parts: DataFrame, borders: DataFrame | None) -> DataFrame:
    """_BORDERS for ``parts``: the states before and after each, and whether it is its conversation's first and last;
    ``borders`` are the next level's (none above the top, where there is one group per conversation)."""
    groups, top = _grouped(parts, ["costs"]), borders is None
    if top:
        groups = groups.select("conv_id", "parts", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(True).alias("head"), F.lit(True).alias("tail"))
    else:
        up = borders.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", "last", "head", "tail")
        groups = groups.join(up, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "parts", "first", "last", "head", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables, at = _square(b.column("parts")), _offsets(b.column("parts"))
            if top:
                first, last = np.zeros(len(at) - 1, np.int64), final(products(tables, at))
            else:
                first, last = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
            after, owner = paths(tables, at, first, last), np.repeat(np.arange(len(at) - 1), np.diff(at))
            lead, end = np.zeros(len(after), bool), np.zeros(len(after), bool)
            lead[at[:-1]], end[at[1:] - 1] = True, True
            before = np.where(lead, first[owner], np.append(0, after[:-1]))
            flag = lambda c: b.column(c).to_numpy(zero_copy_only=False)[owner]  # noqa: B023,E731
            cols = [b.column("conv_id").take(pa.array(owner)), b.column("parts").flatten().field("part"), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32)), pa.array(flag("head") & lead), pa.array(flag("tail") & end)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "part", "first", "last", "head", "tail"])

    return groups.mapInArrow(lean(run), _BORDERS)


def _borders(parts: DataFrame) -> DataFrame:
    levels = [parts]
    while not levels[-1].groupBy("conv_id").agg(F.min(_above()).alias("a"), F.max(_above()).alias("b")).where("a < b").isEmpty():
        levels.append(keep(_up(levels[-1])))
    borders = None
    for level in reversed(levels):
        borders = keep(_down(level, borders))
    drop(*levels[1:])
    return borders


def written(role: str, text: str) -> str:
    return f"{OPEN}{role}\n{text}"


def render(roles: list[str | None], texts: list[str], states: list[int], first: int, head: bool, tail: bool) -> list[tuple]:
    """(new role, merged, inserted before, inserted behind, cost, piece) for each turn of a chunk; ``states``: after each."""
    out, state = [], STATES[first]
    for i, (role, text, to) in enumerate(zip(roles, texts, states, strict=True)):
        now = STATES[to]
        cost, merged, before = move(state, role, now)
        opened = not (head and i == 0)  # a turn before this one is still open
        if merged:
            piece = "\n" + text
        else:
            piece = (CLOSE if opened else "") + "".join(written(r, "") + CLOSE for r in before) + written(now, text)
        behind: tuple[str, ...] = ()
        if tail and i == len(roles) - 1:
            behind = ending(now)
            cost += INSERT * len(behind)
            piece += CLOSE + "".join(written(r, "") + CLOSE for r in behind)
        out.append((now, merged, ",".join(before), ",".join(behind), cost, piece))
        state = now
    return out


REPAIRED = "conv_id long, turn long, role string, new_role string, merged boolean, inserted string, appended string, cost long, piece string"


def repair(conversations: DataFrame) -> DataFrame:
    """A row of REPAIRED for each row of ``conversations`` (conv_id, turn, role, text).

    inserted, appended: roles of empty turns before this turn, and behind the last one, comma-joined.
    """
    workers(conversations.sparkSession)
    turns = only(conversations, conv_id="long", turn="long", role="string", text="string")
    turns = _placed(turns.withColumn("text", F.coalesce("text", F.lit("")))).withColumn("part", F.expr(f"pos div {CHUNK}"))
    parts = keep(_tables(turns))
    borders = _borders(parts).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", "last", "head", "tail")
    drop(parts)
    turn = F.struct("pos", "role", "text", "turn")
    chunks = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    known = chunks.join(borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "turns", "first", "last", "head", "tail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                rows, some = [], b.slice(at, 200)
                turns, cut = some.column("turns"), _offsets(some.column("turns"))
                ends = [some.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last")]
                states = paths(SINGLE[codes(turns.flatten().field("role"))], cut, *ends).tolist()
                for g, x, y in zip(some.to_pylist(), cut, cut[1:], strict=False):
                    done = render([t["role"] for t in g["turns"]], [t["text"] for t in g["turns"]], states[x:y], g["first"], g["head"], g["tail"])
                    rows += [(g["conv_id"], t["turn"], t["role"], *d) for t, d in zip(g["turns"], done, strict=True)]
                names = [x.split()[0] for x in REPAIRED.split(", ")]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return known.mapInArrow(lean(run), REPAIRED)
