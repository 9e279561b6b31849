"""Benchmark decontamination with suffix arrays over the training texts.

Each shard (some megabytes of consecutive training texts) is turned into word numbers and indexed by a suffix array;
every suffix of every benchmark item (those that begin alike together, in sorted order) is binary-searched in it, which yields its longest verbatim match and all places
of it. Shards are built and searched inside one Arrow task each: no text is shuffled, memory is bounded by the shard
(or one long text), and a lost executor costs a repeat of its tasks.

Suffixes that share a window share a range of the array, and ranges of one window length are equal or disjoint, so each
distinct range is gone through once: work and memory are bounded by the shard, not by how often items repeat it. Items
that share ranges are kept as sets of items, and a document's items are the union of its sets. How far each place of a
text matches any test suffix (``longest``) falls out of how many of the nested ranges cover it.

The suffix array leaves out suffixes that cannot match: those at a word that no item has, or in a run of known words
shorter than the shortest window; and of the benchmark's suffixes only those are searched whose first words (as many as the
shortest window has) are somewhere in the shard, so what a shard costs hangs on what it holds, and a clean one is not even indexed.

The benchmark is sent to the tasks in blocks of ``BLOCK_CHARS`` characters at most (one longer item stands alone). Each block
but the last is a pass that writes findings alone, by the digests of the texts that are hit; they join the last pass, and
no pass writes texts.

Defined cases: null or wordless texts have no words and no hits, longest 0 and longest_at null; a null or wordless item never occurs; repeated rows
are judged each by itself; items that share an id count once; other columns of either table play no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textnum
from .common import drop, keep, lean, numbered, only, workers

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_CHARS = 16 << 20


@dataclass
class Tests:
    """A block of items as word numbers: ``vocabulary`` sorted, ``words`` as ids from 1, 0 behind each item."""

    ids: list[str]
    vocabulary: np.ndarray
    words: np.ndarray
    suffix: np.ndarray  # where each suffix starts in words
    item: np.ndarray  # whose it is
    left: np.ndarray  # words from there to the item's end
    window: np.ndarray  # length of the window that starts there; 0 where none does
    group: np.ndarray  # which set of items has the window that starts there; -1 where none does
    sets: list[np.ndarray]  # the items of each set
    order: np.ndarray  # suffixes in order
    shared: np.ndarray  # how many words each has in common with the one before in that order (-1: the first)
    least: int = 0  # words of the shortest window, of all blocks
    alone: bool = True  # whether this is the only block
    grams: np.ndarray | None = None  # sorted numbers of the suffixes' first ``least`` words, and whose each is
    owner: np.ndarray | None = None
    seen: np.ndarray | None = None  # a table of which grams there may be
    rank: np.ndarray | None = None  # each suffix's place in the order


def prepare(rows: list[tuple[str, str | None]], window: int = WINDOW, least: int | None = None) -> Tests:
    """``rows`` (id, text) as tests; ``least``: words of the shortest window where there are more blocks than this."""
    number, at = textnum.words(pa.array([t for _, t in rows], pa.string()), textnum.ALNUM)
    count = np.diff(at)
    vocabulary, ids = np.unique(number, return_inverse=True)
    item = np.repeat(np.arange(len(rows)), count)
    suffix = np.arange(len(number)) + item
    words = np.zeros(len(number) + len(rows), np.int64)
    words[suffix] = ids + 1
    left = at[1:][item] - np.arange(len(number))
    whole = np.minimum(window, count)[item]
    size = np.where(left >= whole, whole, 0)
    group, sets = _sets(words, suffix, item, size)
    place = SuffixArray(words, int(left.max()) if len(left) else 1).order
    order = place - np.searchsorted(np.flatnonzero(words == 0), place)  # without the 0 behind each item before
    shared = np.zeros(len(order), np.int64)
    same = np.arange(1, len(order))
    while len(same):
        depth = shared[same]
        a, b = order[same - 1], order[same]
        same = same[(left[a] > depth) & (left[b] > depth) & (words[suffix[a] + depth] == words[suffix[b] + depth])]
        shared[same] += 1
    shared[:1] = -1
    tests = Tests([str(i) for i, _ in rows], vocabulary, words, suffix, item, left, size, group, sets, order, shared)
    if size.any():
        tests.least, tests.alone = least or int(size[size > 0].min()), least is None
        whole = np.flatnonzero(left >= tests.least)
        number = _grams(words, suffix[whole], tests.least)
        by = np.argsort(number, kind="stable")
        tests.grams, tests.owner = number[by], whole[by]
        tests.seen = np.zeros(1 << min(24, max(10, (8 * len(whole)).bit_length())), bool)
        tests.seen[(number & textnum.U(len(tests.seen) - 1)).astype(np.int64)] = True
        tests.rank = np.empty(len(order), np.int64)
        tests.rank[order] = np.arange(len(order))
    return tests


def _grams(words: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """A number for the ``n`` words from each start on."""
    out = np.zeros(len(start), textnum.U)
    for j in range(n):
        out = textnum.mix(out * textnum.U(0xD6E8FEB86659FD93) + words[start + j].astype(textnum.U))
    return out


def _within(tests: Tests, text: np.ndarray) -> Tests | None:
    """The tests with those suffixes alone whose first words are in ``text`` (0 between runs of known words); None for none.

    No other can be found there: a match of fewer words is no window, and no longest match of a text that is hit.
    """
    if tests.grams is None:
        return None
    ends = np.append(np.flatnonzero(text == 0), len(text))
    starts = np.append(-1, ends[:-1]) + 1
    spot, _ = _ranges(starts, np.maximum(ends - tests.least + 1, starts))
    number = _grams(text, spot, tests.least)
    number = np.unique(number[tests.seen[(number & textnum.U(len(tests.seen) - 1)).astype(np.int64)]])
    place, _ = _ranges(np.searchsorted(tests.grams, number), np.searchsorted(tests.grams, number, "right"))
    if not len(place):
        return None
    pick = np.sort(tests.owner[place])
    at = np.sort(tests.rank[pick])
    # what two have in common is the least that any between them have
    shared = np.append(-1, np.minimum.reduceat(tests.shared[: at[-1] + 1], at[:-1] + 1) if len(at) > 1 else [])
    order = np.searchsorted(pick, tests.order[at])
    return Tests(tests.ids, tests.vocabulary, tests.words, tests.suffix[pick], tests.item[pick], tests.left[pick], tests.window[pick], tests.group[pick], tests.sets, order, shared.astype(np.int64), tests.least, tests.alone)


def _sets(words: np.ndarray, suffix: np.ndarray, item: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(each suffix's set of items, or -1; the sets): windows that occur in the same items have one set."""
    group, start = np.full(len(suffix), -1), np.flatnonzero(size)
    if not len(start):
        return group, []
    rank, most = np.zeros(len(start), np.int64), int(size.max())
    for j in range(most):  # equal windows get one rank
        word = np.where(size[start] > j, words[np.minimum(suffix[start] + j, len(words) - 1)], 0)
        rank = np.unique(rank * (int(words.max()) + 1) + word, return_inverse=True)[1]
    pair = np.unique(rank * (int(item.max()) + 1) + item[start])
    of, who = pair // (int(item.max()) + 1), pair % (int(item.max()) + 1)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    known: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    number = np.zeros(len(first), np.int64)
    for i, (a, b) in enumerate(zip(first, np.append(first[1:], len(of)), strict=True)):
        number[i] = known.setdefault(who[a:b].tobytes(), len(sets))
        if number[i] == len(sets):
            sets.append(who[a:b])
    group[start] = number[rank]
    return group, sets


class SuffixArray:
    """Suffixes of a text of word ids (0 ends a run), sorted by their first ``depth`` words at least."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        ends = np.flatnonzero(text == 0)
        self.text = np.append(text, 0)
        self.left = np.append(ends, n)[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        rank, step = text.astype(np.int64), 1
        while step < depth and n:
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(self.left > step)
            after[inside] = rank[inside + step]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
            rank[text == 0] = 0
            step *= 2
        order = np.argsort(rank, kind="stable")
        self.order = order[text[order] > 0]

    def narrow(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges whose suffixes have ``word`` after ``depth`` words, by binary search."""
        ends = []
        for more in (0, 1):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) // 2
                place = self.order[np.minimum(mid, len(self.order) - 1)] + depth
                right = open_ & (self.text[np.minimum(place, len(self.text) - 1)] < word + more)
                a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
            ends.append(a)
        return ends[0], ends[1]


def search(text: np.ndarray, tests: Tests) -> dict[str, np.ndarray]:
    """For every test suffix: the range of window occurrences and of its longest match in ``places`` (of ``text``), the
    suffixes of the index in order; and for each of those how many words of it some test suffix starts with."""
    n = len(tests.suffix)
    shortest, widest = tests.least, int(tests.window.max())
    ends = np.append(np.flatnonzero(text == 0), len(text))
    starts = np.append(-1, ends[:-1]) + 1
    run = np.flatnonzero(ends - starts >= shortest)
    length = ends[run] - starts[run]
    # the runs that may hold a window, one 0 behind each
    base = np.cumsum(length + 1) - length - 1
    total = int((length + 1).sum())
    spot = np.arange(total) - np.repeat(base - starts[run], length + 1)
    kept = np.where(np.arange(total) == np.repeat(base + length, length + 1), 0, np.append(text, 0)[spot])
    index = SuffixArray(kept, int(tests.left.max()))
    window_low, window_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, best_low, best_high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    change = np.zeros(len(index.order) + 1, np.int64)
    by_end, by_split = _at(tests.left[tests.order]), _at(tests.shared)
    # runs of sorted suffixes that share their first ``depth`` words, and where those are in the index
    lo, hi, low, high, depth = np.zeros(1, np.int64), np.full(1, n), np.zeros(1, np.int64), np.full(1, len(index.order)), 0

    def settle(run: np.ndarray, owner: np.ndarray) -> None:
        who = tests.order[run]
        longest[who], best_low[who], best_high[who] = depth, low[owner], high[owner]

    while len(lo):
        ended = by_end(depth)  # these come first in their runs
        first, last = np.searchsorted(ended, lo), np.searchsorted(ended, hi)
        settle(*_pick(ended, first, last))
        lo = lo + last - first
        split = by_split(depth)
        first, last = np.searchsorted(split, lo, "right"), np.searchsorted(split, hi)
        some = np.flatnonzero(lo < hi)
        cut, owner = _pick(split, first[some], last[some])
        start, owner = np.concatenate([lo[some], cut]), np.concatenate([some, some[owner]])
        place = np.argsort(start)
        start, owner = start[place], owner[place]
        end = np.minimum(np.append(start[1:], n), hi[owner])
        a, b = index.narrow(low[owner], high[owner], depth, tests.words[tests.suffix[tests.order[start]] + depth])
        dead = b <= a
        if depth:
            run, whose = _ranges(start[dead], end[dead])
            settle(run, owner[dead][whose])
        lo, hi, low, high = start[~dead], end[~dead], a[~dead], b[~dead]
        depth += 1
        change[low] += 1  # ranges of one depth are disjoint
        change[high] -= 1
        if depth <= widest:
            run, whose = _ranges(lo, hi)
            who = tests.order[run]
            here = tests.window[who] == depth
            window_low[who[here]], window_high[who[here]] = low[whose[here]], high[whose[here]]
    return {"places": spot[index.order], "low": window_low, "high": window_high, "longest": longest, "best_low": best_low, "best_high": best_high, "match": np.cumsum(change[:-1])}


def _at(value: np.ndarray):
    """A function that gives the places of a value, in order."""
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    return lambda v: order[np.searchsorted(ranked, v) : np.searchsorted(ranked, v, "right")]


def _pick(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values at all places from ``first`` to before ``last`` of each, and whose each is."""
    place, who = _ranges(first, last)
    return values[place], who


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and whose each is."""
    size = high - low
    who = np.repeat(np.arange(len(low)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + low[who], who


def _shard(texts: pa.Array, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray, Tests | None, dict]:
    """(word ids of the shard with a 0 behind each row, the rows' starts in it, their word counts, the tests that may be there, search
    results)."""
    number, at = textnum.words(texts, textnum.ALNUM)
    count = np.diff(at)
    spot = np.minimum(np.searchsorted(tests.vocabulary, number), len(tests.vocabulary) - 1)
    ids = np.where(tests.vocabulary[spot] == number, spot + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    text = np.zeros(len(number) + len(count), np.int64)
    text[np.arange(len(number)) + row] = ids
    some = _within(tests, text)
    return text, at[:-1] + np.arange(len(count)), count, some, search(text, some) if some else {}


@dataclass
class Found:
    """What is known of one row: ranges of hit words, item ids, the longest match and where it starts."""

    hits: list[tuple[int, int]]
    items: set[str]
    longest: int
    at: int | None


def _judge(texts: pa.Array, tests: Tests, rows: dict[int, Found]) -> np.ndarray:
    """Add this block's findings to ``rows`` (those with a hit alone); returns the rows' word counts."""
    if not len(tests.suffix):
        return np.diff(textnum.words(texts, textnum.ALNUM)[1])
    text, start, count, tests, found = _shard(texts, tests)
    if not found:
        return count
    some = np.flatnonzero(found["high"] > found["low"])
    # each distinct range once: suffixes with one range have one window, and so one set of items
    some = some[np.unique(np.stack([tests.window[some], found["low"][some]]), axis=1, return_index=True)[1]]
    place, who = _ranges(found["low"][some], found["high"][some])
    place, size, group = found["places"][place], tests.window[some][who], tests.group[some][who]
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + size, -1)
    hit = np.append(np.cumsum(change[:-1]) > 0, False)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    row = np.searchsorted(start, first, "right") - 1
    for r, a, b in zip(row.tolist(), (first - start[row]).tolist(), (last - start[row]).tolist(), strict=True):
        rows.setdefault(r, Found([], set(), 0, None)).hits.append((a, b))
    pair = np.unique((np.searchsorted(start, place, "right") - 1) * len(tests.sets) + group)
    of, group = pair // max(1, len(tests.sets)), pair % max(1, len(tests.sets))
    cut = np.append(np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64), len(of))
    for a, b in zip(cut, cut[1:], strict=False):
        mine = np.unique(np.concatenate([tests.sets[g] for g in group[a:b]]))
        rows[int(of[a])].items.update(tests.ids[i] for i in mine)
    # the longest match of each such row, the first of equals
    row = np.searchsorted(start, found["places"], "right") - 1
    order = np.lexsort((found["places"], -found["match"], row))
    of = row[order]
    for i in order[np.append(True, of[1:] != of[:-1])] if len(order) else order:
        if not tests.alone and found["match"][i] >= tests.least:  # another block may hit it
            rows.setdefault(int(row[i]), Found([], set(), 0, None))
        if (mine := rows.get(int(row[i]))) is not None:
            longest, at = int(found["match"][i]), int(found["places"][i] - start[row[i]])
            if longest > mine.longest or longest == mine.longest and at < mine.at:
                mine.longest, mine.at = longest, at
    return count


def _union(ranges: list[tuple[int, int]]) -> int:
    total = to = 0
    for a, b in sorted(ranges):
        total += max(0, b - max(a, to))
        to = max(to, b)
    return total


_STATE = {"_hits": "array<array<long>>", "_items": "array<string>", "_longest": "long", "_at": "long"}
RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean", "longest": "long", "longest_at": "long"}


def _findings(tests):
    """A pass of a block but the last: the digest and what is found of each text that is hit, or may be by another block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("_text", pa.string()), ("_hits", pa.list_(pa.list_(pa.int64()))), ("_items", pa.list_(pa.string())), ("_longest", pa.int64()), ("_at", pa.int64())])
        for whole in batches:
            for b in textnum.slices(whole, "text", SHARD_BYTES):
                rows: dict[int, Found] = {}
                _judge(b.column("text"), tests.value, rows)
                if rows:
                    texts = b.column("text").take(pa.array(sorted(rows))).to_pylist()
                    each = [rows[i] for i in sorted(rows)]
                    cols = [[hashlib.md5(t.encode()).hexdigest() for t in texts], [[list(x) for x in r.hits] for r in each], [sorted(r.items) for r in each], [r.longest for r in each], [r.at for r in each]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _final(tests, names: list[str], schema: pa.Schema):
    """The last block's pass: RESULT behind the rows' own columns, with what other blocks have found where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = Found([], set(), 0, None)
        for whole in batches:
            for b in textnum.slices(whole, "text", SHARD_BYTES):
                rows: dict[int, Found] = {}
                if "_hits" in b.schema.names:
                    for i, (h, items, longest, at) in enumerate(zip(*(b.column(c).to_pylist() for c in _STATE), strict=True)):
                        if longest:
                            rows[i] = Found([tuple(x) for x in h], set(items), longest, at)
                count = _judge(b.column("text"), tests.value, rows)
                each = [rows.get(i, nothing) for i in range(b.num_rows)]
                n_hit = [_union(r.hits) for r in each]
                digests = [hashlib.sha256(",".join(sorted(r.items)).encode()).hexdigest() for r in each]
                more = [count.tolist(), n_hit, [len(r.items) for r in each], digests, [x > 0 for x in n_hit], [r.longest if x else 0 for x, r in zip(n_hit, each, strict=True)], [r.at if x else None for x, r in zip(n_hit, each, strict=True)]]
                cols = [b.column(n) for n in names] + [pa.array(x, f.type) for x, f in zip(more, list(schema)[len(names) :], strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Tests]:
    """The items in blocks of bounded size, read by the driver one block at a time."""
    items = only(benchmark, item_id="string", text="string").where("text is not null").withColumn("_n", F.length("text"))
    total = items.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts, least = max(1, -(-2 * total // BLOCK_CHARS)), None
    if parts > 1:
        words = F.size(F.regexp_extract_all("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"), 0))
        least = items.where(words > 0).agg(F.least(F.min(words), F.lit(window))).first()[0]
    for k in range(parts):
        rows, chars = [], 0
        for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).toLocalIterator():
            if rows and chars + r["_n"] > BLOCK_CHARS:
                yield prepare(rows, window, least)
                rows, chars = [], 0
            rows.append((r["item_id"], r["text"]))
            chars += r["_n"]
        if rows or k == 0 and total == 0:
            yield prepare(rows, window, least)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs``, one row for one, with the columns of RESULT behind its own (which it must not have already).

    longest, longest_at: of a document that is hit, the most consecutive words that an item has too, and at which of its
    words (from 0) they first start.
    """
    spark, names = docs.sparkSession, docs.columns
    workers(spark)
    schema = docs.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(k).alias(c) for c, k in RESULT.items()]).schema
    blocks = iter(_blocks(benchmark, window))
    block, found = next(blocks), []
    while (after := next(blocks, None)) is not None:
        shared, kinds = spark.sparkContext.broadcast(block), ", ".join(f"{c} {k}" for c, k in _STATE.items())
        # equal texts have equal findings
        found.append(keep(docs.select("text").mapInArrow(lean(_findings(shared)), f"_text string, {kinds}").dropDuplicates(["_text"])))
        shared.destroy()
        block = after
    if found:
        best = F.max(F.struct("_longest", (-F.col("_at")).alias("at")))
        each = functools.reduce(DataFrame.unionAll, found).groupBy("_text")
        all_ = keep(each.agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"), best.alias("_best")))
        drop(*found)
        joined = docs.withColumn("_md5", F.md5(F.col("text").cast("binary"))).join(all_, F.col("_md5") == F.col("_text"), "left")
        docs = joined.select(*[F.col(f"`{c}`") for c in names], "_hits", "_items", F.col("_best._longest").alias("_longest"), (-F.col("_best.at")).alias("_at"))
    return docs.mapInArrow(lean(_final(spark.sparkContext.broadcast(block), names, to_arrow_schema(schema))), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; its columns stay as they are."""
    plain = numbered(docs, "text")
    return contamination(plain, benchmark, window).where("not contaminated").select(*plain.columns).toDF(*docs.columns)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches of a window's length at least: item_id, item_start, doc_id, doc_start, length (words).

    One row for each place in each shard where a test suffix has its longest match there: as many as the repeats of
    texts and items multiply to, streamed out, so this is for inspection.
    """
    workers(docs.sparkSession)
    out = None
    for block in _blocks(benchmark, window):
        tests = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, tests=tests):
            t = tests.value
            for whole in batches:
                for b in textnum.slices(whole, "text", SHARD_BYTES):
                    if not len(t.suffix):
                        continue
                    _, start, _, t, found = _shard(b.column("text"), tests.value)
                    if not found:
                        continue
                    good = (t.window > 0) & (found["longest"] >= t.window)
                    place, who = _ranges(np.where(good, found["best_low"], 0), np.where(good, found["best_high"], 0))
                    place = found["places"][place]
                    row = np.searchsorted(start, place, "right") - 1
                    begin = np.searchsorted(tests.value.item, t.item)  # each suffix's item's first suffix
                    nth = t.suffix - tests.value.suffix[begin]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t.ids[i] for i in t.item[who]], pa.string()), pa.array(nth[who]), b.column("doc_id").take(pa.array(row)), pa.array(place - start[row]), pa.array(found["longest"][who])],
                        names=["item_id", "item_start", "doc_id", "doc_start", "length"],
                    )

        part = only(docs, doc_id="long", text="string").mapInArrow(lean(run), "item_id string, item_start long, doc_id long, doc_start long, length long")
        out = part if out is None else out.unionAll(part)
    return out
