"""Sum-of-squares online packing of token documents into windows.

Each task packs the documents of its own partition as they come. Whole windows of a long document stand alone; what
is left of it goes to the fill level that makes the sum of squared counts of partially filled windows least, kept in
an array of counts by level (ties: the fullest). Texts are tokenized once. Windows still open at the end of a partition, or
when ``MOST_OPEN`` are open (which bounds memory), are taken apart again: their pieces, with their token ids, meet in
second streams of about ``STREAM`` tokens, of however many partitions that takes, and are packed by the same rule. What is
still open at the end of a second stream is packed by that rule once more, with levels counted in ever larger units
(``LEVELS``) and cuts allowed: a piece may go to any window, fills it, and its end is placed on. So hardly more windows
stay open than there are levels. The few that the last, two levels leave are run together and cut at window length, the
very last part into powers of two, which need no padding. Column ``run_together`` marks those sequences.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each by itself; sequence ids are
unique (partition number times 2**40, counted on from there; those of second streams over 2**62); other columns play no part.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import keep, lean, only, workers

WINDOW = 4096
END_ID = 2
MOST_OPEN = 2048
STREAM = 1 << 24
#: Numbers of levels by which what is open at the end is packed again.
LEVELS = (64, 8, 2)
CACHED_WORDS = 250_000
SLICE = 2 << 20

_LETTERS = "a-zß-öø-ÿ"
_SPACE = " \\t\\n\\r\\x0b\\x0c"
#: Texts of these characters alone can be lower-cased and cut between letters and others without changing any id.
_PLAIN = re.compile("[\\x00-\\x7fÀ-ÖØ-öø-ÿ]*")
_PARTS = re.compile(f"[{_LETTERS}]+|[^{_SPACE}{_LETTERS}]+")
_PARTS_QUOTED = re.compile(f"[^{_SPACE}']*'[^{_SPACE}]*|[{_LETTERS}]+|[^{_SPACE}{_LETTERS}]+")
_WORD = re.compile(f"[{_LETTERS}]+")
_CHUNKS = re.compile(f"[^{_SPACE}]+")


def parts(text: str) -> list[str]:
    """Pieces whose token ids, strung together, are the text's (for a tokenizer that lower-cases, drops white space
    and never joins letters with others, apostrophes aside)."""
    if "<|" in text or not _PLAIN.fullmatch(text):
        return _CHUNKS.findall(text)
    return (_PARTS_QUOTED if "'" in text else _PARTS).findall(text.lower())


class _Places(dict):
    """A number for each piece, in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


#: Texts by which a tokenizer shows whether pieces can be tokenized by themselves.
_SHOWN = ("Hello, World's caf\u00e9 12.5 don't re-use A.B x_1", "a  b\n\tc UPPER Lower\u00c0 \u00fcber-\u00e9t\u00e9!?", " lead and trail ", "#x @y 'quoted' it's \"so\"")


class Ids:
    """Token ids of texts, by a bounded cache of their pieces' ids. A tokenizer whose ids are not those of its texts'
    pieces strung together (one that keeps case or white space, say) gets whole texts."""

    def __init__(self, path: str, most: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._clear()
        self.whole = False
        with_pieces = [x.tolist() for x in self.of(list(_SHOWN))]
        self.whole = with_pieces != [self.tokenizer.encode(t, add_special_tokens=False).ids for t in _SHOWN]

    def _clear(self) -> None:
        self.place = _Places()
        self.table = np.zeros(0, self.kind)
        self.start = self.size = np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        """Append the ids of new pieces: runs of letters as one text, where each is one of the tokenizer's words."""
        size, ids = np.zeros(len(new), np.int64), [np.zeros(0, self.kind)] * 2
        plain = np.fromiter((_WORD.fullmatch(p) is not None for p in new), bool, len(new))
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        if words := [new[i] for i in order[: plain.sum()]]:
            e = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            size[: len(words)] = np.bincount(np.array([w for w in e.word_ids if w is not None], np.int64), minlength=len(words))[: len(words)]
            ids[0] = np.array(e.ids, self.kind)
        if rest := [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in order[len(words) :]], add_special_tokens=False)]:
            size[len(words) :] = [len(x) for x in rest]
            ids[1] = np.array([x for y in rest for x in y], self.kind)
        start = len(self.table) + np.cumsum(size) - size
        back = np.argsort(order)
        self.start, self.size = np.concatenate([self.start, start[back]]), np.concatenate([self.size, size[back]])
        self.table = np.concatenate([self.table, *ids])

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.whole:
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.place) > self.most:
            self._clear()
        known = len(self.place)
        split = [parts(t) if t else [] for t in texts]
        ends = np.cumsum([0, *map(len, split)])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, ends[-1])
        if len(self.place) > known:
            self._learn(list(islice(self.place, known, None)))
        size = self.size[at]
        to = np.concatenate([[0], np.cumsum(size)])
        ids = self.table[np.repeat(self.start[at] - to[:-1], size) + np.arange(to[-1])]
        cuts = to[ends]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_kept: dict[str, Ids] = {}


def _ids(path: str) -> Ids:
    """One cache in each worker process, which Spark uses for many tasks."""
    if path not in _kept:
        _kept[path] = Ids(path)
    return _kept[path]


class Packer:
    """One task's open windows. ``put``, ``settle`` and ``close`` yield (sequence number, pieces); a piece is (document, start, ids).

    Levels are counted in units of ``unit`` ids. With a unit over one pieces may be cut, so that any window takes any piece.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, unit: int = 1):
        self.window, self.most_open, self.unit = window, most_open, unit
        self.count = np.zeros(window // unit + 1, np.int64)  # partially filled windows by level; none at the last
        self.open: dict[int, list[tuple[int, list]]] = {}  # level: windows as (ids in it, pieces)
        self.n_open = self.sequence = 0

    def _done(self, pieces: list) -> tuple[int, list]:
        self.sequence += 1
        return self.sequence - 1, pieces

    def _keep(self, fill: int, pieces: list) -> None:
        level = fill // self.unit
        self.open.setdefault(level, []).append((fill, pieces))
        self.count[level] += 1
        self.n_open += 1

    def level(self, size: int) -> int:
        """The level (0 without a window there: a new one) where a piece of ``size`` adds least to the sum of squared counts."""
        size //= self.unit
        top = len(self.count) - 1 - size
        here, after = self.count[: top + 1], self.count[size:]
        if self.unit > 1:
            if not size:  # changes no level
                return int(max(np.flatnonzero(self.count), default=0))
            # cut where it does not fit: the window is gone, the rest of the piece counts as a new one
            here, after = self.count[:-1], np.concatenate([after, self.count[1:size]])
        cost = 2 * (after - here) + 2
        cost[top] -= 1  # a full window counts no more
        used = np.flatnonzero(here)
        if not len(used):
            return 0
        best = used[len(used) - 1 - int(np.argmin(cost[used][::-1]))]
        return int(best) if cost[best] <= 2 * self.count[size] + 1 else 0

    def put(self, document, ids: np.ndarray, start: int = 0) -> Iterator[tuple[int, list]]:
        """Take a document's ids, of which ``start`` come before these."""
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            yield self._done([(document, start + at, ids[at : at + self.window])])
        start, rest = start + whole, ids[whole:]
        while len(rest):
            level = self.level(len(rest))
            fill, pieces = 0, []
            if self.count[level]:
                fill, pieces = self.open[level].pop()
                self.count[level] -= 1
                self.n_open -= 1
            part, rest = rest[: self.window - fill], rest[self.window - fill :]
            pieces.append((document, start, part.copy()))
            start, fill = start + len(part), fill + len(part)
            if fill == self.window:
                yield self._done(pieces)
            else:
                self._keep(fill, pieces)

    @property
    def full(self) -> bool:
        return self.n_open > self.most_open

    def take_apart(self) -> list:
        """The pieces of all open windows, which are gone then."""
        pieces = [p for level in sorted(self.open) for _, w in self.open[level] for p in w]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        return pieces

    def settle(self) -> Iterator[tuple[int, list]]:
        """Pack the pieces of open windows again by fewer and fewer levels, with cuts; hardly more than two stay open."""
        for unit in (self.window // n for n in LEVELS):
            if unit < 2:
                continue
            again = Packer(self.window, unit=unit)
            for piece in self.take_apart():
                for _, pieces in again.put(piece[0], piece[2], piece[1]):
                    yield self._done(pieces)
            for windows in again.open.values():
                for fill, pieces in windows:
                    self._keep(fill, pieces)

    def close(self) -> Iterator[tuple[int, list]]:
        """Run the open windows together and cut at window length, the last part into powers of two."""
        pieces = self.take_apart()
        left = sum(len(p[2]) for p in pieces)
        room = want = self._next(left)
        now: list = []
        for document, start, ids in pieces:
            while len(ids):
                part = ids[:room]
                now.append((document, start, part))
                start, ids, room = start + len(part), ids[room:], room - len(part)
                if not room:
                    yield self._done(now)
                    left -= want
                    room = want = self._next(left)
                    now = []

    def _next(self, left: int) -> int:
        return self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, run_together boolean"
#: Pieces of a first stream; those without a sequence wait for a second one, in the order of part and place.
_INNER = PIECES + ", ids array<int>, part int, place long"
_KINDS = [pa.int64()] * 7 + [pa.bool_(), pa.list_(pa.int32()), pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in _INNER.split(", ")]


class _Rows:
    """Rows of _INNER, handed on in batches; ids only where they are asked for or waiting."""

    def __init__(self, ids: bool, base: int, part: int):
        self.ids, self.base, self.part, self.rows, self.place, self.held = ids, base, part, [], 0, 0

    def closed(self, windows: Iterator[tuple[int, list]], together: bool = False) -> None:
        for number, pieces in windows:
            offset = 0
            for (doc, total), start, ids in pieces:
                row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.base + number, offset, together)
                self.rows.append((*row, ids.astype(np.int32) if self.ids else None, None, None))
                self.held += len(ids) if self.ids else 8
                offset += len(ids)

    def waiting(self, pieces: list) -> None:
        for (doc, total), start, ids in pieces:
            self.rows.append((doc, start, len(ids), None, total, None, None, None, ids.astype(np.int32), self.part, self.place))
            self.place += 1
            self.held += len(ids)

    def batches(self, least: int = 1 << 18) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= least:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)
            self.rows, self.held = [], 0


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row per piece (PIECES), with its token ids too where ``ids`` is set.

    ``tokenizer``: path, on every machine, of a tokenizers file.
    """
    if window < 2 or window & (window - 1):
        raise ValueError("window must be a power of two")
    workers(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokens, packer, rows = _ids(tokenizer), Packer(window), _Rows(ids, part << 40, part)
        for whole in batches:
            for b in textnum.slices(whole, "text", SLICE):
                found = tokens.of(b.column("text").to_pylist())
                for doc, got in zip(b.column("doc_id").to_pylist(), found, strict=True):
                    got = np.append(got, got.dtype.type(end_id))
                    rows.closed(packer.put((doc, len(got)), got))
                    if packer.full:
                        rows.waiting(packer.take_apart())
                    yield from rows.batches()
        rows.waiting(packer.take_apart())
        yield from rows.batches(0)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows = Packer(window), _Rows(ids, (1 << 62) + (TaskContext.get().partitionId() << 40), 0)
        for whole in batches:
            lists = whole.column("ids")
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (doc, total, start) in enumerate(zip(*(whole.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start")), strict=True)):
                rows.closed(packer.put((doc, total), values[at[i] : at[i + 1]], start))
                if packer.full:
                    rows.closed(packer.settle())
                yield from rows.batches()
        rows.closed(packer.settle())
        rows.closed(packer.close(), True)
        yield from rows.batches(0)

    # written, so that both reads of it see the same pieces
    packed = keep(only(docs, doc_id="long", text="string").mapInArrow(lean(first), _INNER))
    waiting = packed.where("sequence_id is null")
    streams = -(-(waiting.agg(F.sum("length")).first()[0] or 1) // STREAM)
    again = waiting.repartition(streams).sortWithinPartitions("part", "place").mapInArrow(lean(second), _INNER)
    names = _NAMES[: 8 + ids]
    return packed.where("sequence_id is not null").select(*names).unionAll(again.select(*names))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed token sequences, from ``pack(..., ids=True)``; a group is at most one window."""
    parts_ = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts_, lambda p: p["ids"])).alias("ids"))
