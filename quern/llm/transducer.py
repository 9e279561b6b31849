"""A byte-level BPE tokenizer compiled to two deterministic transducers that count tokens.

The first reads characters by their class and says where pieces begin (words with their leading space, runs of digits, of other
signs, of white space, and English contractions). It has eleven states, so what a chunk of bytes does to each of them is a
short map; maps of chunks are composed by a parallel prefix scan, which gives each chunk its true first state, however long a
text is, and then all chunks are read side by side.

The second reads the bytes of a piece. Its state says which vocabulary entries may still be running, and for each place where
one began, the last token before it and how the number of tokens there compares with the number here. The next byte ends exactly one
entry that can stand behind the token before it (two tokens can stand side by side just where merging their bytes gives them back),
so each transition carries the change in the number of tokens, and a piece's count is the sum over its transitions.
States and transitions are made when they are first met and kept in a hash table; when it is full all are made anew, which
changes no result. Pieces are read side by side; those of over CHUNK bytes are cut into chunks, whose maps are evaluated at the first
states that are reached: guessed from the bytes before, corrected where the chunk before ends otherwise.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np

CHUNK, PART = 64, 512
#: Transitions held at most: some 100 MB with their states.
MOST = 400_000

OTHER, LETTER, DIGIT, SPACE, WHITE, QUOTE, ONE, WITH_E, WITH_L, E, INNER = range(11)
_LETTERS = (LETTER, ONE, WITH_E, WITH_L, E)
START, WORD, NUMBER, SIGNS, BLANK, GAP, BLANKS, GAPS, QUOTED, QUOTED_E, QUOTED_L = range(11)
HERE, BEFORE = 1, 2  # a piece begins at this character, at the one before
# The contractions that are pieces of their own, by their letters.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _fresh(kind: int) -> int:
    return {OTHER: SIGNS, DIGIT: NUMBER, SPACE: BLANK, WHITE: GAP, QUOTE: QUOTED}.get(kind, WORD)


def _step(state: int, kind: int) -> tuple[int, int]:
    """(next state, where pieces begin) at a character of this class."""
    letter, sign = kind in _LETTERS, kind in (OTHER, QUOTE)
    if kind == INNER:
        return state, 0
    run = WORD if letter else NUMBER if kind == DIGIT else SIGNS if sign else None
    if state in (BLANK, GAP, BLANKS, GAPS):
        if run is None:
            return BLANKS if kind == SPACE else GAPS, 0
        # the last of several blanks is no part of their run; a space goes with what follows
        if state in (BLANK, BLANKS):
            return run, BEFORE if state == BLANKS else 0
        return _fresh(kind), HERE | (BEFORE if state == GAPS else 0)
    if state == QUOTED:
        if kind in (ONE, WITH_E, WITH_L):
            return {ONE: START, WITH_E: QUOTED_E, WITH_L: QUOTED_L}[kind], 0
        return (SIGNS, 0) if sign else (_fresh(kind), HERE)
    if state in (QUOTED_E, QUOTED_L):
        if kind == (E if state == QUOTED_E else WITH_L):
            return START, 0
        return (WORD, BEFORE) if letter else (_fresh(kind), HERE | BEFORE)
    return (state, 0) if run is not None and state == run else (_fresh(kind), HERE)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by state and class; classes from 11 on are those of a text's first character."""
    to, mark = np.zeros((2, 11, 22), np.uint8)
    for s in range(11):
        for k in range(11):
            to[s, k], mark[s, k] = _step(s, k)
            to[s, k + 11], mark[s, k + 11] = _fresh(k), HERE | (BEFORE if s in (QUOTED_E, QUOTED_L) else 0)
    return to, mark


_TO, _MARK = _tables()


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of (chunks, states) maps: what all chunks up to each do to each state."""
    maps, far = maps.copy(), 1
    while far < len(maps):
        maps[far:] = np.take_along_axis(maps[far:], maps[:-far], 1)
        far *= 2
    return maps


def _read(state: np.ndarray, columns: np.ndarray, marks: np.ndarray | None = None) -> np.ndarray:
    to, mark = _TO.ravel(), _MARK.ravel()
    for j, kinds in enumerate(columns):
        at = state.astype(np.int16) * np.int16(22) + kinds
        if marks is not None:
            marks[j] = mark[at]
        state = to[at]
    return state


@dataclass
class Vocabulary:
    """What is compiled: entries' bytes by id, merges as (left, right, made), special tokens, and ranges of character classes."""

    tokens: list[bytes]
    merges: list[tuple[int, int, int]]
    special: list[bytes]
    ranges: list[tuple[int, int, int]]  # first, end, class


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as the character of its number where that is visible, others as the next from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges() -> list[tuple[int, int, int]]:
    """Runs of letters, digits and white space among all characters, as the tokenizer library's own expressions see them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    text, out = "".join(map(chr, codes)), []
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (WHITE, r"\s+")):
        inside = re.compile("A" if kind == LETTER else "7" if kind == DIGIT else "\t")
        for piece, (a, b) in Split(Regex(pattern), "isolated").pre_tokenize_str(text):
            # pieces alternate between runs of the class and others; a known member tells which
            out.append((codes[a], codes[b - 1] + 1, kind, bool(inside.search(piece))))
    runs = []
    for kind in (LETTER, DIGIT, WHITE):
        mine = [r for r in out if r[2] == kind]
        parity = next(i for i, r in enumerate(mine) if r[3]) % 2
        runs += [(a, b, k) for i, (a, b, k, _) in enumerate(mine) if i % 2 == parity]
    return runs


def load(path: str) -> Vocabulary:
    """The vocabulary of a tokenizer file: byte-level BPE without a normalizer, cut by the usual byte-level expression."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    model, pre = d["model"], d.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not d.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    added = d.get("added_tokens", [])
    if not plain or any(odd) or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    letters, special = _byte_letters(), {t["content"] for t in added}
    ids = model["vocab"]
    tokens = [b""] * (max(ids.values()) + 1)
    for text, i in ids.items():
        tokens[i] = b"" if text in special else bytes(letters[c] for c in text)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return Vocabulary(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], [t.encode() for t in sorted(special, key=len, reverse=True)], _ranges())


class Counter:
    """Both transducers of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        kind = np.full(0x110000, OTHER, np.uint8)
        for a, b, k in vocabulary.ranges:
            kind[a:b] = k
        kind[0x20], kind[0x27] = SPACE, QUOTE
        for c in CONTRACTIONS:
            kind[ord(c[0])] = ONE if len(c) == 1 else WITH_E if c[1] == "e" else WITH_L
        kind[ord("e")] = E
        self.kind, self.tokens = kind, vocabulary.tokens
        self.special = re.compile(b"|".join(map(re.escape, vocabulary.special))) if vocabulary.special else None
        self.merge = {(a, b): (rank, made) for rank, (a, b, made) in reversed(list(enumerate(vocabulary.merges)))}
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.ends: dict[int, int] = {}  # node: entry
        inner = set()
        for i, token in enumerate(vocabulary.tokens):
            node = 0
            for b in token:
                inner.add(node)
                node = self.child.setdefault(node << 8 | b, len(self.child) + 1)
            if token:
                self.ends[node] = i
        self.inner = inner
        self.single = {t[0]: i for i, t in enumerate(vocabulary.tokens) if len(t) == 1}
        self.made: dict[int, tuple[int, int, int]] = {}  # entry: rank, left, right
        bytes_ = set(self.single.values())
        for rank, (a, b, made) in enumerate(vocabulary.merges):
            if made in self.made or not all(x in self.made or x in bytes_ for x in (a, b)):
                raise ValueError("an entry is made twice, or of entries made later")
            self.made[made] = rank, a, b
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.alone: dict[int, bool] = {}
        self.side: dict[int, bool] = {}
        self._forget()

    # --- pieces ---------------------------------------------------------------------------------------------------------

    def kinds(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each byte's class: that of the character it begins (plus 11 for a text's first), or INNER."""
        out = self.kind[raw & 0x7F]
        out[(raw & 0xC0) == 0x80] = INNER
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            b = np.concatenate([raw, np.zeros(3, np.uint8)])
            x, y, z, w = (b[lead + i].astype(np.int64) & (0xFF if i == 0 else 0x3F) for i in range(4))
            code = np.where(x < 0xE0, (x & 0x1F) << 6 | y, np.where(x < 0xF0, (x & 0xF) << 12 | y << 6 | z, (x & 7) << 18 | y << 12 | z << 6 | w))
            out[lead] = self.kind[np.minimum(code, 0x10FFFF)]
        out[first] += 11
        return out

    def pieces(self, raw: np.ndarray, first: np.ndarray) -> np.ndarray:
        """First bytes of all pieces; ``first`` has those of all texts (in order, none empty)."""
        n = len(raw)
        kinds = self.kinds(raw, first)
        parts = -(-n // PART)
        columns = np.full((parts, PART), INNER, np.uint8)
        columns.ravel()[:n] = kinds
        columns = np.ascontiguousarray(columns.T)
        # what each chunk does to each state; where all states have met early, one stands for all
        maps = _read(np.repeat(np.arange(11, dtype=np.uint8)[:, None], parts, 1), columns[:32])
        met = (maps == maps[0]).all(0)
        maps[:, met] = _read(maps[0, met], columns[32:, met])
        maps[:, ~met] = _read(maps[:, ~met], columns[32:, ~met])
        upto = compose(np.ascontiguousarray(maps.T))
        entry = np.concatenate([np.zeros(1, np.uint8), upto[:-1, START]])
        marks = np.empty((PART, parts), np.uint8)
        last = _read(entry, columns, marks)[-1]
        marks = np.ascontiguousarray(marks.T).ravel()[:n]
        start = kinds != INNER
        lead = np.flatnonzero(start)
        begins = np.zeros(n, bool)
        begins[(marks & HERE) > 0] = True
        begins[lead[np.searchsorted(lead, np.flatnonzero(marks & BEFORE)) - 1]] = True
        if last in (QUOTED_E, QUOTED_L):
            begins[lead[-1]] = True
        return np.flatnonzero(begins)

    # --- tokens of a piece ----------------------------------------------------------------------------------------------

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a few bytes by merging, best pair first."""
        out = [self.single[b] for b in data]
        while len(out) > 1:
            rank, at = min((self.merge.get((out[i], out[i + 1]), (len(self.merge), 0))[0], i) for i in range(len(out) - 1))
            if rank == len(self.merge):
                break
            out[at : at + 2] = [self.merge[out[at], out[at + 1]][1]]
        return out

    def edge(self, token: int, right: int) -> list[tuple[int, int]]:
        """(entry, rank at which it is merged on) of all that stand at a token's left (right: 0) or right end (1) while it is made."""
        if (known := self.edges.get((token, right))) is None:
            known, at, until = [], token, len(self.merge)
            while True:
                known.append((at, until))
                if at not in self.made:
                    break
                until, *both = self.made[at]
                at = both[right]
            self.edges[token, right] = known
        return known

    def beside(self, a: int, b: int) -> bool:
        """Whether token ``b`` can stand behind ``a`` (-1: first).

        Merges happen by rank, so both are made as if alone unless two entries that stand at the border at the same time merge
        before either is merged on (of equal ranks the left one goes first).
        """
        if (whole := self.alone.get(b)) is None:
            whole = self.alone[b] = self.merged(self.tokens[b]) == [b]
        if a < 0 or not whole:
            return whole
        if (known := self.side.get(a << 32 | b)) is None:
            get = self.merge.get
            known = self.side[a << 32 | b] = not any((m := get((x, y))) and m[0] < until and m[0] <= then for x, until in self.edge(a, 1) for y, then in self.edge(b, 0))
        return known

    def _forget(self) -> None:
        #: The last token, then for each entry that may be running: its node, the token before it, how many tokens there are more there.
        self.states, self.number = [(-1,)], {(-1,): 0}
        self.held, self.size = 0, 1 << 16
        self.keys, self.to, self.change = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
        if len(self.side) > MOST:
            self.side = {}

    def _next(self, key: int) -> tuple[int, int]:
        """(state, change in the number of tokens) of a state and byte."""
        state, byte = self.states[key >> 8], key & 255
        child, ends, side, inner = self.child.get, self.ends.get, self.side.get, self.inner
        live, token, change = [], None, 0
        for node, before, ahead in (*zip(state[1::3], state[2::3], state[3::3], strict=True), (0, state[0], 0)):
            if (node := child(node << 8 | byte)) is not None:
                if token is None and (t := ends(node)) is not None:
                    fits = side(before << 32 | t) if before >= 0 else None
                    if self.beside(before, t) if fits is None else fits:
                        token, change = t, ahead + 1
                if node in inner:
                    live.append((node, before, ahead))
        new = [token]
        for node, before, ahead in live:
            new += node, before, ahead - change
        new = tuple(new)
        to = self.number.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
        return to, change

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key lies, or the free slot where it should."""
        mask = np.int64(self.size - 1)
        slot = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & mask
        have = self.keys[slot]
        off = np.flatnonzero((have != keys) & (have != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & mask
            have = self.keys[slot[off]]
            off = off[(have != keys[off]) & (have != -1)]
        return slot

    def _add(self, keys: np.ndarray) -> None:
        made = [self._next(k) for k in keys.tolist()]
        if (self.held + len(keys)) * 3 > self.size:
            had = self.keys != -1
            old = self.keys[had], self.to[had], self.change[had]
            self.size = 1 << max(16, (3 * (self.held + len(keys))).bit_length())
            self.keys, self.to, self.change = np.full(self.size, -1, np.int64), np.zeros(self.size, np.int32), np.zeros(self.size, np.int16)
            self._put(*old)
        self._put(keys, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
        self.held += len(keys)

    def _put(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        left = np.arange(len(keys))
        while len(left):
            slot = self._slots(keys[left])
            _, first = np.unique(slot, return_index=True)  # of keys that want one slot the first gets it
            put = left[first]
            self.keys[slot[first]], self.to[slot[first]], self.change[slot[first]] = keys[put], to[put], change[put]
            left = np.setdiff1d(left, put, assume_unique=True)

    def _walk(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last state, tokens more) of each stretch from its first state: all step by step, longest first."""
        length = end - start
        order = np.argsort(-length, kind="stable")
        begin, size = start[order], length[order]
        now, total = state[order].astype(np.int64), np.zeros(len(order), np.int64)
        for j in range(int(size[0]) if len(size) else 0):
            to = int(np.searchsorted(-size, -j, "left"))
            keys = now[:to] << 8 | raw[begin[:to] + j]
            slot = self._slots(keys)
            if len(new := np.flatnonzero(self.keys[slot] == -1)):
                self._add(np.unique(keys[new]))
                slot = self._slots(keys)
            now[:to] = self.to[slot]
            total[:to] += self.change[slot]
        out, more = np.empty_like(now), np.empty_like(total)
        out[order], more[order] = now, total
        return out, more

    def _long(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of long pieces, by chunks."""
        chunks = -(-(end - start) // CHUNK)
        piece = np.repeat(np.arange(len(start)), chunks)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        a = start[piece] + nth * CHUNK
        b = np.minimum(a + CHUNK, end[piece])
        inner = np.flatnonzero(nth > 0)
        entry = np.zeros(len(piece), np.int64)
        entry[inner], _ = self._walk(raw, a[inner] - CHUNK // 2, a[inner], np.zeros(len(inner), np.int64))
        out, more = self._walk(raw, a, b, entry)
        for _ in range(3):
            wrong = inner[entry[inner] != out[inner - 1]]
            if not len(wrong):
                break
            entry[wrong] = out[wrong - 1]
            out[wrong], more[wrong] = self._walk(raw, a[wrong], b[wrong], entry[wrong])
        # a text that never forgets where it began (a long run of one letter) is read from chunk to chunk
        for k in inner[np.isin(piece[inner], piece[inner[entry[inner] != out[inner - 1]]])]:
            if entry[k] != out[k - 1]:
                entry[k] = out[k - 1]
                out[k], more[k] = self._follow(raw[a[k] : b[k]].tobytes(), int(entry[k]))
        return np.bincount(piece, weights=more, minlength=len(start)).astype(np.int64)

    def _follow(self, data: bytes, state: int) -> tuple[int, int]:
        total = 0
        for byte in data:
            if (known := self.known.get(key := state << 8 | byte)) is None:
                known = self.known[key] = self._next(key)
            state, change = known
            total += change
        return state, total

    def counts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many tokens each text has; ``at`` has the first byte of each, with the end behind."""
        out = np.zeros(len(at) - 1, np.int64)
        first = np.unique(at[:-1][np.diff(at) > 0])
        if not len(first):
            return out
        row = lambda x: np.searchsorted(at, x, "right") - 1
        whole = []
        if self.special:
            # a special token is one token, and ends the text before it and begins one behind it
            for m in self.special.finditer(raw.tobytes()):
                if row(m.start()) == row(m.end() - 1):
                    whole.append(m.span())
            if whole:
                first = np.unique(np.concatenate([first, [x for s in whole for x in s if x < len(raw)]]))
        begin = self.pieces(raw, first)
        end = np.append(begin[1:], len(raw))
        if whole:
            spans = np.array(whole)
            np.add.at(out, row(spans[:, 0]), 1)
            near = np.searchsorted(spans[:, 0], begin, "right") - 1
            inside = (near >= 0) & (begin < spans[np.maximum(near, 0), 1])
            begin, end = begin[~inside], end[~inside]
        if self.held > MOST:
            self._forget()
        self.known = {}
        long = end - begin > CHUNK
        n = np.zeros(len(begin), np.int64)
        _, n[~long] = self._walk(raw, begin[~long], end[~long], np.zeros(int((~long).sum()), np.int64))
        if long.any():
            n[long] = self._long(raw, begin[long], end[long])
        np.add.at(out, row(begin), n)
        return out
