"""Large lexicons: all terms of all constraints in one automaton, run over Arrow batches.

The patterns of :mod:`lexicon` try one term after the other; here the cost of a text hardly depends on how many terms there are. What is
found is the same: terms between word borders, in lower-cased text, the longest at each place first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD: dict[str, bool] = {}


def _is_word(c: str) -> bool:
    """What Java's \\w holds under Unicode: alphabetic, marks, decimal digits, connectors and joiners."""
    if (known := _WORD.get(c)) is None:
        import regex

        known = _WORD[c] = regex.match(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]", c) is not None
    return known


def _border(text: str, at: int) -> bool:
    return (at > 0 and _is_word(text[at - 1])) != (at < len(text) and _is_word(text[at]))


class Scanner:
    """An automaton of a lexicon's terms and false-positive phrases; made once in each worker."""

    def __init__(self, terms: dict[str, list[str]], phrases: list[str]):
        import ahocorasick

        self.names, self.phrases = list(terms), phrases
        owners: dict[str, list[tuple[int, int, str]]] = {}  # lower-cased term: (constraint, place in its order, term)
        for c, name in enumerate(self.names):
            for i, t in enumerate(sorted(terms[name], key=len, reverse=True)):
                owners.setdefault(t.lower(), []).append((c, i, t))
        self.tree = ahocorasick.Automaton()
        for t, who in owners.items():
            if t:
                self.tree.add_word(t, (len(t), who, None))
        for i, p in enumerate(phrases):
            self.tree.add_word(p, (len(p), owners.get(p, []), i))
        if len(self.tree):
            self.tree.make_automaton()
        # a phrase's own terms are exempt where it stands
        self.covered = [[{m[2] for m in found} for found in self._spans(p)] for p in phrases]

    def _matches(self, text: str) -> tuple[list[tuple[int, int, list]], set[int]]:
        """(start, end, owners) of all terms between word borders, and the phrases that are there at all."""
        found, there = [], set()
        for last, (n, who, phrase) in self.tree.iter(text) if len(self.tree) else ():
            if phrase is not None:
                there.add(phrase)
            if who and _border(text, last - n + 1) and _border(text, last + 1):
                found.append((last - n + 1, last + 1, who))
        return found, there

    def _spans(self, text: str) -> list[list[tuple[int, int, str]]]:
        """For each constraint its matches as a pattern of all its terms takes them: leftmost, of those the longest, without overlaps."""
        return self._taken(self._matches(text)[0])

    def _taken(self, found: list[tuple[int, int, list]]) -> list[list[tuple[int, int, str]]]:
        out: list[list[tuple[int, int, str]]] = [[] for _ in self.names]
        for start, end, who in sorted(found, key=lambda f: (f[0], -f[1])):
            for c in {c for c, _, _ in who}:
                if not out[c] or start >= out[c][-1][1]:
                    out[c].append((start, end, next(t for o, _, t in who if o == c).lower()))
        return out

    def counts(self, text: str | None) -> list[int] | None:
        """For each constraint how many matches no active phrase covers."""
        if text is None:
            return None
        found, there = self._matches(text)
        if not found:
            return [0] * len(self.names)
        return [sum(not any(t in self.covered[p][c] for p in there) for _, _, t in got) for c, got in enumerate(self._taken(found))]

    def terms(self, text: str | None) -> list[dict]:
        """Each term that is somewhere in the text, by constraint and in the constraint's order, without those that a phrase shields."""
        if text is None:
            return []
        found, there = self._matches(text)
        got = {(c, i): t for _, _, who in found for c, i, t in who}
        return [{"constraint": self.names[c], "term": t} for (c, _), t in sorted(got.items()) if not any(t.lower() in self.phrases[p] for p in there)]


_scanners: dict[int, Scanner] = {}


def _scanner(key: int, terms, phrases) -> Scanner:
    """The worker's automaton for a lexicon; one is kept."""
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(terms, phrases)
    return _scanners[key]


def _udf(kind: str, terms: dict[str, list[str]], phrases: list[str], of):
    key = hash((tuple((k, tuple(v)) for k, v in terms.items()), tuple(phrases)))

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = _scanner(key, terms, phrases)
        for b in batches:
            yield pd.Series([of(scanner, x) for x in b], dtype="object")

    return run


def counts(text: Column, terms: dict[str, list[str]], phrases: list[str]) -> Column:
    """array<int> by constraint: matches in (lower-cased) text that no active phrase covers; null for null."""
    return _udf("array<int>", terms, phrases, lambda s, x: s.counts(x))(text)


def item_terms(items: Column, terms: dict[str, list[str]], phrases: list[str]) -> Column:
    """For each (lower-cased) item of an array the terms that it holds and no phrase shields, by constraint, longest first."""
    of = lambda s, x: None if x is None else [s.terms(i) for i in x]
    return _udf("array<array<struct<constraint:string,term:string>>>", terms, phrases, of)(items)
