"""Number words against regular expressions, and token ids against the tokenizer."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing, pii, textnum

PATTERNS = [(textnum.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (textnum.SPACED, r"[^\x20\x09-\x0D]+")]
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aB z\t\n\x0b.é9_\x00日-", max_size=40)), max_size=8)


def low(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


@settings(deadline=None, max_examples=80)
@given(TEXT)
def test_words(texts):
    for kind, pattern in PATTERNS:
        number, at = textnum.words(pa.array(texts, pa.string()), kind)
        seen = {}
        for i, t in enumerate(texts):
            words = re.findall(pattern, low(t))
            assert len(words) == at[i + 1] - at[i]
            for w, n in zip(words, number[at[i] : at[i + 1]].tolist(), strict=True):
                assert seen.setdefault(w, n) == n
        assert len(set(seen.values())) == len(seen)


@settings(deadline=None, max_examples=60)
@given(TEXT, st.integers(1, 5))
def test_shingles(texts, k):
    number, at = textnum.words(pa.array(texts, pa.string()), textnum.SPACED)
    got, to = textnum.shingles(number, at, k)
    seen = {}
    for i in range(len(texts)):
        w = number[at[i] : at[i + 1]].tolist()
        want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else [tuple(w)] * bool(w)
        assert len(want) == to[i + 1] - to[i]
        for s, n in zip(want, got[to[i] : to[i + 1]].tolist(), strict=True):
            assert seen.setdefault(s, n) == n
    assert len(set(seen.values())) == len(seen)


def test_slices_hold_whole_rows():
    b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 30, "", "c"]})
    assert [s.num_rows for s in textnum.slices(b, "text", 12)] == [2, 1, 2]
    assert list(textnum.slices(b.slice(0, 0), "text")) == []


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
IDS = packing.Ids(public_tokenizers.path("word_bpe_49k.json"), most=50)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="aBé ßÿ'’.,12²\n\t\x0b\x1c\x85\xa0\u0301ΣςИ<|>-_日İÅ\u212b", max_size=30), max_size=5))
def test_token_ids(texts):
    for t, got in zip(texts, IDS.of(texts), strict=True):
        assert got.tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_token_ids_of_special_strings():
    texts = ["<|endoftext|> x<|endoftext|>y", "it's John's 'll", "", "a" * 5000, "Straße ÀÉ"]
    assert [g.tolist() for g in IDS.of(texts)] == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


BASE = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(x) <= 255 for x in s.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(re.sub("[^0-9]", "", s))),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def base_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(BASE) for m in p.finditer(text or "") if good(m[0]))


@settings(deadline=None, max_examples=500)
@given(st.text(alphabet="a.@-1 2+(0)9%é4", max_size=60))
def test_base_spans(text):
    assert [s[:3] for s in pii.spans(text) if s[4]] == base_spans(text)


def test_packer_keeps_all_ids():
    rng = np.random.default_rng(0)
    for window, most in ((64, 2048), (64, 3), (8, 1)):
        p, docs, got = packing.Packer(window, most), {}, {}
        closed = []
        for d in range(300):
            docs[d] = rng.integers(0, 1000, rng.integers(1, 3 * window)).astype(np.uint16)
            closed += p.put(d, docs[d])
            if p.full:
                closed += p.settle()
                assert p.n_open <= 6
        closed += [*p.settle(), *p.close()]
        for _, pieces in closed:
            n = sum(len(x[2]) for x in pieces)
            assert 0 < n <= window and (n == window or n & (n - 1) == 0)
            for d, start, ids in pieces:
                got.setdefault(d, {})[start] = ids
        for d, ids in docs.items():
            assert np.concatenate([got[d][s] for s in sorted(got[d])]).tolist() == ids.tolist()
        assert len({s for s, _ in closed}) == len(closed)


def test_sizes_that_do_not_fill_windows_leave_few_open():
    for sizes in ([1800], [2049], [1500, 2700], [4095], [1], list(range(1, 4096, 17))):
        p = packing.Packer()
        for d in range(1000):
            list(p.put(d, np.zeros(sizes[d % len(sizes)], np.uint16)))
        before, closed = p.n_open, list(p.settle())
        assert p.n_open <= 4 and all(sum(len(x[2]) for x in pieces) == 4096 for _, pieces in closed), (sizes, before, p.n_open)


def test_packer_level_with_cuts_is_the_best_one():
    rng = np.random.default_rng(2)
    p = packing.Packer(32, unit=4)
    for _ in range(300):
        p.count[:8] = rng.integers(0, 4, 8)
        p.count[8] = 0
        size = int(rng.integers(1, 32))
        t, cost = size // 4, {}
        for h in {0, *np.flatnonzero(p.count).tolist()}:
            c = p.count.copy()
            c[h] -= c[h] > 0
            c[(h + t) % 8] += h + t != 8
            cost[h] = int((c.astype(int) ** 2).sum())
        assert cost[p.level(size)] == min(cost.values())


def test_packer_level_is_the_best_one():
    rng = np.random.default_rng(1)
    p = packing.Packer(32)
    for _ in range(200):
        p.count[1:32] = rng.integers(0, 4, 31)
        p.count[0] = p.count[32] = 0
        size = int(rng.integers(1, 32))
        cost = {}
        for h in [0, *np.flatnonzero(p.count).tolist()]:
            if h + size <= 32:
                c = p.count.copy()
                c[h] -= h > 0
                c[h + size] += h + size < 32
                cost[h] = int((c.astype(int) ** 2).sum())
        assert cost[p.level(size)] == min(cost.values())
