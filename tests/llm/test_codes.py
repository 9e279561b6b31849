"""Vector codes, importance resampling and token counts against plain forms, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import crc, importance, textnum, tokens, transducer, yinyang
from quern.llm.queries import QUERIES

TOKENS = public_tokenizers.path("byte_bpe_50k.json")

# --- op11 ----------------------------------------------------------------------------------------------------------


def lloyd(rows, entries=256, parts=4, rounds=4):
    """(code, error) of each kept (vec_id, vector), and all entries: every distance computed, in Python's integers."""
    big = (1 << 63) - 1
    scaled = lambda x: max(-big - 1, min(big, math.floor(x * 1024) if abs(x) < 1e300 else int(math.copysign(big + (x < 0), x))))
    kept = [(i, [scaled(x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first)[:entries]]
    size = len(kept[0][1])
    cuts = [c.tolist() for c in np.array_split(np.arange(size), parts)]
    books = [[[v[j] for j in cut] for v in start] for cut in cuts]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for last in [False] * rounds + [True]:
        codes = [[assign([v[j] for j in cut], book) for cut, book in zip(cuts, books, strict=True)] for _, v in kept]
        if last:
            return {(i, "".join(f"{e:02x}" for _, e in c), min(big, sum(d for d, _ in c))) for (i, _), c in zip(kept, codes, strict=True)}, books
        for p, cut in enumerate(cuts):
            for e in range(len(books[p])):
                mine = [v for (_, v), c in zip(kept, codes, strict=True) if c[p][1] == e]
                if mine:
                    books[p][e] = [sum(v[j] for v in mine) // len(mine) for j in cut]


VECTORS = "vec_id long, embedding array<double>, label int, size int, code string"


def coded(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0 if i is None else i % 3, 9, "x") for i, v in rows], VECTORS).repartition(3)
    return yinyang.encoded(df, **options).collect()


@pytest.mark.parametrize("spread", [0.3, 0.02, 0.002])
def test_codes_by_hand(spark, spread):
    rng = np.random.default_rng(int(spread * 1000))
    x = np.repeat(rng.normal(size=(20, 12)), 12, 0) + spread * rng.normal(size=(240, 12))
    x[200:] = np.round(x[200:], 1)  # ties
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(240), x, strict=True)] + [(5, x[0].tolist()), (None, x[1].tolist())]
    want, books = lloyd(rows, entries=40)
    got = coded(spark, rows, entries=40)
    assert {(r.vec_id, r.code, r.error) for r in got} == want and len(got) == 242
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()}
    for r in got:
        assert r.label_error == sum(o.error for o in got if (o.vec_id or 0) % 3 == (r.vec_id or 0) % 3)


def test_groups_spare_distances():
    """Most distances are never computed, and what the bounds let out changes nothing."""
    rng = np.random.default_rng(3)
    x = np.floor(1024 * (np.repeat(rng.normal(size=(40, 16)), 50, 0) + 0.05 * rng.normal(size=(2000, 16))))
    book = yinyang.Codebook([tuple(int(c) for c in v) for v in x[::8][:250]], 0)
    own, lower, tried = np.zeros(2000, np.int64), np.zeros((2000, book.groups)), []
    for _ in range(5):
        own, d, lower, n = book.assign(x, own, yinyang._rounded_down(lower).astype(float))
        tried.append(n)
        all_ = ((x[:, None, :] - np.array(book.entries, float)) ** 2).sum(2)
        assert (own == all_.argmin(1)).all() and (d == all_.min(1)).all()
        book.moved({e: (int((own == e).sum()), [int(t) for t in x[own == e].sum(0)]) for e in set(own.tolist())})
    assert tried[-1] < 0.3 * tried[0]


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1e9, -1e9, 0.0, 1e300, 7.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.5]), (4, None), (5, [None, 1.0, 1.0, 1.0, 1.0]), (6, [float("nan")] * 5), (7, [float("-inf")] * 5), (8, [-0.0001, 0.0, 0.0, 0.0, 0.0])]
    for entries in (1, 2, 256):
        want, _ = lloyd(rows, entries)
        assert {(r.vec_id, r.code, r.error) for r in coded(spark, rows, entries=entries)} == want
    mixed = coded(spark, [*rows, (9, []), (10, [1.0] * 8), (11, [2.0] * 8)])
    assert len(mixed) == 7 and next(r for r in mixed if r.vec_id == 9).code == "00000000" and len({r.codebooks_sha256 for r in mixed}) == 3
    assert coded(spark, [(None, [1.0])]) == [] and coded(spark, []) == [] and len(coded(spark, [(1, [1.0])] * 300)) == 300
    unlabelled = spark.createDataFrame([(1, [1.0, 1.0]), (2, [3.0, 3.0])], "vec_id long, embedding array<double>")
    assert {r.label_error for r in yinyang.encoded(unlabelled).collect()} == {0}


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(yinyang, "FEW_LABELS", 3)
    df = spark.createDataFrame([(i, [float(i % 7), 0.0, 0.0, 1.0], None if i % 3 else i % 50) for i in range(300)], "vec_id long, embedding array<double>, label int")
    got = yinyang.encoded(df, entries=3).collect()
    label = lambda i: None if i % 3 else i % 50
    assert len(got) == 300 and all(r.label_error == sum(o.error for o in got if label(o.vec_id) == label(r.vec_id)) for r in got) and any(r.error for r in got)


# --- op12 ----------------------------------------------------------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("ab Cé1-\n日", max_size=40), st.integers(40, 300).map(lambda n: "x" * n + " y"))), st.integers(1, 4))
def test_crcs_of_runs(texts, most):
    want = [[] for _ in range(most)]
    for row, t in enumerate(texts):
        w = words_of(t)
        for k in range(1, most + 1):
            want[k - 1] += [(zlib.crc32(b" ".join(w[i : i + k])) % 977, row) for i in range(len(w) - k + 1)]
    got = [list(zip(b.tolist(), r.tolist(), strict=True)) for b, r in importance.features(pa.array(texts, pa.string()), most, 977)]
    assert got + [[]] * (most - len(got)) == want


def test_crc_of_joined_strings():
    draw = random.Random(1)
    for n in (0, 1, 7, 64, 65, 1000, 123_457):
        a, b = draw.randbytes(9), draw.randbytes(n)
        got = crc.join(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)


def test_resample_odd(spark):
    schema = "doc_id long, text string, score string, rank int, bucket long"
    long = " ".join(f"w{i % 999}" for i in range(200_000))
    rows = [(1, None, "a", 1, 1), (2, "", "b", 2, 2), (3, "-- !", None, None, None), (4, long, "x", 3, 3), (None, "word " * 30, "x", 3, 3)] + [(i, "some words " * 10 + f"n{i}", "x", 0, 0) for i in (5, 6, 7, 7, 8)] + [(9, "few words", "x", 0, 0)]
    docs, target = spark.createDataFrame(rows, schema), spark.createDataFrame([("some words",), (None,)], "text string")
    got = importance.resample(docs, target, percent=50).collect()
    assert len(got) == 11 and sum(r.rank is not None for r in got) == 3  # half of seven
    by = {r.doc_id: r for r in got}
    assert all((by[i].n_features, by[i].weight, by[i].rank) == (0, 0, None) for i in (1, 2, 3)) and by[4].n_features == 399_999 and by[9].rank is None
    assert by[None].score is None and by[None].rank is None and by[5].weight > by[4].weight
    drawn = sorted((r.rank, -r.score) for r in got if r.rank)
    assert [r for r, _ in drawn] == [1, 2, 3] and drawn == sorted(drawn, key=lambda x: x[1]) and importance.resample(docs.limit(0), target).count() == 0
    assert {r.rank for r in importance.resample(docs, target, percent=0).collect()} == {None}
    everyone = importance.resample(docs, target.limit(0), percent=100).collect()
    assert sorted(r.rank for r in everyone if r.rank) == [1, 2, 3, 4, 5, 6] and {r.doc_id for r in everyone if r.rank} == {4, 5, 6, 7, 8}


# --- op13 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def counter():
    return transducer.Counter(transducer.load(TOKENS))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(TOKENS)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def counted(counter, texts):
    raw, at = textnum.flat(pa.array(texts, pa.string()))
    return counter.counts(raw, at).tolist()


PIECES = ["'s", "'re", "'r", "'l", "'ll", "'", "’s", " ", "  ", "\n", "\t", " ", "　", "a", "e", "the", " hello", "world", "123", "½", "٣", "é", "中文", "日本語", "😀", "!!!", "<|endoftext|>", "<|endof", "text|>", "_", "aaaaaaaaaaaaa", "\r\n", "x" * 70, "́", "\x00", "՘"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), max_size=6))
def test_counts_of_odd_pieces(counter, library, texts):
    assert counted(counter, [*texts, None, ""]) == [*library(texts), 0, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=4))
def test_counts_of_any_text(counter, library, texts):
    assert counted(counter, texts) == library(texts)


def test_counts_of_long_texts(counter, library):
    draw = random.Random(2)
    texts = ["a" * 30_011, "ab" * 9_999, "中文字" * 5_000, "".join(draw.choice("abcdefghijklmnop") for _ in range(30_000)), " " * 5_000 + "x", "= " * 5_000, "\n" * 999 + "'", "word " * 40_000]
    assert counted(counter, texts) == library(texts)


def test_tables_that_are_full(library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST", 50)
    small = transducer.Counter(transducer.load(TOKENS))
    draw = random.Random(4)
    for _ in range(20):
        texts = ["".join(draw.choice(PIECES) for _ in range(30)) for _ in range(5)]
        assert counted(small, texts) == library(texts)


def test_maps_compose():
    """A scan of chunks' maps is their composition in order."""
    maps = np.random.default_rng(1).integers(0, 11, (37, 11)).astype(np.uint8)
    got, now = transducer.compose(maps), np.arange(11)
    for i, m in enumerate(maps):
        now = m[now]
        assert (got[i] == now).all()


def test_token_query(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want = dict(zip(texts, library(list(texts.values())), strict=True))
    got = QUERIES["op13_tokens"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), want[r.doc_id] > 1024)


def test_token_counts_odd(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (2, "x " * 50_000, 5), (2, "x " * 50_000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, TOKENS).collect())
    assert got == [(0, 3, 2, False), (1, 0, 0, False), (1, 0, 0, False), (2, 100_000, 50_001, True), (2, 100_000, 50_001, True)]
    assert tokens.token_counts(docs.limit(0), TOKENS).count() == 0
    with pytest.raises(ValueError):
        transducer.load(public_tokenizers.path("word_bpe_49k.json"))
