"""Each operator's query against brute force, and on awkward rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, decontaminate, langid, linkgraph, minhash, packing, pii, pq, quality, warc
from quern.llm.queries import QUERIES, SQL

from compare import SF, check
from test_words import base_spans, low

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, _hits string"
ODD = [(1, None, None, None, None, None, None, None), (2, "", "en", "s", 0, True, 1, "x"), (3, " \n ", "en", None, 3, None, None, ""), (4, "word", "en", "s", 4, False, 0, ""), (4, "word", "en", "s", 4, False, 0, ""), (5, "!? 12", "fr", "t", 5, True, 3, ""),
       (6, "long " * 60_000 + "a@b.co", "en", "s", 1, True, 5, "y"), (None, "no id at all but some words", "en", "s", 1, True, 5, "y"), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def tables(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    check(spark, QUERIES[name], SQL[name])


# --- op1 -----------------------------------------------------------------------------------------------------------


def links_of(ids, x, least=0.9):
    order = np.argsort(ids)
    ids, x = np.array(ids)[order], x[order]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    comp = np.arange(len(ids))
    while True:
        new = np.minimum(comp, np.where(near, comp[None, :], len(ids)).min(1))
        new = new[new]
        if (new == comp).all():
            return {int(i): (int(n), int(ids[c])) for i, n, c in zip(ids, near.sum(1), comp, strict=True)}
        comp = new


def test_near_vectors(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST", 30)
    monkeypatch.setattr(pq, "BLOCK", 40)
    monkeypatch.setattr(pq, "PART", 50)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    x = np.concatenate([base[rng.integers(0, 40, 300)] + 0.25 * rng.normal(size=(300, 16)), np.repeat(base[:1], 200, 0) + 0.05 * rng.normal(size=(200, 16)), rng.normal(size=(50, 16)) * 1e-200])
    ids = rng.permutation(550).tolist()
    rows = [(i, v.tolist(), 0) for i, v in zip(ids, x, strict=True)]
    strange = [(600, None, 1), (601, [0.0] * 16, 1), (602, [None] + [1.0] * 15, 1), (603, [float("nan")] + [1.0] * 15, 1), (604, [float("inf")] * 16, 1), (605, [], 1), (606, [1.0, 2.0], 1), (ids[0], x[0].tolist(), 5), (None, x[0].tolist(), 1)]
    df = spark.createDataFrame(rows + strange, "vec_id long, embedding array<double>, n_links int")
    got = defaultdict(list)
    for r in pq.near_vectors(df).collect():
        got[r.vec_id].append((r.n_links, r.component_id, r.kept))
    # scaled first, as squares of the smallest would vanish
    want = links_of(ids, x / np.abs(x).max(1, keepdims=True))
    assert all(set(got[i]) == {(n, c, c == i)} for i, (n, c) in want.items())
    assert len(got[ids[0]]) == 2 and got[None] == [(0, None, True)] and all(got[i] == [(0, i, True)] for i in range(600, 607))
    assert pq.near_vectors(df.limit(0)).count() == 0 and pq.near_vectors(df.where("vec_id = 601")).count() == 1


def test_near_vectors_of_all_dimensions(spark, monkeypatch):
    monkeypatch.setattr(pq, "LIST", 4)
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n, size, spread in ((16, 200, 0.08), (24, 60, 0.05)):
        x = np.repeat(rng.normal(size=(size // 4, n)), 4, 0) + spread * rng.normal(size=(size, n))
        ids = list(range(len(rows), len(rows) + size))
        rows += [(i, v.tolist()) for i, v in zip(ids, x, strict=True)]
        want |= links_of(ids, x)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(df, probes=None).collect()} == want and any(n for n, _ in want.values())
    # with one probe many links are found from one end alone
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(df, probes=1).collect()}
    # an end's links are those of its component: with both ends counted the sum is even, and no linked vector has none
    assert sum(n for n, _ in got.values()) % 2 == 0 and all(got[i][0] for i in got if sum(c == got[i][1] for _, c in got.values()) > 1)


def test_near_vectors_at_the_threshold(spark):
    """Integer pairs whose cosine is exactly nine tenths are links, those a hair below are none."""
    exact = [([1, 0, 0, 0, 0], [9, 3, 3, 1, 0]), ([0, 0, 3, 0, 0], [1, 1, 9, 4, 1]), ([0, 2, 0, 0, 0], [3, 18, 3, 0, 5]), ([10, 0, 0, 0, 0], [18, 6, 6, 2, 0])]
    for a, b in exact:
        short = [float(b[0]), *map(float, b[1:])]
        hair = [x * (1 - 1e-12) if y else x for x, y in zip(short, a, strict=True)]
        rows = [(1, [float(x) for x in a]), (2, short), (3, hair)]
        got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        x = np.array([r[1] for r in rows])
        cos = lambda u, v: float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum())))
        assert got[1][0] == (cos(x[0], x[1]) >= 0.9) + (cos(x[0], x[2]) >= 0.9) and got[1][1] == 1, (a, b)
    both = [(i, [float(v) for v in e]) for i, e in enumerate(([1, 0, 0, 0, 0], [9, 3, 3, 1, 0]))]
    assert [(r.n_links, r.component_id) for r in pq.near_vectors(spark.createDataFrame(both, "vec_id long, embedding array<double>")).collect()] == [(1, 0), (1, 0)]


def test_near_vectors_of_large_groups_of_copies(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([np.repeat(rng.normal(size=(1, 8)), 120, 0), rng.normal(size=(60, 8))])
    x[120:140] = x[0] + 0.05 * rng.normal(size=(20, 8))
    ids = list(range(180))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")).collect()}
    assert got == links_of(ids, x) and got[0][0] >= 119


@pytest.mark.parametrize("probes", [pq.PROBES, None])
def test_recall_of_hard_neighbours(spark, monkeypatch, probes):
    """Pairs whose cosine is hardly over the least one, in lists of few vectors; with all probes nothing is lost."""
    monkeypatch.setattr(pq, "LIST", 40)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 0.93, (1500, 1))
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos**2) * other])
    got = {r.vec_id: r.n_links for r in pq.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.9, probes).collect()}
    want = links_of(list(range(len(x))), x)
    found = sum(got.values()) / sum(n for n, _ in want.values())
    assert found >= 0.9 if probes else all(got[i] == n for i, (n, _) in want.items())


# --- op2 -----------------------------------------------------------------------------------------------------------


def hits_of(docs, items, window):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, seen = words(t), set(), set()
        for k in {len(g) for g in grams}:
            for j in range(len(w) - k + 1):
                if g := grams.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    seen |= g
        out.append((d, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit), *(longest_of(w, [words(t) for _, t in items]) if hit else (0, None))))
    return sorted(out, key=str)


def longest_of(w, items):
    """(most consecutive words of ``w`` that an item has too, their first place)."""
    best = (0, None)
    for i in range(len(w)):
        n = max((next((k for k in range(min(len(w) - i, len(t) - j) + 1) if k == min(len(w) - i, len(t) - j) or w[i + k] != t[j + k]), 0) for t in items for j in range(len(t)) if t[j] == w[i]), default=0)
        if n > best[0]:
            best = (n, i)
    return best


def test_repetitive_texts_take_room_in_proportion():
    import tracemalloc

    import pyarrow as pa

    text = "word " * 4_000
    for items in ([("a", text)], [(f"i{i:04}", f"{' '.join('abcdefghij')} x{i}") for i in range(1000)]):
        tests = decontaminate.prepare(items)
        docs = pa.array([text, "a b c d e f g h i j " * 400])
        rows = {}
        tracemalloc.start()
        count = decontaminate._judge(docs, tests, rows)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        hit = rows[0] if len(items) == 1 else rows[1]
        assert peak < 20 << 20 and count.tolist() == [4_000, 4_000] and len(hit.items) == len(items)
        assert decontaminate._union(hit.hits) == 4_000 and hit.longest == (4_000 if len(items) == 1 else 10)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice("aa bb cc dd ee ff".split()) for _ in range(n))
    items = [(i, text(rnd.choice([2, 3, 5, 9, 14]))) for i in range(12)] + [(12, None), (13, "--"), (3, "zz")]
    docs = [(i, rnd.choice([text(rnd.randrange(40)), "xx " + items[i % 12][1].upper() + ", yy"])) for i in range(60)] + [(7, "zz"), (90, None), (91, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.contamination(d, b, 4).drop("text").collect()), key=str)
    assert got == hits_of(docs, items, 4)


def test_shards_cost_what_they_hold():
    """Thousands of items more cost a shard little, and find the same."""
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    few, docs = [(f"i{i:05}", text(60)) for i in range(40)], [text(300) for _ in range(500)]
    docs[7] += " " + few[3][1]
    docs[9] = few[5][1][:200] + " " + docs[9]
    took, found = [], []
    for items in (few, few + [(f"j{i:05}", text(60)) for i in range(20_000)]):
        tests, texts = decontaminate.prepare(items), pa.array(docs)
        decontaminate._judge(texts, tests, {})
        best = float("inf")
        for _ in range(3):
            rows, began = {}, time.perf_counter()
            decontaminate._judge(texts, tests, rows)
            best = min(best, time.perf_counter() - began)
        took.append(best)
        found.append({i: (r.hits, r.items, r.longest, r.at) for i, r in rows.items()})
    assert found[0] == found[1] and set(found[0]) == {7, 9} and took[1] < 3 * took[0] + 0.05


def test_passes_write_no_texts(spark, monkeypatch):
    """With many blocks all that is written are findings of hit texts, and what another block finds partly counts for ``longest``."""
    written, keep = [], decontaminate.keep
    monkeypatch.setattr(decontaminate, "keep", lambda df: written.append(df.columns) or keep(df))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)
    docs = [(1, "a b c d e f g h"), (2, "x a b y"), (3, "none"), (4, "a b c d e f g h"), (5, None)]
    items = [(1, "a b"), (2, "c d e f g z z z z z"), (3, "q q q q q q q q q q"), (4, "b c d q r")]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert sorted((tuple(r) for r in got.drop("text").collect()), key=str) == hits_of(docs, items, 10)
    assert len(written) > 1 and all("text" not in c for c in written)


def test_contamination_query(spark):
    d = [(r.doc_id, r.text) for r in tables(spark, "documents").collect()]
    b = [(r.item_id, r.text) for r in tables(spark, "benchmark").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_decontaminate"](spark, SF).collect()), key=str) == hits_of(d, b, 10)


def test_decontaminate_odd(spark, odd, empty):
    b = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    out = decontaminate.decontaminate(odd, b, 10)
    assert out.columns == odd.columns and out.count() == len(ODD) - 1
    assert decontaminate.decontaminate(odd, b.limit(0)).count() == len(ODD) and decontaminate.decontaminate(empty, b).count() == 0


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d y"), (2, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "a b c d e")], "item_id string, text string")
    got = {tuple(r) for r in decontaminate.longest_matches(d.coalesce(1), b, 3).collect()}
    assert ("i", 0, 1, 1, 4) in got and ("i", 1, 1, 2, 3) in got and len(got) == 2


# --- op3 -----------------------------------------------------------------------------------------------------------


def test_quality(spark, odd, empty):
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").collect()}
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    right = [got[r.doc_id].kept == (r.quality == 1 and r.toxic == 0) for r in truth]
    assert sum(right) / len(right) > 0.9
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (99, 1, 1), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.judge(odd, labels, F.col("source"), F.col("lang")).collect()
    assert len(out) == len(ODD) and all(r.quality == 0 and not r.kept for r in out if r.doc_id in (1, 2, 3))
    assert quality.judge(empty, labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.judge(odd, labels.limit(0), F.col("source"), F.col("lang")).count() == len(ODD)


def test_posteriors_against_plain_sums(spark):
    docs, labels = tables(spark, "documents"), tables(spark, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels)
    named = docs.select("doc_id", "text", F.col("source").alias("host"), F.col("lang").alias("path"))
    rows = quality.score(named, model).collect()
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    logit = lambda p: np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))
    want = {r.doc_id: {} for r in rows}
    for t in ("quality", "toxic"):
        p = {r.doc_id: sigmoid(r[f"{t}_odds"]) for r in rows}
        mean = sum(p.values()) / len(p)

        def shrunk(key, prior):
            groups = defaultdict(list)
            for r in rows:
                groups[key(r)].append(p[r.doc_id])
            n = sum(map(len, groups.values()))
            s2 = max(sum(((np.array(g) - np.mean(g)) ** 2).sum() for g in groups.values()) / max(n - len(groups), 1), 1e-9)
            d2 = sum(len(g) * (np.mean(g) - prior(k)) ** 2 for k, g in groups.items()) / n
            t2 = max(d2 - s2 * len(groups) / n, 1e-9)
            return {k: (sum(g) + s2 / t2 * prior(k)) / (len(g) + s2 / t2) for k, g in groups.items()}

        hosts = shrunk(lambda r: r.host, lambda k: mean)
        paths = shrunk(lambda r: (r.host, r.path), lambda k: hosts[k[0]])
        for r in rows:
            want[r.doc_id][t] = 0.0 if r.empty else sigmoid(r[f"{t}_odds"] + 0.5 * (logit(paths[r.host, r.path]) - logit(mean)))
            want[r.doc_id][f"path_{t}"] = paths[r.host, r.path]
    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    for i, w in want.items():
        assert all(abs(got[i][c] - v) < 1e-6 for c, v in w.items()) and (got[i].kept == (w["quality"] >= 0.5 and w["toxic"] < 0.5))


def test_shrinkage(spark):
    rows = [("big", "p", 3.0, False)] * 50 + [("big", "q", 3.0, False)] * 50 + [("tiny", "p", -3.0, False)] + [("low", "p", -3.0, False)] * 60
    df = spark.createDataFrame([(i, h, p, o, 0.0, e) for i, (h, p, o, e) in enumerate(rows)], "doc_id long, host string, path string, quality_odds double, toxic_odds double, empty boolean")
    got = {(r.host, r.path): r for r in quality.posteriors(df).collect()}
    mean = got["tiny", "p"].all_quality
    assert got["low", "p"].host_quality < got["tiny", "p"].host_quality <= mean < got["big", "p"].host_quality


# --- op4 -----------------------------------------------------------------------------------------------------------


def near_of(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    over = {d: d for d in sets}

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                over[max(x, y)] = min(x, y)
    return {d: (len(s), top(d), top(d) == d) for d, s in sets.items()}


def family(rnd, n, size, most):
    """Copies of one text with up to ``most`` words changed: many are linked by others only."""
    base = [f"w{rnd.randrange(500)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(most + 1)):
            w[rnd.randrange(size)] = f"v{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [64, 4])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rnd = random.Random(6)
    texts = [t for n, size, most in ((80, 80, 6), (80, 70, 3), (30, 12, 2), (20, 200, 10)) for t in family(rnd, n, size, most)]
    texts += [texts[0].upper(), texts[0], "a b", "a  b", "", None, "x"]
    rnd.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([*docs, docs[3], (None, "a b")], "doc_id long, text string").withColumn("rep", F.lit(1))
    got = defaultdict(set)
    for r in minhash.near_duplicates(df, 4, 80).collect():
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got.pop(None) == {(1, None, True)}
    assert got == {d: {x} for d, x in near_of(docs, 4, 80).items()}


def test_near_duplicates_query(spark):
    docs = [(r.doc_id, r.text) for r in tables(spark, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op4_minhash"](spark, SF).collect()} == near_of(docs, 4, 80)


def test_large_groups_through_sql(spark, monkeypatch, tmp_path):
    """Buckets of over SMALL near copies, whose differences from one centre decide, through the query and its SQL."""
    rnd, entered = random.Random(12), []
    by_difference = minhash._by_difference
    monkeypatch.setattr(minhash, "_by_difference", lambda *a: entered.append(1) or by_difference(*a))
    base = [f"w{rnd.randrange(5000)}" for _ in range(400)]

    def variant(changed):
        w = list(base)
        for i in changed:
            w[i] = f"v{rnd.randrange(10**6)}"
        return w

    # two variants too far apart to link, each with near copies; some in between
    texts = [" ".join(variant(range(0, 400, 8))) for _ in range(3)]
    for far in (range(0, 40), range(360, 400)):
        one = variant(far)
        for _ in range(70):
            w = list(one)
            for i in rnd.sample(range(400), rnd.randrange(4)):
                w[i] = f"u{rnd.randrange(10**6)}"
            texts.append(" ".join(w))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    (part,) = (tmp_path / "x").glob("part-*.parquet")
    part.rename(tmp_path / "documents.parquet")
    check(spark, QUERIES["op4_minhash"], SQL["op4_minhash"], str(tmp_path))
    assert entered


def test_long_near_copies(spark):
    """Work on large groups grows with texts' length, not with its square: 80 texts of 6,000 words."""
    rnd = random.Random(13)
    base, texts = [f"w{i}" for i in range(6_000)], []
    for far in (0, 5_400):
        one = list(base)
        one[far : far + 600] = [f"v{far}{i}" for i in range(600)]
        for _ in range(40):
            w = list(one)
            w[rnd.randrange(6_000)] = "u"
            texts.append(" ".join(w))
    began = time.time()
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: 0 if i < 40 else 40 for i in range(80)} and time.time() - began < 90


def test_deduplicate_odd(spark, odd, empty):
    out = minhash.deduplicate(odd)
    assert out.columns == odd.columns and sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, None, None], key=str)
    assert minhash.deduplicate(empty).count() == 0


def test_deduplicate_shared_ids(spark):
    rnd = random.Random(3)
    a, b, c, d = (" ".join(f"{x}{rnd.randrange(300)}" for _ in range(60)) for x in "abcd")
    # 7: a near copy of 3's text and two of its own; 8: an exact copy of 3's and one of its own; 9: one row twice
    rows = [(3, a), (7, a + " more"), (7, b), (7, c), (8, a), (8, d), (9, "x y"), (9, "x y"), (None, a)]
    df = spark.createDataFrame([(*r, {"n": i}) for i, r in enumerate(rows)], "doc_id long, text string, tags map<string,int>")
    got = [[(r.doc_id, r.text, r.tags["n"]) for r in minhash.deduplicate(x).collect()] for x in (df, df.repartition(5, "text"))]
    assert sorted((t, str(i)) for i, t, _ in got[0]) == sorted([(a, "3"), (b, "7"), (c, "7"), (d, "8"), ("x y", "9"), (a, "None")])
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))


# --- op5 -----------------------------------------------------------------------------------------------------------


def cheapest(roles):
    best = {("start"): 0}
    reach = lambda b: _closure(b)
    best = reach(best)
    for r in roles:
        new = {}
        for s, d in best.items():
            for t in chat.ROLES:
                c = 0 if t == r else chat.RELABEL
                if t in chat.NEXT[s]:
                    new[t] = min(new.get(t, 10**9), d + c)
                if t == s:
                    new[t] = min(new.get(t, 10**9), d + c + chat.MERGE)
        best = reach(new)
    return best["assistant"]


def _closure(b):
    b, again = dict(b), True
    while again:
        again = False
        for s, d in list(b.items()):
            for t in chat.NEXT[s]:
                if d + chat.INSERT < b.get(t, 10**9):
                    b[t], again = d + chat.INSERT, True
    return b


@pytest.mark.parametrize(("chunk", "fan"), [(256, 256), (4, 3)])
def test_chat(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    monkeypatch.setattr(chat, "FAN", fan)
    rnd = random.Random(5)
    talks = {c: [rnd.choice(["system", "user", "assistant", "tool", None, "human"]) for _ in range(rnd.choice([1, 2, 3, 8, 50]))] for c in range(40)}
    rows = [(c, i, r, f"t{i}", 7) for c, rs in talks.items() for i, r in enumerate(rs)] + [(None, None, "user", None, 1), (None, 3, None, "x", 1), (99, 1, "user", "t0", 1), (99, 1, "user", "t0", 1)]
    got = defaultdict(list)
    for r in chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")).collect():
        got[r.conv_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    for c, roles in talks.items():
        turns = sorted(got[c], key=lambda r: r.turn)
        text = "".join(r.piece for r in turns)
        said = [m.partition("\n")[0] for m in text.split(chat.OPEN)[1:]]
        state = "start"
        for r in said:
            assert r in chat.NEXT[state]
            state = r
        assert state == "assistant" and text.count(chat.CLOSE) == len(said) and re.findall(r"t\d+", text) == [f"t{i}" for i in range(len(roles))]
        assert sum(r.cost for r in turns) == cheapest(roles)
    assert chat.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("same", ["turn", "null"])
def test_chat_chunks_are_bounded(spark, monkeypatch, same):
    monkeypatch.setattr(chat, "CHUNK", 8)
    monkeypatch.setattr(chat, "FAN", 4)
    most, table = [], chat._tables
    monkeypatch.setattr(chat, "_tables", lambda turns: most.append(max(r["count"] for r in turns.groupBy("conv_id", "part").count().collect())) or table(turns))
    rnd = random.Random(8)
    # all under one turn number, and all rows without conv_id
    rows = [(None if same == "null" else 5, None if same == "null" else 3, rnd.choice(["user", "assistant", "tool"]), f"t{i:03}") for i in range(300)]
    rows += [(c, i, "user", f"u{i}") for c in range(6, 40) for i in range(c % 3 + 1)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert most == [8] and sorted((str(r.conv_id), str(r.turn), r.role) for r in got) == sorted((str(c), str(t), r) for c, t, r, _ in rows)
    hot = sorted((r for r in rows if r[0] == rows[0][0]), key=lambda r: (r[2], r[3]))
    assert sum(r.cost for r in got if r.conv_id == rows[0][0]) == cheapest([r[2] for r in hot])
    assert sum(bool(r.appended) or r.piece.endswith(chat.CLOSE) for r in got if r.conv_id == rows[0][0]) == 1


# --- op6 -----------------------------------------------------------------------------------------------------------


def test_hosts(spark):
    rows = QUERIES["op6_hosts"](spark, SF).collect()
    urls = {r.page_id: r.url for r in tables(spark, "pages").collect()}
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    for r in rows:
        m = re.search(r"(?s)^.*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        fit = max((len(h + p), h + p, v) for v, h, p in [*rules, ("", "", "")] if (host == h or host.endswith("." + h) or not h) and path.startswith(p))
        assert (r.host, r.path, r.rule or "") == (host, path, fit[1]) and (not fit[2] or r.verdict == fit[2])


def test_ranks(spark):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("s", "bad", 3.0), ("s", "a", 1.0)]
    seeds = [("a", 2.0, 0.0, 1.0), ("b", 0.0, 0.0, 1.0), ("c", 0.0, 0.0, 0.0), ("s", 0.0, 0.0, 2.0), ("bad", 0.0, 4.0, 0.0)]
    got = {r.host: (r.trust, r.distrust, r.neutral) for r in linkgraph.ranks(spark.createDataFrame(links, "src string, dst string, n double"), spark.createDataFrame(seeds, "host string, allow double, block double, other double")).collect()}
    hosts = [s[0] for s in seeds]
    for k, (column, along) in enumerate(((1, True), (2, False), (3, True))):
        m = np.zeros((5, 5))
        for a, b, n in links:
            i, j = hosts.index(a), hosts.index(b)
            m[(i, j) if along else (j, i)] += n
        m[m.sum(1) == 0] = np.eye(5)[m.sum(1) == 0]
        m /= m.sum(1, keepdims=True)
        s = np.array([x[column] for x in seeds])
        s = s / s.sum()
        r = s.copy()
        for _ in range(linkgraph.ITERATIONS):
            r = 0.15 * s + 0.85 * r @ m
        assert np.allclose([got.get(h, (0, 0, 0))[k] for h in hosts], r)


def test_pages_odd(spark):
    rows = [(1, None, None), (2, "no scheme", ""), (3, "http://A.example.net/EN/", "<a href='//x.org/fr/'>"), (3, "http://A.example.net/EN/", None), (4, "http://x.org", "<a href=\"HTTP://bad.net/1\">"), (None, "x://y.org?q", None), (5, "http://bad.net/#f", "")]
    got = linkgraph.judge(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)), [linkgraph.Rule("block", "net/"), linkgraph.Rule("allow", "org/fr/")]).collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == [
        ("1", "", "", None, "allow"), ("2", "", "", None, "allow"), ("3", "a.example.net", "/EN/", "net/", "block"), ("3", "a.example.net", "/EN/", "net/", "block"), ("4", "x.org", "", None, "allow"), ("5", "bad.net", "/", "net/", "block"), ("None", "y.org", "", None, "allow"),
    ]
    assert linkgraph.judge(spark.createDataFrame([], "page_id long, url string, html string"), []).count() == 0


# --- op7 -----------------------------------------------------------------------------------------------------------


def test_pack_query(spark):
    from test_words import TOKENIZER

    ids = {r.doc_id: np.array([*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in tables(spark, "documents").collect()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op7_pack"](spark, SF).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts, most in [(docs[d], len(x)) for d, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == most if most else at <= 4096


def test_pack_odd(spark, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    out = packing.pack(odd, path, ids=True)
    assert sum(r.length for r in out.collect()) == sum(r.doc_tokens for r in out.where("start = 0").collect()) and out.where("start = 0").count() == len(ODD)
    got = packing.sequences(out).collect()
    assert all(len(r.ids) <= 4096 for r in got) and sum(len(r.ids) for r in got) == sum(r.length for r in out.collect())
    assert packing.pack(empty, path).count() == 0


def test_open_windows_meet_in_second_streams(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(8)
    share = {}
    for stream in (100_000, 1 << 24):
        monkeypatch.setattr(packing, "STREAM", stream)
        out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), ids=True).cache()
        whole = {r.sequence_id: (r.n, r.t) for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.first("run_together").alias("t")).collect()}
        share[stream] = sum(t for _, t in whole.values()) / len(whole)
        assert all(n == 4096 or t and n & (n - 1) == 0 for n, t in whole.values())
        got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"), F.min("doc_tokens").alias("k")).where("n <> m or n <> k")
        assert got.isEmpty() and out.where("size(ids) <> length").isEmpty()
        out.unpersist()
    assert share[1 << 24] < share[100_000] and share[1 << 24] < 0.1


@pytest.mark.parametrize("name", [n for n in sorted(__import__("os").listdir("/opt/tokenizers")) if n.endswith(".json")])
def test_ids_of_any_tokenizer(name):
    from tokenizers import Tokenizer

    path, texts = f"/opt/tokenizers/{name}", ["Hello World's  x\n\ty", "Straße ÀÉ 12.5", "", None, "a" * 300, "<|x|> é\u0301"]
    want = [Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing.Ids(path).of(texts)] == want


# --- op8 -----------------------------------------------------------------------------------------------------------


def test_warc_odd(spark):
    rows = [(5, "http://a/\r\nX: y", "p"), (3, None, "p"), (9, "u", "p"), (9, "u", "p"), (3, "u", "p"), (1, "u", None), (2, "u", ""), (None, "u", "p"), (7, "u", "WARC/1.1\r\n\r\né\r\n\r\nWARC-Type: x" * 3), (8, None, "q" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = sorted(((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    revisit = lambda i, n, first: (str(i), n, "revisit", first)
    response = lambda i, n: (str(i), n, "response", None)
    assert got == sorted([revisit(5, 1, 3), response(3, 1), response(3, 1), revisit(9, 1, 3), revisit(9, 1, 3), response(1, 0), revisit(2, 0, 1), response(None, 1), response(7, 90), response(8, 300_000)], key=str)
    assert all(r.record_type == "response" for r in warc.round_trip(df, least=2).where("payload_bytes < 2").collect())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_payloads(spark, tmp_path):
    df = tables(spark, "pages")
    warc.write(df, str(tmp_path / "w"), file_bytes=5000)
    got = {r.page_id: r.payload for r in warc.read(spark, str(tmp_path / "w"), payload=True).where("record_type = 'response'").collect()}
    want = {r.page_id: (r.html or "").encode() for r in df.collect()}
    assert all(bytes(p) == want[i] for i, p in got.items()) and set(got.values()) >= set(want.values())
    with pytest.raises(warc.Damaged):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"))


def test_warc_files_are_members_of_bounded_size(spark, tmp_path):
    import gzip

    rows = [(i, f"http://h/{i}", "x" * 3000 + str(i)) for i in range(20)] + [(3, "http://h/3", "x" * 30003)] * 3 + [(50, "http://big/", random.Random(1).randbytes(40_000).hex())]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), file_bytes=1000, date="2020-02-02T00:00:00Z")
    files = [f.read_bytes() for f in (tmp_path / "w").glob("*.txt")]
    assert len(files) > 5 and all(len(f) < 1500 for f in files if b"big" not in gzip.decompress(f))
    assert sum(len(list(warc.records(f))) for f in files) == len(rows) and all(f.count(b"\x1f\x8b\x08") >= len(list(warc.records(f))) for f in files)
    got = warc.read(spark, str(tmp_path / "w")).collect()
    ids = {r.record_id: r for r in got}
    assert len(ids) == len(rows) and {r.date for r in got} == {"2020-02-02T00:00:00Z"}
    assert len(warc.member(b"\0" * (1 << 24))) and warc.member(b"\0" * (1 << 24))[-1] == 0


def foreign(compress):
    """An archive of another writer: records without page ids, revisits with and without HTTP headers."""
    import base64
    import gzip

    def record(kind, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<{kind}{len(out)}>", "WARC-Date": "2001-01-01T00:00:00Z", **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
        raw = b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"
        out.append(gzip.compress(raw) if compress else raw)

    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    out: list[bytes] = []
    record("warcinfo", b"software: x\r\n")
    record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Target_URI="http://a/")
    record("response", b"HTTP/1.1 200 OK\r\n\r\nbody \xff", WARC_Target_URI="http://a/", WARC_Payload_Digest=sha(b"body \xff"))
    record("response", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\nother", WARC_Target_URI="http://b/")
    record("revisit", b"", WARC_Target_URI="http://c/", WARC_Payload_Digest=sha(b"body \xff"))
    record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Target_URI="http://d/", WARC_Refers_To="<response2>", WARC_Payload_Digest=sha(b"gone"))
    record("revisit", b"", WARC_Target_URI="http://e/", WARC_Payload_Digest=sha(b"nowhere"))
    return b"".join(out)


@pytest.mark.parametrize("compress", [True, False])
def test_foreign_archives(spark, tmp_path, compress):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(foreign(compress))
    (tmp_path / "in" / "empty.warc.gz").write_bytes(b"")
    found = warc.read(spark, str(tmp_path / "in"), payload=True)
    got = {(r.record_type, r.url): (r.payload_bytes, r.payload and bytes(r.payload)) for r in found.collect()}
    assert len(got) == 7 and got["response", "http://a/"] == (6, b"body \xff") and got["response", "http://b/"] == (5, b"other") and got["warcinfo", None] == (None, None)
    assert {r.url: r.original_url for r in warc.resolve(found).collect()} == {"http://c/": "http://a/", "http://d/": "http://a/", "http://e/": None}
    warc.rewrite(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    new = warc.read(spark, str(tmp_path / "out"), payload=True).collect()
    assert sorted((r.url, r.record_type == "response") for r in new if r.url != "http://b/") in [sorted((u, u == first) for u in ("http://a/", "http://c/", "http://d/")) for first in ("http://a/", "http://c/", "http://d/")]
    assert {bytes(r.payload) for r in new if r.payload} == {b"body \xff", b"other"} and all(r.refers_to_id and r.refers_to_url for r in new if r.record_type == "revisit")


# --- op9 -----------------------------------------------------------------------------------------------------------


def test_language(spark):
    got = QUERIES["op9_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.97


def test_language_odd(spark, odd, empty):
    out = langid.identify(odd).collect()
    assert len(out) == len(ODD) and {r.lang_pred for r in out if r.doc_id in (1, 2, 3, 5)} == {langid.UNKNOWN}
    assert langid.identify(empty).count() == 0 and langid.known(odd).columns == odd.columns
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_backward():
    rng = np.random.default_rng(3)
    k, steps = 3, 5
    start, change = rng.normal(size=k), rng.normal(size=(k, k))
    lengths = np.array([5, 3, 1])
    score = rng.normal(size=(3, steps, k))
    got, expected, _ = langid.forward_backward(np.exp(score), lengths, start, change)
    moves = np.zeros((k, k))
    for s, n in enumerate(lengths):
        total, marginal = 0.0, np.zeros((n, k))
        for labels in np.ndindex(*(k,) * n):
            p = np.exp(start[labels[0]] + sum(score[s, t, y] for t, y in enumerate(labels)) + sum(change[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            total += p
            for t, y in enumerate(labels):
                marginal[t, y] += p
        assert np.allclose(got[s, :n], marginal / total)
        for labels in np.ndindex(*(k,) * n):
            p = np.exp(start[labels[0]] + sum(score[s, t, y] for t, y in enumerate(labels)) + sum(change[a, b] for a, b in zip(labels, labels[1:], strict=False)))
            for a, b in zip(labels, labels[1:], strict=False):
                moves[a, b] += p / total
    assert np.allclose(expected, moves)


def test_chains_of_any_length_are_whole():
    rng = np.random.default_rng(5)
    k, count = 3, np.array([4, 0, 150, 1, 37])
    start, change = rng.normal(size=k), rng.normal(size=(k, k))
    e = langid._potentials(rng.normal(size=(int(count.sum()), k)))
    got, at = langid.chains(e, count, start, change), 0
    for n in count:
        if n:
            want = langid.forward_backward(e[None, at : at + n], np.array([n]), start, change)[0][0]
            assert np.allclose(got[at : at + n], want)
            at += n


def test_words_are_labelled(spark):
    words = {"x": ["lahon", "lemon", "lasson"], "y": ["grubst", "drabst", "knabst"]}
    rnd = random.Random(1)
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    model = langid.fit([say(x, 80) for x in "xy" * 20], list("xy" * 20))
    text = "1 " + say("x", 100) + ", é " + say("y", 100)
    rows = {r.doc_id: r.words for r in langid.label_words(spark.createDataFrame([(1, text), (2, None), (3, "12")], "doc_id long, text string"), model).collect()}
    got = [(text[w.start : w.end], w.lang) for w in rows[1]]
    assert len(got) == 201 and {w for w, _ in got} <= {*words["x"], *words["y"], "é"} and [x for _, x in got[:100]] == ["x"] * 100 and [x for _, x in got[101:]] == ["y"] * 100
    assert rows[2] == rows[3] == []


def posteriors_of(text, model):
    """Posteriors (words by languages) of a whole text by the plain recursions, word by word."""
    e = langid.emissions(langid.Features([text]), model.weights)
    n, k = e.shape
    log = lambda v: np.log(np.exp(v - v.max()).sum()) + v.max()
    a, b = np.zeros((n, k)), np.zeros((n, k))
    if not n:
        return a
    a[0] = model.start + e[0]
    for i in range(1, n):
        a[i] = [log(a[i - 1] + model.change[:, j]) + e[i, j] for j in range(k)]
    for i in range(n - 2, -1, -1):
        b[i] = [log(model.change[j] + e[i + 1] + b[i + 1]) for j in range(k)]
    return np.exp(a + b - log(a[-1]))


def scores_of(texts, model):
    """lang_pred and score of whole texts."""
    found = [posteriors_of(t, model) for t in texts]
    return [(model.labels[int(p.sum(0).argmax())], float(p.sum(0).max() / len(p))) if len(p) else ("und", 0.0) for p in found]


def test_language_query_against_plain_recursions(spark):
    docs = tables(spark, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op9_language"](spark, SF).collect()}
    want = dict(zip(texts, scores_of(texts.values(), model), strict=True))
    assert set(got) == set(want) and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def test_code_switching():
    words = {"x": ["lahon", "lemon", "lasson"], "y": ["grubst", "drabst", "knabst"]}
    rnd = random.Random(1)
    say = lambda lang, n: " ".join(rnd.choice(words[lang]) for _ in range(n))
    model = langid.fit([say(x, 80) for x in "xy" * 20], list("xy" * 20))
    p = langid.posteriors(langid.Features([say("x", 30) + " " + say("y", 30)]), model)
    assert p[:30, 0].min() > 0.5 and p[30:, 1].min() > 0.5 and np.allclose(p.sum(1), 1)


def test_long_texts_are_learned_from(spark):
    words = {"x": ["lahon", "lemon", "lasson"], "y": ["grubst", "drabst", "knabst"]}
    rnd = random.Random(2)
    long = lambda lang: "1 " * 10_000 + " ".join(rnd.choice(words[lang]) for _ in range(4_000))
    rows = [(i, long("x"), "x") for i in range(30)] + [(i, " ".join(rnd.choice(words["y"]) for _ in range(80)), "y") for i in range(30, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()} == {(i, lang) for i, _, lang in rows}
    # long texts alone: none is lost
    assert langid.known(docs.where("lang = 'x'"), 0.3).count() == 30


def test_texts_of_many_languages_are_known(spark):
    words = {"v": ["lahon", "lemon"], "w": ["grubst", "drabst"], "x": ["ouiki", "touiki"], "y": ["zzapa", "ezzapa"]}
    say = lambda lang, n: " ".join(words[lang][i % 2] for i in range(n))
    rows = [(i, say("vwxy"[i % 4], 80), "vwxy"[i % 4]) for i in range(120)] + [(1000, " ".join(say(x, 30) for x in "vwxy"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    mixed = docs.where("doc_id = 1000")
    assert langid.predict(mixed, langid.train(docs)).first().score < 0.3
    assert langid.known(docs, 0.3).where("doc_id = 1000").count() == 1


# --- op10 ----------------------------------------------------------------------------------------------------------


def test_personal_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in QUERIES["op10_personal"](spark, "/root/testdata/sf0.01").collect():
        base = base_spans(texts[r.doc_id])
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[1] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and set(line.split(",")) <= {*r.spans.split(","), ""}


def test_personal_odd(spark, odd, empty):
    got = {r.doc_id: r for r in pii.detect(odd).collect()}
    assert got[1].spans == "" and got[6].spans == "email:300000:300006" and got[6].n_email == 1
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.where("text like '%[EMAIL]'").count() == 1 and pii.detect(empty).count() == 0


def test_long_secrets_and_addresses():
    """Whatever their length, to their end; and a text of many keys in time that grows with it."""
    assert list(pii.proposals("api_key=" + "a1" * 5000)) == [("secret", 8, 10_008, 1)]
    (spelt,) = pii.proposals("b" * 300 + " (at) " + "c" * 100 + " (dot) d" * 9)
    assert spelt == ("email", 0, 300 + 6 + 100 + 72, 1)
    between = "K1" * 20 + " token=abcdefgh " + "Q2" * 20 + " pwd: 'xyz123' " + "R3" * 20
    assert [(a, b) for _, a, b, _ in pii.proposals(between)] == [(0, 40), (47, 55), (56, 96), (103, 109), (111, 151)]
    began = time.time()
    assert len(pii.spans("".join(f"password: hunter{i:06d} and key AKIA{i:032d}\n" for i in range(20_000)))) == 40_000
    assert time.time() - began < 10


def test_looser_spans_are_learned(spark):
    good = [(i, f"mail bob{i}@site.com or call +1 (555) 123-456{i % 10} now") for i in range(50)]
    rows = [*good, (100, "mail ann (at) site (dot) org today"), (101, "call (555) 123-4567 today"), (102, "order no. 1234567890123456 version 1.2.3.999")]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100].spans.startswith("email:") and got[101].spans.startswith("phone:") and got[102].spans == "" and got[100].n_email == 0


def added_by_hand(texts):
    """Spans that the method adds: proposals of its own patterns that overlap nothing before, and that EM and the classifier,
    written out over single spans instead of counts, take."""
    found = {d: pii.spans(t) for d, t in texts.items()}
    every = [pii.decode(s[3]) for x in found.values() for s in x]
    weight, y = {}, {}
    for kind in pii.KINDS:
        v = np.array([x[1] for x in every if x[0] == kind])
        if not len(v):
            continue
        p = 1 / (1 + np.exp(-1.5 * v.sum(1)))
        for _ in range(50):
            t = {(c, j, k): (1 + 2 * (k == (1 if c else -1)) + ((p if c else 1 - p)[v[:, j] == k]).sum()) for c in (0, 1) for j in range(4) for k in (-1, 0, 1)}
            t = {(c, j, k): n / sum(t[c, j, m] for m in (-1, 0, 1)) for (c, j, k), n in t.items()}
            prior = (p.sum() + 1) / (len(p) + 2)
            odds = np.array([np.log(prior / (1 - prior)) + sum(np.log(t[1, j, r[j]] / t[0, j, r[j]]) for j in range(4)) for r in v])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        y |= {(kind, tuple(r)): q for r, q in zip(v.tolist(), p, strict=True)}
    counts = {}
    for k, v, sh in every:
        counts[pii.code(k, v, sh)] = counts.get(pii.code(k, v, sh), 0) + 1
    posterior = {n: y[pii.decode(n)[0], pii.decode(n)[1]] for n in counts}
    beta = pii.classifier(counts, posterior)
    good = lambda c: pii.decode(c)[1][0] == 0 and pii._row(c) @ beta >= 0
    return {d: {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, c, base in x if not base and good(c)} for d, x in found.items()}


def test_added_spans_by_hand(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    want, seen = added_by_hand(texts), 0
    for r in QUERIES["op10_personal"](spark, "/root/testdata/sf0.01").collect():
        base = {f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(texts[r.doc_id])}
        assert {*r.spans.split(",")} - {""} - base == want[r.doc_id] and r.n_added == len(want[r.doc_id]) and r.personal == bool(r.spans)
        seen += r.n_added
        keys = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer('token = "([0-9a-f]{40})"', texts[r.doc_id] or "")}
        assert keys <= {*r.spans.split(","), *[k for k in keys if any(int(b.split(":")[1]) < int(k.split(":")[2]) and int(k.split(":")[1]) < int(b.split(":")[2]) for b in base)]}
    assert seen > 10


def test_failing_matches_take_no_room():
    kinds = {(pii.KINDS[k], a) for a, k, _, c, _ in pii.spans("4112 555-123-4567 or mail bob at example.com") if pii.decode(c)[1][0] == 0}
    assert kinds == {("phone", 5), ("email", 26)}


def test_reliabilities_find_the_bad_labeler():
    rng = np.random.default_rng(0)
    counts = defaultdict(int)
    for _ in range(4000):
        y = rng.random() < 0.6
        vote = [1 if (y if rng.random() < good else not y) else -1 for good in (0.95, 0.9, 0.55, 0.9)]
        counts[pii.code("email", tuple(vote))] += 1
    table = pii.reliabilities(dict(counts))[1]["email"]
    right = [(table[0, j, 0] + table[1, j, 2]) / 2 for j in range(4)]
    assert right[2] < 0.65 and min(right[0], right[1], right[3]) > 0.8


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = tables(spark, "documents")
    want = {r.doc_id: r for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
    assert p.run(spark, SF).select("doc_id").distinct().count() <= len(want)
    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "benchmark", "personal", "pack"]


def masked(text, spans):
    """The text with each run of overlapping spans (start, kind, end) replaced by its first one's kind."""
    runs = []
    for start, kind, end in sorted(spans):
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([start, kind, end])
    for start, kind, end in reversed(runs):
        text = text[:start] + f"[{pii.KINDS[kind].upper()}]" + text[end:]
    return text


def test_pipeline_against_plain_forms(spark, tmp_path):
    """All stages by their brute-force forms, one after the other, on the test table and planted documents."""
    import corpus_pipeline as p

    from test_words import TOKENIZER

    rnd = random.Random(3)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in tables(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in tables(spark, "benchmark").collect()]
    long = [r for r in rows if r[1] and len(r[1].split()) > 60]
    planted = [r[1] for r in long[:5]]
    for _, t, *_ in long[5:15]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        planted.append(" ".join(w))
    planted += [f"{r[1]} {t} {r[1][::-1]}" for r, (_, t) in zip(long[15:25], items, strict=False)]
    planted += [f"{r[1]}\nmail ann{i} (at) site (dot) org or bob{i}@site.com, call +1 (555) 123-45{i:02} from 10.0.0.{i}" for i, r in enumerate(long[25:35])]
    planted += ["", " ", "12 34!", None]
    first = max(r[0] for r in rows) + 1
    rows += [(first + i, t, None, "planted", len(t or "")) for i, t in enumerate(planted)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = {r[0]: (r[1], posteriors_of(r[1], model)) for r in rows}
    least = min(p.LEAST_SCORE, langid.ABOVE_CHANCE / len(model.labels))
    by_language = {d: t for d, (t, x) in found.items() if len(x) and x.max(1).mean() >= least}
    by_copies = {d: by_language[d] for d, (_, _, kept) in near_of(by_language.items(), p.SHINGLE, p.PERCENT).items() if kept}
    by_items = {r[0]: by_copies[r[0]] for r in hits_of(by_copies.items(), items, 10) if not r[5]}
    assert len(rows) > len(by_language) >= len(by_copies) + 14 and len(by_copies) > len(by_items)
    kinds = {k: i for i, k in enumerate(pii.KINDS)}
    added = {d: {(int(a), kinds[k], int(b)) for k, a, b in (x.split(":") for x in v)} for d, v in added_by_hand(by_items).items()}
    texts = {d: masked(t, {*base_spans(t), *added[d]}) for d, t in by_items.items()}
    assert sum(t != by_items[d] for d, t in texts.items()) >= 5

    ids = {d: np.array([*TOKENIZER.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in p.run(spark, str(tmp_path)).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for parts, most in [(pieces[d], len(x)) for d, x in ids.items()] + [(s, None) for s in sequences.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == most if most else at == 4096 or at & (at - 1) == 0


def test_pipeline_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline as p

    def saved(docs, name, items):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        items.write.parquet(str(tmp_path / name / "benchmark.parquet"))
        return str(tmp_path / name)

    items = spark.createDataFrame([(1, "some words"), (2, None)], "item_id long, text string")
    got = p.run(spark, saved(odd, "odd", items)).collect()
    assert {r.doc_id for r in got} <= {4, 6} and {r.doc_id for r in got if r.start == 0} == {4, 6} and sum(r.doc_id == 4 for r in got) == 1
    assert p.run(spark, saved(empty, "empty", items)).count() == 0
    clash = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(1).alias("ids"), F.lit("x").alias("n_hit"), F.lit(2).alias("component_id"), F.lit("y").alias("found"))
    plain = p.run(spark, saved(clash, "clash", items.limit(0)))
    assert {r.doc_id for r in plain.where("start = 0").collect()} == {4, 6, None}
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, clash, str(tmp_path / "clash")).columns == clash.columns
