"""Large lexicons by the automaton against the patterns, and what they cost."""

import random
import time

from pyspark.sql import functions as F

from quern.functions import automaton, lexicon
from quern.functions.lexicon import Lexicon

PARTS = ["egg", "eggs", "_egg", "2egg", "jalapeño", "jalapeños", "crème", "creme brûlée", "red", "red ring", "ring", "ring rod", "c++", "(x)", "é", "a-b", "b", "x_y", "naïve", "Straße", "½", "٣", "ring."]


def texts(draw, n):
    return ["".join(draw.choice([*PARTS, *PARTS, " ", ", ", "-", "_", "́", "ii", "1"]) + draw.choice(["", " ", " ", "-"]) for _ in range(draw.randrange(9))) for _ in range(n)]


def lexicons():
    terms = {"a": ["egg", "Jalapeño", "red ring", "ring", "ring rod", "c++", "x_y", "½"], "b": ["ring", "red", "creme brûlée", "é", "a-b", "b", "٣"], "c": []}
    return Lexicon(terms, ["hot ring rod", "jalapeños", "ring (x)", "red ring"], {"a": {"ring": "metal"}}), Lexicon(terms)


def test_same_as_patterns(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(i, t, texts(draw, 4)) for i, t in enumerate(texts(draw, 1500))] + [(-1, None, None), (-2, "", [])]
    df = spark.createDataFrame(rows, "id int, text string, items array<string>")

    def all_of(words):
        flat = df.select("id", *[f(F.col("text"), words, c).alias(f"{f.__name__}_{c}") for f in (lexicon.passes, lexicon.occurrences) for c in words.terms], *[lexicon.violations(F.col("items"), words, c).alias(f"v_{c}") for c in words.terms])
        items = df.select(F.explode("items").alias("item"))
        return sorted(map(str, flat.collect())), sorted(map(str, lexicon.all_violations(df, "items", words).collect())), sorted(map(str, lexicon.coverage(items, words, {"a": ["eg", "rin"], "b": ["x"]}).collect()))

    for words in lexicons():
        monkeypatch.setattr(lexicon, "LARGE", 256)
        want = all_of(words)
        monkeypatch.setattr(lexicon, "LARGE", 0)
        got = all_of(words)
        for g, w in zip(got, want, strict=True):
            assert [(x, y) for x, y in zip(g, w, strict=True) if x != y][:3] == []
        assert any("metal" in r for r in want[1]) == bool(words.reasons)


def test_cost_hardly_grows():
    draw = random.Random(3)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(4, 9)))
    every = sorted({word() for _ in range(10_500)})[:10_000]
    draw.shuffle(every)
    said = [" ".join(draw.choice(every[:100]) if draw.random() < 0.01 else word() for _ in range(100)) for _ in range(300)]
    took = []
    for n in (100, 10_000):
        s = automaton.Scanner({"x": every[:n]}, [])
        s.counts(said[0])
        began = time.perf_counter()
        got = [s.counts(t)[0] for t in said]
        took.append(time.perf_counter() - began)
        listed = set(every[:n])
        assert got == [sum(w in listed for w in t.split()) for t in said]
    assert took[1] < 20 * took[0]  # a hundred times the terms
