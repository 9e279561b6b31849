"""Sketches, totals and anchors on awkward rows."""

import numpy as np
from pyspark.sql import functions as F

from quern.functions.scoring import Vocabulary
from quern.operators import anchors, audit, decide, sketches


def test_sketches_merge(spark):
    rows = spark.range(20_000).select((F.col("id") % 7).alias("day"), (F.col("id") % 2).alias("kind"), F.when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") % 10 != 4, F.col("id") * 1.5).alias("v"))
    rows = rows.unionAll(spark.createDataFrame([(0, 2, None), (1, 2, float("nan"))], "day long, kind long, v double"))
    got = sketches.quantiles(sketches.merged(sketches.sketched(rows, [F.col("day"), F.col("kind")], F.col("v")), [F.col("kind")]), {"low": 0.1, "mid": 0.5, "high": 0.99})
    for r in got.collect():
        if r.kind == 2:
            assert r.n == 0 and r.mid is None
            continue
        values = np.array([i * 1.5 for i in range(20_000) if i % 2 == r.kind and i % 10 not in (3, 4)])
        assert r.n == len(values) and all(abs((values <= x).mean() - p) < 0.01 for x, p in ((r.low, 0.1), (r.mid, 0.5), (r.high, 0.99)))
    assert sketches.merged(sketches.sketched(rows.limit(0), [F.col("day"), F.col("kind")], F.col("v")), [F.col("kind")]).count() == 0


def test_totals_and_nulls(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), (None, "x"), (None, None)], "r string, c string")
    got = {(r.r, r.c, r.level): r.n for r in audit.cross_totals(rows, "r", "c").collect()}
    assert got == {("a", "x", 0): 1, ("a", None, 0): 1, (None, "x", 0): 1, (None, None, 0): 1, ("a", None, 1): 2, (None, None, 1): 2, (None, "x", 2): 2, (None, None, 2): 2, (None, None, 3): 4}


def test_anchors(spark):
    pairs = spark.createDataFrame([(1, "vegan", "2 cups Milk", "Oat Milk", 7), (1, "vegan", "milk", "water", 8), (1, "vegan", "egg", "oat milks", 9), (2, "vegan", "milk", "oat milk", 1), (1, None, "milk", "oat milk", 2), (1, "dairy", None, "", 3), (1, "vegan", "2 cups Milk", "Oat Milk", 7)], "id int, constraint string, `from` string, to string, anchored int")
    items = spark.createDataFrame([(1, "1 cup milk"), (1, "3 cups MILK (cold)"), (2, "flour"), (3, None)], "id int, item string")
    rules = spark.createDataFrame([("vegan", "oat milk"), ("vegan", "**oat milk**"), ("dairy", "water"), (None, "oat milk")], "constraint string, replacement string")
    rows = anchors.anchored(pairs.drop("anchored"), items, rules, Vocabulary(("cups", "cup")))
    got = sorted((r.id, str(r.constraint), str(r["from"]), r.from_grounded, r.to_valid, r.anchored) for r in rows.collect())
    assert got == [(1, "None", "milk", True, False, False), (1, "dairy", "None", False, False, False), (1, "vegan", "2 cups Milk", True, True, True), (1, "vegan", "2 cups Milk", True, True, True), (1, "vegan", "egg", False, True, False), (1, "vegan", "milk", True, False, False), (2, "vegan", "milk", False, True, False)]
    assert {r.constraint: r.swap_anchor_rate for r in anchors.anchor_rate(rows, F.col("constraint")).collect()} == {"vegan": 0.4, "dairy": 0.0, None: 0.0}
    assert anchors.anchor_rate(rows.limit(0)).first().swap_anchor_rate is None


def test_launch_checks_of_all_kinds(spark):
    facts = [("set", "key", "abc", None, True), ("set", "no_key", " ", None, True), ("path", "quick", "false", None, False), ("path", "late", None, None, None), ("manifest", "none", None, None, False), ("manifest", "bad", "[1]", None, True), ("split", "differ", "a", " b", True), ("split", "same", "a", "a", True), ("split", "agreed", "yes", None, True), ("what", "x", "y", None, True)]
    got = decide.launch_checks(spark.createDataFrame(facts, "kind string, name string, value string, other string, required boolean"))
    assert [(r.check, r.status) for r in got.collect()] == [("key", "PASS"), ("no_key", "FAIL"), ("quick", "WARN"), ("late", "FAIL"), ("none", "SKIP"), ("bad", "FAIL"), ("differ", "PASS"), ("same", "FAIL"), ("agreed", "PASS"), ("x", "SKIP")]
