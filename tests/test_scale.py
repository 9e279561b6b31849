"""Work that grows no faster than its input, and lies in as many tasks as there are cores."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from quern.catalogue import QUERIES
from quern.common import keep
from quern.functions import hashing, lexicon, scoring, sections, text
from quern.operators import select
from quern.sources import quoted

from compare import SF


@pytest.mark.parametrize("name", ["table_pairs", "prose_pairs", "completeness", "endpoint_rows", "master_rows", "audit_scores", "export_text", "parsed_response", "section_split", "section_format", "arrow_pairs", "normalize_item", "nested_keys"])
def test_parts_go_to_all_tasks(spark, name):
    assert QUERIES[name](spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_long_table(spark):
    n = 1500
    table = "x\n| Ingredient | Swap |\n|---|---|\n" + "\n".join(f"| **a{i}** | b{i} |" for i in range(n)) + "\nend\n| c | d |"
    began = time.monotonic()
    got = spark.createDataFrame([(table,), (None,), ("| Original | Swap |",), ("no table",)], "t string").select(sections.table_pairs(F.col("t")).alias("p")).collect()
    assert [[(p["from"], p["to"]) for p in r.p] for r in got] == [[(f"a{i}", f"b{i}") for i in range(n)], [], [], []]
    assert time.monotonic() - began < 20


def test_plan_words_once(spark):
    plan = "- ring -> band\n" * 10_000 + "- red-hot -> x"
    row = spark.createDataFrame([(plan, ["blue rods"] * 400 + ["the red hot one"])], "plan string, said array<string>")
    parsed = F.struct(F.col("plan"), F.array(F.lit("1 cup x")).alias("ingredients"), F.array().cast(sections.PAIR).alias("pairs"))
    found = F.transform("said", lambda s: F.struct(s.alias("ingredient")))
    began = time.monotonic()
    got = row.select(scoring.completeness_failures(F.lit("t"), parsed, found, scoring.Vocabulary()).alias("f")).first().f
    assert got == ["violation_unmapped_in_substitution_plan: blue rods"] * 400 and time.monotonic() - began < 10


def test_strip_takes_all_white_space(spark):
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(c, f"{c}{c}a{c}b{c}") for c in chars], "c string, t string")
    bad = rows.select("c", text.strip(F.col("t")).alias("got"), F.regexp_replace("t", r"^(?U)\s+|(?U)\s+$", "").alias("want")).where("got <> want")
    assert bad.collect() == []


def test_small_blocks_share_tasks(spark, tmp_path):
    n = 3000
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(n)))
    got = quoted.scan(spark, str(tmp_path), block=64)
    assert sorted((int(r.a), r.b) for r in got.collect()) == [(i, f"x\n{i}") for i in range(n)]
    assert quoted._lines(spark, str(tmp_path), 64).rdd.getNumPartitions() <= quoted.TASKS < (tmp_path / "a.csv").stat().st_size // 64


def test_quantities_once(spark):
    n = 3000
    rows = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("p"), F.sequence(F.lit(0), F.lit(n - 1)).alias("q"))
    began = time.monotonic()
    got = rows.select("p", F.transform("q", lambda i: i.cast("string")).alias("q")).select(text.combine(F.col("q"), F.col("p")).alias("x")).first().x
    assert got == [f"{i} p{i}" for i in range(n)] and time.monotonic() - began < 5


def test_prompt_made_once(spark):
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"))
    assert [r.c for r in rows.select(scoring.prompt_complete(F.concat(F.lit(""), "id")).alias("c")).collect()] == [0] * 10
    text_of = F.lit("Recipe: x\nIngredients: y\nSteps: z\nRestrictions: w")
    plan = rows.select(scoring.prompt_complete(F.concat(text_of, F.md5(F.col("id").cast("binary")))).alias("c"))
    assert [r.c for r in plan.collect()] == [1] * 10
    assert str(plan._jdf.queryExecution().optimizedPlan()).count("md5(") == 1
    once = rows.select(hashing.template(F.col("id"), F.lit("c")).alias("t"))
    assert str(once._jdf.queryExecution().optimizedPlan()).count("md5(") == 1


def _written(monkeypatch) -> list[int]:
    """Row counts of the tables that selection writes from now on."""
    counts = []

    def counting(df):
        out = keep(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(select, "keep", counting)
    return counts


def test_quotas_write_what_may_count(spark, monkeypatch):
    # each pair twice, and those of one constraint forty times
    n = 20_000
    pairs = spark.range(n).select("id", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("constraint"), F.lit(1).alias("x"))
    again = pairs.where("constraint = 'c' AND id < 500").select("id", "constraint", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("x"))
    candidates = keep(pairs.where("constraint <> 'c'").unionAll(pairs.where("constraint <> 'c'")).unionAll(again).select("id", "constraint"))
    written = _written(monkeypatch)
    got = [(r.id, r.constraint) for r in select.quota_select(candidates, {"a": 50, "b": 30, "c": 450}).collect()]
    assert max(written) < 5000
    taken = {}
    for c, k, ids in (("a", 50, range(n)), ("b", 30, range(n)), ("c", 450, range(500))):
        by = sorted((i for i in ids if i not in taken), key=lambda i: hashlib.md5(f"42:{c}:{i}".encode()).hexdigest())  # noqa: B023
        taken |= dict.fromkeys(by[:k], c)
    assert sorted(got) == sorted(taken.items())
    assert select.quota_select(candidates, {"a": 0, "b": 2}).count() == 2 and select.quota_select(candidates, {}).count() == 0


def test_top_up_writes_what_may_count(spark, monkeypatch):
    n = 20_000
    candidates = keep(spark.range(n).select("id", F.explode(F.array(*[F.lit(c) for c in "bbbbba"])).alias("constraint")))
    first = sorted(range(n), key=lambda i: hashlib.md5(f"42:top-up:{i}".encode()).hexdigest())
    taken = spark.createDataFrame([(i, "a") for i in first[:40]], "id long, constraint string")
    written = _written(monkeypatch)
    got = select.top_up(candidates, taken, 100, ["a", "b"]).collect()
    assert {(r.id, r.constraint) for r in got} == {(i, "a") for i in first[40:140]} and max(written) < 5000
    assert select.top_up(candidates, taken, 10 * n, ["b"]).count() == n - 40 and select.top_up(candidates, taken, 0, ["b"]).count() == 0


def test_items_by_themselves(spark):
    many = {f"k{i}": [f"term{i}x{j}" for j in range(10)] for i in range(30)} | {"hot": ["hot", "hot plate"]}
    for words in (lexicon.Lexicon({"hot": ["hot plate", "hot"], "red": ["red", "(raw)"], "none": []}, ["Hot Plate (appliance)", "red"]), lexicon.Lexicon(many, ["hot plate (appliance)"])):
        lists = [["2 Hot Plates", "hot dog", None], ["a hot plate (appliance)", "x"], ["hot plate (appliance)", "hot"], ["ahot", "hotb", "été hoté"], ["RED (raw)", "bored"], [None, ""], ["term3x7", "a term29x0 b"], []]
        rows = spark.createDataFrame(list(enumerate(lists)), "id long, items array<string>")
        want = {(r.id, r.constraint) for r in lexicon.all_violations(rows.select("id", F.filter("items", lambda x: x.isNotNull()).alias("items")), "items", words).collect()}
        got = lexicon.broken(rows.select("id", F.explode("items").alias("item")), "id", "item", words).collect()
        assert want and {(r.id, r.constraint) for r in got} == want and len(got) == len(want)
    few = lexicon.broken(spark.createDataFrame([(1, "hot"), (1, None), (2, "hot"), (2, "x")], "id long, item string"), "id", "item", words, least=2)
    assert [r.id for r in few.collect()] == [2]


def test_one_combined(spark):
    rows = spark.createDataFrame([("1", "a"), (" NA ", " b "), (None, "c"), ("2", " "), ("3", None), ("\u00a0", "d"), ("nan", "e")], "q string, p string")
    got = rows.select(text.combine_one(F.col("q"), F.col("p")).alias("one"), F.try_element_at(text.combine(F.array("q"), F.array("p")), F.lit(1)).alias("want")).collect()
    assert [r.one for r in got] == [r.want for r in got] == ["1 a", "b", "c", None, None, "d", "e"]
