import hashlib

import pytest
from pyspark.sql import functions as F

from quern.operators import audit, decide, evals, generate, pairwise, recipes, select, validate


def test_split_sizes(spark):
    for n, train in ((0, 0), (1, 1), (10, 9), (1212, 1090)):
        got = {r["split"]: r["count"] for r in select.split(spark.range(n), "id").groupBy("split").count().collect()}
        assert got.get("train", 0) == train and got.get("valid", 0) == n - train


def test_global_rank_is_total(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = sorted((r["k"], r["id"], r["rank"]) for r in select.global_rank(rows, F.col("k"), F.col("id")).collect())
    assert [g[2] for g in got] == list(range(1, 1001))


def test_global_rank_with_sampled_bounds(spark):
    # each input partition holds far more rows than the sampler of bounds takes
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
    try:
        rows = spark.range(0, 20_000, 1, 4).select(F.col("id"), F.xxhash64("id").alias("k"), F.concat(F.lit("x"), F.col("id")).alias("other"))
        got = select.global_rank(rows, F.col("k"), F.col("id")).agg(F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.max("other")).first()
        assert tuple(got) == (20_000, 20_000, 1, 20_000, "x9999")
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")


def test_quotas_take_each_id_once(spark):
    pairs = spark.createDataFrame([(i, c) for i in range(100) for c in ("a", "b") if c == "a" or i % 2], "id long, constraint string")
    got = select.quota_select(pairs, {"a": 60, "b": 60, "c": 5}).collect()
    assert len({r.id for r in got}) == len(got) and sum(r.constraint == "a" for r in got) == 60
    assert sum(r.constraint == "b" for r in got) <= 40
    more = select.top_up(pairs, select.quota_select(pairs, {"b": 10}), 200, ["b", "a"]).collect()
    assert len(more) == 90 and {r.constraint for r in more} == {"a", "b"}


def test_quotas_of_ten_constraints(spark):
    names = [f"c{i}" for i in range(10)]
    pairs = spark.range(3000).select("id", F.explode(F.array(*[F.when((F.col("id") * (i + 3)) % 7 < 3, n) for i, n in enumerate(names)])).alias("constraint")).where("constraint is not null")
    got = select.quota_select(pairs, dict.fromkeys(names, 200))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 10 and len(plan) < 10_000
    by = {}
    for r in pairs.collect():
        by.setdefault(r.constraint, []).append(r.id)
    taken, want = set(), set()
    for n in names:
        key = lambda i: (hashlib.md5(f"42:{n}:{i}".encode()).hexdigest(), i)  # noqa: B023,E731
        mine = sorted((i for i in by[n] if i not in taken), key=key)[:200]
        taken |= set(mine)
        want |= {(i, n) for i in mine}
    assert {(r.id, r.constraint) for r in got.collect()} == want


def test_first_by(spark):
    rows = spark.range(2000).withColumn("h", select.shuffled(F.col("id"))).cache()
    order = [r.id for r in rows.orderBy("h", "id").collect()]
    for n in (0, -3, 1, 777, 2000, 5000):
        assert {r.id for r in select.first_by(rows, F.col("h"), "id", n).collect()} == set(order[: max(0, n)])
    rows.unpersist()


def test_until_target(spark):
    rows = spark.range(10).withColumn("kept", F.col("id") % 2 == 1)
    assert sorted(r.id for r in select.until_target(rows, F.col("kept"), 2, F.col("id")).collect()) == [0, 1, 2, 3]
    assert select.until_target(rows, F.col("kept"), 50, F.col("id")).count() == 10


def _rows(spark, kept, a, b, c):
    values = [(True, 1, 1, True, 0.6, 0.9, t) for t, n in (("A", a), ("B", b), ("C", c)) for _ in range(n)] if kept else []
    return spark.createDataFrame(values, "kept boolean, constraint_pass int, semantic_pass int, complete boolean, relevance double, nontriviality double, template string")


def test_gate_arithmetic(spark):
    # the recorded run: 753, 44 and 262 of 1,059 rows
    m = audit.metrics(_rows(spark, True, 753, 44, 262)).first()
    assert (m.template_a, m.template_b, m.template_c) == (0.711, 0.0415, 0.2474)
    got = {r.metric: r.passed for r in audit.gate(audit.metrics(_rows(spark, True, 753, 44, 262))).collect()}
    assert got["constraint_pass_rate"] and not got["template_a"] and got["template_c"]
    edge = {r.metric: r.passed for r in audit.gate(audit.metrics(_rows(spark, True, 60, 40, 0))).collect()}
    assert edge["template_a"] and edge["template_b"] and not edge["template_c"]


def test_gate_without_rows_fails(spark):
    r = audit.gate_report(audit.metrics(_rows(spark, False, 0, 0, 0))).first()
    assert not r.gate_passed and len(r.failures) == 8


def test_equal_after_rounding(spark):
    one = spark.createDataFrame([(0.99996,)], "x double").select(F.bround("x", 4).alias("x"))
    assert audit.gate(one, (audit.Check("x", "==", 1.0),)).first().passed


def _eval(spark, rows):
    return spark.createDataFrame(rows, "row_id string, format_pass boolean, constraint_pass boolean, judge double, tokens_in long, tokens_out long, restrictions array<string>")


def test_headline_needs_full_coverage(spark):
    r = evals.summary(_eval(spark, [("1", True, None, 7.0, 1, 1, []), ("2", False, None, None, 1, 1, [])])).first()
    assert r.constraint_pass_rate is None and r.judge_average is None and r.judge_average_scored == 7.0 and r.format_pass_rate == 0.5
    assert evals.summary(_eval(spark, [("1", True, True, 7.0, 1, 1, [])])).first().judge_average == 7.0
    assert evals.summary(_eval(spark, [])).first().rows == 0


def test_pairwise(spark):
    kind = "row_id string, judge double, constraint_pass boolean, format_pass boolean"
    a = spark.createDataFrame([("1", 5.0, True, True), (" 2", None, True, True), ("3", None, None, True), ("4", 5.0, True, True)], kind)
    b = spark.createDataFrame([("1", 5.5, True, True), ("2", 7.0, True, True), ("3", 1.0, True, True), ("5", 5.0, True, True)], kind)
    got = {r.row_id: (r.outcome, r.source) for r in pairwise.compare(a, b, 0.5).collect()}
    assert got == {"1": ("tie", "judge"), "2": ("win", "mixed"), "3": ("incomparable", "missing")}
    with pytest.raises(pairwise.DuplicateIds):
        pairwise.require_unique(a.unionAll(a))
    t = pairwise.tally(pairwise.compare(a, b, 0.5), matched=False).first()
    assert (t.wins, t.ties, t.win_rate) == (1, 1, None)


def test_published_pairwise_rate(spark):
    rows = spark.createDataFrame([("win",)] * 13 + [("tie",)] * 37, "outcome string").withColumn("delta", F.lit(0.0)).withColumn("source", F.lit("constraint"))
    t = pairwise.tally(rows).first()
    assert (t.wins, t.losses, t.ties, t.win_rate, t.non_loss_rate) == (13, 0, 37, 0.26, 1.0)


def test_validate(spark):
    lines = ["", "{bad", "[1]", "{}", '{"messages": []}', '{"messages": [1, {"role": "user", "content": "a"}]}', '{"messages": [{"role": "x"}, {"role": "assistant", "content": ["a"]}]}',
             '{"messages": [{"role": "user", "tool_calls": []}, {"role": "assistant", "tool_calls": []}]}', '{"messages": [{"role": "assistant", "content": "a"}]} more']
    df = spark.createDataFrame([("p", i, v) for i, v in enumerate(lines)], "path string, line int, value string")
    checked = validate.validate_lines(df)
    got = {r.line: (r.status, r.errors, r.assistants) for r in checked.collect()}
    assert got[0] == ("blank", ["blank line"], 0) and got[1][0] == "parse_error" and got[2][1] == ["no object"] and got[3][1] == got[4][1] == ["no messages"]
    assert got[5][1] == ["messages[0] is no object", "no assistant message"] and got[6][1] == ["messages[0].role is unknown", "messages[0] has neither content nor tool_calls"]
    assert got[7][1] == ["messages[0] has tool_calls but is no assistant's"] and got[7][2] == 1 and got[8][0] == "parse_error"
    s = validate.file_stats(checked).first()
    assert (s.lines, s.records, s.parse_errors, s.assistants) == (9, 6, 2, 2)


def test_decisions(spark):
    doc = '{"deep": [{"mean_relevance_on_kept": 0.6}], "metrics": {"constraint_pass_rate": 100}, "kept_rows": "1,200", "semantic_completeness_pass_rate_on_kept": 1, "template_distribution": {"A": 5, "B": 3, "C": 2}}'
    got = lambda d: {r.check: r.status for r in decide.check_report(spark.createDataFrame([(d,)], "document string")).collect()}
    assert got(doc) == {"decision": "SKIP", "flag": "SKIP", "kept_rows": "PASS", "constraint_pass_rate": "PASS", "semantic_completeness": "PASS", "completeness": "FAIL", "mean_relevance": "PASS", "nontriviality": "FAIL", "spot_check": "WARN", "template_a": "PASS", "template_b": "PASS", "template_c": "PASS"}
    refused = got(doc[:-1] + ', "decision": "Failed"}')
    assert refused.pop("decision") == "FAIL" and set(refused.values()) == {"SKIP"}
    # no template at all, and one that is negative
    assert got("{}")["template_a"] == "FAIL" == got('{"template_distribution": {"A": 5, "B": 3, "C": -2}}')["template_a"]
    one = lambda c, j: spark.createDataFrame([(c, None, j)], "constraint_pass_rate double, judge_average double, judge_average_scored double")
    assert decide.go_or_not(one(0.1, None), one(0.2, None)).first().decision == "GO_5A"
    assert decide.go_or_not(one(None, 9.0), one(None, 9.2)).first().decision == "RUN_5B"
    assert decide.go_or_not(one(None, None), one(None, None), F.lit(0.6)).first().decision == "GO_5A"


def test_providers(spark):
    df = spark.createDataFrame([("s", f"u{i}", 10) for i in range(5)], "system string, user string, max_tokens int")
    assert generate.call_model(df).where("output is not null and error is null").count() == 5

    def broken(_):
        raise RuntimeError("boom")

    assert {r.error for r in generate.call_model(df, broken).collect()} == {"boom"}
    tries = []

    def flaky(r):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("429 rate limit")
        return ["ok"]

    assert generate.with_retry(flaky, sleep=lambda _: None)([("", "", 1)]) == ["ok"] and len(tries) == 3


def test_recipes(spark):
    raw = spark.createDataFrame([("1", "Pie", "Desserts", 'c("1", "2")', 'c("butter", "flour", "milk")', 'c("mix", "bake")', "0"), ("2", "NA", None, None, 'c("a")', "x", None), ("3", "Few", None, None, 'c("a", "b")', 'c("s", "t")', None)],
                                "id string, name string, category string, quantities string, parts string, instructions string, rating string")
    got = {r.id: r for r in recipes.parse(raw, [("dessert", "Sweet")], [("rich", ["butter"])]).collect()}
    assert got["1"].skip_reason is None and got["1"].cuisine == "Sweet" and got["1"].flavor_notes == ["rich"] and got["1"].rating == 3.0 and got["1"].ingredients == ["1 butter", "2 flour", "milk"]
    assert got["2"].skip_reason == "no_title" and got["3"].skip_reason == "few_ingredients"


def test_reason_of_equal_keys_is_the_first(spark):
    from quern.functions.lexicon import Lexicon, reason

    lex = Lexicon({"v": ["beef"]}, reasons={"v": {"beef": "meat", "clam": "seafood", "stew": "dish"}})
    assert spark.range(1).select(reason(lex, "v", F.lit("beef and clam stew"))).first()[0] == "meat"
