import json
import os

import pytest
from pyspark.sql import functions as F

from quern.functions.lexicon import Lexicon
from quern.functions.scoring import Vocabulary
from quern.plans import curation
from quern.sources import readers, sinks
from quern.streaming import snapshots

CSV = '''RecipeId,Name,RecipeCategory,RecipeIngredientQuantities,RecipeIngredientParts,RecipeInstructions,AggregatedRating
1,Butter Pie,Dessert,"c(""1"", ""2"", ""3"")","c(""butter"", ""flour"", ""sugar"")","c(""Mix."", ""Bake."")",4.5
2,Milk Rice,N/A,"c(""1"", ""2"", ""3"")","c(""milk"", ""rice"", ""salt"")","c(""Boil."", ""Stir."")",NA
3,Soup,Soup,"c(""1"")","c(""water"", ""salt"", ""leek"")","c(""Boil."", ""Serve."")",3
4,,Soup,"c(""1"")","c(""water"", ""salt"", ""leek"")","c(""Boil."", ""Serve."")",3
'''
LEX = Lexicon({"dairy_free": ["butter", "milk"], "low_sugar": ["sugar"]})


def test_columns_resolve_in_any_case():
    assert readers.resolve(["ID", "Title", "Ingredients", "steps"])["parts"] == "Ingredients"
    with pytest.raises(readers.MissingColumns):
        readers.resolve(["id", "name"])


def test_ingest_generate_gate_export(spark, tmp_path):
    path = tmp_path / "recipes.csv"
    path.write_text(CSV)
    pool, summary = curation.ingest(spark, str(path), LEX, {"dairy_free": 0.5, "low_sugar": 0.5}, 4)
    s = summary.first()
    assert (s.raw_rows, s.parsed, s.no_title, s.selected) == (4, 3, 1, 2) and s.template_A + s.template_B + s.template_C == 2
    scored = curation.run_generation(pool, LEX, Vocabulary(("cup",)), dict.fromkeys(("concise", "standard", "rich"), "You adapt recipes."))
    rows = {r.id: r for r in scored.collect()}
    assert set(rows) == {"1", "2"} and all(r.reject_reason for r in rows.values() if not r.kept)
    # resume: what is done is not done again
    assert curation.run_generation(pool, LEX, Vocabulary(), {"standard": "x"}, done=(scored.select("id"),)).count() == 0
    assert curation.gate(scored).count() == 1
    good = scored.withColumn("kept", F.lit(True))
    assert sum(r.n for r in curation.export(good, str(tmp_path / "out")).collect()) == 2
    sinks.routed(scored.select("id", "kept", "reject_reason"), str(tmp_path / "routed"))
    assert spark.read.json(str(tmp_path / "routed")).count() == 2


def test_jsonl_strictness(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [r.a for r in readers.jsonl(spark, str(p), "a int").orderBy("line").collect()] == [1, 2]
    p.write_text('{"a": 1}\n[1]\n{x\n')
    with pytest.raises(readers.BadLines, match=":2"):
        readers.jsonl(spark, str(p), "a int")
    assert readers.jsonl(spark, str(p), "a int", "lenient").count() == 1


def test_small_documents(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert sinks.update_manifest(spark, path, {"job": {"id": 1, "x": 2}}) == {"job": {"id": 1, "x": 2}}
    assert sinks.update_manifest(spark, path, {"job": {"id": 3}, "y": [1]}) == {"job": {"id": 3, "x": 2}, "y": [1]}
    assert readers.optional_document(spark, str(tmp_path / "none.json")) == {}
    one = spark.createDataFrame([(1, "é")], "a int, b string")
    assert sinks.document(one, str(tmp_path / "d.json")) == readers.document(spark, str(tmp_path / "d.json")) == {"a": 1, "b": "é"}
    lex = tmp_path / "lex.json"
    lex.write_text(json.dumps({"_meta": {"known_false_positives": ["a (b)"]}, "vegan": {"banned": ["milk"]}}))
    assert readers.lexicon(spark, str(lex)).terms == {"vegan": ["milk"]}
    assert sinks.markdown("T", one).startswith("# T\n\n| a | b |")


def test_logs(spark, tmp_path):
    (tmp_path / "l.txt").write_text("1.5\nbad\n\n 2 \n")
    assert sorted(r.value for r in readers.number_log(spark, str(tmp_path / "l.txt")).collect()) == [1.5, 2.0]
    (tmp_path / "ig").write_text("# c\n\n*.pt\n!keep\n data/ \n")
    assert sorted(r.pattern for r in readers.ignore_patterns(spark, str(tmp_path / "ig")).collect()) == ["*.pt", "data/"]
    sinks.append_latency(spark.createDataFrame([(1.23456,)], "value double"), str(tmp_path / "lat"))
    assert readers.number_log(spark, str(tmp_path / "lat")).first().value == 1.235
    sinks.jsonl(spark.createDataFrame([("é",)], "a string"), str(tmp_path / "j"), ascii_only=True)
    assert "\\u00E9" in "".join(open(tmp_path / "j" / f).read() for f in os.listdir(tmp_path / "j") if f.endswith(".json"))


def test_snapshot_stream(spark, tmp_path):
    rows = [("2024-01-01T00:00:00Z", 0, "RUNNING", "j", "{}"), ("2024-01-01T00:01:00Z", 1, "running", "j", "{}"), ("2024-01-01T00:02:00Z", 2, "Succeeded", "j", "{}"), ("bad", 3, "x", "j", "{}")]
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("captured_at", "poll_index", "status", "job_id", "payload"), r))) for r in rows))
    q = snapshots.write(snapshots.transitions(snapshots.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.status, r.final) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("running", False), ("succeeded", True)]


def test_line_numbers_across_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(1, 3001)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(1, 11)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = readers.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3010 and all(r.value[1:] == str(r.line) for r in got)


def test_watch_waits_longer_each_time(spark, tmp_path):
    import argparse

    from quern.plans import commands

    states, waits = iter(["RUNNING", "RUNNING", "SUCCESS"]), []
    a = argparse.Namespace(interval_seconds=10.0, backoff=2.0, max_interval_seconds=15.0, max_wait_seconds=1000.0, out=str(tmp_path / "log"))
    assert commands.watch(spark, a, lambda: {"status": next(states), "id": "j"}, waits.append, lambda: 0.0) == 0
    assert waits == [10.0, 15.0] and spark.read.json(a.out).count() == 3


def test_reports_say_what_is_cut(spark):
    text = sinks.markdown("T", spark.range(5), most=3)
    assert text.count("\n| ") == 4 and "more than these 3 rows" in text


def test_commands_over_documents(spark, tmp_path, capsys):
    """Suggestions from gaps, a decision from metrics, and generation up to a target that goes on where it stopped."""
    from quern.plans import commands

    def put(name, d):
        (tmp_path / name).write_text(json.dumps(d))
        return str(tmp_path / name)

    run = lambda *a: commands.main([str(x) for x in a], spark)
    words = put("lexicon.json", {"_meta": {"known_false_positives": ["cream of tartar (powder)"]}, "dairy": {"banned": ["milk"]}, "nuts": {"banned": ["nut"]}})
    names = put("names.json", {"units_to_strip": ["cups", "cup"]})
    summary = put("summary.json", {"constraints_coverage_check": {"dairy": {"matched_ingredients": 3, "potential_gaps_count": 2, "potential_gaps_sample": ["2 cups creamer", "1 cup cream of tartar"]}}})
    assert run("suggest", summary, "--lexicon", words, "--vocabulary", names) == 0
    assert capsys.readouterr().out.splitlines() == ["[dairy] 3 matched, 2 gaps", "  suggest: creamer (2 cups creamer)", "  false_positive: cream of tartar (1 cup cream of tartar)", "[nuts] not in the coverage check"]
    base, good = put("base.json", {"summary": {"constraint_pass_rate": 0.5, "judge_average_scored": 5}}), put("good.json", {"summary": {"constraint_pass_rate": 0.56, "judge_average": 5.1, "estimated_cost_usd": {"total_cost": 0.25}}})
    versus, manifest = put("versus.json", {"summary": {"hard_case_win_rate": True}}), put("manifest.json", {"job": {"fine_tuned_model": "m"}})
    assert run("decision", base, good, versus, manifest, tmp_path / "report.md") == 0
    report = (tmp_path / "report.md").read_text()
    assert "- constraint_pass_rate delta: +6.00%" in report and "- Cost (baseline / candidate): N/A / $0.250000" in report and "- Decision: GO_5A" in report and "- Fine-tuned model id: m" in report
    assert run("decision", base, tmp_path / "none.json", versus, manifest, tmp_path / "report.md") == 2 and "RUN_5B" in (tmp_path / "report.md").read_text()
