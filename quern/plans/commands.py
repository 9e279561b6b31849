"""Commands with exit codes: 0 all is well, 1 an error, 2 a gate or job failed, 3 time ran out.

``python -m quern.plans.commands COMMAND ...`` with a Spark session of the environment's settings.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import keep
from ..functions import lexicon as lex
from ..functions import messages, prompts, text
from ..functions.scoring import Vocabulary
from ..operators import audit, decide, evals, pairwise, validate
from ..operators import generate as calls
from ..sources import readers, sinks
from ..streaming import snapshots
from . import curation

OK, ERROR, REFUSED, LATE = 0, 1, 2, 3

MASTER = """source_recipe_id string, template_id string, kept_for_training boolean,
 audit_scores struct<constraint_pass:int,semantic_completeness_pass:int,relevance_score:double,nontriviality_score:double,completeness_failures:array<string>>,
 messages array<struct<role:string,content:string>>"""
RESULT = "row_id string, judge double, constraint_pass boolean, format_pass boolean"


def _kept(spark: SparkSession, path: str) -> DataFrame:
    return readers.jsonl(spark, path, MASTER).withColumn("kept", F.coalesce("kept_for_training", F.lit(True)))


def ingest(spark: SparkSession, a) -> int:
    """A recipe CSV to a pool of sources."""
    lexicon = readers.lexicon(spark, a.lexicon)
    n = len(lexicon.terms)
    pool, summary = curation.ingest(spark, a.csv, lexicon, json.loads(a.shares) if a.shares else dict.fromkeys(lexicon.terms, 1 / n), a.target_size, a.seed)
    pool.write.mode("overwrite").parquet(a.out)
    print(summary.toJSON().first())
    return OK


def generate(spark: SparkSession, a) -> int:
    """Scored candidates of a pool, up to --target-pairs kept ones; with --resume those that are not done, counting the kept ones there are."""
    lexicon = readers.lexicon(spark, a.lexicon)
    vocabulary = readers.vocabulary(spark, a.vocabulary) if a.vocabulary else Vocabulary()
    pool, systems, limits = spark.read.parquet(a.pool), readers.document(spark, a.systems), {"in_flight": a.concurrency, "timeout": a.timeout}
    have = readers.routed(spark, a.out, f"id {dict(pool.dtypes)['id']}")
    done, kept = ((have,), have.where("kept").count()) if a.resume else ((), 0)
    if a.target_pairs is None:
        scored = curation.run_generation(pool, lexicon, vocabulary, systems, done=done, **limits)
    else:
        scored = curation.generate_until(pool, lexicon, vocabulary, systems, max(0, a.target_pairs - kept), done, a.seed, **limits)
    sinks.routed(scored, a.out, a.resume)
    return OK


def gate(spark: SparkSession, a) -> int:
    """The quality gate on a master file: 2 where it does not pass."""
    s = F.col("audit_scores")
    rows = _kept(spark, a.master).select("kept", s["constraint_pass"].alias("constraint_pass"), s["semantic_completeness_pass"].alias("semantic_pass"), (F.size(F.coalesce(s["completeness_failures"], F.array().cast("array<string>"))) == 0).alias("complete"), s["relevance_score"].alias("relevance"), s["nontriviality_score"].alias("nontriviality"), F.col("template_id").alias("template"))
    report = audit.gate_report(audit.metrics(rows)).first()
    for line in report["failures"]:
        print(line, file=sys.stderr)
    return OK if report["gate_passed"] else REFUSED


def export(spark: SparkSession, a) -> int:
    """Kept rows' messages by split."""
    for r in curation.export(_kept(spark, a.master).withColumnRenamed("source_recipe_id", "id"), a.out, a.valid_fraction, a.seed).collect():
        print(r["split"], r["n"])
    return OK


def check_gate(spark: SparkSession, a) -> int:
    """A gate report of any known form: 2 where a check fails."""
    report = spark.createDataFrame([(json.dumps(readers.document(spark, a.report)),)], "document string")
    kept = decide.Requirement("kept_rows", decide.KEPT.keys, a.target_kept_rows, is_rate=False)
    rows = decide.check_report(report, kept).collect()
    for r in rows:
        print(r["status"], r["check"], r["value"])
    return REFUSED if any(r["status"] == "FAIL" for r in rows) else OK


def preflight(spark: SparkSession, a) -> int:
    """JSON Lines files for training: 1 where one has errors, no records, or is too large (the validation file alone)."""
    bad = 0
    for path, most in ((a.train, 1 << 62), (a.valid, a.max_validation_bytes)):
        checked = validate.validate_lines(readers.lines(spark, path))
        sizes = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
        for r in validate.first_errors(checked, a.show_errors).collect():
            print(f"{r['path']}:{r['line']} {r['error']}", file=sys.stderr)
        bad += validate.preflight(validate.file_stats(checked), sizes, most).where("not passed").count()
    return ERROR if bad else OK


def evaluate(spark: SparkSession, a) -> int:
    """Format and restriction checks of outputs, and their summary."""
    shape = "row_id string, output_text string, restrictions array<string>, judge double, tokens_in long, tokens_out long"
    rows = readers.jsonl(spark, a.rows, shape)
    if a.limit is not None:
        rows = rows.orderBy("path", "line").limit(max(0, a.limit))
    done, summary = curation.evaluate(rows, readers.lexicon(spark, a.lexicon), input_price=a.input_price, output_price=a.output_price)
    sinks.jsonl(done.drop("path", "line"), a.out, ascii_only=True)
    print(summary.toJSON().first())
    return OK


def evaluate_endpoint(spark: SparkSession, a) -> int:
    """Chat rows sent to an endpoint (its errors are outputs too), checked and summed up."""
    rows = readers.jsonl(spark, a.rows, "row_id string, id string, restrictions array<string>, target_restrictions array<string>, messages array<struct<role:string,content:string>>")
    if a.limit is not None:
        rows = rows.orderBy("path", "line").limit(max(0, a.limit))
    text = messages.user_text(messages.valid(F.col("messages")))
    names = messages.restrictions([(F.col(c), "array<string>") for c in ("target_restrictions", "restrictions")], text)
    todo = rows.where(text != "").select(messages.row_id([F.col("row_id"), F.col("id")], F.col("line")).alias("row_id"), names.alias("restrictions"), F.lit("").alias("system"), prompts.endpoint_message(text, names).alias("user"), F.lit(a.max_tokens).alias("max_tokens"))
    module, _, name = a.provider.partition(":")
    done = calls.call_model(todo, getattr(importlib.import_module(module), name), batch=1, in_flight=a.concurrency, timeout=a.timeout)
    none = F.lit(None)
    outputs = keep(done.select("row_id", "restrictions", calls.scored_output(F.col("output"), F.col("error")).alias("output_text"), none.cast("double").alias("judge"), none.cast("long").alias("tokens_in"), none.cast("long").alias("tokens_out"), F.col("error").isNotNull().alias("failed")))
    checked, summary = curation.evaluate(outputs, readers.lexicon(spark, a.lexicon))
    sinks.jsonl(checked, f"{a.out}/rows", ascii_only=True)
    sinks.document(summary.crossJoin(outputs.agg(F.count_if("failed").alias("endpoint_errors"))), f"{a.out}/metrics.json")  # one row and one row
    return OK


def suggest(spark: SparkSession, a) -> int:
    """What a coverage check's gaps would add to a lexicon, constraint by constraint in the lexicon's order."""
    lexicon = readers.lexicon(spark, a.lexicon)
    units = readers.vocabulary(spark, a.vocabulary).units if a.vocabulary else ()
    found = readers.document(spark, a.summary).get("constraints_coverage_check") or {}
    gaps = [(c, i, g) for c in lexicon.terms if c in found for i, g in enumerate(found[c].get("potential_gaps_sample", []))]
    named = spark.createDataFrame(gaps, "constraint string, place int, raw string").withColumn("item", text.strip_quantity(F.col("raw"), units))
    rows = lex.triage(named, lexicon).orderBy("constraint", "place").collect()
    for c in lexicon.terms:
        if c not in found:
            print(f"[{c}] not in the coverage check")
            continue
        print(f"[{c}] {found[c].get('matched_ingredients', 0)} matched, {found[c].get('potential_gaps_count', 0)} gaps")
        for r in (r for r in rows if r["constraint"] == c):
            print(f"  {r['status']}: {r['item']} ({r['raw']})")
    return OK


def decision(spark: SparkSession, a) -> int:
    """A report on whether to go on with a tuned model, from two runs' metrics and their comparison; 2 where not."""
    runs = [readers.optional_document(spark, p).get("summary") or {} for p in (a.baseline, a.candidate)]
    wins = (readers.optional_document(spark, a.comparison).get("summary") or {}).get("hard_case_win_rate")
    frame = lambda d: spark.createDataFrame([tuple(_real(d.get(k)) for k in _METRICS)], ", ".join(f"{k} double" for k in _METRICS))
    won = F.lit(_real(wins)).cast("double")
    got = decide.go_or_not(frame(runs[0]), frame(runs[1]), won)
    cost = [_real((d.get("estimated_cost_usd") or {}).get("total_cost")) for d in runs]
    shown = got.select("decision", text.show_delta(F.col("constraint_delta")).alias("constraint"), text.show_score_delta(F.col("judge_delta")).alias("judge"), text.show_float(won).alias("wins"), *[text.show_money(F.lit(c).cast("double")).alias(f"cost_{i}") for i, c in enumerate(cost)]).first()
    go = shown["decision"] == "GO_5A"
    fields = {
        "Inputs": [("Fine-tuned model id", readers.model_name(spark, a.manifest)), ("Baseline metrics", a.baseline), ("Candidate metrics", a.candidate), ("Comparison", a.comparison)],
        "Decision metrics": [("constraint_pass_rate delta", shown["constraint"]), ("average judge score delta", shown["judge"]), ("hard_case_win_rate", shown["wins"]), ("Cost (baseline / candidate)", f"{shown['cost_0']} / {shown['cost_1']}")],
        "Result": [("Condition met", go), ("Decision", shown["decision"])],
    }
    sinks.write_text(spark, a.out, sinks.report("Decision", fields))
    return OK if go else REFUSED


_METRICS = ("constraint_pass_rate", "judge_average", "judge_average_scored")


def _real(v) -> float | None:
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else None


def compare(spark: SparkSession, a) -> int:
    """Two runs row by row; their rows must be the same."""
    rows, summary, lost = curation.compare(*(readers.jsonl(spark, p, RESULT) for p in (a.baseline, a.candidate)), a.min_win_delta)
    sinks.jsonl(rows, a.out)
    print(summary.toJSON().first())
    return OK if lost.isEmpty() else ERROR


def watch(spark: SparkSession, a, fetch: Callable[[], dict] | None = None, sleep=time.sleep, clock=time.monotonic) -> int:
    """Poll a job's status with growing waits, appending snapshots: 0 where it ends well, 2 where not, 3 when time is up.

    ``fetch`` gives the status (a map with ``status`` and ``id``); by default it is read from the file ``--status``.
    """
    fetch = fetch or (lambda: readers.document(spark, a.status))
    wait, began, polls = max(1.0, a.interval_seconds), clock(), 0
    while True:
        polls += 1
        now = fetch()
        status = str(now.get("status") or "UNKNOWN")
        row = spark.createDataFrame([(polls, status, str(now.get("id") or "") or None, json.dumps(now))], "poll_index int, status string, job_id string, payload string")
        sinks.append_snapshot(row.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("captured_at"), "*").coalesce(1), a.out)
        if status.lower() in snapshots.TERMINAL:
            return OK if status.lower() in snapshots.GOOD else REFUSED
        left = a.max_wait_seconds - (clock() - began)
        if left <= 0:
            return LATE
        sleep(min(wait, max(1.0, left)))
        wait = min(max(1.0, a.max_interval_seconds), wait * max(1.0, a.backoff))


def prelaunch(spark: SparkSession, a) -> int:
    """Checks before a launch, from a JSON Lines file of facts: 1 where one fails."""
    rows = decide.launch_checks(readers.jsonl(spark, a.facts, "kind string, name string, value string, other string, required boolean"))
    for r in rows.collect():
        print(f"[{r['status']}] {r['check']}")
    print(decide.status_counts(rows).toJSON().first())
    return ERROR if not rows.where("status = 'FAIL'").isEmpty() else OK


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def command(run, *options: tuple) -> None:
        p = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        p.set_defaults(run=run)
        for name, *kind in options:
            p.add_argument(name, **(kind[0] if kind else {"required": True} if name.startswith("--") else {}))

    number = lambda kind, default: {"type": kind, "default": default}
    command(ingest, ("csv",), ("out",), ("--lexicon",), ("--shares", {"default": None}), ("--target-size", number(int, 2400)), ("--seed", number(int, 42)))
    command(generate, ("pool",), ("out",), ("--lexicon",), ("--systems",), ("--vocabulary", {"default": None}), ("--resume", {"action": "store_true"}), ("--target-pairs", number(int, None)), ("--concurrency", number(int, calls.IN_FLIGHT)), ("--timeout", number(float, calls.TIMEOUT)), ("--seed", number(int, 42)))
    command(gate, ("--master",))
    command(export, ("out",), ("--master",), ("--valid-fraction", number(float, 0.1)), ("--seed", number(int, 42)))
    command(check_gate, ("report",), ("--target-kept-rows", number(int, 1200)))
    command(preflight, ("train",), ("valid",), ("--max-validation-bytes", number(int, 1 << 20)), ("--show-errors", number(int, 20)))
    command(evaluate, ("rows",), ("out",), ("--lexicon",), ("--limit", number(int, None)), ("--input-price", number(float, 0.0)), ("--output-price", number(float, 0.0)))
    command(evaluate_endpoint, ("rows",), ("out",), ("--lexicon",), ("--limit", number(int, None)), ("--provider", {"default": "quern.operators.generate:mock"}), ("--max-tokens", number(int, 1024)), ("--concurrency", number(int, calls.IN_FLIGHT)), ("--timeout", number(float, calls.TIMEOUT)))
    command(suggest, ("summary",), ("--lexicon",), ("--vocabulary", {"default": None}))
    command(decision, ("baseline",), ("candidate",), ("comparison",), ("manifest",), ("out",))
    command(compare, ("baseline",), ("candidate",), ("out",), ("--min-win-delta", number(float, 0.0)))
    command(watch, ("status",), ("out",), ("--interval-seconds", number(float, 30.0)), ("--backoff", number(float, 1.3)), ("--max-interval-seconds", number(float, 120.0)), ("--max-wait-seconds", number(float, 7200.0)))
    command(prelaunch, ("facts",))
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(spark or SparkSession.builder.getOrCreate(), a)
    except (ValueError, OSError, AnalysisException) as e:  # unreadable or missing input, missing columns, repeated ids
        print(f"error: {e}", file=sys.stderr)
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
