"""Decisions over one-row reports: gate re-evaluation, template mix, go or no go, launch checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_keys, float_like, plain, rate, strip, truthy


@dataclass(frozen=True)
class Requirement:
    name: str
    keys: tuple[str, ...]  # names that reports of several kinds have for it
    least: float
    is_rate: bool = True
    optional: bool = False  # a miss only warns


# What a gate report must show, and words and flags of its own verdict.
KEPT = Requirement("kept_rows", ("kept_rows", "final_kept_rows", "train_rows_kept"), 1200, is_rate=False)
REQUIREMENTS = (
    Requirement("constraint_pass_rate", ("constraint_pass_rate_on_kept", "metrics.constraint_pass_rate_on_kept", "metrics.constraint_pass_rate"), 0.98),
    Requirement("semantic_completeness", ("semantic_completeness_pass_rate_on_kept", "metrics.semantic_completeness_pass_rate_on_kept"), 1.0),
    Requirement("completeness", ("assistant_completeness_validation_pass_rate_on_kept", "metrics.assistant_completeness_validation_pass_rate_on_kept"), 1.0),
    Requirement("mean_relevance", ("mean_relevance_score_on_kept", "mean_relevance_on_kept", "metrics.mean_relevance_score_on_kept", "metrics.mean_relevance_on_kept"), 0.55),
    Requirement("nontriviality", ("nontriviality_pass_rate_on_kept", "nontrivial_adaptation_pass_rate_on_kept", "nontrivial_pass_rate_on_kept", "metrics.nontriviality_pass_rate_on_kept", "metrics.nontrivial_pass_rate_on_kept", "metrics.nontrivial_pass_rate"), 0.90),
    Requirement("spot_check", ("manual_10_row_pre_ft_spotcheck_pass_rate", "manual_10_row_spotcheck_pass_rate", "metrics.manual_10_row_pre_ft_spotcheck_pass_rate"), 0.80, optional=True),
)
DECISION = ("decision", "gate_status")
FLAGS = ("gate_passed", "quality_gate_pass", "gate_pass", "quality_gate_ok", "all_quality_gates_passed")
_PASS, _FAIL = ("GO", "PASS", "READY", "READY_FOR_FT", "GO_FT"), ("NO_GO", "FAIL", "FAILED")
MIX = {"A": 0.5, "B": 0.3, "C": 0.2}
DISTRIBUTION = ("template_distribution_on_kept", "template_distribution", "metrics.template_distribution_on_kept", "metrics.template_distribution")


def _fraction(t: str) -> tuple[str, ...]:
    return f"template_{t.lower()}_fraction", f"metrics.template_{t.lower()}_fraction"


def _number(json: Column) -> Column:
    """A JSON number, or a string of one with thousands commas or not; booleans and all else are null."""
    return F.when(~F.rlike(json, F.lit("^(?:true|false)$")), float_like(plain(json)))


def check_report(report: DataFrame, kept: Requirement = KEPT, requirements: tuple[Requirement, ...] = REQUIREMENTS, mix: dict[str, float] = MIX, tolerance: float = 0.1, document: str = "document") -> DataFrame:
    """The columns of ``report`` but its document, and check, value, status (PASS, FAIL, WARN or SKIP): a row for each
    check of each report document, of any known form and nesting.

    Decision words and flags can only fail the gate: where one of them fails, the other checks are skipped. The mix of
    templates is taken from fractions, else from a distribution normalised to sum 1.
    """
    text = F.col(document)
    found = {"decision": DECISION, **{f"flag_{f}": (f,) for f in FLAGS}, **{r.name: r.keys for r in (kept, *requirements)}, **{f"fraction_{t}": _fraction(t) for t in mix}, "distribution": DISTRIBUTION}
    names = [c for c in report.columns if c != document]
    got = report.select(*names, find_keys(text, {f"_{n}": keys for n, keys in found.items()}).alias("_found")).select(*names, "_found.*")
    at = lambda n: F.col(f"_{n}")
    word = F.upper(strip(F.when(F.startswith(at("decision"), F.lit('"')), plain(at("decision")))))
    refused = F.coalesce(word.isin(*_FAIL), F.lit(False)) | F.coalesce(F.greatest(*[(at(f"flag_{f}") == "false").cast("int") for f in FLAGS]) == 1, F.lit(False))
    agreed = F.coalesce(F.greatest(*[(at(f"flag_{f}") == "true").cast("int") for f in FLAGS]) == 1, F.lit(False))
    row = lambda name, value, status: F.struct(F.lit(name).alias("check"), value.cast("string").alias("value"), status.alias("status"))
    flagged = F.coalesce(F.greatest(*[(at(f"flag_{f}") == "false").cast("int") for f in FLAGS]) == 1, F.lit(False))
    rows = [
        row("decision", word, F.when(word.isin(*_FAIL), "FAIL").when(word.isin(*_PASS), "PASS").otherwise("SKIP")),
        row("flag", F.when(flagged, "false").when(agreed, "true"), F.when(flagged, "FAIL").when(agreed, "PASS").otherwise("SKIP")),
    ]
    unless = lambda status: F.when(refused, "SKIP").otherwise(status)
    for r in (kept, *requirements):
        v = _number(at(r.name))
        v = F.bround(rate(v), 4) if r.is_rate else F.when(v == F.floor(v), v)
        rows.append(row(r.name, v, unless(F.when(v >= r.least, "PASS").otherwise("WARN" if r.optional else "FAIL"))))
    some = F.greatest(*[at(f"fraction_{t}").isNotNull() for t in mix], F.lit(False))
    count = {t: _number(F.to_json(F.try_variant_get(F.try_parse_json(at("distribution")), f"$.{t}", "variant"))) for t in mix}
    total = sum(count.values())
    for t, want in mix.items():
        v = F.when(some, rate(_number(at(f"fraction_{t}")))).otherwise(F.when(F.least(*count.values()) >= 0, F.try_divide(count[t], total)))
        rows.append(row(f"template_{t.lower()}", F.bround(v, 4), unless(F.when(F.abs(v - want) <= tolerance + 1e-9, "PASS").otherwise("FAIL"))))
    return got.select(*names, F.explode(F.array(*rows)).alias("c")).select(*names, "c.*")


def template_mix(shares: DataFrame, target: dict[str, float], tolerance: float = 0.1) -> DataFrame:
    """template, share, within: ``shares`` (template, n: counts or fractions) against targets, normalised to sum 1."""
    want = F.create_map(*[F.lit(x) for pair in sorted(target.items()) for x in pair])
    total = shares.agg(F.sum("n").alias("total"))
    share = F.try_divide(F.col("n"), F.col("total"))
    return shares.crossJoin(F.broadcast(total)).select("template", F.bround(share, 4).alias("share"), (F.abs(share - F.element_at(want, F.col("template"))) <= tolerance + 1e-9).alias("within"))


def judge_score(document: Column) -> Column:
    """The headline average, else the one over scored rows."""
    return F.coalesce(float_like(F.get_json_object(document, "$.judge_average")), float_like(F.get_json_object(document, "$.judge_average_scored")))


def go_or_not(baseline: DataFrame, candidate: DataFrame, win_rate: Column | None = None, constraint: float = 0.05, judge: float = 0.5, wins: float = 0.6) -> DataFrame:
    """One row: the metrics' differences and GO_5A or RUN_5B, from two one-row summaries side by side."""
    a = baseline.select(F.col("constraint_pass_rate").alias("ca"), F.coalesce("judge_average", "judge_average_scored").alias("ja"))
    b = candidate.select(F.col("constraint_pass_rate").alias("cb"), F.coalesce("judge_average", "judge_average_scored").alias("jb"))
    both = a.crossJoin(b)  # one row and one row
    dc, dj = F.col("cb") - F.col("ca"), F.col("jb") - F.col("ja")
    yes = lambda c: F.coalesce(c, F.lit(False))
    won = win_rate if win_rate is not None else F.lit(None).cast("double")
    go = yes(dc >= constraint) | yes(dj >= judge) | yes(won >= wins)
    return both.select(F.bround(dc, 4).alias("constraint_delta"), F.bround(dj, 4).alias("judge_delta"), F.when(go, "GO_5A").otherwise("RUN_5B").alias("decision"))


def status_counts(checks: DataFrame) -> DataFrame:
    """PASS, FAIL, WARN, SKIP: one row, all present."""
    return checks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("PASS", "FAIL", "WARN", "SKIP")])


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """``requests`` (key and others) with the cache's ``output`` (null: to be computed)."""
    return requests.join(cache.select("key", "output"), "key", "left")


def launch_checks(facts: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``check`` and ``status`` of what must hold before a launch, from ``facts`` (kind, name, value, other, required): one
    row each.

    set: ``value`` is not blank; path: ``value`` says that it exists (true; a missing one that is not required warns);
    gate: ``value`` says that the gate passed; manifest: ``value`` is its text (null: none; skipped where not required),
    whose root must be an object; split: ``value`` and ``other`` are two labels that must differ, or one truthy word.
    """
    v, o, need = strip(F.col("value")), strip(F.col("other")), F.coalesce("required", F.lit(True))
    yes = F.coalesce(truthy(F.col("value")), F.lit(False))
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    document = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col("value"))).startswith("OBJECT"), F.lit(False))
    passed = lambda c: F.when(c, "PASS").otherwise("FAIL")
    status = (
        F.when(F.col("kind") == "set", passed(filled(v)))
        .when(F.col("kind") == "path", F.when(yes, "PASS").when(need, "FAIL").otherwise("WARN"))
        .when(F.col("kind") == "gate", passed(yes))
        .when(F.col("kind") == "manifest", F.when(F.col("value").isNull(), F.when(need, "FAIL").otherwise("SKIP")).otherwise(passed(document)))
        .when(F.col("kind") == "split", F.when(filled(v) & filled(o), passed(v != o)).otherwise(passed(yes)))
        .otherwise("SKIP")
    )
    return facts.select(*keep, F.col("name").alias("check"), status.alias("status"))
