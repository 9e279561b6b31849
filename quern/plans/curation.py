"""Whole runs: ingest, generate, audit, export, evaluate, compare. Each is a function over frames and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, prompts, scoring, sections
from ..functions.lexicon import Lexicon
from ..operators import audit, evals, generate, pairwise, recipes, select
from ..sources import readers, sinks


def ingest(spark: SparkSession, csv: str, lexicon: Lexicon, shares: dict[str, float], target: int, seed: int = 42, **names) -> tuple[DataFrame, DataFrame]:
    """(pool, one-row summary) of a recipe CSV."""
    parsed = recipes.parse(readers.recipes_csv(spark, csv), **names)
    good = parsed.where("skip_reason is null")
    pool = recipes.build_pool(good, lexicon, select.quotas(target, shares), target, seed)
    counts = parsed.agg(F.count("*").alias("raw_rows"), F.count_if(F.col("skip_reason").isNull()).alias("parsed"), F.count_if(F.col("skip_reason") == "no_title").alias("no_title"), F.count_if(F.col("skip_reason").isin("few_ingredients", "few_steps")).alias("too_short"))
    chosen = pool.agg(F.count("*").alias("selected"), *[F.count_if(F.col("template_id") == t).alias(f"template_{t}") for t in "ABC"])
    return pool, counts.crossJoin(chosen)  # one row and one row


def by_constraint(lexicon: Lexicon, build):
    """A column that depends on the row's constraint, as one case per constraint."""
    out = None
    for c in lexicon.terms:
        out = (F.when if out is None else out.when)(F.col("target_restriction") == c, build(c))
    return out


def score(rows: DataFrame, lexicon: Lexicon, vocabulary: scoring.Vocabulary) -> DataFrame:
    """Rows of a pool with ``output`` and ``user`` get parsed, scores, reject_reason, kept."""
    parsed = rows.withColumn("parsed", sections.parse(F.col("output")))
    s = by_constraint(lexicon, lambda c: scoring.audit_scores(F.col("output"), F.col("user"), F.col("parsed"), F.col("ingredients"), F.col("steps"), F.col("violations"), lexicon, c, vocabulary))
    scored = parsed.withColumn("scores", s).withColumn("reject_reason", F.coalesce(F.when(F.col("output").isNull(), F.lit("api_error")), scoring.reject_reason(F.col("scores"))))
    return scored.withColumn("kept", F.col("reject_reason").isNull())


def run_generation(pool: DataFrame, lexicon: Lexicon, vocabulary: scoring.Vocabulary, systems: dict[str, str], provider: generate.Provider = generate.mock, done: tuple[DataFrame, ...] = (), in_flight: int = generate.IN_FLIGHT, timeout: float = generate.TIMEOUT) -> DataFrame:
    """Scored candidates of a pool: resume, pre-filter, prompt, model, parse, score. Cheap filters come before the model."""
    todo = select.unseen(pool, *done)
    why = by_constraint(lexicon, lambda c: scoring.prefilter_reason(F.col("title"), F.col("ingredients"), F.col("steps"), F.col("violations"), lexicon, c))
    todo = todo.withColumn("reject_reason", why)
    go, stop = todo.where("reject_reason is null").drop("reject_reason"), todo.where("reject_reason is not null")
    go = go.withColumn("richness_tier", hashing.richness(F.col("id"), F.col("target_restriction")))
    user = prompts.user_prompt(F.col("template_id"), F.col("title"), F.col("ingredients"), F.col("steps"), F.col("target_restriction"), F.col("cuisine"), F.col("flavor_notes"))
    go = go.withColumn("user", user).withColumn("system", prompts.by_tier(F.col("richness_tier"), systems)).withColumn("max_tokens", prompts.by_tier(F.col("richness_tier"), prompts.BUDGET))
    scored = score(generate.call_model(go, provider, in_flight=in_flight, timeout=timeout), lexicon, vocabulary)
    scored = scored.withColumn("messages", prompts.export_messages(prompts.chat(F.col("system"), F.col("user")), F.col("parsed")))
    return scored.unionByName(stop.withColumn("kept", F.lit(False)), allowMissingColumns=True)


def generate_until(pool: DataFrame, lexicon: Lexicon, vocabulary: scoring.Vocabulary, systems: dict[str, str], target: int, done: tuple[DataFrame, ...] = (), seed: int = 42, **calls) -> DataFrame:
    """:func:`run_generation` of candidates in shuffled order up to the one with which ``target`` are kept; the model is asked in waves, so
    hardly for more."""
    todo = select.unseen(pool, *done)
    work = lambda rows: run_generation(rows, lexicon, vocabulary, systems, **calls)
    return select.in_waves(todo, work, F.col("kept"), target, select.shuffled(F.col("id"), seed), F.col("id"))


def gate(scored: DataFrame) -> DataFrame:
    s = F.col("scores")
    rows = scored.select("kept", s["constraint_pass"].alias("constraint_pass"), s["semantic_completeness_pass"].alias("semantic_pass"), (F.size(s["completeness_failures"]) == 0).alias("complete"), s["relevance_score"].alias("relevance"), s["nontriviality_score"].alias("nontriviality"), F.col("template_id").alias("template"))
    return audit.metrics(rows)


def export(scored: DataFrame, path: str, valid: float = 0.1, seed: int = 42) -> DataFrame:
    """Write the kept rows' messages by split; returns split counts."""
    rows = select.split(scored.where("kept"), "id", valid, seed)
    sinks.export_messages(rows, path)
    return rows.groupBy("split").agg(F.count("*").alias("n"))


def evaluate(rows: DataFrame, lexicon: Lexicon, **prices: float) -> tuple[DataFrame, DataFrame]:
    done = evals.evaluate(rows, lexicon)
    return done, evals.summary(done, **prices)


def compare(baseline: DataFrame, candidate: DataFrame, delta: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, summary, mismatches); rates are null where the two runs' rows differ."""
    rows, lost = pairwise.compare(baseline, candidate, delta), pairwise.mismatches(baseline, candidate)
    return rows, pairwise.tally(rows, matched=lost.isEmpty()), lost
