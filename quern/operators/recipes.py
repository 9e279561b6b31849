"""Recipes: from raw CSV rows to a balanced pool of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..functions.lexicon import Lexicon, all_violations
from .select import quota_select, top_up


def parse(raw: DataFrame, categories: Sequence[tuple[str, str]] = (), signals: Sequence[tuple[str, Sequence[str]]] = (), no_label: Sequence[str] = ("seasoning balance", "dish identity")) -> DataFrame:
    """``raw`` (id, name, category, quantities, parts, instructions, rating) with the parsed fields and ``skip_reason``."""
    parts, steps = text.r_vector(F.col("parts")), text.r_vector(F.col("instructions"))
    rows = raw.select(
        F.col("id").cast("string").alias("id"), text.strip(F.col("name")).alias("title"), "category",
        text.combine(text.r_vector(F.col("quantities")), parts).alias("ingredients"), parts.alias("_parts"), steps.alias("steps"),
        text.rating(F.col("rating")).alias("rating"),
    )
    rows = rows.withColumn("skip_reason", text.skip_reason(F.col("title"), F.col("_parts"), F.col("steps"))).drop("_parts")
    cuisine = text.first_category(F.col("category"), categories, "International")
    return rows.withColumn("cuisine", cuisine).withColumn("flavor_notes", text.labels(F.col("ingredients"), signals, 3, no_label))


def build_pool(recipes: DataFrame, lexicon: Lexicon, quotas: dict[str, int], target: int, seed: int = 42) -> DataFrame:
    """The source pool: each recipe once, for one of the constraints that it violates; quotas by constraint, then a
    top-up to ``target`` from what is left. ``recipes``: id, title, ingredients, steps and others."""
    found = all_violations(recipes.select("id", "ingredients"), "ingredients", lexicon)
    pairs = found.select("id", "constraint")
    taken = quota_select(pairs, quotas, seed)
    short = target - taken.count()
    chosen = taken.unionAll(top_up(pairs, taken, short, list(lexicon.terms), seed)) if short > 0 else taken
    out = recipes.join(chosen, "id").join(found.select("id", "constraint", "violations"), ["id", "constraint"])
    return out.withColumnRenamed("constraint", "target_restriction").withColumn("template_id", hashing.template(F.col("id"), F.col("target_restriction")))


def master_rows(scored: DataFrame, kb_version: str) -> DataFrame:
    """Internal master rows of scored candidates (id, target_restriction, title, ingredients, steps, violations, messages,
    parsed, scores, template_id, richness_tier)."""
    s = F.col("scores")
    kept = (s["constraint_pass"] == 1) & (s["semantic_completeness_pass"] == 1) & (F.size(s["completeness_failures"]) == 0)
    return scored.select(
        F.col("id").alias("source_recipe_id"), F.struct("title", "ingredients", "steps").alias("source_recipe"), F.array("target_restriction").alias("target_restrictions"),
        F.col("violations").alias("detected_violations"), F.col("parsed.pairs").alias("replacement_pairs"), "messages", "template_id", "richness_tier",
        s.alias("audit_scores"), kept.alias("kept_for_training"), F.lit(kb_version).alias("kb_version"), F.col("reject_reason"),
    )
