"""Scores and checks of a parsed response against its source, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import Lexicon, occurrences, passes, title_terms
from .text import let, normal_item, strip


@dataclass
class Vocabulary:
    """What item names are cleaned of, and what other names they go by."""

    units: Sequence[str] = ()
    adjectives: Sequence[str] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    def name(self, c: Column, aliased: bool = True) -> Column:
        return normal_item(c, self.units, self.adjectives, self.aliases if aliased else None)


# What counts as an amount, and how a plan says that an item stays.
_AMOUNT = r"(?i)\d|(?U)\b(?:cup|tbsp|tsp|tablespoon|teaspoon|oz|lb|g|kg|ml|l|pinch|dash|handful|clove|sprig|bunch|slice|piece)\b"
_STAYS = r"(?iU)\b(?:no\s+change|no\s+substitution|unchanged|keep|remains?|already|compliant|retain(?:ed)?|same|reduce[ds]?|omit(?:ted)?)\b"


def completeness_failures(text: Column, parsed: Column, violations: Column, vocabulary: Vocabulary) -> Column:
    """Reasons why a response is incomplete: an ellipsis; no items, or over half of them without an amount; a
    violation that the plan does not name; a replaced item that is still there."""
    none = F.array().cast("array<string>")
    items = parsed["ingredients"]
    bare = F.filter(items, lambda i: ~F.rlike(i, F.lit(_AMOUNT)))
    amounts = F.when(F.size(items) == 0, F.array(F.lit("adapted_ingredients_empty"))).when(F.size(bare) * 2 > F.size(items), F.array(F.concat(F.lit("adapted_ingredients_missing_quantities ("), F.size(bare).cast("string"), F.lit("/"), F.size(items).cast("string"), F.lit(" lines lack quantities)")))).otherwise(none)

    plan = F.lower(parsed["plan"])
    words = lambda i: F.filter(F.split(i, r"\s+"), lambda w: F.length(w) > 2)
    # the plan's words between borders stand for a test of each word by pattern: a column pattern is compiled per row
    said = F.concat(F.lit(" "), F.regexp_replace(plan, r"(?U)\W+", " "), F.lit(" "))
    named = lambda said, w: F.contains(said, F.concat(F.lit(" "), F.trim(F.regexp_replace(w, r"(?U)\W+", " ")), F.lit(" ")))
    wanted = F.filter(F.transform(violations, lambda v: F.lower(v["ingredient"])), lambda i: i.isNotNull() & (i != ""))
    unmapped = let(said, lambda s: F.filter(wanted, lambda i: ~F.exists(words(i), lambda w: named(s, w))))
    unmapped = F.transform(unmapped, lambda i: F.concat(F.lit("violation_unmapped_in_substitution_plan: "), i))

    name = lambda c: vocabulary.name(c, aliased=False)
    changed = F.filter(parsed["pairs"], lambda p: (strip(p["from"]) != "") & (strip(p["to"]) != "") & ~F.rlike(strip(p["to"]), F.lit(r"^[–—\-\s]+$")) & ~F.rlike(p["to"], F.lit(_STAYS)))
    plain = F.struct(F.transform(items, name).alias("left"), F.transform(changed, lambda p: F.struct(strip(p["from"]).alias("said"), name(p["from"]).alias("from"), name(p["to"]).alias("to"))).alias("changed"))
    still = let(plain, lambda x: F.filter(x["changed"], lambda p: (p["from"] != "") & ~F.contains(p["to"], p["from"]) & F.array_contains(x["left"], p["from"])))
    still = F.transform(still, lambda p: F.concat(F.lit("banned_ingredient_in_adapted_content: "), p["said"]))
    return F.concat(F.when(F.contains(text, F.lit("...")), F.array(F.lit("contains_ellipsis"))).otherwise(none), amounts, unmapped, still)


def allowed(items: Column, lexicon: Lexicon, constraint: str) -> Column:
    """The items that none of the constraint's terms matches."""
    pattern = lexicon.pattern(constraint)
    return F.filter(items, lambda i: ~F.rlike(F.lower(i), F.lit(pattern))) if pattern else items


def names_of(items: Column, vocabulary: Vocabulary) -> Column:
    return F.transform(items, lambda i: vocabulary.name(i))


def retained(source: Column, wanted: Column, adapted: Column) -> Column:
    """The share of ``wanted`` names (repeats count) that are among ``adapted`` ones; 0 without a source, 1 where none of
    it is wanted. Arrays of names are compared as they are, so each item is normalised once."""
    kept = F.filter(wanted, lambda i: F.array_contains(adapted, i))
    return F.when(F.size(source) == 0, 0.0).when(F.size(wanted) == 0, 1.0).otherwise(F.bround(F.try_divide(F.size(kept), F.size(wanted)), 4))


def with_names(rows: DataFrame, items: str, lexicon: Lexicon, constraint: str, vocabulary: Vocabulary, key: str = "id") -> DataFrame:
    """``key``, names and wanted of ``rows`` (each key once): all items' names in order, and those of the items not banned.

    Each distinct item is normalised once, whatever number of rows has it, and joined back; the join's small side is
    broadcast where Spark's own size check allows it.
    """
    each = rows.select(key, F.posexplode(items).alias("_at", "_item"))
    pattern = lexicon.pattern(constraint)
    banned = F.rlike(F.lower("_item"), F.lit(pattern)) if pattern else F.lit(False)
    distinct = each.select("_item").distinct().select(F.col("_item").alias("_i"), vocabulary.name(F.col("_item")).alias("_name"), banned.alias("_banned"))
    got = each.join(distinct, F.col("_item") == F.col("_i")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_name", "_banned"))).alias("_x"))
    name = lambda x: x["_name"]
    return got.select(key, F.transform("_x", name).alias("names"), F.transform(F.filter("_x", lambda x: ~x["_banned"]), name).alias("wanted"))


def relevance(source: Column, adapted: Column, lexicon: Lexicon, constraint: str, vocabulary: Vocabulary) -> Column:
    """The share of source items not banned that the adapted items still have (repeats in the source count)."""
    both = F.struct(names_of(allowed(source, lexicon, constraint), vocabulary).alias("wanted"), names_of(adapted, vocabulary).alias("adapted"))
    return let(both, lambda x: retained(source, x["wanted"], x["adapted"]))


def steps_changed(source: Column, adapted: Column) -> Column:
    """1 where the numbers of steps or any of the first three differ; 0 where either has none."""
    differ = F.exists(F.zip_with(F.slice(source, 1, 3), F.slice(adapted, 1, 3), lambda a, b: strip(F.lower(a)) != strip(F.lower(b))), lambda x: x)
    return F.when((F.size(source) == 0) | (F.size(adapted) == 0), 0).when(F.size(source) != F.size(adapted), 1).otherwise(differ.cast("int"))


def nontriviality(pairs: Column, violations: Column, changed: Column) -> Column:
    """Four fifths for replacements per violation (one at most), a fifth for changed steps."""
    made = F.size(F.filter(pairs, lambda p: strip(p["to"]) != ""))
    return F.bround(F.lit(0.8) * F.least(F.lit(1.0), made / F.greatest(F.lit(1), violations)) + F.lit(0.2) * changed, 4)


# What shows that a prompt has a title, items, steps and restrictions.
_PROMPT = (
    r"recipe\s*:|goal\s*:\s*make\s+\w|i have a recipe for\s+\w",
    r"ingredients?\s*:|the ingredients are",
    r"steps?\s*:|here'?s how|\b[1-9][.)]\s+\w",
    r"restrictions?\s*:|\b(?:vegetarian|vegan|gluten[- ]free|dairy[- ]free|nut[- ]free|egg[- ]free|shellfish[- ]free|low[- ]sodium|low[- ]sugar|low[- ]fat)\b",
)


def prompt_complete(user: Column) -> Column:
    def all_of(low: Column) -> Column:
        out = F.lit(True)
        for p in _PROMPT:
            out = out & F.rlike(low, F.lit("(?U)" + p))
        return out.cast("int")

    return let(F.lower(user), all_of)  # or each test would make the prompt anew


def audit_scores(text: Column, user: Column, parsed: Column, source: Column, steps: Column, violations: Column, lexicon: Lexicon, constraint: str, vocabulary: Vocabulary) -> Column:
    """struct<constraint_pass, relevance_score, nontriviality_score, semantic_completeness_pass, completeness_failures>."""
    adapted = F.concat(parsed["ingredients_text"], F.lit(" "), parsed["steps_text"])
    return F.struct(
        passes(adapted, lexicon, constraint).alias("constraint_pass"),
        relevance(source, parsed["ingredients"], lexicon, constraint, vocabulary).alias("relevance_score"),
        nontriviality(parsed["pairs"], F.size(violations), steps_changed(steps, parsed["steps"])).alias("nontriviality_score"),
        prompt_complete(user).alias("semantic_completeness_pass"),
        completeness_failures(text, parsed, violations, vocabulary).alias("completeness_failures"),
    )


def reject_reason(scores: Column) -> Column:
    """Why a scored response is dropped (null: it is kept). Relevance and nontriviality drop nothing."""
    return F.when(scores["constraint_pass"] != 1, "constraint_fail").when(scores["semantic_completeness_pass"] != 1, "semantic_fail").when(F.size(scores["completeness_failures"]) > 0, "completeness_fail")


def prefilter_reason(title: Column, items: Column, steps: Column, violations: Column, lexicon: Lexicon, constraint: str, most_occurrences: int = 1, most_violations: int = 2, most_share: float = 0.33, compound: bool = True) -> Column:
    """Why a source is not worth generating from (the first that holds), else null."""
    found = occurrences(F.array_join(steps, " "), lexicon, constraint)
    both = (title_terms(title, lexicon, constraint) >= 1) & (found >= 1)
    n = F.size(violations)
    out = F.when(found > most_occurrences, "step_ban_occurrences")
    if compound:
        out = out.when(both, "title_step_compound")
    return out.when(n > most_violations, "too_many_violations").when(F.coalesce(F.try_divide(n, F.size(items)), F.lit(0.0)) > most_share, "violation_fraction")


def row_score(judge: Column, constraint: Column, formatted: Column) -> Column:
    """struct<score, source>: the judge's score, else the constraint's with a tenth for form, else null."""
    own = F.when(constraint, 1.0).when(~constraint, 0.0) + F.when(F.coalesce(formatted, F.lit(False)), 0.1).otherwise(0.0)
    return F.when(judge.isNotNull(), F.struct(judge.cast("double").alias("score"), F.lit("judge").alias("source"))).when(constraint.isNotNull(), F.struct(own.alias("score"), F.lit("constraint").alias("source"))).otherwise(F.struct(F.lit(None).cast("double").alias("score"), F.lit("none").alias("source")))


def source_bucket(a: Column, b: Column) -> Column:
    """How a pair of scores came about."""
    return F.when((a == "none") | (b == "none"), "missing").when(a == b, a).otherwise("mixed")
