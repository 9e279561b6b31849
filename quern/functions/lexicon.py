"""Matching against lexicons of banned terms.

A lexicon is data: constraint names with their terms, phrases that are known false positives, and reasons. Terms become
literal patterns on the driver, so a scan compiles each once; the ordered greedy scan is a fold over the items.
"""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import automaton
from .text import literal, normal_name, strip

#: Lexicons of more terms are matched by an automaton, with the same results.
LARGE = 256


@dataclass
class Lexicon:
    terms: dict[str, list[str]]
    false_positives: list[str] = field(default_factory=list)
    reasons: dict[str, dict[str, str]] = field(default_factory=dict)
    #: "literal": a phrase counts as it stands, brackets too; "stripped": without what is in brackets.
    mode: str = "literal"

    def phrases(self) -> list[str]:
        cut = (p.partition("(")[0].strip() if self.mode == "stripped" else p for p in self.false_positives)
        return [p.lower() for p in cut if p]

    @property
    def large(self) -> bool:
        return sum(map(len, self.terms.values())) > LARGE

    def place(self, constraint: str) -> int:
        return list(self.terms).index(constraint)

    def ordered(self, constraint: str) -> list[str]:
        """Longest first; equals as given."""
        return sorted(self.terms.get(constraint, []), key=len, reverse=True)

    def pattern(self, constraint: str) -> str | None:
        """One pattern for all terms between word borders (Unicode's, whatever the Java version)."""
        terms = self.ordered(constraint)
        return r"(?U)\b(?:" + "|".join(literal(t.lower()) for t in terms) + r")\b" if terms else None


def word(term: str) -> str:
    """A pattern for one term between word borders."""
    return r"(?U)\b" + literal(term.lower()) + r"\b"


def has_word(text: Column, term: str) -> Column:
    return F.rlike(F.lower(text), F.lit(word(term)))


def _shielded(lexicon: Lexicon, term: str, text: Column) -> Column:
    """Whether a false-positive phrase that holds the term is in the (lower-cased) text."""
    holding = [p for p in lexicon.phrases() if term.lower() in p]
    return F.greatest(*[F.contains(text, F.lit(p)) for p in holding], F.lit(False)) if holding else F.lit(False)


def reason(lexicon: Lexicon, constraint: str, item: Column) -> Column:
    """Of the longest key that is part of the item; of equals the first given."""
    keys = sorted(lexicon.reasons.get(constraint, {}).items(), key=lambda x: len(x[0]), reverse=True)
    return F.coalesce(*[F.when(F.contains(F.lower(item), F.lit(key)), name) for key, name in keys], F.lit(f"violates_{constraint}"))


def violations(items: Column, lexicon: Lexicon, constraint: str) -> Column:
    """array<struct<ingredient, reason, term>>: for each item in order its first term, longest first, that no earlier
    item has used up; so each term fires once and each item once."""
    terms, none = lexicon.ordered(constraint), F.array().cast("array<struct<ingredient:string,reason:string,term:string>>")
    if not terms:
        return none
    start = F.struct(F.array().cast("array<string>").alias("seen"), none.alias("hits"))
    if lexicon.large:
        return _violations_by_hits(items, automaton.item_terms(F.transform(items, F.lower), lexicon.terms, lexicon.phrases()), lexicon, constraint)

    def step(acc: Column, item: Column) -> Column:
        low = F.lower(item)
        # one flat choice of all terms, whose conditions are tried in order
        term = F.coalesce(*[F.when(F.rlike(low, F.lit(word(t))) & ~_shielded(lexicon, t, low) & ~F.array_contains(acc["seen"], F.lit(t)), t) for t in terms])
        hit = F.struct(strip(item).alias("ingredient"), reason(lexicon, constraint, item).alias("reason"), term.alias("term"))
        new = F.struct(F.array_append(acc["seen"], term).alias("seen"), F.array_append(acc["hits"], hit).alias("hits"))
        # most items match nothing: one test of the combined pattern spares them the terms
        return F.when(F.rlike(low, F.lit(lexicon.pattern(constraint))) & term.isNotNull(), new).otherwise(acc)

    any_ = F.exists(items, lambda x: F.rlike(F.lower(x), F.lit(lexicon.pattern(constraint))))
    return F.when(any_, F.aggregate(items, start, step, lambda acc: acc["hits"])).otherwise(none)


def _violations_by_hits(items: Column, found: Column, lexicon: Lexicon, constraint: str) -> Column:
    """:func:`violations` from what an automaton has found in each item: the fold meets hits alone."""
    none = F.array().cast("array<struct<ingredient:string,reason:string,term:string>>")
    start = F.struct(F.array().cast("array<string>").alias("seen"), none.alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.filter(x["terms"], lambda t: (t["constraint"] == constraint) & ~F.array_contains(acc["seen"], t["term"]))
        term = F.try_element_at(fresh, F.lit(1))["term"]
        hit = F.struct(strip(x["item"]).alias("ingredient"), reason(lexicon, constraint, x["item"]).alias("reason"), term.alias("term"))
        return F.when(term.isNotNull(), F.struct(F.array_append(acc["seen"], term).alias("seen"), F.array_append(acc["hits"], hit).alias("hits"))).otherwise(acc)

    folded = F.aggregate(F.zip_with(items, found, lambda i, t: F.struct(i.alias("item"), t.alias("terms"))), start, step, lambda acc: acc["hits"])
    return F.coalesce(folded, none)


def all_violations(df: DataFrame, items: str, lexicon: Lexicon) -> DataFrame:
    """A row for each row and constraint with a violation: ``constraint``, its ``rank``, ``violations``."""
    of, source = (lambda c: violations(F.col(items), lexicon, c)), df
    if lexicon.large:  # one scan for all constraints
        source = df.withColumn("_found", automaton.item_terms(F.transform(items, F.lower), lexicon.terms, lexicon.phrases()))
        of = lambda c: _violations_by_hits(F.col(items), F.col("_found"), lexicon, c)
    each = F.array(*[F.struct(F.lit(c).alias("constraint"), F.lit(i).alias("rank"), of(c).alias("violations")) for i, c in enumerate(lexicon.terms)])
    out = source.withColumn("_v", F.explode(F.filter(each, lambda x: F.size(x["violations"]) > 0)))
    return out.select(*df.columns, "_v.*")


def breaks(item: Column, lexicon: Lexicon, constraint: str) -> Column:
    """Whether one item has a term that no phrase shields. A list of items has :func:`violations` where one of them does: its first such item
    is always a hit, so who asks for no more needs no fold."""
    terms, low = lexicon.ordered(constraint), F.lower(item)
    if not terms:
        return F.lit(False)
    if lexicon.large:
        found = automaton.item_terms(F.array(low), lexicon.terms, lexicon.phrases())
        return F.coalesce(F.exists(F.try_element_at(found, F.lit(1)), lambda t: t["constraint"] == constraint), F.lit(False))
    hit = F.rlike(low, F.lit(lexicon.pattern(constraint)))
    if any(t.lower() in p for t in terms for p in lexicon.phrases()):
        hit = hit & functools.reduce(operator.or_, [F.rlike(low, F.lit(word(t))) & ~_shielded(lexicon, t, low) for t in terms])
    return F.coalesce(hit, F.lit(False))


def broken(items: DataFrame, key: str, item: str, lexicon: Lexicon, least: int = 1) -> DataFrame:
    """``key``, ``constraint``: of each key with at least ``least`` items (rows whose item is not null) the constraints that one of them breaks.

    Items are looked at where they are, and of each key only flags are shuffled.
    """
    flags = [breaks(F.col(item), lexicon, c).alias(f"_{i}") for i, c in enumerate(lexicon.terms)]
    rows = items.select(key, F.col(item).isNotNull().alias("_named"), *flags)
    each = rows.groupBy(key).agg(F.count_if("_named").alias("_n"), *[F.max(f"_{i}").alias(f"_{i}") for i in range(len(flags))]).where(F.col("_n") >= least)
    names = F.array(*[F.when(F.col(f"_{i}"), F.lit(c)) for i, c in enumerate(lexicon.terms)])
    return each.select(key, F.explode(names).alias("constraint")).where("constraint is not null")


def _unshielded(text: Column, lexicon: Lexicon, constraint: str) -> Column:
    """All occurrences of terms in the (lower-cased) text, without those that an active false-positive phrase covers."""
    pattern = lexicon.pattern(constraint)
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    shields = [(p, F.regexp_extract_all(F.lit(p), F.lit(pattern), 0)) for p in lexicon.phrases()]
    if not shields:
        return found
    covered = F.flatten(F.array(*[F.when(F.contains(text, F.lit(p)), m).otherwise(F.array().cast("array<string>")) for p, m in shields]))
    return F.filter(found, lambda x: ~F.array_contains(covered, x))


def passes(text: Column, lexicon: Lexicon, constraint: str) -> Column:
    """1 where no banned term is left in the text, else 0."""
    if not lexicon.pattern(constraint):
        return F.lit(1)
    low = F.lower(text)
    if lexicon.large:
        return (automaton.counts(low, lexicon.terms, lexicon.phrases())[lexicon.place(constraint)] == 0).cast("int")
    active = F.greatest(*[F.contains(low, F.lit(p)) for p in lexicon.phrases()], F.lit(False)) if lexicon.phrases() else F.lit(False)
    plain = ~F.rlike(low, F.lit(lexicon.pattern(constraint)))
    return F.when(active, F.size(_unshielded(low, lexicon, constraint)) == 0).otherwise(plain).cast("int")


def occurrences(text: Column, lexicon: Lexicon, constraint: str) -> Column:
    """How often banned terms occur in the text."""
    if lexicon.large and lexicon.pattern(constraint):
        return automaton.counts(F.lower(text), lexicon.terms, lexicon.phrases())[lexicon.place(constraint)]
    return F.size(_unshielded(F.lower(text), lexicon, constraint)) if lexicon.pattern(constraint) else F.lit(0)


def title_terms(title: Column, lexicon: Lexicon, constraint: str) -> Column:
    """How many entries of the list, each by itself, the title has."""
    low, out = F.lower(title), F.lit(0)
    for t in lexicon.terms.get(constraint, []):
        out = out + (has_word(title, t) & ~_shielded(lexicon, t, low)).cast("int")
    return F.coalesce(out, F.lit(0))


def _apart(term: str) -> str:
    """A term with no letter or digit (of ASCII) on either side; an underscore is a border here."""
    return "(?i)(?<![a-z0-9])" + literal(term) + "(?![a-z0-9])"


def check_restrictions(text: Column, names: Column, lexicon: Lexicon) -> Column:
    """struct<checked_restrictions, unknown_restrictions, violations, constraint_pass> of a text for the row's
    restrictions; the pass is null where none of them is in the lexicon."""
    known = {normal: sorted({t.strip().lower() for t in terms if t.strip()}) for normal, terms in ((_normal(k), v) for k, v in lexicon.terms.items())}
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.filter(F.array(*[F.when(F.rlike(text, F.lit(_apart(t))), t) for t in v]), lambda x: x.isNotNull()).alias("matched")) for k, v in known.items() if v])
    found = F.transform(names, lambda r: F.struct(r.alias("restriction"), normal_name(r).alias("normalized_restriction"), F.try_element_at(F.filter(table, lambda t: t["name"] == normal_name(r)), F.lit(1))["matched"].alias("matched_terms")))
    unknown = F.transform(F.filter(found, lambda x: x["matched_terms"].isNull()), lambda x: x["restriction"])
    bad = F.filter(found, lambda x: F.size(x["matched_terms"]) > 0)
    checked = F.size(names) - F.size(unknown)
    return F.struct(checked.alias("checked_restrictions"), unknown.alias("unknown_restrictions"), bad.alias("violations"), F.when(checked > 0, F.size(bad) == 0).alias("constraint_pass"))


def _normal(name: str) -> str:
    import re

    return re.sub("[^a-z0-9]+", "_", name.lower()).strip("_")


def coverage(items: DataFrame, lexicon: Lexicon, signals: dict[str, list[str]], sample: int = 5) -> DataFrame:
    """constraint, matched, gaps, sample: of the distinct lower-cased items (column ``item``), how many a constraint's
    terms match, how many hold one of its signals but no term, and the first of those."""
    distinct = items.select(strip(F.lower("item")).alias("item")).where("item <> ''").distinct()
    hit = lambda c: F.rlike("item", F.lit(lexicon.pattern(c))) if lexicon.pattern(c) else F.lit(False)
    if lexicon.large:
        distinct = distinct.withColumn("_n", automaton.counts(F.col("item"), lexicon.terms, []))
        hit = lambda c: F.col("_n")[lexicon.place(c)] > 0
    sign = lambda c: F.greatest(*[F.contains("item", F.lit(s)) for s in signals.get(c, [])], F.lit(False)) if signals.get(c) else F.lit(False)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("constraint"), hit(c).alias("hit"), (sign(c) & ~hit(c)).alias("gap")) for c in lexicon.terms]))
    rows = distinct.select("item", each.alias("x")).select("item", "x.*")
    counts = rows.groupBy("constraint").agg(F.count_if("hit").alias("matched"), F.count_if("gap").alias("gaps"))
    ranked = _first(rows.where("gap"), sample)
    first = ranked.groupBy("constraint").agg(F.array_sort(F.collect_list("item")).alias("sample"))
    return counts.join(first, "constraint", "left").withColumn("sample", F.coalesce("sample", F.array().cast("array<string>")))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` items of each constraint (Spark keeps n per task before it shuffles)."""
    from pyspark.sql import Window

    w = Window.partitionBy("constraint").orderBy("item")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def triage(gaps: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``gaps`` (constraint, item) with ``status``: banned (a term matches), false_positive or suggest."""
    stripped = Lexicon(lexicon.terms, lexicon.false_positives, mode="stripped").phrases()
    hit = F.lit(False)
    for c in lexicon.terms:
        if lexicon.pattern(c):
            hit = F.when(F.col("constraint") == c, F.rlike(F.lower("item"), F.lit(lexicon.pattern(c)))).otherwise(hit)
    known = F.greatest(*[F.contains(F.lower("item"), F.lit(p)) for p in stripped], F.lit(False)) if stripped else F.lit(False)
    return gaps.withColumn("status", F.when(hit, "banned").when(known, "false_positive").otherwise("suggest"))
