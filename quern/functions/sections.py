"""Structured responses: sections, replacement pairs and lists, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, literal, strip

# The sections of a response, in order, and those that hold adapted content.
HEADERS = ("Substitution Plan", "Adapted Ingredients", "Adapted Steps", "Flavor Preservation Notes", "Constraint Check")
SCANNED = ("adapted ingredients", "adapted steps")


def _none() -> Column:
    return F.array().cast("array<string>")


PAIR = "array<struct<from:string,to:string,reason:string>>"


def lines(text: Column) -> Column:
    return F.split(text, r"\R")


def _header(line: Column, headers: Sequence[str]) -> Column:
    """The header that a decorated line is, else null: one pattern for all of them."""
    said = F.regexp_extract(strip(line), rf"(?i)^[*#\s]*({'|'.join(literal(h) for h in headers)})[*#:\s]*$", 1)
    names = {h.lower(): h for h in reversed(headers)}
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.lower(said))


def split_sections(text: Column, headers: Sequence[str] = HEADERS) -> Column:
    """map<header, body> in the order of the headers' first lines: bodies of header lines (``**Header**``, ``## Header:``
    and the like); of a header that comes twice, the last.

    Header lines are found once, and each body is one slice of the lines.
    """
    marks = lambda rows: F.filter(F.transform(rows, lambda l, i: F.struct(i.alias("at"), _header(l, headers).alias("header"))), lambda m: m["header"].isNotNull())

    def body(rows: Column, spans: Column, h: str) -> Column:
        return let(F.filter(spans, lambda m: m["header"] == h), lambda mine: span(rows, mine, F.try_element_at(mine, F.lit(-1)), h))

    def span(rows: Column, mine: Column, last: Column, h: str) -> Column:
        return F.struct(F.try_element_at(mine, F.lit(1))["at"].alias("first"), F.lit(h).alias("header"), strip(F.array_join(F.slice(rows, last["at"] + 2, last["end"] - last["at"] - 1), "\n")).alias("body"))

    def build(rows: Column, found: Column) -> Column:
        spans = F.transform(found, lambda m, i: F.struct(m["at"].alias("at"), F.coalesce(F.get(found, i + 1)["at"], F.size(rows)).alias("end"), m["header"].alias("header")))
        each = F.array_sort(F.filter(let(spans, lambda all_: F.array(*[body(rows, all_, h) for h in headers])), lambda s: s["first"].isNotNull()))
        return F.map_from_entries(F.transform(each, lambda s: F.struct(s["header"], s["body"])))

    return let(lines(text), lambda rows: let(marks(rows), lambda found: build(rows, found)))


def section(sections: Column, header: str) -> Column:
    return F.coalesce(F.element_at(sections, F.lit(header)), F.lit(""))


def _bare(line: Column) -> Column:
    """A list line without its bullet and bold marks."""
    return F.replace(strip(F.regexp_replace(strip(line), r"^[-•*]+", "")), F.lit("**"), F.lit(""))


# How a plan writes a replacement: with an arrow, in a table's columns, or in prose.
_ARROW = r"^(.+?)\s*(?:->|→)\s*(.+?)(?:\s*:\s*(.+)|\s+\((.+)\))?$"
_OLD, _NEW = "(?i)original|ingredient", "(?i)substitut|replacement|swap"
_PROSE = r"(?i)replaced?\s+([^,;\n]+?)\s+with\s+([^,;\n.]+)"


def arrow_pairs(text: Column) -> Column:
    """``X -> Y: why`` and ``X → Y (why)``."""
    got = F.filter(F.transform(lines(text), _bare), lambda l: F.rlike(l, F.lit(_ARROW)))
    part = lambda l, i: strip(F.regexp_extract(l, _ARROW, i))
    return F.transform(got, lambda l: F.struct(part(l, 1).alias("from"), part(l, 2).alias("to"), F.coalesce(blank(part(l, 3)), part(l, 4)).alias("reason")))


def table_pairs(text: Column) -> Column:
    """Rows of a markdown table whose head names an original and a substitute column (the last such cells), up to the
    first line that is no table row. Lines are cut into cells once, and the head and the table's end are looked for once."""
    cells = F.transform(lines(text), lambda l: F.when(F.contains(l, F.lit("|")), F.transform(F.split(l, r"\|"), lambda c: F.replace(strip(c), F.lit("**"), F.lit("")))))
    place = lambda row, pattern: F.array_max(F.transform(row, lambda c, i: F.when(F.rlike(c, F.lit(pattern)), i).otherwise(-1)))

    def first_head(rows: Column) -> Column:
        heads = F.transform(rows, lambda row, i: F.struct(i.alias("at"), place(row, _OLD).alias("old"), place(row, _NEW).alias("new")))
        return F.try_element_at(F.filter(heads, lambda h: (h["old"] >= 0) & (h["new"] >= 0)), F.lit(1))

    def under(rows: Column, head: Column) -> Column:
        behind = F.slice(rows, head["at"] + 3, F.greatest(F.size(rows) - head["at"] - 2, F.lit(0)))
        found = let(behind, lambda left: F.slice(left, F.lit(1), F.coalesce(F.array_min(F.filter(F.transform(left, lambda row, i: F.when(row.isNull(), i)), lambda i: i.isNotNull())), F.size(left))))
        pairs = F.transform(found, lambda row: F.struct(F.get(row, head["old"]).alias("from"), F.get(row, head["new"]).alias("to"), F.lit("").alias("reason")))
        good = F.filter(pairs, lambda p: (p["from"] != "") & (p["to"] != "") & ~F.rlike(p["from"], F.lit("^[-:]+$")))
        return F.when(head.isNotNull(), good).otherwise(F.array().cast(PAIR))

    return let(cells, lambda rows: let(first_head(rows), lambda head: under(rows, head)))


def prose_pairs(text: Column) -> Column:
    """``replace X with Y``; leading letters of "the " go from X, as a set of characters."""
    both = let(F.replace(text, F.lit("**"), F.lit("")), lambda plain: F.arrays_zip(F.regexp_extract_all(plain, F.lit(_PROSE), 1).alias("x"), F.regexp_extract_all(plain, F.lit(_PROSE), 2).alias("y")))
    pairs = F.transform(both, lambda p: F.struct(strip(F.ltrim(strip(p["x"]), F.lit("the "))).alias("from"), strip(p["y"]).alias("to"), F.lit("").alias("reason")))
    return F.filter(pairs, lambda p: (p["from"] != "") & (p["to"] != ""))


def pairs(text: Column) -> Column:
    """By the first of the three forms that gives any."""
    some = lambda first, other: let(first, lambda found: F.when(F.size(found) > 0, found).otherwise(other))
    return let(text, lambda t: some(arrow_pairs(t), some(table_pairs(t), prose_pairs(t))))


def ingredient_list(text: Column) -> Column:
    bare = F.transform(lines(text), lambda l: F.regexp_replace(strip(F.regexp_replace(strip(l), r"^[-•*]+", "")), r"^\d+[.)]\s*", ""))
    return F.filter(bare, lambda l: l != "")


def step_list(text: Column) -> Column:
    bare = F.transform(lines(text), lambda l: strip(F.regexp_replace(strip(l), r"^(?:\d+[.)]\s*|[Ss]tep\s+\d+[.:)]\s*)", "")))
    return F.filter(bare, lambda l: l != "")


def parse(text: Column) -> Column:
    """struct<plan, ingredients_text, steps_text, notes, check, pairs, ingredients, steps, found> of a response."""
    def build(got: Column) -> Column:
        plan, items, steps, notes, check = (section(got, h) for h in HEADERS)
        return F.struct(
            plan.alias("plan"), items.alias("ingredients_text"), steps.alias("steps_text"), notes.alias("notes"), check.alias("check"),
            pairs(plan).alias("pairs"), ingredient_list(items).alias("ingredients"), step_list(steps).alias("steps"), F.map_keys(got).alias("found"),
        )

    return let(split_sections(text), build)


# --- the evaluation's own, stricter reading ------------------------------------------------------------------------

_NAMES = "|".join(h.lower() for h in HEADERS)
#: A header line: markdown # marks or none, a colon or none, no bold.
_LINE = rf"(?im)^\s{{0,3}}(?:#{{1,6}}\s*)?({_NAMES})\s*:?\s*$"


def output_sections(text: Column) -> Column:
    """array<struct<name, body>> in order, bodies from behind a header line to the next one."""
    none = F.array().cast("array<struct<name:string,body:string>>")

    def build(t: Column, names: Column) -> Column:
        bodies = F.slice(F.split(t, _LINE), 2, F.greatest(F.size(names), F.lit(1)))
        each = F.transform(F.arrays_zip(names.alias("name"), bodies.alias("body")), lambda s: F.struct(s["name"].alias("name"), strip(s["body"]).alias("body")))
        return F.when(F.size(names) > 0, each).otherwise(none)

    found = lambda t: F.transform(F.regexp_extract_all(t, F.lit(_LINE), 1), lambda n: F.lower(strip(n)))
    return let(text, lambda t: let(found(t), lambda names: build(t, names)))


def missing_sections(text: Column) -> Column:
    """Headers that are missing, in order, and marks of placeholders."""
    present = F.transform(output_sections(text), lambda s: s["name"])
    wanted = let(present, lambda names: F.filter(F.array(*[F.lit(h.lower()) for h in HEADERS]), lambda h: ~F.array_contains(names, h)))
    marks = F.array(F.when(F.contains(text, F.lit("...")), "placeholder_ellipsis"), F.when(F.contains(F.lower(text), F.lit("same as original")), "placeholder_same_as_original"))
    return F.concat(wanted, F.filter(marks, lambda m: m.isNotNull()))


def scan_text(text: Column) -> Column:
    """struct<text, mode>: what restrictions are held against: adapted sections, else all but the first constraint check."""
    header = r"(?im)^\s{0,3}(?:#{1,6}\s*)?constraint check\s*:?\s*$"

    def adapted(got: Column) -> Column:
        body = lambda name: F.try_element_at(F.filter(got, lambda s: s["name"] == name), F.lit(-1))["body"]
        return F.array_join(F.filter(F.array(*[body(n) for n in SCANNED]), lambda b: b.isNotNull() & (b != "")), "\n\n")

    def rest(halves: Column) -> Column:
        # from the next header line on
        tail = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        behind = let(tail, lambda b: F.substring(b, F.length(F.get(F.split(b, _LINE, 2), F.lit(0))) + 1, F.length(b)))
        return strip(F.concat(F.get(halves, F.lit(0)), F.lit("\n"), behind))

    def other(t: Column, got: Column) -> Column:
        has = F.exists(got, lambda s: s["name"] == "constraint check")
        left = let(F.when(has, let(F.split(t, header, 2), rest)), lambda r: F.when(r != "", F.struct(r.alias("text"), F.lit("full_output_minus_constraint_check").alias("mode"))))
        return F.coalesce(left, F.struct(t.alias("text"), F.lit("full_output").alias("mode")))

    def build(t: Column, got: Column) -> Column:
        return let(adapted(got), lambda a: F.when(a != "", F.struct(a.alias("text"), F.lit("adapted_sections_only").alias("mode"))).otherwise(other(t, got)))

    return let(text, lambda t: let(output_sections(t), lambda got: build(t, got)))
