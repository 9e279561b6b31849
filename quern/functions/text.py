"""Scalar text functions as column expressions. All stay in the JVM; nothing here is a UDF."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, however often it stands in it (inside lambdas too)."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: All characters that Unicode calls white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (Unicode's) at either end; F.trim by itself takes off U+0020 alone. A pattern would look at every character."""
    return F.trim(c, F.lit(SPACES))


def normal_name(c: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def literal(term: str) -> str:
    """``term`` as a regular expression that matches it alone, in Java as in Python."""
    return re.escape(term)


def blank(c: Column, *tokens: str) -> Column:
    """Null where ``c`` is empty or one of ``tokens``."""
    return F.when(c.isin("", *tokens), None).otherwise(c)


# --- list-valued cells and recipes -------------------------------------------------------------------------------


def r_vector(c: Column) -> Column:
    """Items of a cell: an R vector literal, a bare string, or nothing (null, NA, nan, character(0))."""
    s = strip(c)
    quoted = F.regexp_extract_all(s, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    inner = F.substring(s, F.lit(3), F.greatest(F.length(s) - 3, F.lit(0)))
    bare = F.filter(F.transform(F.split(inner, ","), lambda x: strip(x)), lambda x: ~x.isin("", "NA"))
    bare = F.transform(bare, lambda x: F.trim(x, F.lit('"')))
    items = F.when(F.startswith(s, F.lit("c(")), F.when(F.size(quoted) > 0, quoted).otherwise(bare)).otherwise(F.array(s))
    none = F.array().cast("array<string>")
    return F.when(s.isNull() | s.isin("", "NA", "nan", "character(0)"), none).otherwise(F.filter(items, lambda x: ~x.isin("", "NA")))


def combine(quantities: Column, parts: Column, aligned: bool = True) -> Column:
    """``quantity part`` for each part that is not blank; a missing quantity leaves the part alone.

    Quantities pair with parts by place, whatever was dropped from either list before.
    """
    def pairs(amounts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(strip(p).alias("name"), strip(F.coalesce(F.try_element_at(amounts, i + 1), F.lit(""))).alias("amount")))

    # the quantities are made once a row: Spark would put what they are made of into each item
    named = F.filter(let(quantities, pairs), lambda x: x["name"] != "")
    return F.transform(named, lambda x: _combined(x["amount"], x["name"]))


def _combined(amount: Column, name: Column) -> Column:
    return F.when(amount.isin("", "NA", "nan"), name).otherwise(F.concat(amount, F.lit(" "), name))


def combine_one(quantity: Column, part: Column) -> Column:
    """What :func:`combine` makes of one quantity and part; null where the part is blank."""
    return F.when(strip(part) != "", _combined(strip(F.coalesce(quantity, F.lit(""))), strip(part)))


def first_category(c: Column, names: Sequence[tuple[str, str]], other: str) -> Column:
    """The value of the first key that is part of the lower-cased ``c``."""
    out, low = F.lit(other), strip(F.lower(c))
    for key, value in reversed(names):
        out = F.when(F.contains(low, F.lit(key)), value).otherwise(out)
    return F.when(c.isNull() | c.isin("", "nan", "None", "NA"), other).otherwise(out)


def labels(items: Column, signals: Sequence[tuple[str, Sequence[str]]], most: int, none: Sequence[str]) -> Column:
    """The first ``most`` labels of which a signal is part of the joined lower-cased items; ``none`` where there is none."""
    text = F.lower(F.array_join(items, " "))
    found = [F.when(F.lit(False) if not words else F.greatest(*[F.contains(text, F.lit(w)) for w in words], F.lit(False)), label) for label, words in signals]
    got = F.slice(F.filter(F.array(*found), lambda x: x.isNotNull()), 1, most)
    return F.when(F.size(got) > 0, got).otherwise(F.array(*[F.lit(x) for x in none]))


def rating(c: Column, other: float = 3.0) -> Column:
    """A number; ``other`` for null, NaN, zero and anything that is no number."""
    n = c.try_cast("double")
    return F.coalesce(F.when(~F.isnan(n) & (n != 0), n), F.lit(other))


def skip_reason(title: Column, parts: Column, steps: Column, least_parts: int = 3, least_steps: int = 2) -> Column:
    """Why a parsed recipe is left out (the first that holds), else null."""
    name = strip(title)
    return F.when(name.isNull() | name.isin("", "nan", "NA"), "no_title").when(F.size(parts) < least_parts, "few_ingredients").when(F.size(steps) < least_steps, "few_steps")


# --- normalisation of items --------------------------------------------------------------------------------------


def unbold(c: Column) -> Column:
    return F.regexp_replace(c, r"\*\*([^*]+)\*\*", "$1")


#: Suffixes in the order in which they are tried, and what takes their place.
SINGULAR = (("ies", "y"), ("oes", "o"), ("ves", "f"), ("ches", "ch"), ("shes", "sh"), ("xes", "x"), ("ses", "s"), ("s", ""))


def singular(c: Column) -> Column:
    """By the first suffix of SINGULAR that the word has."""

    def cut(w: Column) -> Column:
        return F.coalesce(*[F.when(F.endswith(w, F.lit(end)), F.concat(F.left(w, F.length(w) - len(end)), F.lit(new))) for end, new in SINGULAR], w)

    return let(c, cut)  # or each test would make the word anew


def strip_quantity(c: Column, units: Sequence[str]) -> Column:
    """Without a leading amount and unit; the trimmed text itself where nothing would be left."""
    unit = "|".join(literal(u) for u in sorted(units, key=lambda u: (-len(u), u)))
    amount = r"^\s*(?:[\d¼-¾⅐-⅞][\d/.,\-\s¼-¾⅐-⅞]*)?\s*(?:(?:" + unit + r")\.?(?![a-z]))?\s*"
    left = F.trim(F.regexp_replace(F.regexp_replace(c, "(?i)" + amount, ""), r"\s{2,}", " "))
    return F.coalesce(blank(left), F.trim(c))


def _words(words: Sequence[str]) -> list[str]:
    return sorted(words, key=len, reverse=True)


def normal_item(c: Column, units: Sequence[str], adjectives: Sequence[str], aliases: dict[str, str] | None = None) -> Column:
    """An item's name for comparison: no bold, amounts, units, brackets or preparation; singular; by its alias."""
    s = F.trim(F.lower(unbold(strip(c))))
    s = F.regexp_replace(s, r"\([^)]*\)", "")
    s = F.regexp_replace(s, r"^[¼-¾⅐-⅞]?\s*\d[\d/.,\-]*\s*", "")
    s = F.regexp_replace(s, r"^[¼-¾⅐-⅞]\s*", "")
    if units:
        s = F.regexp_replace(s, r"(?iU)\b(?:" + "|".join(literal(u) for u in _words(units)) + r")\.?\b", "")
    for at in ("^{}\\s+", "\\s+{}$"):
        for a in _words(adjectives):
            s = F.regexp_replace(s, "(?i)" + at.format(literal(a)), "")
    s = singular(strip(F.trim(strip(s), F.lit(","))))
    if aliases:
        other = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
        s = let(s, lambda name: F.coalesce(F.element_at(other, name), name))
    return F.coalesce(strip(s), F.lit(""))


# --- JSON and numbers --------------------------------------------------------------------------------------------


def parse_json(c: Column) -> Column:
    """JSON text as a variant; null for all else. (try_parse_json alone takes ``{} and more`` for an object.)"""
    whole = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.size(F.try_variant_get(whole, "$", "array<variant>")) == 1, F.try_variant_get(whole, "$[0]", "variant"))


def json_object(c: Column) -> Column:
    """What stands from the first { to the last }, where that is a JSON object; else null."""
    text = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.schema_of_variant(parse_json(text)).startswith("OBJECT"), text)


_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def optional_float(text: Column, path: str) -> Column:
    """The number (or numeric string) at a path of JSON text; booleans and all else are null."""
    v = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    raw = F.try_variant_get(v, path, "string")
    return F.when((kind != "BOOLEAN") & F.rlike(raw, F.lit(_NUMBER)), F.trim(raw).try_cast("double"))


def int_like(c: Column) -> Column:
    """A whole number, with thousands commas or not; null for all else."""
    n = float_like(c)
    return F.when(n == F.floor(n), n.try_cast("bigint"))


def float_like(c: Column) -> Column:
    text = F.regexp_replace(strip(c), ",", "")
    return F.when(F.rlike(text, F.lit(_NUMBER)), text.try_cast("double"))


def rate(c: Column) -> Column:
    """Percentages (over 1, at most 100) as shares."""
    return F.when((c > 1) & (c <= 100), c / 100).otherwise(c)


def find_keys(text: Column, wanted: dict[str, Sequence[str]]) -> Column:
    """A struct of JSON texts: under each name the first of its keys that JSON text has. A dotted key is a path from the root, any other is
    looked for at the top and then at all depths: of the outermost map first, then the first in order that is not null.

    Each document is parsed and walked once, however many names there are. Maps keep the order of the text, which variants
    do not, so this is a Python step over Arrow batches.
    """
    wanted = {name: list(keys) for name, keys in wanted.items()}
    plain_keys = {k for keys in wanted.values() for k in keys if "." not in k}

    def walk(value, left: set[str], found: dict) -> None:
        """Add what is under ``value`` for the keys in ``left`` that nothing has been found for."""
        if isinstance(value, dict):
            here = left & value.keys()
            for k in here:
                if value[k] is not None and k not in found:
                    found[k] = value[k]
            left, value = left - here, value.values()  # a map that has the key hides what is below it
        elif not isinstance(value, list):
            return
        for v in value:
            if not (left := left - found.keys()):
                return
            if isinstance(v, dict | list):
                walk(v, left, found)

    def one(t):
        try:
            root = json.loads(t)
        except (TypeError, ValueError):
            return dict.fromkeys(wanted)
        found: dict = {}
        walk(root, plain_keys, found)

        def value(key: str):
            if "." not in key:
                return found.get(key)
            at = root
            for part in key.split("."):
                at = at.get(part) if isinstance(at, dict) else None
            return at

        first = {name: next((v for v in map(value, keys) if v is not None), None) for name, keys in wanted.items()}
        return {name: None if v is None else json.dumps(v) for name, v in first.items()}

    @F.pandas_udf("struct<" + ",".join(f"`{name}`:string" for name in wanted) + ">")
    def search(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=list(wanted), dtype="object")

    return search(text)


def find_key(text: Column, keys: Sequence[str]) -> Column:
    """:func:`find_keys` for one name."""
    return find_keys(text, {"found": keys})["found"]


def plain(c: Column) -> Column:
    """JSON text of a string without its quotes; other JSON text as it is."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "string"), c)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def has_anchor(listed: Column, single: Column) -> Column:
    """Whether a row names what to keep: a list that is not empty, or where there is no list a text that is not blank."""
    return F.when(listed.isNotNull(), F.size(listed) > 0).otherwise(F.coalesce(strip(single) != "", F.lit(False)))


def model_name(document: Column) -> Column:
    """The fine-tuned model that a manifest names: only a string under a map counts, and not a blank one."""
    v = F.try_parse_json(document)
    at = F.try_variant_get(v, "$.job.fine_tuned_model", "variant")
    return F.when(F.schema_of_variant(at) == "STRING", blank(strip(F.try_variant_get(v, "$.job.fine_tuned_model", "string"))))


def reply_text(text: Column) -> Column:
    return F.coalesce(F.get_json_object(text, "$.choices[0].message.content"), F.lit(""))


def reply_tokens(text: Column, name: str) -> Column:
    return F.coalesce(F.get_json_object(text, f"$.usage.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))


def cache_key(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in the order of their names (nulls left out)."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])).cast("binary"), 256)


# --- formatting ---------------------------------------------------------------------------------------------------


# How reports write what is missing.
MISSING = "N/A"


def shown(form: str, c: Column) -> Column:
    """A number in a printf form (format_string alone writes ``null`` for none)."""
    return F.when(c.isNotNull(), F.format_string(form, c.cast("double"))).otherwise(MISSING)


def show_float(c: Column, digits: int = 3) -> Column:
    return shown(f"%.{digits}f", c)


def show_delta(c: Column) -> Column:
    """A share's change in per cent, with its sign."""
    return shown("%+.2f%%", c.cast("double") * 100)


def show_score_delta(c: Column) -> Column:
    return shown("%+.3f", c)


def show_money(c: Column) -> Column:
    return shown("$%.6f", c)


def show_flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), "YES").otherwise("NO")


def show_time(c: Column, zone: str = "Asia/Tokyo", name: str = "JST") -> Column:
    """An ISO time (UTC where it names no zone) as local time of ``zone`` (in a session whose zone is UTC); other text as it
    is; ``MISSING`` where there is none."""
    at = F.when(F.rlike(c, F.lit(r"^\s*\d{4}-\d\d-\d\d")), strip(c)).try_cast("timestamp")
    local = F.concat(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss"), F.lit(" " + name))
    return F.coalesce(local, blank(strip(c)), F.lit(MISSING))
