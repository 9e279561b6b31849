"""Chat rows: arrays of struct<role, content> in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, normal_name, strip

ROLES = ("system", "user", "assistant", "tool")


def content_text(c: Column) -> Column:
    """Content as text: a string is itself; of a list (as JSON text) the parts' texts, joined by line breaks."""
    parts = F.from_json(c, "array<struct<type:string,text:string,content:string>>")
    texts = F.transform(parts, lambda p: F.when((p["type"] == "text") & p["text"].isNotNull(), p["text"]).otherwise(p["content"]))
    joined = strip(F.array_join(F.filter(texts, lambda t: t.isNotNull()), "\n"))
    return F.coalesce(F.when(F.rlike(c, F.lit(r"^\s*\[\s*\{")) & parts.isNotNull(), joined), c, F.lit(""))


def valid(messages: Column) -> Column:
    """Messages of a known role."""
    return F.filter(messages, lambda m: m["role"].isin(*ROLES))


def for_inference(messages: Column) -> Column:
    """Without a last assistant message; null where no user message is left."""
    n = F.size(messages)
    cut = F.when(F.try_element_at(messages, F.lit(-1))["role"] == "assistant", F.slice(messages, 1, n - 1)).otherwise(messages)
    return F.when(F.exists(cut, lambda m: m["role"] == "user"), cut)


def text_only(messages: Column) -> Column:
    """Messages with text, as text; null where no user message is left."""
    flat = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), strip(content_text(m["content"])).alias("content")))
    kept = F.filter(flat, lambda m: m["content"] != "")
    return F.when(F.exists(kept, lambda m: m["role"] == "user"), kept)


def user_text(messages: Column) -> Column:
    texts = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: strip(content_text(m["content"])))
    return F.array_join(F.filter(texts, lambda t: t != ""), "\n\n")


def gold(messages: Column) -> Column:
    """The last message's text where an assistant wrote it and it is not empty."""
    last = F.try_element_at(messages, F.lit(-1))
    return F.when(last["role"] == "assistant", blank(strip(content_text(last["content"]))))


def _items(c: Column, kind: str) -> Column:
    """A column's entries: of an array all that are not blank, of a string its parts between commas."""
    array = c if kind.startswith("array") else F.split(c, ",")
    return F.coalesce(F.filter(F.transform(array, lambda x: strip(x.cast("string"))), lambda x: x != ""), F.array().cast("array<string>"))


def dedupe(names: Column) -> Column:
    """The first spelling of each normalised name, in order."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        key = normal_name(x)
        old = F.array_contains(acc["seen"], key)
        return F.struct(F.when(old, acc["seen"]).otherwise(F.array_append(acc["seen"], key)).alias("seen"), F.when(old, acc["kept"]).otherwise(F.array_append(acc["kept"], x)).alias("kept"))

    return F.aggregate(names, start, add, lambda acc: acc["kept"])


def restrictions(columns: Sequence[tuple[Column, str]], user: Column) -> Column:
    """Restrictions of a row: of its columns (with their types) in order; else of its user text's ``Restrictions:`` line,
    or of a quoted list behind ``categories:``."""
    given = F.concat(*[_items(c, kind) for c, kind in columns]) if columns else F.array().cast("array<string>")
    line = _items(blank(F.regexp_extract(user, r"(?im)^\s*restrictions\s*:\s*(.+)$", 1)), "string")
    listed = F.regexp_extract(user, r"(?is)categories\s*:\s*\[(.*?)\]", 1)
    quoted = F.transform(F.regexp_extract_all(listed, F.lit("[\"']([^\"']+)[\"']"), 1), lambda x: strip(x))
    return F.when(F.size(given) > 0, dedupe(given)).when(F.size(line) > 0, dedupe(line)).otherwise(dedupe(F.filter(quoted, lambda x: x != "")))


def row_id(names: Sequence[Column], number: Column) -> Column:
    """The first of the columns that is not blank, else ``row_<number>``."""
    return F.coalesce(*[blank(strip(c.cast("string"))) for c in names], F.concat(F.lit("row_"), number.cast("string")))
