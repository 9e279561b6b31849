"""Validation of JSON Lines training files, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.messages import ROLES
from ..functions.text import parse_json


def _kind(v: Column) -> Column:
    """object, array, string, number, boolean or null."""
    s = F.schema_of_variant(v)
    return F.when(v.isNull(), None).when(s.startswith("OBJECT"), "object").when(s.startswith("ARRAY"), "array").when(s == "STRING", "string").when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").otherwise("number")


def message_errors(message: Column, place: Column) -> Column:
    """What is wrong with one message (a variant)."""
    at = F.concat(F.lit("messages["), place.cast("string"), F.lit("]"))
    role = F.when(_kind(F.try_variant_get(message, "$.role", "variant")) == "string", F.try_variant_get(message, "$.role", "string"))
    content, calls = F.try_variant_get(message, "$.content", "variant"), F.try_variant_get(message, "$.tool_calls", "variant")
    say = lambda bad, text: F.when(bad, F.concat(at, F.lit(text)))
    found = F.array(
        say(~F.coalesce(role.isin(*ROLES), F.lit(False)), ".role is unknown"),
        say(content.isNull() & calls.isNull(), " has neither content nor tool_calls"),
        say(calls.isNotNull() & ~F.coalesce(role == "assistant", F.lit(False)), " has tool_calls but is no assistant's"),
        say(content.isNotNull() & ~_kind(content).isin("string", "array"), ".content is neither string nor list"),
    )
    return F.when(_kind(message) != "object", F.array(F.concat(at, F.lit(" is no object")))).otherwise(F.filter(found, lambda e: e.isNotNull()))


def validate_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (path, line, value) with status (record, parse_error or blank), errors, assistants."""
    v = parse_json(F.col("value"))
    rows = lines.withColumn("_v", v).withColumn("_list", F.try_variant_get("_v", "$.messages", "array<variant>"))
    blank = F.trim(F.regexp_replace("value", r"\s+", " ")) == ""
    role = lambda m: F.coalesce(F.try_variant_get(m, "$.role", "string") == "assistant", F.lit(False))
    count = F.size(F.filter("_list", role))
    some = F.size(F.coalesce("_list", F.array().cast("array<variant>"))) > 0
    each = F.flatten(F.transform("_list", message_errors))
    errors = (
        F.when(blank, F.array(F.lit("blank line")))
        .when(F.col("_v").isNull(), F.array(F.lit("no JSON")))
        .when(_kind(F.col("_v")) != "object", F.array(F.lit("no object")))
        .when(~some, F.array(F.lit("no messages")))
        .otherwise(F.concat(each, F.when(count == 0, F.array(F.lit("no assistant message"))).otherwise(F.array().cast("array<string>"))))
    )
    status = F.when(blank, "blank").when(F.col("_v").isNull(), "parse_error").otherwise("record")
    return rows.select("path", "line", status.alias("status"), errors.alias("errors"), F.when(some, count).otherwise(0).alias("assistants"))


def file_stats(checked: DataFrame) -> DataFrame:
    """path, lines, records, assistants, parse_errors, schema_errors: one row per file, partial sums."""
    wrong = F.when(F.col("status") == "parse_error", 0).otherwise(F.size("errors"))
    return checked.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("status") == "record").alias("records"), F.sum("assistants").alias("assistants"), F.count_if(F.col("status") == "parse_error").alias("parse_errors"), F.sum(wrong).alias("schema_errors"))


def first_errors(checked: DataFrame, n: int = 20) -> DataFrame:
    """path, line, error: the first ``n`` errors in order (a report)."""
    return checked.select("path", "line", F.posexplode("errors").alias("i", "error")).orderBy("path", "line", "i").limit(n).select("path", "line", "error")


def preflight(stats: DataFrame, sizes: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """``sizes`` (path, bytes; all files there are) with their ``stats`` (none: an empty file), and ``passed``: no errors,
    some records, not too large."""
    counts = ["lines", "records", "assistants", "parse_errors", "schema_errors"]
    rows = sizes.select("path", "bytes").join(stats, "path", "left").select("path", "bytes", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    good = (F.col("parse_errors") == 0) & (F.col("schema_errors") == 0) & (F.col("records") > 0) & (F.col("bytes") <= most_bytes)
    return rows.withColumn("passed", good)
