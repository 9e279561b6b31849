"""Stated swaps against what they rest on: the source's items, and the replacements that rules know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Vocabulary


def _normal(df: DataFrame, text: str, vocabulary: Vocabulary, *keys: str) -> DataFrame:
    """The distinct keys and normal names of ``df``, each different text normalised once."""
    names = df.select(text).where(F.col(text).isNotNull()).distinct().withColumn("_name", vocabulary.name(F.col(text)))
    return df.join(names, text).select(*keys, "_name").where("_name <> ''").distinct()


def anchored(pairs: DataFrame, items: DataFrame, rules: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``pairs`` (id, constraint, from, to and others) with ``from_grounded`` (the source's items have it), ``to_valid`` (a rule of the
    constraint puts it in place of something) and ``anchored`` (both).

    ``items`` (id, item) and ``rules`` (constraint, replacement) are compared by normal names, as equi-joins on keys and name; a pair
    matches one row of either at most, so none is doubled. What is null or has no name is not anchored.
    """
    v = vocabulary or Vocabulary()
    grounded = _normal(items, "item", v, "id").select(F.col("id").alias("_id"), F.col("_name").alias("_item"), F.lit(True).alias("_g"))
    known = _normal(rules, "replacement", v, "constraint").select(F.col("constraint").alias("_c"), F.col("_name").alias("_to"), F.lit(True).alias("_k"))
    texts = pairs.select(F.col("from").alias("_t")).unionAll(pairs.select(F.col("to"))).where("_t is not null").distinct()
    names = texts.withColumn("_n", v.name(F.col("_t")))
    of = lambda c: names.select(F.col("_t").alias(f"_t_{c}"), F.col("_n").alias(f"_n_{c}"))
    rows = pairs.join(of("from"), F.col("from") == F.col("_t_from"), "left").join(of("to"), F.col("to") == F.col("_t_to"), "left")
    rows = rows.join(grounded, (F.col("id") == F.col("_id")) & (F.col("_n_from") == F.col("_item")), "left")
    rows = rows.join(known, (F.col("constraint") == F.col("_c")) & (F.col("_n_to") == F.col("_to")), "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in pairs.columns], yes("_g").alias("from_grounded"), yes("_k").alias("to_valid"), (yes("_g") & yes("_k")).alias("anchored"))


def anchor_rate(rows: DataFrame, *by: Column) -> DataFrame:
    """pairs, grounded, valid and ``swap_anchor_rate`` (anchored of all pairs, 4 digits) of each group; null where there are none."""
    share = F.bround(F.try_divide(F.count_if("anchored"), F.count("*")), 4)
    return rows.groupBy(*by).agg(F.count("*").alias("pairs"), F.count_if("from_grounded").alias("grounded"), F.count_if("to_valid").alias("valid"), share.alias("swap_anchor_rate"))
