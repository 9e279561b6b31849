"""Two runs compared row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import row_score, source_bucket
from ..functions.text import strip


class DuplicateIds(ValueError):
    """An id that should stand for one row is missing or stands for several."""


def bad_ids(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """The trimmed ids that are blank, missing or stand for several rows, with how many rows have them (``n``)."""
    named = rows.groupBy(strip(F.col(key).cast("string")).alias(key)).agg(F.count("*").alias("n"))
    return named.where((F.col("n") > 1) | F.col(key).isNull() | (F.col(key) == ""))


def require_unique(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """``rows`` with trimmed ids; raises where one is blank or repeated."""
    if bad := bad_ids(rows, key).limit(5).collect():
        raise DuplicateIds(", ".join(f"{r[key]!r} x {r['n']}" for r in bad))
    return rows.withColumn(key, strip(F.col(key).cast("string")))


def scored(rows: DataFrame) -> DataFrame:
    """row_id, score, source of ``rows`` (row_id, judge, constraint_pass, format_pass)."""
    s = row_score(F.col("judge"), F.col("constraint_pass"), F.col("format_pass"))
    return rows.select("row_id", s.alias("s")).select("row_id", "s.*")


def compare(baseline: DataFrame, candidate: DataFrame, delta: float = 0.0) -> DataFrame:
    """row_id, scores, delta, outcome and source of the rows that both runs have; a difference within ``delta`` is a tie."""
    a = scored(require_unique(baseline)).select("row_id", F.col("score").alias("baseline_score"), F.col("source").alias("sa"))
    b = scored(require_unique(candidate)).select("row_id", F.col("score").alias("candidate_score"), F.col("source").alias("sb"))
    gap = F.col("candidate_score") - F.col("baseline_score")
    outcome = F.when(gap.isNull(), "incomparable").when(F.abs(gap) <= delta, "tie").when(gap > 0, "win").otherwise("loss")
    return a.join(b, "row_id").select("row_id", "baseline_score", "candidate_score", gap.alias("delta"), outcome.alias("outcome"), source_bucket(F.col("sa"), F.col("sb")).alias("source"))


def mismatches(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """row_id, side (baseline_only or candidate_only) of the rows that one run alone has."""
    a, b = baseline.select("row_id").distinct(), candidate.select("row_id").distinct()
    return a.join(b, "row_id", "left_anti").withColumn("side", F.lit("baseline_only")).unionAll(b.join(a, "row_id", "left_anti").withColumn("side", F.lit("candidate_only")))


def tally(rows: DataFrame, matched: bool = True) -> DataFrame:
    """One row of counts and rates over :func:`compare`'s rows; rates are null where the runs' rows differ."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    comparable = count("win") + count("loss") + count("tie")
    headline = lambda c: F.bround(c, 4) if matched else F.lit(None).cast("double")
    return rows.agg(
        count("win").alias("wins"),
        count("loss").alias("losses"),
        count("tie").alias("ties"),
        count("incomparable").alias("incomparable"),
        headline(F.try_divide(count("win"), comparable)).alias("win_rate"),
        headline(F.try_divide(count("win") + count("tie"), comparable)).alias("non_loss_rate"),
        headline(F.avg("delta")).alias("mean_delta"),
        headline(F.try_divide(F.count_if(F.col("source") == "mixed"), F.count("*"))).alias("mixed_rate"),
    )


def by_source(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source", "outcome").agg(F.count("*").alias("n"))
