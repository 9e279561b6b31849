"""Counts, the quality gate and the export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import shown


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def cross_tab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """A row for each of ``rows`` (in order: ``rank``), counts for each of ``columns``, zeros where there is none."""
    counts = df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in columns])
    spark = df.sparkSession
    frame = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], f"{row} string, rank int")
    return frame.join(counts, row, "left").select(row, "rank", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in columns])


def cross_totals(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts by both, by each, and of all in one pass. ``level`` tells what a row is (0: both, 1: a ``row``'s total, 2: a ``column``'s, 3:
    all), as a null may also be a value."""
    return df.cube(row, column).agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


@dataclass(frozen=True)
class Check:
    metric: str
    op: str  # ">=", "==" or "within"
    threshold: float
    tolerance: float = 0.0


# The gate on a training set.
GATE = (
    Check("constraint_pass_rate", "==", 1.0),
    Check("semantic_completeness_rate", "==", 1.0),
    Check("completeness_rate", "==", 1.0),
    Check("mean_relevance", ">=", 0.55),
    Check("nontrivial_share", ">=", 0.9),
    Check("template_a", "within", 0.5, 0.1),
    Check("template_b", "within", 0.3, 0.1),
    Check("template_c", "within", 0.2, 0.1),
)


def metrics(rows: DataFrame) -> DataFrame:
    """One row of the gate's metrics, of the kept among ``rows`` (kept, constraint_pass, semantic_pass, complete,
    relevance, nontriviality, template); null where nothing is kept. One pass, partial sums."""
    kept = rows.where("kept")
    share = lambda c: F.bround(F.avg(c.cast("int").cast("double")), 4)
    return kept.agg(
        F.count("*").alias("kept_rows"),
        share(F.col("constraint_pass") == 1).alias("constraint_pass_rate"),
        share(F.col("semantic_pass") == 1).alias("semantic_completeness_rate"),
        share(F.col("complete")).alias("completeness_rate"),
        F.bround(F.avg("relevance"), 4).alias("mean_relevance"),
        share(F.col("nontriviality") >= 0.5).alias("nontrivial_share"),
        *[share(F.col("template") == t).alias(f"template_{t.lower()}") for t in "ABC"],
    )


def gate(one: DataFrame, checks: tuple[Check, ...] = GATE) -> DataFrame:
    """metric, value, op, threshold, passed for each check, from one row of metrics."""
    def test(c: Check) -> Column:
        v = F.col(c.metric)
        # a tolerance counts as reached up to the error of a binary fraction
        return {">=": v >= c.threshold, "==": v == c.threshold, "within": F.abs(v - c.threshold) <= c.tolerance + 1e-9}[c.op]

    each = F.array(*[F.struct(F.lit(c.metric).alias("metric"), F.col(c.metric).cast("double").alias("value"), F.lit(c.op).alias("op"), F.lit(c.threshold).alias("threshold"), F.coalesce(test(c), F.lit(False)).alias("passed")) for c in checks])
    return one.select(F.explode(each).alias("c")).select("c.*")


def gate_report(one: DataFrame, checks: tuple[Check, ...] = GATE) -> DataFrame:
    """gate_passed, failures: one row."""
    got = gate(one, checks)
    line = F.concat(F.col("metric"), F.lit(": "), shown("%.4f", F.col("value")), F.lit(" not "), F.col("op"), F.lit(" "), F.format_string("%.4f", "threshold"))
    return got.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("gate_passed"), F.array_sort(F.collect_list(F.when(~F.col("passed"), line))).alias("failures"))


def totals(*runs: DataFrame) -> DataFrame:
    """kept: rows kept over all runs; a missing flag counts as kept."""
    out = None
    for r in runs:
        part = r.agg(F.count_if(F.coalesce("kept", F.lit(True))).alias("kept"))
        out = part if out is None else out.unionAll(part)
    return out.agg(F.sum("kept").alias("kept"))
