"""Evaluation rows and their summary. Pass flags have three values: null where nothing could be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lex
from ..functions import sections as sec


def evaluate(rows: DataFrame, lexicon: lex.Lexicon) -> DataFrame:
    """``rows`` (output_text, restrictions and others) with format_pass, missing_sections, deterministic, scan_mode."""
    out = rows.withColumn("missing_sections", sec.missing_sections(F.col("output_text"))).withColumn("_scan", sec.scan_text(F.col("output_text")))
    out = out.withColumn("deterministic", lex.check_restrictions(F.col("_scan.text"), F.col("restrictions"), lexicon)).withColumn("scan_mode", F.col("_scan.mode"))
    return out.withColumn("format_pass", F.size("missing_sections") == 0).withColumn("constraint_pass", F.col("deterministic.constraint_pass")).drop("_scan")


def _share(flag: Column) -> Column:
    return F.avg(flag.cast("int").cast("double"))


def summary(rows: DataFrame, input_price: float = 0.0, output_price: float = 0.0) -> DataFrame:
    """One row over ``rows`` (format_pass, constraint_pass, judge, tokens_in, tokens_out).

    The headline average is null unless every row was judged; prices are for a million tokens.
    """
    n, judged = F.count("*"), F.count("judge")
    cost = (F.sum("tokens_in") * input_price + F.sum("tokens_out") * output_price) / 1e6
    return rows.agg(
        n.alias("rows"),
        F.bround(_share(F.col("format_pass")), 4).alias("format_pass_rate"),
        F.bround(_share(F.col("constraint_pass")), 4).alias("constraint_pass_rate"),
        F.count("constraint_pass").alias("constraint_checked"),
        judged.alias("judged"),
        (n - judged).alias("judge_missing"),
        F.bround(F.try_divide(judged, n), 4).alias("judge_coverage"),
        F.bround(F.when(judged == n, F.avg("judge")), 4).alias("judge_average"),
        F.bround(F.avg("judge"), 4).alias("judge_average_scored"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.bround(F.coalesce(cost, F.lit(0.0)), 6).alias("cost"),
    )


def by_restriction(rows: DataFrame) -> DataFrame:
    """restriction, rows, format and constraint rates, judge average."""
    each = rows.select(F.explode("restrictions").alias("restriction"), "format_pass", "constraint_pass", "judge")
    return each.groupBy("restriction").agg(F.count("*").alias("rows"), F.bround(_share(F.col("format_pass")), 4).alias("format_pass_rate"), F.bround(_share(F.col("constraint_pass")), 4).alias("constraint_pass_rate"), F.bround(F.avg("judge"), 4).alias("judge_average"))


def term_frequency(rows: DataFrame) -> DataFrame:
    """term, n: how many rows' checks matched each term."""
    each = rows.select(F.explode("deterministic.violations").alias("v")).select(F.explode("v.matched_terms").alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n"))


def tracked(rows: DataFrame, one: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What an experiment tracker takes: metrics (name, value; null as 0.0) and a table of six columns."""
    names = [c for c, k in one.dtypes if k in ("double", "bigint", "int")]
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("value")) for c in names])
    return one.select(F.explode(each).alias("m")).select("m.*"), rows.select("row_id", F.array_join("restrictions", ", ").alias("restrictions"), "constraint_pass", "format_pass", "judge", "output_text")
