"""Registered queries for quantile sketches, totals of cross tables, and anchors of stated swaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import anchors, audit, sketches
from .queries import _query, _t, _template, hashing


@_query("""SELECT event_type, count(*)::BIGINT AS n, count(DISTINCT ts::DATE)::BIGINT AS days, true AS near_50, true AS near_95, true AS near_99, min(value) <= max(value) AS within FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    """Percentiles of each type from its days' sketches; ranks of what they say among all values are off by one per cent at most."""
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = _t(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"), "value")
    daily = sketches.sketched(rows, [F.col("event_type"), F.col("day")], F.col("value"))
    whole = sketches.quantiles(sketches.merged(daily, [F.col("event_type")]), shares)
    said = rows.join(F.broadcast(whole.select("event_type", *shares)), "event_type")  # a row for each type
    near = [(F.abs(F.count_if(F.col("value") <= F.col(c)) / F.count("*") - p) <= 0.01).alias(f"near_{c[1:]}") for c, p in shares.items()]
    return said.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), *near, ((F.min("value") <= F.min("p50")) & (F.max("p99") <= F.max("value"))).alias("within"))


@_query(f"""WITH t AS (SELECT CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS priority, CASE WHEN o_orderkey % 7 <> 0 THEN {_template("o_orderkey || o_orderpriority")} END AS template FROM orders)
SELECT priority, template, count(*)::BIGINT AS n, (grouping(priority) * 2 + grouping(template))::INT AS level FROM t GROUP BY CUBE (priority, template)""")
def template_totals(spark, sf_dir):
    """Counts by priority and template with all totals; nulls among the values are no totals."""
    t = hashing.template(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    rows = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderpriority")).alias("priority"), F.when(F.col("o_orderkey") % 7 != 0, t).alias("template"))
    return audit.cross_totals(rows, "priority", "template")


@_query("""WITH l AS (SELECT l_orderkey AS id, 'no_' || lower(l_returnflag) AS con, p_name, p_brand, l_quantity::INT AS q, l_linenumber AS n FROM lineitem JOIN part ON p_partkey = l_partkey),
item AS (SELECT DISTINCT id, p_name FROM l), rule AS (SELECT DISTINCT con, p_brand FROM l WHERE n = 1 AND q <= 2),
pair AS (SELECT id, con, CASE WHEN q % 5 = 0 THEN 'red gear' WHEN q % 5 = 1 THEN NULL ELSE p_name END AS f, p_brand AS t FROM l)
SELECT p.con AS "constraint", count(*)::BIGINT AS pairs, count(i.id)::BIGINT AS grounded, count(r.con)::BIGINT AS valid, round_even(count(*) FILTER (i.id IS NOT NULL AND r.con IS NOT NULL) / count(*), 4)::DOUBLE AS swap_anchor_rate
FROM pair p LEFT JOIN item i ON i.id = p.id AND i.p_name = p.f LEFT JOIN rule r ON r.con = p.con AND r.p_brand = p.t GROUP BY p.con""")
def swap_anchors(spark, sf_dir):
    """Each line of an order as a stated swap of its item for a brand: is the item among the order's, is the brand in a rule?"""
    q = F.col("l_quantity").cast("int")
    lines = _t(spark, sf_dir, "lineitem").join(_t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("no_"), F.lower("l_returnflag")).alias("constraint"), "p_name", "p_brand", q.alias("q"), "l_linenumber")
    items = lines.select("id", F.concat(F.col("q").cast("string"), F.lit(" "), F.upper("p_name"), F.lit("s (fresh)")).alias("item"))
    rules = lines.where("l_linenumber = 1 and q <= 2").select("constraint", F.concat(F.lit("**"), "p_brand", F.lit("**")).alias("replacement"))
    said = F.when(F.col("q") % 5 == 0, "red gears").when(F.col("q") % 5 != 1, F.concat(F.lit(" "), F.col("p_name")))
    pairs = lines.select("id", "constraint", said.alias("from"), F.lower("p_brand").alias("to"))
    return anchors.anchor_rate(anchors.anchored(pairs, items, rules), F.col("constraint"))
