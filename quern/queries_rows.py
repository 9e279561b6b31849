"""Registered queries for row-level operators: cells, messages, replies, sections, scores, reports and decisions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import hashing, lexicon, messages, prompts, scoring, sections, text
from .operators import audit, decide, evals, generate, pairwise, recipes, select
from .plans import curation
from .queries import LEXICON, _CHATS_SQL, _EVAL, _LI, _RUNS, _chats, _evaluated, _parts, _query, _recipes, _runs, _t, _template

# --- cells and names -------------------------------------------------------------------------------------------------


@_query(r"""SELECT p_partkey, CASE p_partkey % 8 WHEN 3 THEN p_name WHEN 4 THEN p_name || '|' || p_brand WHEN 5 THEN p_name || '|' || p_type WHEN 6 THEN 'a \"b\"|' || p_name WHEN 7 THEN '' ELSE '' END AS items FROM part""")
def r_vector(spark, sf_dir):
    k, n, b = F.col("p_partkey") % 8, F.col("p_name"), F.col("p_brand")
    cell = F.when(k == 0, F.lit(None).cast("string")).when(k == 1, " NA ").when(k == 2, "character(0)").when(k == 3, n)
    cell = cell.when(k == 4, F.concat(F.lit('c("'), n, F.lit('", "NA", "", "'), b, F.lit('")'))).when(k == 5, F.concat(F.lit("c("), n, F.lit(", NA, "), F.col("p_type"), F.lit(")")))
    cell = cell.when(k == 6, F.concat(F.lit('c("a \\"b\\"", "'), n, F.lit('")'))).otherwise("nan")
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(text.r_vector(cell), "|").alias("items"))


@_query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1234000 + c_custkey END AS whole, CASE c_custkey % 4 WHEN 0 THEN (1234000 + c_custkey)::DOUBLE WHEN 1 THEN c_custkey + 0.5::DOUBLE END AS number,
round_even(CASE WHEN c_custkey % 250 > 1 AND c_custkey % 250 <= 100 THEN (c_custkey % 250) / 100 ELSE c_custkey % 250 END, 6)::DOUBLE AS share FROM customer""")
def number_cells(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit(" 1,234,"), F.lpad((k % 1000).cast("string"), 3, "0"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(".5"))).when(k % 4 == 2, "true").otherwise("1d")
    raw = F.when(k % 4 == 0, F.format_string("%,d", (k + 1234000).cast("bigint"))).otherwise(raw)
    return _t(spark, sf_dir, "customer").select("c_custkey", text.int_like(raw).alias("whole"), text.float_like(raw).alias("number"), F.bround(text.rate((k % 250).cast("double")), 6).alias("share"))


@_query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '"top"' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN '[1]' WHEN 3 THEN 'true' END AS found, CASE WHEN p_partkey % 5 = 1 THEN p_size::VARCHAR END AS dotted FROM part""")
def nested_keys(spark, sf_dir):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    doc = F.when(k == 0, '{"a": {"key": 1}, "key": "top"}').when(k == 1, F.concat(F.lit('{"a": [{"x": null}, {"b": {"key": '), size, F.lit('}}], "m": {"key": '), size, F.lit("}}")))
    doc = doc.when(k == 2, '{"a": {"key": null}, "z": {"key": [1]}}').when(k == 3, '{"a": {"other": true}}').otherwise("no json")
    return _parts(spark, sf_dir).select("p_partkey", text.find_key(doc, ["key", "other"]).alias("found"), text.find_key(doc, ["m.key"]).alias("dotted"))



@_query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE printf('%.3f', c_acctbal / 7) END AS number, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE printf('%+.2f%%', (c_custkey - 50) / 8 * 100) END AS share,
CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE printf('%+.3f', (c_custkey - 50) / 8) END AS score, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE '$' || printf('%.6f', c_custkey / 64) END AS money, CASE WHEN c_custkey % 2 = 0 THEN 'YES' ELSE 'NO' END AS flag,
CASE c_custkey % 3 WHEN 0 THEN 'N/A' WHEN 1 THEN 'soon' ELSE strftime(TIMESTAMP '2024-01-31 20:00:00' + to_hours(9 + (c_custkey % 48)::INT), '%Y-%m-%d %H:%M:%S') || ' JST' END AS at FROM customer""")
def report_values(spark, sf_dir):
    k = F.col("c_custkey")
    some = lambda c: F.when(k % 3 != 0, c)
    at = F.when(k % 3 == 1, "soon").when(k % 3 == 2, F.concat(F.date_format(F.expr("timestamp_ntz'2024-01-31 20:00:00' + make_dt_interval(0, cast(c_custkey % 48 as int))"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    d = (k - 50) / F.lit(8.0)
    return _t(spark, sf_dir, "customer").select("c_custkey", text.show_float(some(F.col("c_acctbal") / 7)).alias("number"), text.show_delta(some(d)).alias("share"), text.show_score_delta(some(d)).alias("score"), text.show_money(some(k / F.lit(64.0))).alias("money"), text.show_flag(k % 2 == 0).alias("flag"), text.show_time(at).alias("at"))


@_query("SELECT n_nationkey, n_nationkey % 6 < 5 AS yes FROM nation")
def truthy_words(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("1", " True", "YES", "y ", "on", "0")])
    return _t(spark, sf_dir, "nation").select("n_nationkey", text.truthy(F.get(words, (F.col("n_nationkey") % 6).cast("int"))).alias("yes"))


@_query("SELECT p_partkey, p_partkey % 4 IN (0, 2) AS anchored FROM part")
def flavor_anchor(spark, sf_dir):
    k = F.col("p_partkey") % 4
    listed = F.when(k == 0, F.array("p_name")).when(k == 1, F.array().cast("array<string>"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.has_anchor(listed, F.when(k == 2, F.col("p_name")).when(k == 3, " \t")).alias("anchored"))


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'hi ' || p_name ELSE '' END AS reply, CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN p_size ELSE 0 END::BIGINT AS tokens, CASE WHEN p_partkey % 4 = 1 THEN p_name END AS model FROM part""")
def reply_fields(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    doc = F.when(k == 0, F.concat(F.lit('{"choices": [{"message": {"content": "hi '), F.col("p_name"), F.lit('"}}], "usage": {"prompt_tokens": '), size, F.lit("}}")))
    doc = doc.when(k == 1, F.concat(F.lit('{"job": {"fine_tuned_model": " '), F.col("p_name"), F.lit(' "}, "choices": [], "usage": {"prompt_tokens": "'), size, F.lit('"}}'))).when(k == 2, '{"job": {"fine_tuned_model": 7}, "usage": 3}').otherwise('{"job": {"fine_tuned_model": " "}}')
    return _t(spark, sf_dir, "part").select("p_partkey", text.reply_text(doc).alias("reply"), text.reply_tokens(doc, "prompt_tokens").alias("tokens"), text.model_name(doc).alias("model"))


# --- messages and prompts ----------------------------------------------------------------------------------------------


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || chr(10) || p_brand WHEN 2 THEN p_type WHEN 3 THEN '' END AS flat FROM part""")
def content_flatten(spark, sf_dir):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    raw = F.when(k == 0, n).when(k == 1, F.concat(F.lit('[{"type": "text", "text": "'), n, F.lit('"}, {"type": "image", "content": "'), F.col("p_brand"), F.lit('"}]')))
    raw = raw.when(k == 2, F.concat(F.lit(' [{"type": "text", "content": "'), F.col("p_type"), F.lit('"}, {"type": "image"}]')))
    return _t(spark, sf_dir, "part").select("p_partkey", messages.content_text(raw).alias("flat"))


@_query(f"""{_CHATS_SQL} SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) FILTER (turn % 3 <> 2) AS roles, count(*)::INT AS n,
CASE WHEN bool_or(role = 'user' AND said <> '' AND turn % 5 <> 1) THEN string_agg(said, '|' ORDER BY turn, role, text) FILTER (said <> '' AND turn % 5 <> 1) END AS said FROM c GROUP BY conv_id""")
def message_rows(spark, sf_dir):
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    odd = F.transform("t", lambda t: F.struct(F.when(t["turn"] % 3 == 2, "narrator").otherwise(t["role"]).alias("role"), t["text"].alias("content")))
    blank = F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.when(t["turn"] % 5 == 1, " ").otherwise(t["text"]).alias("content")))
    rows = turns.select("conv_id", messages.valid(odd).alias("v"), F.size("t").alias("n"), messages.text_only(blank).alias("s"))
    return rows.select("conv_id", F.when(F.size("v") > 0, F.array_join(F.transform("v", lambda m: m["role"]), ",")).alias("roles"), "n", F.array_join(F.transform("s", lambda m: m["content"]), "|").alias("said"))


@_query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'a' || o_orderkey WHEN 1 THEN 'b' || o_orderkey WHEN 2 THEN o_orderkey::VARCHAR ELSE 'row_' || o_orderkey END AS row_id FROM orders")
def row_ids(spark, sf_dir):
    k = F.col("o_orderkey")
    first = F.when(k % 4 == 0, F.concat(F.lit(" a"), k.cast("string"))).when(k % 4 == 1, "  ")
    second = F.when(k % 4 == 1, F.concat(F.lit("b"), k.cast("string"))).when(k % 4 == 0, "x")
    return _t(spark, sf_dir, "orders").select("o_orderkey", messages.row_id([first, second, F.when(k % 4 == 2, k)], k).alias("row_id"))


_TIERS = {t: len(prompts.SYSTEMS[t]) for t in prompts.SYSTEMS}


@_query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 512 WHEN 1 THEN 1024 ELSE 2048 END AS budget, CASE n_nationkey % 3 WHEN 0 THEN {concise} WHEN 1 THEN {standard} ELSE {rich} END AS chars FROM nation""".format(**_TIERS))
def system_prompts(spark, sf_dir):
    tier = F.get(F.array(F.lit("concise"), F.lit("standard"), F.lit("rich")), (F.col("n_nationkey") % 3).cast("int"))
    return _t(spark, sf_dir, "nation").select("n_nationkey", prompts.by_tier(tier, prompts.BUDGET).alias("budget"), F.length(prompts.by_tier(tier, prompts.SYSTEMS)).alias("chars"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Adapt this recipe for: nut free, ' || p_brand || chr(10) || chr(10) || p_name || ' ' ELSE p_name || ' ' END AS endpoint, CASE WHEN p_partkey % 2 = 0 THEN p_name || chr(10) || chr(10) || 'Restrictions: nut_free, ' || p_brand ELSE p_name END AS demo FROM part""")
def restriction_prompts(spark, sf_dir):
    user = F.concat("p_name", F.lit(" "))
    named = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("nut_free"), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    blanks = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(" nut_free"), F.lit(" "), F.col("p_brand"))).otherwise(F.array(F.lit(" ")))
    return _t(spark, sf_dir, "part").select("p_partkey", prompts.endpoint_message(user, named).alias("endpoint"), prompts.demo_prompt(user, blanks).alias("demo"))


@_query(f"""{_CHATS_SQL}, u AS (SELECT conv_id, coalesce(string_agg(said, chr(10) || chr(10) ORDER BY turn, role, text) FILTER (role = 'user' AND said <> ''), '') AS t, count(*) AS n FROM c GROUP BY conv_id)
SELECT conv_id, md5('Evaluate the model output.' || chr(10) || chr(10) || 'Restrictions: ' || CASE WHEN conv_id % 2 = 0 THEN 'vegan, nut_free' ELSE '(not provided)' END || chr(10) || chr(10) || 'Original user request:' || chr(10) || t || chr(10) || chr(10) || 'Model output:' || chr(10) || n || chr(10) || chr(10)
|| 'Return JSON with keys: compliance (1-10), flavor_fidelity (1-10), dish_identity_preservation (1-10), explanation_quality (1-10), overall_score (float 1-10), verdict (PASS/FAIL), notes (string).') AS asked, 7.0::DOUBLE AS judge FROM u""")
def judge_prompt(spark, sf_dir):
    named = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("vegan"), F.lit("nut_free"))).otherwise(F.array().cast("array<string>"))
    rows = _chats(spark, sf_dir).select("conv_id", named.alias("restrictions"), messages.user_text(F.col("messages")).alias("user_text"), F.size("messages").cast("string").alias("output_text"))
    asked = prompts.judge_messages(F.col("restrictions"), F.col("user_text"), F.col("output_text"))[1]["content"]
    return generate.judged(rows).select("conv_id", F.md5(asked.cast("binary")).alias("asked"), "judge")


# --- sections --------------------------------------------------------------------------------------------------------


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '>plain ' || p_name || '|old>' || p_brand ELSE '' END AS pairs FROM part""")
def table_pairs(spark, sf_dir):
    n = F.col("p_name")
    head = F.when(F.col("p_partkey") % 2 == 0, "| Ingredient | Why | Swap |").otherwise("| A | B | C |")
    table = F.concat(F.lit("before\n"), head, F.lit("\n|---|---|---|\n| **"), n, F.lit("** | x | plain "), n, F.lit(" |\n| | x | y |\n| old | x | "), F.col("p_brand"), F.lit(" |\nafter\n| a | b | c |"))
    pairs = sections.table_pairs(table)
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["from"], F.lit(">"), p["to"])), "|").alias("pairs"))


@_query("""SELECT p_partkey, p_brand || '>plain ' || p_type || '|old>new ' || p_brand AS pairs FROM part""")
def prose_pairs(spark, sf_dir):
    said = F.concat(F.lit("We replace "), F.col("p_brand"), F.lit(" with plain "), F.col("p_type"), F.lit(". Then **Replaced** old with new "), F.col("p_brand"), F.lit(", and so on"))
    pairs = sections.prose_pairs(said)
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["from"], F.lit(">"), p["to"])), "|").alias("pairs"))


def _response(k: Column, name: Column, brand: Column) -> Column:
    """A well-formed response, with flaws that hang on the key: bold headers, a doubled section, an ellipsis, no plan."""
    return F.concat(
        F.when(k % 5 != 0, F.concat(F.lit("**Substitution Plan**\n- "), name, F.lit(" -> plain "), brand, F.lit(": lighter\n"))).otherwise(""),
        F.when(k % 4 == 0, "## Adapted Steps:\n1. gone\n").otherwise(""),
        F.lit("Adapted Ingredients:\n- 2 cups plain "), brand, F.lit("\n* 1 "), F.when(k % 3 == 0, name).otherwise("water"), F.lit("\n\n3) "), F.when(k % 7 == 0, "salt\n- oil\n- rice\n").otherwise("1 pinch salt\n"),
        F.lit("Adapted Steps\n1) Mix "), brand, F.lit("\nStep 2: Bake"), F.when(k % 6 == 0, "...").otherwise("."), F.lit("\n## Flavor Preservation Notes\n- mild\n# Constraint Check\n- ok\n"),
    )


def _parsed(spark, sf_dir) -> DataFrame:
    k, n, b = F.col("p_partkey"), F.col("p_name"), F.col("p_brand")
    return _parts(spark, sf_dir).select("p_partkey", "p_name", "p_brand", _response(k, n, b).alias("text")).withColumn("p", sections.parse(F.col("text")))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name || '>plain ' || p_brand || '>lighter' ELSE '' END AS pairs, '2 cups plain ' || p_brand || '|1 ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'water' END || CASE WHEN p_partkey % 7 = 0 THEN '|salt|oil|rice' ELSE '|1 pinch salt' END AS items,
'Mix ' || p_brand || '|Bake' || CASE WHEN p_partkey % 6 = 0 THEN '...' ELSE '.' END AS steps, '- mild' AS notes, '- ok' AS checked,
CASE WHEN p_partkey % 5 <> 0 THEN 'Substitution Plan|' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN 'Adapted Steps|Adapted Ingredients' ELSE 'Adapted Ingredients|Adapted Steps' END || '|Flavor Preservation Notes|Constraint Check' AS found FROM part""")
def parsed_response(spark, sf_dir):
    joined = lambda c: F.array_join(c, "|")
    pairs = F.transform("p.pairs", lambda x: F.concat_ws(">", x["from"], x["to"], x["reason"]))
    return _parsed(spark, sf_dir).select("p_partkey", joined(pairs).alias("pairs"), joined("p.ingredients").alias("items"), joined("p.steps").alias("steps"), F.col("p.notes").alias("notes"), F.col("p.check").alias("checked"), joined("p.found").alias("found"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN 'Substitution Plan:' || chr(10) || '- ' || p_name || ' -> plain ' || p_brand || ': lighter' || chr(10) || chr(10) ELSE '' END || 'Adapted Ingredients:' || chr(10) || '- 2 cups plain ' || p_brand || chr(10) || '* 1 ' || CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'water' END || chr(10) || chr(10) || '3) '
|| CASE WHEN p_partkey % 7 = 0 THEN 'salt' || chr(10) || '- oil' || chr(10) || '- rice' ELSE '1 pinch salt' END || chr(10) || chr(10) || 'Adapted Steps:' || chr(10) || '1) Mix ' || p_brand || chr(10) || 'Step 2: Bake' || CASE WHEN p_partkey % 6 = 0 THEN '...' ELSE '.' END || chr(10) || chr(10) || 'Flavor Preservation Notes:' || chr(10) || '- mild' || chr(10) || chr(10) || 'Constraint Check:' || chr(10) || '- ok' AS answer, 3 AS turns FROM part""")
def export_text(spark, sf_dir):
    turns = prompts.export_messages(prompts.chat(F.lit("s"), F.col("p_name")), F.col("p"))
    return _parsed(spark, sf_dir).select("p_partkey", F.element_at(turns, -1)["content"].alias("answer"), F.size(turns).alias("turns"))


# --- scores ----------------------------------------------------------------------------------------------------------

_PLAN = scoring.Vocabulary(("cups", "cup", "pinch"), ())
#: One violation: the part itself; every eleventh part has a second one that no plan names.
_FAILS = """f AS (SELECT *, list_filter([CASE WHEN p_partkey % 6 = 0 THEN 'contains_ellipsis' END, CASE WHEN p_partkey % 7 = 0 THEN 'adapted_ingredients_missing_quantities (3/5 lines lack quantities)' END,
 CASE WHEN p_partkey % 5 = 0 THEN 'violation_unmapped_in_substitution_plan: 1 ' || p_name END, CASE WHEN p_partkey % 11 = 0 THEN 'violation_unmapped_in_substitution_plan: zzz' END,
 CASE WHEN p_partkey % 5 <> 0 AND p_partkey % 3 = 0 THEN 'banned_ingredient_in_adapted_content: ' || p_name END], lambda x: x IS NOT NULL) AS fails FROM part)"""


def _violated(spark, sf_dir) -> DataFrame:
    hit = lambda c: F.struct(c.alias("ingredient"), F.lit("r").alias("reason"), F.lit("t").alias("term"))
    found = F.concat(F.array(hit(F.concat(F.lit("1 "), "p_name"))), F.when(F.col("p_partkey") % 11 == 0, F.array(hit(F.lit("zzz")))).otherwise(F.array().cast("array<struct<ingredient:string,reason:string,term:string>>")))
    return _parsed(spark, sf_dir).withColumn("violations", found)


@_query(f"WITH {_FAILS} SELECT p_partkey, array_to_string(fails, '|') AS failures FROM f")
def completeness(spark, sf_dir):
    return _violated(spark, sf_dir).select("p_partkey", F.array_join(scoring.completeness_failures(F.col("text"), F.col("p"), F.col("violations"), _PLAN), "|").alias("failures"))


_BAN = lexicon.Lexicon({"no_water": ["water"]})
_AUDIT = f"""{_FAILS}, s AS (SELECT p_partkey, (p_partkey % 3 = 0)::INT AS cp, (p_partkey % 2)::INT AS semantic, len(fails) AS n, CASE WHEN p_partkey % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS relevance,
 round_even(0.8::DOUBLE * CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 11 = 0 THEN 0.5 ELSE 1 END + 0.2::DOUBLE, 4)::DOUBLE AS nontrivial FROM f)"""


def _audited(spark, sf_dir) -> DataFrame:
    user = F.concat(F.lit("Recipe: "), "p_name", F.lit("\nIngredients: x\nSteps: y"), F.when(F.col("p_partkey") % 2 == 1, "\nRestrictions: no water").otherwise(""))
    source = F.array(F.concat(F.lit("1 "), "p_name"), F.lit("1 cup water"))
    scores = scoring.audit_scores(F.col("text"), user, F.col("p"), source, F.array(F.lit("a")), F.col("violations"), _BAN, "no_water", _PLAN)
    return _violated(spark, sf_dir).withColumn("scores", scores)


@_query(f"WITH {_AUDIT} SELECT p_partkey, cp AS constraint_pass, relevance AS relevance_score, nontrivial AS nontriviality_score, semantic AS semantic_completeness_pass, n::INT AS failures FROM s")
def audit_scores(spark, sf_dir):
    s = F.col("scores")
    return _audited(spark, sf_dir).select("p_partkey", s["constraint_pass"].alias("constraint_pass"), s["relevance_score"].alias("relevance_score"), s["nontriviality_score"].alias("nontriviality_score"), s["semantic_completeness_pass"].alias("semantic_completeness_pass"), F.size(s["completeness_failures"]).alias("failures"))


_WHY = "CASE WHEN cp <> 1 THEN 'constraint_fail' WHEN semantic <> 1 THEN 'semantic_fail' WHEN n > 0 THEN 'completeness_fail' END"


@_query(f"WITH {_AUDIT} SELECT coalesce({_WHY}, 'kept') AS reason, count(*)::BIGINT AS n FROM s GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return audit.count_by(_audited(spark, sf_dir), F.coalesce(scoring.reject_reason(F.col("scores")), F.lit("kept")), "reason")


@_query(f"""WITH {_AUDIT} SELECT p_partkey::VARCHAR AS source_recipe_id, {_template("p_partkey || 'no_water'")} AS template_id, {_WHY} IS NULL AS kept_for_training, {_WHY} AS reject_reason, 'v0' AS kb_version, (1 + (p_partkey % 11 = 0)::INT)::INT AS violations, (p_partkey % 5 <> 0)::INT AS pairs FROM s""")
def master_rows(spark, sf_dir):
    rows = _audited(spark, sf_dir).select(
        F.col("p_partkey").cast("string").alias("id"), F.lit("no_water").alias("target_restriction"), F.col("p_name").alias("title"), F.array("p_name").alias("ingredients"), F.array(F.lit("a")).alias("steps"), "violations", F.col("p").alias("parsed"), "scores",
        prompts.chat(F.lit("s"), F.col("p_name")).alias("messages"), F.lit("standard").alias("richness_tier"), scoring.reject_reason(F.col("scores")).alias("reject_reason"),
    )
    out = recipes.master_rows(rows.withColumn("template_id", hashing.template(F.col("id"), F.col("target_restriction"))), "v0")
    return out.select("source_recipe_id", "template_id", "kept_for_training", "reject_reason", "kb_version", F.size("detected_violations").alias("violations"), F.size("replacement_pairs").alias("pairs"))


_REASONS = lexicon.Lexicon(LEXICON.terms, reasons={"no_metal": {"ring": "first", "bolt": "never", "rods": "long", "gear": "gears", "red ": "equal", "old ": "late"}})


@_query(f"""WITH {_LI}, x AS (SELECT id, unnest(items) AS item FROM orders_of)
SELECT id, CASE WHEN contains(item, 'ring') THEN 'first' WHEN contains(item, 'red ') THEN 'equal' WHEN contains(item, 'old ') THEN 'late' ELSE 'violates_no_metal' END AS reason, count(*)::BIGINT AS n FROM x WHERE regexp_matches(item, '\\b(red ring|old rod|ring|rod)\\b') GROUP BY 1, 2""")
def violation_reasons(spark, sf_dir):
    rows = _items_of(spark, sf_dir).withColumn("item", F.explode("items")).withColumn("v", lexicon.violations(F.array("item"), _REASONS, "no_metal"))
    return rows.where(F.size("v") > 0).groupBy("id", F.col("v")[0]["reason"].alias("reason")).agg(F.count("*").alias("n"))


def _items_of(spark, sf_dir) -> DataFrame:
    from .queries import _items

    return _items(spark, sf_dir).select("id", "items")


# --- large lexicons ----------------------------------------------------------------------------------------------------

_WORDS = "[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]+"


@_query(f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS w FROM documents),
term AS (SELECT w, min(lang) AS c FROM w WHERE length(w) > 3 AND lang IS NOT NULL GROUP BY w ORDER BY md5(w), w LIMIT 10000),
n AS (SELECT doc_id, c, count(*)::INT AS n FROM w JOIN term USING (w) GROUP BY 1, 2)
SELECT d.doc_id, coalesce(max(n) FILTER (c = 'en'), 0)::INT AS en, coalesce(max(n) FILTER (c = 'fr'), 0)::INT AS fr, (coalesce(max(n) FILTER (c = 'de'), 0) = 0)::INT AS no_de FROM (SELECT * FROM documents WHERE text IS NOT NULL) d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def large_lexicon(spark, sf_dir):
    """A lexicon of thousands of the documents' own words, by the first of their languages, against all documents."""
    docs = _t(spark, sf_dir, "documents").where("text is not null")
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(_WORDS), 0)).alias("w")).where("length(w) > 3 and lang is not null")
    # a lexicon has a bounded number of terms
    terms = words.groupBy("w").agg(F.min("lang").alias("c")).orderBy(F.md5(F.col("w").cast("binary")), "w").limit(10_000).collect()
    known = lexicon.Lexicon({c: [r["w"] for r in terms if r["c"] == c] for c in ("en", "fr", "de", "es")})
    return docs.select("doc_id", lexicon.occurrences(F.col("text"), known, "en").alias("en"), lexicon.occurrences(F.col("text"), known, "fr").alias("fr"), lexicon.passes(F.col("text"), known, "de").alias("no_de"))


# --- model steps -----------------------------------------------------------------------------------------------------


@_query(f"""WITH {_LI}, h AS (SELECT id, {_template("id || 'no_metal'")} AS t FROM rec)
SELECT t AS template, count(*)::BIGINT AS n, count(*)::BIGINT AS answered, 0::BIGINT AS failed, 1024::INT AS most FROM h GROUP BY t""")
def generation(spark, sf_dir):
    """Prompts of every recipe to a provider in batches; the offline one answers all."""
    t = hashing.template(F.col("id"), F.lit("no_metal"))
    user = prompts.user_prompt(t, F.col("title"), F.col("items"), F.col("steps"), F.lit("no_metal"), F.lit("Iron"), F.array(F.lit("sharp")))
    todo = _recipes(spark, sf_dir).select(t.alias("template"), F.lit(prompts.SYSTEMS["standard"]).alias("system"), user.alias("user"), F.lit(prompts.BUDGET["standard"]).alias("max_tokens"))
    done = generate.call_model(todo, generate.with_retry(generate.mock))
    return done.groupBy("template").agg(F.count("*").alias("n"), F.count("output").alias("answered"), F.count("error").alias("failed"), F.max("max_tokens").alias("most"))


def _third(requests):
    """A provider whose answer hangs on the request alone: yes for about a third."""
    import hashlib

    return ["yes" if int(hashlib.md5(u.encode()).hexdigest()[:8], 16) % 3 == 0 else "no" for _, u, _ in requests]


@_query("""WITH a AS (SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('order ' || o_orderkey), 1, 8))::BIGINT % 3 = 0 THEN 'yes' ELSE 'no' END AS output, row_number() OVER (ORDER BY md5('11:' || o_orderkey), o_orderkey) AS r FROM orders),
s AS (SELECT *, sum((output = 'yes')::INT) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) - (output = 'yes')::INT AS before FROM a)
SELECT o_orderkey, output FROM s WHERE before < 400""")
def target_waves(spark, sf_dir):
    """Orders in shuffled order up to the 400th that a model accepts; it is asked in waves, several calls at a time."""
    ask = lambda rows: generate.call_model(rows.withColumns({"system": F.lit("s"), "user": F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "max_tokens": F.lit(8)}), _third, batch=8)
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    return select.in_waves(orders, ask, F.col("output") == "yes", 400, select.shuffled(F.col("o_orderkey"), 11), F.col("o_orderkey")).select("o_orderkey", "output")


def _half(requests):
    """A provider that fails for every batch whose first user text has an even length."""
    if len(requests[0][1]) % 2 == 0:
        raise RuntimeError("overloaded")
    return [u.upper() for _, u, _ in requests]


@_query("SELECT p_partkey, CASE WHEN length(p_name) % 2 = 0 THEN '[space_error] overloaded' ELSE upper(p_name) END AS output_text FROM part")
def endpoint_rows(spark, sf_dir):
    todo = _parts(spark, sf_dir).select("p_partkey", F.lit("s").alias("system"), F.col("p_name").alias("user"), F.lit(16).alias("max_tokens"))
    return generate.call_model(todo, _half, batch=1).select("p_partkey", generate.scored_output(F.col("output"), F.col("error")).alias("output_text"))


@_query(f"""WITH {_LI} SELECT r.id, 'no_metal' AS "constraint", regexp_matches(array_to_string(names, '|'), '\\b(red ring|old rod|ring|rod)\\b') AS banned, n::INT AS items FROM rec r""")
def pool_scan(spark, sf_dir):
    """One constraint over all recipes, as a pool's first look at them."""
    rows = _recipes(spark, sf_dir)
    return rows.select("id", F.lit("no_metal").alias("constraint"), (lexicon.passes(F.array_join("items", "|"), LEXICON, "no_metal") == 0).alias("banned"), F.size("items").alias("items"))


# --- reports and decisions -------------------------------------------------------------------------------------------


@_query("""WITH k AS (SELECT n_nationkey AS k FROM nation),
c AS (SELECT k, unnest(['decision', 'flag', 'kept_rows', 'constraint_pass_rate', 'semantic_completeness', 'completeness', 'mean_relevance', 'nontriviality', 'spot_check', 'template_a', 'template_b', 'template_c']) AS "check" FROM k)
SELECT k, "check", CASE "check" WHEN 'decision' THEN CASE k % 4 WHEN 1 THEN 'NO_GO' ELSE 'READY' END WHEN 'flag' THEN CASE WHEN k % 4 = 2 THEN 'false' WHEN k % 4 = 3 THEN 'true' END WHEN 'kept_rows' THEN (1190 + k) || '.0' WHEN 'constraint_pass_rate' THEN '0.99' WHEN 'semantic_completeness' THEN '1.0' WHEN 'completeness' THEN CASE WHEN k % 5 = 0 THEN NULL ELSE '1.0' END
 WHEN 'mean_relevance' THEN '0.55' WHEN 'nontriviality' THEN '0.9' WHEN 'spot_check' THEN NULL WHEN 'template_a' THEN '0.5' WHEN 'template_b' THEN '0.3' ELSE '0.2' END AS value,
CASE "check" WHEN 'decision' THEN CASE k % 4 WHEN 1 THEN 'FAIL' ELSE 'PASS' END WHEN 'flag' THEN CASE WHEN k % 4 = 2 THEN 'FAIL' WHEN k % 4 = 3 THEN 'PASS' ELSE 'SKIP' END
 ELSE CASE WHEN k % 4 IN (1, 2) THEN 'SKIP' WHEN "check" = 'kept_rows' AND k < 10 OR "check" = 'completeness' AND k % 5 = 0 THEN 'FAIL' WHEN "check" = 'spot_check' THEN 'WARN' ELSE 'PASS' END END AS status FROM c""")
def gate_reports(spark, sf_dir):
    k = F.col("n_nationkey")
    flag = F.when(k % 4 == 2, ', "gate_passed": false, "gate_pass": true').when(k % 4 == 3, ', "x": {"gate_passed": true}').otherwise("")
    doc = F.concat(
        F.lit('{"decision": "'), F.when(k % 4 == 1, " no_go").otherwise("ready"), F.lit('"'), flag, F.lit(', "deep": [{"kept_rows": "'), F.format_string("%,d", (k + 1190).cast("bigint")), F.lit('"}], "metrics": {"constraint_pass_rate": 99, "semantic_completeness_pass_rate_on_kept": 1'),
        F.when(k % 5 == 0, ', "assistant_completeness_validation_pass_rate_on_kept": true').otherwise(', "assistant_completeness_validation_pass_rate_on_kept": 1.0'), F.lit(', "mean_relevance_on_kept": 0.55, "nontrivial_pass_rate": 90'),
        F.when(k % 2 == 0, ', "template_a_fraction": 0.5, "template_b_fraction": 0.3, "template_c_fraction": 20}}').otherwise(', "template_distribution": {"A": 50, "B": "30", "C": 20}}}'),
    )
    return decide.check_report(_t(spark, sf_dir, "nation").select(k.alias("k"), doc.alias("document")))


@_query("""SELECT c_custkey, 'fact ' || c_custkey AS "check", CASE k WHEN 0 THEN CASE WHEN c_acctbal > 0 THEN 'PASS' ELSE 'FAIL' END WHEN 1 THEN CASE WHEN c_acctbal > 5000 THEN 'PASS' WHEN need THEN 'FAIL' ELSE 'WARN' END
 WHEN 2 THEN CASE WHEN c_acctbal > 5000 THEN 'PASS' ELSE 'FAIL' END WHEN 3 THEN CASE WHEN c_acctbal < 0 THEN CASE WHEN need THEN 'FAIL' ELSE 'SKIP' END WHEN c_acctbal < 5000 THEN 'PASS' ELSE 'FAIL' END
 WHEN 4 THEN CASE WHEN c_acctbal < 0 THEN 'FAIL' WHEN c_mktsegment <> 'BUILDING' THEN 'PASS' ELSE 'FAIL' END ELSE 'SKIP' END AS status FROM (SELECT *, c_custkey % 6 AS k, c_custkey % 4 < 2 AS need FROM customer)""")
def launch_checks(spark, sf_dir):
    """Facts of every kind from customers: set, path, gate, manifest, split, and kinds that nobody knows."""
    k, bal = F.col("c_custkey") % 6, F.col("c_acctbal")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("set", "path", "gate", "manifest", "split", "other")]), (k + 1).cast("int"))
    value = F.when(k == 0, F.when(bal > 0, F.col("c_name")).otherwise(" ")).when(k == 1, F.when(bal > 5000, "true").otherwise("false")).when(k == 2, F.when(bal > 5000, "Yes").when(bal > 0, "maybe"))
    value = value.when(k == 3, F.when(bal < 0, None).when(bal < 5000, F.to_json(F.struct("c_name"))).otherwise("[1]")).when(k == 4, F.when(bal < 0, "no").otherwise(F.col("c_mktsegment")))
    other = F.when((k == 4) & (bal >= 0), " BUILDING")
    facts = _t(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind"), F.concat(F.lit("fact "), F.col("c_custkey").cast("string")).alias("name"), value.alias("value"), other.alias("other"), (F.col("c_custkey") % 4 < 2).alias("required"))
    return decide.launch_checks(facts, "c_custkey")


@_query("""SELECT count(*) FILTER (event_id % 4 = 0)::BIGINT AS "PASS", count(*) FILTER (event_id % 4 = 1)::BIGINT AS "FAIL", 0::BIGINT AS "WARN", count(*) FILTER (event_id % 4 = 3)::BIGINT AS "SKIP" FROM events""")
def status_counts(spark, sf_dir):
    k = F.col("event_id") % 4
    return decide.status_counts(_t(spark, sf_dir, "events").select(F.when(k == 0, "PASS").when(k == 1, "FAIL").when(k == 3, "SKIP").otherwise("other").alias("status")))


@_query("""SELECT (count(*) FILTER (o_orderkey % 3 <> 1) + count(*) FILTER (o_orderkey % 2 = 0))::BIGINT AS kept FROM orders""")
def session_totals(spark, sf_dir):
    k, orders = F.col("o_orderkey"), _t(spark, sf_dir, "orders")
    return audit.totals(orders.select(F.when(k % 3 == 1, F.lit(False)).when(k % 3 == 2, F.lit(True)).alias("kept")), orders.select((k % 2 == 0).alias("kept")))


@_query("""SELECT CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 7 = 0 THEN (c_custkey - 1)::VARCHAR ELSE c_custkey::VARCHAR END AS row_id, count(*)::BIGINT AS n FROM customer GROUP BY 1 HAVING count(*) > 1 OR row_id = ''""")
def duplicate_ids(spark, sf_dir):
    k = F.col("c_custkey")
    return pairwise.bad_ids(_t(spark, sf_dir, "customer").select(F.when(k % 50 == 0, "  ").when(k % 7 == 0, F.concat(F.lit(" "), (k - 1).cast("string"))).otherwise(k.cast("string")).alias("row_id")))


@_query("""SELECT name, value FROM (SELECT count(*)::DOUBLE AS rows, round_even(avg((n_chars > 500)::INT), 4)::DOUBLE AS format_pass_rate, round_even(avg((toxic = 0)::INT), 4)::DOUBLE AS constraint_pass_rate, count(toxic)::DOUBLE AS constraint_checked, 0.0::DOUBLE AS judge_average FROM documents LEFT JOIN labels USING (doc_id))
UNPIVOT (value FOR name IN (rows, format_pass_rate, constraint_pass_rate, constraint_checked, judge_average))""")
def tracked_metrics(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).withColumn("output_text", F.lit("x"))
    one = evals.summary(rows.withColumn("judge", F.lit(None).cast("double"))).select("rows", "format_pass_rate", "constraint_pass_rate", "constraint_checked", "judge_average")
    return evals.tracked(rows, one)[0]


@_query(f"""WITH {_EVAL} SELECT doc_id::VARCHAR AS row_id, lang || ', ' || source AS restrictions, c AS constraint_pass, f AS format_pass, j AS judge, 'out ' || doc_id AS output_text FROM e""")
def tracked_rows(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).withColumn("output_text", F.concat(F.lit("out "), "row_id"))
    return evals.tracked(rows, evals.summary(rows))[1]


@_query(f"""WITH {_RUNS} SELECT source, outcome, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def pairwise_sources(spark, sf_dir):
    return pairwise.by_source(pairwise.compare(*_runs(spark, sf_dir), 0.5))


@_query("""WITH k AS (SELECT orders.*, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= greatest(1, floor(n * 0.9)) THEN 'train' ELSE 'valid' END AS split FROM k""")
def split_orders(spark, sf_dir):
    return select.split(_t(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@_query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag = 'R' AS kept, row_number() OVER (ORDER BY md5('3:' || l_orderkey), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) AS r FROM lineitem),
s AS (SELECT *, sum(kept::INT) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) - kept::INT AS before FROM l)
SELECT count(*)::BIGINT AS rows, sum(kept::INT)::BIGINT AS kept, sum(l_orderkey)::BIGINT AS keys FROM s WHERE before < 2000""")
def target_lines(spark, sf_dir):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")]
    rows = select.until_target(_t(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", 2000, select.shuffled(F.col("l_orderkey"), 3), *order)
    return rows.agg(F.count("*").alias("rows"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("kept"), F.sum("l_orderkey").alias("keys"))
