"""Registered queries for the curation operators, each over whole tables, with DuckDB SQL.

The test tables hold no recipes: orders stand in for recipes, their lines with parts for ingredients, conversations for
chat rows, documents with labels for scored rows, events for logs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, spread
from .functions import hashing, lexicon, messages, prompts, scoring, sections, text
from .operators import audit, decide, evals, pairwise, select, validate

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts over all tasks: their table is narrow, and what is made of them is not."""
    return spread(_t(spark, sf_dir, "part"), "p_partkey")


# --- stand-ins -----------------------------------------------------------------------------------------------------

LEXICON = lexicon.Lexicon(
    {"no_metal": ["red ring", "old rod", "ring", "rod"], "no_hot": ["hot plate", "hot"], "no_cold": ["cold ring", "cold"], "no_large": ["large anvil", "anvil"], "no_gizmo": ["new gizmo", "gizmo"]},
    ["hot plate (appliance)"],
    {"no_metal": {"ring": "is_ring", "red ring": "is_red_ring"}},
)
SHARES = {"no_metal": 0.30, "no_hot": 0.25, "no_cold": 0.20, "no_large": 0.15, "no_gizmo": 0.10}
WORDS = lexicon.Lexicon({"function_words": ["of the", "the", "and", "of"]})
CATEGORIES = (("anvil", "Iron"), ("gear", "Machine"), ("red", "Warm"), ("hot", "Warm"), ("blue", "Cool"))
SIGNALS = (("sharp", ("rod", "bolt")), ("heavy", ("anvil", "plate")), ("fresh", ("new",)), ("odd", ("gizmo", "widget")))
VOCABULARY = scoring.Vocabulary(("cup", "kg"), ("hot", "old", "small", "very large"), {"ring": "band", "blue ring": "band"})


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n, names, items (``quantity name``; n of them): the lines of each order in order."""
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "p_name")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(key)).alias("x"), F.count_if(text.strip(F.col("p_name")) != "").alias("n"))
    amount = F.transform("x", lambda x: x["l_quantity"].cast("int").cast("string"))
    names = F.transform("x", lambda x: x["p_name"])
    return rows.select("id", "n", names.alias("names"), amount.alias("amounts")).withColumn("items", text.combine(F.col("amounts"), F.col("names")))


def _recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of at least three lines: id (as text), title, items, steps."""
    # by the count: Spark would make the items once for a test of their number and once more behind it
    got = _items(spark, sf_dir).where("n >= 3")
    return got.select(F.col("id").cast("string").alias("id"), F.element_at("names", 1).alias("title"), "items", F.transform("names", lambda n: F.concat(F.lit("Mix "), n, F.lit(" into the pot"))).alias("steps"))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, constraint of :func:`_recipes` with their violations, without making lists of their lines."""
    line = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name")
    item = text.combine_one(F.col("l_quantity").cast("int").cast("string"), F.col("p_name"))
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("id"), item.alias("item"))
    return lexicon.broken(rows, "id", "item", LEXICON, least=3).withColumn("id", F.col("id").cast("string"))


_LI = """
li AS (SELECT l_orderkey AS id, p_name, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty,
              CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ' || p_name AS item,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos
       FROM lineitem JOIN part ON l_partkey = p_partkey),
orders_of AS (SELECT id, list(item ORDER BY pos) AS items, list(p_name ORDER BY pos) AS names, count(*) AS n FROM li GROUP BY id),
rec AS (SELECT CAST(id AS VARCHAR) AS id, names[1] AS title, items, names, n FROM orders_of WHERE n >= 3)"""
#: Each constraint with its terms, longest first.
_TERMS = """
terms(con, rank, term) AS (VALUES ('no_metal', 1, 'red ring'), ('no_metal', 2, 'old rod'), ('no_metal', 3, 'ring'), ('no_metal', 4, 'rod'),
  ('no_hot', 1, 'hot plate'), ('no_hot', 2, 'hot'), ('no_cold', 1, 'cold ring'), ('no_cold', 2, 'cold'),
  ('no_large', 1, 'large anvil'), ('no_large', 2, 'anvil'), ('no_gizmo', 1, 'new gizmo'), ('no_gizmo', 2, 'gizmo'))"""
_GREEDY = f"""
{_LI}, {_TERMS},
cand AS (SELECT CAST(li.id AS VARCHAR) AS id, con, pos, list(term ORDER BY rank) AS found
         FROM li JOIN terms ON regexp_matches(item, '\\b' || term || '\\b')
         WHERE CAST(li.id AS VARCHAR) IN (SELECT id FROM rec) GROUP BY 1, 2, 3),
step AS (SELECT *, row_number() OVER (PARTITION BY id, con ORDER BY pos) AS k FROM cand),
walk(id, con, k, seen) AS (
  SELECT DISTINCT id, con, 0::BIGINT, []::VARCHAR[] FROM step
  UNION ALL
  SELECT w.id, w.con, s.k, CASE WHEN len(list_filter(s.found, lambda t: NOT list_contains(w.seen, t))) > 0
    THEN list_append(w.seen, list_filter(s.found, lambda t: NOT list_contains(w.seen, t))[1]) ELSE w.seen END
  FROM walk w JOIN step s ON s.id = w.id AND s.con = w.con AND s.k = w.k + 1),
hits AS (SELECT id, con, len(arg_max(seen, k)) AS n, arg_max(seen, k) AS used FROM walk GROUP BY id, con)"""


def _md5(key: str, m: int) -> str:
    return f"((('0x' || md5({key}))::UHUGEINT) % {m})::INT"


def _template(key: str) -> str:
    h = _md5(key, 100)
    return f"CASE WHEN {h} < 50 THEN 'A' WHEN {h} < 80 THEN 'B' ELSE 'C' END"


# --- text ----------------------------------------------------------------------------------------------------------


@_query(f"""WITH {_LI}, o AS (SELECT o_orderkey, names, n FROM orders LEFT JOIN orders_of ON o_orderkey = id)
SELECT CASE WHEN names IS NULL THEN 'no_title' WHEN n < 3 THEN 'few_ingredients' ELSE 'ok' END AS reason, count(*)::BIGINT AS n FROM o GROUP BY 1""")
def parse_filter_reasons(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    rows = orders.join(_items(spark, sf_dir), F.col("o_orderkey") == F.col("id"), "left")
    why = text.skip_reason(F.try_element_at("names", F.lit(1)), F.col("items"), F.col("items"))
    return audit.count_by(rows, F.coalesce(why, F.lit("ok")), "reason")


@_query(f"WITH {_LI} SELECT id, array_to_string(items, ', ') AS items FROM orders_of")
def combine_items(spark, sf_dir):
    return _items(spark, sf_dir).select("id", F.array_join("items", ", ").alias("items"))


@_query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'anvil') THEN 'Iron' WHEN contains(lower(p_name), 'gear') THEN 'Machine'
WHEN contains(lower(p_name), 'red') THEN 'Warm' WHEN contains(lower(p_name), 'hot') THEN 'Warm' WHEN contains(lower(p_name), 'blue') THEN 'Cool' ELSE 'International' END AS cuisine FROM part""")
def category_first_match(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", text.first_category(F.col("p_name"), CATEGORIES, "International").alias("cuisine"))


@_query(f"""WITH {_LI}, j AS (SELECT id, lower(array_to_string(items, ' ')) AS t FROM orders_of),
f AS (SELECT id, list_slice(list_filter([CASE WHEN contains(t, 'rod') OR contains(t, 'bolt') THEN 'sharp' END, CASE WHEN contains(t, 'anvil') OR contains(t, 'plate') THEN 'heavy' END,
 CASE WHEN contains(t, 'new') THEN 'fresh' END, CASE WHEN contains(t, 'gizmo') OR contains(t, 'widget') THEN 'odd' END], lambda x: x IS NOT NULL), 1, 3) AS l FROM j)
SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'plain|simple' END AS labels FROM f""")
def label_topk(spark, sf_dir):
    return _items(spark, sf_dir).select("id", F.array_join(text.labels(F.col("items"), SIGNALS, 3, ("plain", "simple")), "|").alias("labels"))


@_query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 0 ELSE c_acctbal END, 0), 3.0)::DOUBLE AS rating FROM customer")
def numeric_default(spark, sf_dir):
    raw = F.when(F.col("c_custkey") % 7 == 0, "NA").when(F.col("c_custkey") % 11 == 0, "0").otherwise(F.col("c_acctbal").cast("string"))
    return _t(spark, sf_dir, "customer").select("c_custkey", text.rating(raw).alias("rating"))


@_query("SELECT p_partkey, trim(regexp_replace(lower('-' || p_brand || ' & ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM part")
def normalize_name(spark, sf_dir):
    raw = F.concat(F.lit("-"), "p_brand", F.lit(" & "), "p_type", F.lit("!"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.normal_name(raw).alias("name"))


@_query("""WITH a AS (SELECT p_partkey, '2 1/2 cup **' || p_name || 's** (chopped), hot' AS s FROM part),
b AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(regexp_replace(s, '\\*\\*([^*]+)\\*\\*', '\\1', 'g')), '\\([^)]*\\)', '', 'g'), '^\\s*\\d[\\d/.,\\-]*\\s*', '')) AS s FROM a),
c AS (SELECT p_partkey, regexp_replace(s, '\\b(?:cup|kg)\\.?\\b', '', 'g') AS s FROM b),
d AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^very large\\s+', ''), '^small\\s+', ''), '^hot\\s+', ''), '^old\\s+', '') AS s FROM c),
e AS (SELECT p_partkey, regexp_replace(s, '\\s+hot$', '') AS s FROM d),
f AS (SELECT p_partkey, trim(trim(trim(s), ',')) AS s FROM e),
g AS (SELECT p_partkey, CASE WHEN s LIKE '%s' THEN left(s, length(s) - 1) ELSE s END AS s FROM f)
SELECT p_partkey, CASE WHEN s IN ('ring', 'blue ring') THEN 'band' ELSE s END AS name FROM g""")
def normalize_item(spark, sf_dir):
    raw = F.concat(F.lit("2 1/2 cup **"), "p_name", F.lit("s** (chopped), hot"))
    return _parts(spark, sf_dir).select("p_partkey", VOCABULARY.name(raw).alias("name"))


@_query("""WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 2) || ['s', 'ies', 'oes', 'ves', 'ches', 'shes', 'xes', 'ses', 't'][1 + p_partkey % 9] AS w FROM part)
SELECT p_partkey, CASE WHEN w LIKE '%ies' THEN left(w, length(w) - 3) || 'y' WHEN w LIKE '%oes' THEN left(w, length(w) - 3) || 'o' WHEN w LIKE '%ves' THEN left(w, length(w) - 3) || 'f'
WHEN w LIKE '%ches' THEN left(w, length(w) - 4) || 'ch' WHEN w LIKE '%shes' THEN left(w, length(w) - 4) || 'sh' WHEN w LIKE '%xes' THEN left(w, length(w) - 3) || 'x'
WHEN w LIKE '%ses' THEN left(w, length(w) - 3) || 's' WHEN w LIKE '%s' THEN left(w, length(w) - 1) ELSE w END AS word FROM w""")
def singularize(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("s", "ies", "oes", "ves", "ches", "shes", "xes", "ses", "t")])
    word = F.concat(F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)), F.get(ends, (F.col("p_partkey") % 9).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", text.singular(word).alias("word"))


@_query(f"WITH {_LI} SELECT id, pos::BIGINT AS pos, p_name AS name FROM li")
def strip_quantity(spark, sf_dir):
    rows = _items(spark, sf_dir).select("id", F.posexplode(F.transform("items", lambda i: F.regexp_replace(i, r"^(\d+) ", "$1 1/2 kg  "))).alias("pos", "item"))
    return rows.select("id", (F.col("pos") + 1).cast("bigint").alias("pos"), text.strip_quantity(F.col("item"), ("cup", "kg", "g")).alias("name"))


# --- lexicon -------------------------------------------------------------------------------------------------------

_PLAIN = "regexp_replace(lower(text), '[À-ÖØ-öø-ÿ]', 'x', 'g')"


@_query(f"SELECT doc_id, (NOT regexp_matches({_PLAIN}, '\\b(of the|the|and|of)\\b'))::INT AS passed FROM documents")
def lexicon_pass(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", lexicon.passes(F.col("text"), WORDS, "function_words").alias("passed"))


@_query(f"SELECT doc_id, len(regexp_extract_all({_PLAIN}, '\\b(of the|the|and|of)\\b'))::INT AS n FROM documents")
def lexicon_occurrences(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", lexicon.occurrences(F.col("text"), WORDS, "function_words").alias("n"))


@_query("""SELECT p_partkey, (regexp_matches(p_name, '\\bred ring\\b')::INT + regexp_matches(p_name, '\\bold rod\\b')::INT + regexp_matches(p_name, '\\bring\\b')::INT + regexp_matches(p_name, '\\brod\\b')::INT)::INT AS n FROM part""")
def title_term_count(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", lexicon.title_terms(F.col("p_name"), LEXICON, "no_metal").alias("n"))


@_query("""WITH c AS (SELECT conv_id, turn, lower(text) AS t FROM conversations),
m AS (SELECT conv_id, turn, list_filter(['and', 'of', 'of the', 'the'], lambda w: regexp_matches(t, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')) AS l FROM c)
SELECT conv_id, turn, array_to_string(l, ',') AS matched, len(l) = 0 AS passed FROM m""")
def lookaround_match(spark, sf_dir):
    got = lexicon.check_restrictions(F.col("text"), F.array(F.lit("Function Words"), F.lit("unknown")), WORDS)
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", got.alias("c"))
    return rows.select("conv_id", "turn", F.coalesce(F.array_join(F.try_element_at("c.violations", F.lit(1))["matched_terms"], ","), F.lit("")).alias("matched"), F.col("c.constraint_pass").alias("passed"))


@_query(f"""WITH RECURSIVE {_GREEDY}, t AS (SELECT con, n, {_template("id || con")} AS template FROM hits WHERE n > 0)
SELECT con AS "constraint", count(*)::BIGINT AS orders, sum(n)::BIGINT AS hits, (count(*) FILTER (template = 'A'))::BIGINT AS a, (count(*) FILTER (template = 'B'))::BIGINT AS b, (count(*) FILTER (template = 'C'))::BIGINT AS c FROM t GROUP BY con""")
def greedy_violations(spark, sf_dir):
    found = lexicon.all_violations(_recipes(spark, sf_dir).select("id", "items"), "items", LEXICON)
    t = hashing.template(F.col("id"), F.col("constraint"))
    rows = found.select("constraint", F.size("violations").alias("n"), t.alias("t"))
    return rows.groupBy("constraint").agg(F.count("*").alias("orders"), F.sum("n").alias("hits"), *[F.count_if(F.col("t") == x).alias(x.lower()) for x in "ABC"])


@_query(f"""WITH RECURSIVE {_GREEDY} SELECT id, con AS "constraint", array_to_string(used, '|') AS terms FROM hits WHERE n > 0""")
def violation_terms(spark, sf_dir):
    found = lexicon.all_violations(_recipes(spark, sf_dir).select("id", "items"), "items", LEXICON)
    return found.select("id", "constraint", F.array_join(F.transform("violations", lambda v: v["term"]), "|").alias("terms"))


@_query("""WITH i AS (SELECT DISTINCT lower(p_name) AS item FROM part),
x AS (SELECT 'no_metal' AS con, item, regexp_matches(item, '\\b(red ring|old rod|ring|rod)\\b') AS hit, contains(item, 'bolt') OR contains(item, 'ro') AS sign FROM i
UNION ALL SELECT 'no_hot', item, regexp_matches(item, '\\b(hot plate|hot)\\b'), contains(item, 'plate') FROM i
UNION ALL SELECT 'no_cold', item, regexp_matches(item, '\\b(cold ring|cold)\\b'), false FROM i
UNION ALL SELECT 'no_large', item, regexp_matches(item, '\\b(large anvil|anvil)\\b'), contains(item, 'large') FROM i
UNION ALL SELECT 'no_gizmo', item, regexp_matches(item, '\\b(new gizmo|gizmo)\\b'), contains(item, 'wid') FROM i)
SELECT con AS "constraint", (count(*) FILTER (hit))::BIGINT AS matched, (count(*) FILTER (sign AND NOT hit))::BIGINT AS gaps,
coalesce(array_to_string(list_slice(list_sort(list(item) FILTER (sign AND NOT hit)), 1, 5), '|'), '') AS sample FROM x GROUP BY con""")
def coverage_stats(spark, sf_dir):
    signals = {"no_metal": ["bolt", "ro"], "no_hot": ["plate"], "no_large": ["large"], "no_gizmo": ["wid"]}
    got = lexicon.coverage(_t(spark, sf_dir, "part").select(F.col("p_name").alias("item")), LEXICON, signals)
    return got.withColumn("sample", F.array_join("sample", "|"))


@_query("""WITH i AS (SELECT DISTINCT p_name AS item FROM part), x AS (SELECT 'no_hot' AS con, item, '\\b(hot plate|hot)\\b' AS p FROM i UNION ALL SELECT 'no_large', item, '\\b(large anvil|anvil)\\b' FROM i)
SELECT con AS "constraint", item, CASE WHEN regexp_matches(item, p) THEN 'banned' WHEN contains(item, 'hot plate') THEN 'false_positive' ELSE 'suggest' END AS status FROM x""")
def gap_triage(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_name").alias("item")).distinct()
    gaps = names.select(F.explode(F.array(F.lit("no_hot"), F.lit("no_large"))).alias("constraint"), "item")
    return lexicon.triage(gaps, LEXICON)


# --- assignment and selection --------------------------------------------------------------------------------------


@_query(f"SELECT o_orderkey, {_template("o_orderkey || 'no_metal'")} AS template FROM orders")
def template_bucket(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", hashing.template(F.col("o_orderkey").cast("string"), F.lit("no_metal")).alias("template"))


@_query(f"""WITH h AS (SELECT o_orderkey, {_md5("o_orderkey || 'no_metal' || 'richness'", 10)} AS h FROM orders)
SELECT o_orderkey, CASE WHEN h = 0 THEN 'concise' WHEN h <= 7 THEN 'standard' ELSE 'rich' END AS tier FROM h""")
def richness_tier(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", hashing.richness(F.col("o_orderkey").cast("string"), F.lit("no_metal")).alias("tier"))


@_query(f"SELECT o_orderkey, {_md5("o_orderkey || 'no_metal' || 'opt'", 2)} = 0 AS heads FROM orders")
def coin_flip(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", hashing.coin(F.col("o_orderkey").cast("string"), F.lit("no_metal")).alias("heads"))


@_query(f"""WITH p(pri, rank) AS (VALUES ('1-URGENT', 0), ('2-HIGH', 1), ('3-MEDIUM', 2), ('4-NOT SPECIFIED', 3), ('5-LOW', 4), ('6-NEVER', 5)),
t AS (SELECT o_orderpriority AS pri, {_template("o_orderkey || o_orderpriority")} AS t FROM orders)
SELECT p.pri AS priority, p.rank::INT AS rank, (count(*) FILTER (t = 'A'))::BIGINT AS "A", (count(*) FILTER (t = 'B'))::BIGINT AS "B", (count(*) FILTER (t = 'C'))::BIGINT AS "C" FROM p LEFT JOIN t USING (pri) GROUP BY 1, 2""")
def template_crosstab(spark, sf_dir):
    t = hashing.template(F.col("o_orderkey").cast("string"), F.col("o_orderpriority"))
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), t.alias("t"))
    return audit.cross_tab(rows, "priority", "t", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"], ["A", "B", "C"])


_PAIRS = f"{_LI}, {_TERMS}, pairs AS (SELECT DISTINCT CAST(li.id AS VARCHAR) AS id, con FROM li JOIN terms ON regexp_matches(item, '\\b' || term || '\\b') WHERE CAST(li.id AS VARCHAR) IN (SELECT id FROM rec))"


def _quota_sql() -> str:
    out, before = "", []
    for i, (c, s) in enumerate(SHARES.items()):
        not_in = "".join(f" AND id NOT IN (SELECT id FROM q{b})" for b in before)
        out += f", q{i} AS (SELECT id, con FROM pairs WHERE con = '{c}'{not_in} ORDER BY md5('42:' || con || ':' || id), id LIMIT {max(1, int(4000 * s))})"
        before.append(i)
    return out + ", taken AS (" + " UNION ALL ".join(f"SELECT * FROM q{i}" for i in before) + ")"


_QUOTAS = _quota_sql()


@_query(f"""WITH {_PAIRS} {_QUOTAS} SELECT id, con AS "constraint" FROM taken""")
def quota_select(spark, sf_dir):
    return select.quota_select(_broken(spark, sf_dir), select.quotas(4000, SHARES))


@_query(f"""WITH {_PAIRS} {_QUOTAS}, r(con, rank) AS (VALUES ('no_metal', 1), ('no_hot', 2), ('no_cold', 3), ('no_large', 4), ('no_gizmo', 5)),
f AS (SELECT id, arg_min(con, rank) AS con FROM pairs JOIN r USING (con) WHERE id NOT IN (SELECT id FROM taken) GROUP BY id)
SELECT id, con AS "constraint" FROM f ORDER BY md5('42:top-up:' || id), id LIMIT 500""")
def quota_topup(spark, sf_dir):
    # read by the quotas and by the top-up
    found = keep(_broken(spark, sf_dir))
    taken = select.quota_select(found, select.quotas(4000, SHARES))
    return select.top_up(found, taken, 500, list(LEXICON.terms))


@_query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS r, count(*) OVER () AS n FROM c)
SELECT conv_id, CASE WHEN r <= greatest(1, floor(n * 0.9)) THEN 'train' ELSE 'valid' END AS split FROM r""")
def split_prefix(spark, sf_dir):
    return select.split(_t(spark, sf_dir, "conversations").select("conv_id").distinct(), "conv_id")


@_query("SELECT event_id, user_id, value FROM events ORDER BY ts, event_id LIMIT 500")
def limit_rows(spark, sf_dir):
    return select.first_rows(_t(spark, sf_dir, "events"), 500, F.col("ts"), F.col("event_id")).select("event_id", "user_id", "value")


@_query("""WITH d AS (SELECT d.doc_id, coalesce(l.quality = 1, false) AS kept FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT doc_id, kept, sum(kept::INT) OVER (ORDER BY md5('7:' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - kept::INT AS before FROM d)
SELECT doc_id, kept FROM r WHERE before < 100""")
def running_target(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("kept"))
    return select.until_target(rows, F.col("kept"), 100, select.shuffled(F.col("doc_id"), 7), F.col("doc_id"))


# --- gate ----------------------------------------------------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang").join(_t(spark, sf_dir, "labels"), "doc_id")
    return rows.select(
        (F.col("quality") == 1).alias("kept"), (1 - F.col("toxic")).alias("constraint_pass"), F.lit(1).alias("semantic_pass"), (F.col("n_chars") > 300).alias("complete"),
        ((F.col("n_chars") % 101) / 100).alias("relevance"), ((F.col("n_chars") % 11) / 10).alias("nontriviality"), hashing.template(F.col("doc_id").cast("string"), F.col("lang")).alias("template"),
    )


_SCORED = f"""s AS (SELECT 1 - toxic AS cp, n_chars, {_template("doc_id || lang")} AS t FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
m AS (SELECT count(*)::BIGINT AS kept_rows, round_even(avg((cp = 1)::INT), 4) AS constraint_pass_rate, 1.0::DOUBLE AS semantic_completeness_rate, round_even(avg((n_chars > 300)::INT), 4) AS completeness_rate,
 round_even(avg((n_chars % 101) / 100), 4) AS mean_relevance, round_even(avg(((n_chars % 11) / 10 >= 0.5)::INT), 4) AS nontrivial_share,
 round_even(avg((t = 'A')::INT), 4) AS template_a, round_even(avg((t = 'B')::INT), 4) AS template_b, round_even(avg((t = 'C')::INT), 4) AS template_c FROM s)"""


@_query(f"WITH {_SCORED} SELECT * FROM m")
def gate_metrics(spark, sf_dir):
    return audit.metrics(_scored(spark, sf_dir))


@_query(f"""WITH {_SCORED} SELECT 'constraint_pass_rate' AS metric, constraint_pass_rate AS value, '==' AS op, 1.0::DOUBLE AS threshold, constraint_pass_rate = 1 AS passed FROM m
UNION ALL SELECT 'semantic_completeness_rate', semantic_completeness_rate, '==', 1.0, semantic_completeness_rate = 1 FROM m UNION ALL SELECT 'completeness_rate', completeness_rate, '==', 1.0, completeness_rate = 1 FROM m
UNION ALL SELECT 'mean_relevance', mean_relevance, '>=', 0.55, mean_relevance >= 0.55 FROM m UNION ALL SELECT 'nontrivial_share', nontrivial_share, '>=', 0.9, nontrivial_share >= 0.9 FROM m
UNION ALL SELECT 'template_a', template_a, 'within', 0.5, abs(template_a - 0.5) <= 0.1 + 1e-9 FROM m UNION ALL SELECT 'template_b', template_b, 'within', 0.3, abs(template_b - 0.3) <= 0.1 + 1e-9 FROM m
UNION ALL SELECT 'template_c', template_c, 'within', 0.2, abs(template_c - 0.2) <= 0.1 + 1e-9 FROM m""")
def gate_checks(spark, sf_dir):
    return audit.gate(audit.metrics(_scored(spark, sf_dir)))


@_query(f"""WITH c AS (SELECT {_template("o_orderkey || 'no_metal'")} AS template, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT template, n / sum(n) OVER () AS share FROM c)
SELECT template, round_even(share, 4) AS share, abs(share - CASE template WHEN 'A' THEN 0.5 WHEN 'B' THEN 0.3 ELSE 0.2 END) <= 0.1 + 1e-9 AS within FROM s""")
def template_mix_check(spark, sf_dir):
    t = hashing.template(F.col("o_orderkey").cast("string"), F.lit("no_metal"))
    return decide.template_mix(audit.count_by(_t(spark, sf_dir, "orders"), t, "template"), {"A": 0.5, "B": 0.3, "C": 0.2})


# --- sections and scores -------------------------------------------------------------------------------------------


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each part: which sections it has hangs on its key."""
    k, name = F.col("p_partkey"), F.col("p_name")
    out = F.concat(
        F.lit("intro\n"),
        F.when(k % 3 != 0, F.concat(F.lit("## Substitution Plan:\n- **"), name, F.lit(" -> plain "), name, F.lit("**: lighter\n* old "), name, F.lit(" → new one (kept)\n"))).otherwise(""),
        F.when(k % 4 != 0, F.concat(F.lit("Adapted Ingredients\n- 1 cup "), name, F.lit("\n2) two\n"))).otherwise(""),
        F.when(k % 5 != 0, F.concat(F.lit("adapted steps:\n1. Mix "), name, F.when(k % 2 == 0, "...").otherwise("."), F.lit("\n"))).otherwise(""),
        F.lit("Constraint Check\nno "), name,
    )
    return _parts(spark, sf_dir).select(k, name, out.alias("text"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 <> 0 THEN '- 1 cup ' || p_name || chr(10) || '2) two' || chr(10) || chr(10) || '1. Mix ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '...' ELSE '.' END
WHEN p_partkey % 4 <> 0 THEN '- 1 cup ' || p_name || chr(10) || '2) two' WHEN p_partkey % 5 <> 0 THEN '1. Mix ' || p_name || CASE WHEN p_partkey % 2 = 0 THEN '...' ELSE '.' END
WHEN p_partkey % 3 <> 0 THEN 'intro' || chr(10) || '## Substitution Plan:' || chr(10) || '- **' || p_name || ' -> plain ' || p_name || '**: lighter' || chr(10) || '* old ' || p_name || ' → new one (kept)'
ELSE 'intro' END AS scanned, CASE WHEN p_partkey % 4 <> 0 OR p_partkey % 5 <> 0 THEN 'adapted_sections_only' ELSE 'full_output_minus_constraint_check' END AS mode FROM part""")
def section_split(spark, sf_dir):
    rows = _responses(spark, sf_dir).select("p_partkey", sections.scan_text(F.col("text")).alias("s"))
    return rows.select("p_partkey", F.col("s.text").alias("scanned"), F.col("s.mode").alias("mode"))


@_query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'substitution plan' END, CASE WHEN p_partkey % 4 = 0 THEN 'adapted ingredients' END, CASE WHEN p_partkey % 5 = 0 THEN 'adapted steps' END,
'flavor preservation notes', CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'placeholder_ellipsis' END], lambda x: x IS NOT NULL), '|') AS missing FROM part""")
def section_format(spark, sf_dir):
    return _responses(spark, sf_dir).select("p_partkey", F.array_join(sections.missing_sections(F.col("text")), "|").alias("missing"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_name || '>plain ' || p_name || '>lighter|old ' || p_name || '>new one>kept' ELSE '' END AS pairs FROM part""")
def arrow_pairs(spark, sf_dir):
    rows = _responses(spark, sf_dir).select("p_partkey", sections.parse(F.col("text"))["pairs"].alias("p"))
    return rows.select("p_partkey", F.array_join(F.transform("p", lambda x: F.concat_ws(">", x["from"], x["to"], x["reason"])), "|").alias("pairs"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order of three lines or more with the one of the next key, where that is one too."""
    a = _recipes(spark, sf_dir).withColumn("k", F.col("id").cast("bigint"))
    b = a.select((F.col("k") - 1).alias("k"), F.col("items").alias("items2"), F.col("steps").alias("steps2"))
    return a.join(b, "k")


_NEXT = f"{_LI}, pair AS (SELECT a.id::BIGINT AS k, a.items, a.names, b.items AS items2, b.names AS names2, a.n, b.n AS n2 FROM rec a JOIN rec b ON b.id::BIGINT = a.id::BIGINT + 1)"
_CHANGED = "CASE WHEN n <> n2 THEN 1 ELSE (names[1:3] <> names2[1:3])::INT END"


@_query(f"WITH {_NEXT} SELECT k, ({_CHANGED})::INT AS changed FROM pair")
def step_change(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("k", scoring.steps_changed(F.col("steps"), F.col("steps2")).alias("changed"))


@_query(f"""WITH {_NEXT}, x AS (SELECT k, list_filter(names, lambda i: NOT regexp_matches(i, '\\b(red ring|old rod|ring|rod)\\b')) AS ok, names2 FROM pair)
SELECT k, CASE WHEN len(ok) = 0 THEN 1.0 ELSE round_even(len(list_filter(ok, lambda i: list_contains(names2, i))) / len(ok), 4) END::DOUBLE AS relevance FROM x""")
def relevance(spark, sf_dir):
    plain = scoring.Vocabulary(("cup",), ())
    named = scoring.with_names(_recipes(spark, sf_dir), "items", LEXICON, "no_metal", plain)
    # written once, as both sides of the join
    rows = keep(named.select(F.col("id").cast("bigint").alias("k"), "names", "wanted"))
    both = rows.withColumnRenamed("names", "own").join(rows.select((F.col("k") - 1).alias("k"), "names"), "k")
    return both.select("k", scoring.retained(F.col("own"), F.col("wanted"), F.col("names")).alias("relevance"))


@_query(f"""WITH {_NEXT}, x AS (SELECT k, len(list_filter(items2, lambda i: i LIKE '2%')) AS made, n, ({_CHANGED}) AS changed FROM pair)
SELECT k, round_even(0.8::DOUBLE * least(1.0::DOUBLE, made::DOUBLE / greatest(1, n)) + 0.2::DOUBLE * changed, 4)::DOUBLE AS score FROM x""")
def nontriviality(spark, sf_dir):
    pairs = F.transform("items2", lambda i: F.struct(i.alias("from"), F.when(F.startswith(i, F.lit("2")), i).otherwise(" ").alias("to")))
    return _neighbours(spark, sf_dir).select("k", scoring.nontriviality(pairs, F.size("items"), scoring.steps_changed(F.col("steps"), F.col("steps2"))).alias("score"))


def _prompt() -> Column:
    t = hashing.template(F.col("id"), F.lit("no_metal"))
    return prompts.user_prompt(t, F.col("title"), F.col("items"), F.col("steps"), F.lit("no_metal"), F.lit("Iron"), F.array(F.lit("sharp"), F.lit("odd")))


@_query(f"""WITH {_LI}, t AS (SELECT *, {_template("id || 'no_metal'")} AS t, list_transform(names, lambda x: 'Mix ' || x || ' into the pot') AS steps FROM rec),
p AS (SELECT id, CASE t WHEN 'A' THEN 'Recipe: ' || title || chr(10) || 'Cuisine: Iron' || chr(10) || 'Ingredients: ' || array_to_string(items, ', ') || chr(10) || 'Steps: ' || array_to_string(list_transform(steps, lambda s, i: i || ') ' || s), ' ') || chr(10) || 'Restrictions: no-metal' || chr(10) || 'Must Keep Flavor Notes: sharp, odd'
WHEN 'B' THEN 'I have a recipe for ' || title || ' (Iron) that I need to make no-metal-friendly.' || chr(10) || chr(10) || 'The ingredients are: ' || array_to_string(items, ', ') || '.' || chr(10) || chr(10) || 'Here''s how it''s made: ' || array_to_string(list_transform(steps, lambda s: s || '.'), ' ') || chr(10) || chr(10) || 'Please adapt it while keeping the dish recognizable.'
ELSE 'Goal: make ' || title || ' fully no-metal-compliant.' || chr(10) || chr(10) || 'Source ingredients:' || chr(10) || array_to_string(list_transform(items, lambda i: '- ' || i), chr(10)) || chr(10) || chr(10) || 'Source steps:' || chr(10) || array_to_string(list_transform(steps, lambda s, i: i || '. ' || s), chr(10)) || chr(10) || chr(10) || 'Preserve these flavors: sharp, odd.'
 || CASE WHEN {_md5("'no_metalopt'", 2)} = 0 THEN chr(10) || 'Weeknight-friendly, under 45 minutes where possible.' ELSE '' END END AS prompt FROM t) SELECT id, md5(prompt) AS prompt_md5 FROM p""")
def prompt_render(spark, sf_dir):
    return _recipes(spark, sf_dir).select("id", F.md5(_prompt().cast("binary")).alias("prompt_md5"))


@_query(f"""WITH {_LI} SELECT id, CASE WHEN {_template("id || 'no_metal'")} = 'A' THEN 1 ELSE 0 END AS complete FROM rec""")
def prompt_complete(spark, sf_dir):
    return _recipes(spark, sf_dir).select("id", scoring.prompt_complete(_prompt()).alias("complete"))


@_query(f"""WITH RECURSIVE {_GREEDY}, x AS (SELECT r.id, r.n AS items, coalesce(h.n, 0) AS v, len(regexp_extract_all(array_to_string(names, ' into the pot Mix '), '\\b(red ring|old rod|ring|rod)\\b')) AS occ,
regexp_matches(title, '\\b(red ring|old rod|ring|rod)\\b') AS titled FROM rec r LEFT JOIN hits h ON h.id = r.id AND h.con = 'no_metal')
SELECT CASE WHEN occ > 1 THEN 'step_ban_occurrences' WHEN titled AND occ >= 1 THEN 'title_step_compound' WHEN v > 2 THEN 'too_many_violations' WHEN v / items > 0.33 THEN 'violation_fraction' ELSE 'ok' END AS reason, count(*)::BIGINT AS n FROM x GROUP BY 1""")
def first_reject_reason(spark, sf_dir):
    rows = _recipes(spark, sf_dir).withColumn("v", lexicon.violations(F.col("items"), LEXICON, "no_metal"))
    why = scoring.prefilter_reason(F.col("title"), F.col("items"), F.col("steps"), F.col("v"), LEXICON, "no_metal")
    return audit.count_by(rows, F.coalesce(why, F.lit("ok")), "reason")


# --- chat rows -----------------------------------------------------------------------------------------------------


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))


_SPACE = "E' \\t\\n\\r'"
_CHATS_SQL = f"WITH c AS (SELECT *, trim(text, {_SPACE}) AS said FROM conversations)"


@_query(f"SELECT conv_id, coalesce(string_agg(trim(text, {_SPACE}), chr(10) || chr(10) ORDER BY turn, text) FILTER (role = 'user' AND trim(text, {_SPACE}) <> ''), '') AS user_text FROM conversations GROUP BY conv_id")
def user_text(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", messages.user_text(F.col("messages")).alias("user_text"))


@_query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations)
SELECT conv_id, CASE WHEN role = 'assistant' THEN nullif(trim(text, {_SPACE}), '') END AS gold FROM r WHERE r = 1""")
def gold_last_assistant(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", messages.gold(F.col("messages")).alias("gold"))


@_query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations), k AS (SELECT * FROM r WHERE NOT (r = 1 AND role = 'assistant'))
SELECT c.conv_id, CASE WHEN count(*) FILTER (k.role = 'user') > 0 THEN string_agg(k.role, ',' ORDER BY k.turn, k.role, k.text) END AS roles FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN k USING (conv_id) GROUP BY c.conv_id""")
def drop_trailing_assistant(spark, sf_dir):
    return _chats(spark, sf_dir).select("conv_id", F.array_join(F.transform(messages.for_inference(F.col("messages")), lambda m: m["role"]), ",").alias("roles"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line for each conversation, some of them broken by their number."""
    k = F.col("conv_id")
    line = F.when(k % 17 == 0, "").when(k % 13 == 0, "{broken").when(k % 11 == 0, "[1]").when(k % 7 == 0, '{"messages": [{"role": "narrator", "content": 5}]}').otherwise(F.to_json(F.struct("messages")))
    return _chats(spark, sf_dir).select(F.concat(F.lit("part"), (k % 3).cast("string")).alias("path"), k.alias("line"), line.alias("value"))


_CHECKED = """c AS (SELECT conv_id AS k, count(*) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id),
v AS (SELECT 'part' || (k % 3) AS path, k AS line, CASE WHEN k % 17 = 0 THEN 'blank' WHEN k % 13 = 0 THEN 'parse_error' ELSE 'record' END AS status,
CASE WHEN k % 17 = 0 THEN 'blank line' WHEN k % 13 = 0 THEN 'no JSON' WHEN k % 11 = 0 THEN 'no object'
 WHEN k % 7 = 0 THEN 'messages[0].role is unknown|messages[0].content is neither string nor list|no assistant message' WHEN a = 0 THEN 'no assistant message' ELSE '' END AS errors,
CASE WHEN k % 17 = 0 OR k % 13 = 0 OR k % 11 = 0 OR k % 7 = 0 THEN 0 ELSE a END::INT AS assistants FROM c)"""


@_query(f"WITH {_CHECKED} SELECT * FROM v")
def message_validation(spark, sf_dir):
    return validate.validate_lines(_lines(spark, sf_dir)).withColumn("errors", F.array_join("errors", "|"))


@_query(f"""WITH {_CHECKED} SELECT path, count(*)::BIGINT AS lines, (count(*) FILTER (status = 'record'))::BIGINT AS records, sum(assistants)::BIGINT AS assistants, (count(*) FILTER (status = 'parse_error'))::BIGINT AS parse_errors,
sum(CASE WHEN status = 'parse_error' OR errors = '' THEN 0 ELSE len(string_split(errors, '|')) END)::BIGINT AS schema_errors FROM v GROUP BY path""")
def file_stats(spark, sf_dir):
    return validate.file_stats(validate.validate_lines(_lines(spark, sf_dir)))


@_query("""WITH n AS (SELECT p_partkey, unnest([p_brand, upper(p_brand), p_type, lower(p_type), p_brand || '!']) AS x, generate_subscripts([1, 2, 3, 4, 5], 1) AS i FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_') ORDER BY i) AS r FROM n)
SELECT p_partkey, string_agg(x, '|' ORDER BY i) AS kept FROM f WHERE r = 1 GROUP BY p_partkey""")
def restriction_dedupe(spark, sf_dir):
    first, second = F.array(F.col("p_brand"), F.upper("p_brand")), F.concat_ws(",", F.col("p_type"), F.lower("p_type"), F.concat("p_brand", F.lit("!")))
    got = messages.restrictions([(first, "array<string>"), (second, "string")], F.lit(""))
    return _t(spark, sf_dir, "part").select("p_partkey", F.array_join(got, "|").alias("kept"))


# --- evaluation and comparison -------------------------------------------------------------------------------------


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("row_id"), F.array("lang", "source").alias("restrictions"), (F.col("n_chars") > 500).alias("format_pass"), (F.col("toxic") == 0).alias("constraint_pass"),
        F.when(F.col("quality") == 1, (F.col("n_chars") % 10).cast("double")).alias("judge"), F.col("n_chars").alias("tokens_in"), (F.col("n_chars") % 7).alias("tokens_out"),
    )


_EVAL = """e AS (SELECT doc_id, lang, source, n_chars > 500 AS f, toxic = 0 AS c, CASE WHEN quality = 1 THEN (n_chars % 10)::DOUBLE END AS j, n_chars AS ti, n_chars % 7 AS t2 FROM documents LEFT JOIN labels USING (doc_id))"""


@_query(f"""WITH {_EVAL} SELECT count(*)::BIGINT AS rows, round_even(avg(f::INT), 4) AS format_pass_rate, round_even(avg(c::INT), 4) AS constraint_pass_rate, count(c)::BIGINT AS constraint_checked, count(j)::BIGINT AS judged, (count(*) - count(j))::BIGINT AS judge_missing,
round_even(count(j) / count(*), 4) AS judge_coverage, CASE WHEN count(j) = count(*) THEN round_even(avg(j), 4) END AS judge_average, round_even(avg(j), 4) AS judge_average_scored, sum(ti)::BIGINT AS tokens_in, sum(t2)::BIGINT AS tokens_out,
round_even((sum(ti)::DOUBLE * 2.0 + sum(t2)::DOUBLE * 6.0) / 1e6, 6) AS cost FROM e""")
def eval_summary(spark, sf_dir):
    return evals.summary(_evaluated(spark, sf_dir), 2.0, 6.0)


@_query(f"""WITH {_EVAL}, x AS (SELECT unnest([lang, source]) AS restriction, f, c, j FROM e)
SELECT restriction, count(*)::BIGINT AS rows, round_even(avg(f::INT), 4) AS format_pass_rate, round_even(avg(c::INT), 4) AS constraint_pass_rate, round_even(avg(j), 4) AS judge_average FROM x GROUP BY restriction""")
def eval_by_restriction(spark, sf_dir):
    return evals.by_restriction(_evaluated(spark, sf_dir))


@_query("""WITH c AS (SELECT lower(text) AS t FROM documents), m AS (SELECT unnest(list_filter(['and', 'of', 'of the', 'the'], lambda w: regexp_matches(t, '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)'))) AS term FROM c)
SELECT term, count(*)::BIGINT AS n FROM m GROUP BY term""")
def term_frequency(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select(lexicon.check_restrictions(F.col("text"), F.array(F.lit("function_words")), WORDS).alias("deterministic"))
    return evals.term_frequency(rows)


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the documents: they share most rows, and each lacks some."""
    rows = _evaluated(spark, sf_dir).withColumn("k", F.col("row_id").cast("bigint"))
    a = rows.where("k % 10 <> 0").select("row_id", "judge", "constraint_pass", "format_pass")
    b = rows.where("k % 10 <> 5").select("row_id", F.when(F.col("k") % 4 != 0, F.col("judge") + (F.col("k") % 3 - 1) * 0.5).alias("judge"), "constraint_pass", "format_pass")
    return a, b


_RUNS = f"""{_EVAL}, a AS (SELECT doc_id, j, c, f FROM e WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN j + (doc_id % 3 - 1) * 0.5::DOUBLE END AS j, c, f FROM e WHERE doc_id % 10 <> 5),
sa AS (SELECT doc_id, coalesce(j, CASE WHEN c THEN 1.0 WHEN NOT c THEN 0.0 END::DOUBLE + CASE WHEN f THEN 0.1 ELSE 0.0 END::DOUBLE) AS s, CASE WHEN j IS NOT NULL THEN 'judge' WHEN c IS NOT NULL THEN 'constraint' ELSE 'none' END AS o FROM a),
sb AS (SELECT doc_id, coalesce(j, CASE WHEN c THEN 1.0 WHEN NOT c THEN 0.0 END::DOUBLE + CASE WHEN f THEN 0.1 ELSE 0.0 END::DOUBLE) AS s, CASE WHEN j IS NOT NULL THEN 'judge' WHEN c IS NOT NULL THEN 'constraint' ELSE 'none' END AS o FROM b),
p AS (SELECT sa.doc_id::VARCHAR AS row_id, sa.s AS baseline_score, sb.s AS candidate_score, sb.s - sa.s AS delta, CASE WHEN sb.s - sa.s IS NULL THEN 'incomparable' WHEN abs(sb.s - sa.s) <= 0.5 THEN 'tie' WHEN sb.s > sa.s THEN 'win' ELSE 'loss' END AS outcome,
 CASE WHEN sa.o = 'none' OR sb.o = 'none' THEN 'missing' WHEN sa.o = sb.o THEN sa.o ELSE 'mixed' END AS source FROM sa JOIN sb USING (doc_id))"""


@_query(f"WITH {_RUNS} SELECT * FROM p")
def pairwise_rows(spark, sf_dir):
    return pairwise.compare(*_runs(spark, sf_dir), 0.5)


@_query(f"""WITH {_RUNS}, n AS (SELECT count(*) FILTER (outcome = 'win') AS w, count(*) FILTER (outcome = 'loss') AS l, count(*) FILTER (outcome = 'tie') AS t, count(*) FILTER (outcome = 'incomparable') AS i, avg(delta) AS d, count(*) FILTER (source = 'mixed') AS m, count(*) AS k FROM p)
SELECT w::BIGINT AS wins, l::BIGINT AS losses, t::BIGINT AS ties, i::BIGINT AS incomparable, round_even(w / (w + l + t), 4) AS win_rate, round_even((w + t) / (w + l + t), 4) AS non_loss_rate, round_even(d, 4) AS mean_delta, round_even(m / k, 4) AS mixed_rate FROM n""")
def pairwise_summary(spark, sf_dir):
    return pairwise.tally(pairwise.compare(*_runs(spark, sf_dir), 0.5))


@_query("SELECT doc_id::VARCHAR AS row_id, CASE WHEN doc_id % 10 = 5 THEN 'baseline_only' ELSE 'candidate_only' END AS side FROM documents WHERE doc_id % 10 IN (0, 5)")
def rowset_mismatch(spark, sf_dir):
    return pairwise.mismatches(*_runs(spark, sf_dir))


@_query("""SELECT o_orderkey AS id, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('A', 'R'))""")
def resume_antijoin(spark, sf_dir):
    done = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_returnflag")
    pool = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return select.unseen(pool, done.where("l_returnflag = 'A'"), done.where("l_returnflag = 'R'"))


@_query("""WITH k AS (SELECT p_partkey, sha256('{"model":"' || p_brand || '","prompt":"' || p_name || '"}') AS key FROM part), c AS (SELECT key, 'out ' || min(p_partkey) AS output FROM k WHERE p_partkey % 3 = 0 GROUP BY key)
SELECT p_partkey, key, output FROM k LEFT JOIN c USING (key)""")
def cache_lookup(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select("p_partkey", text.cache_key(prompt=F.col("p_name"), model=F.col("p_brand")).alias("key"))
    cache = rows.where("p_partkey % 3 = 0").groupBy("key").agg(F.concat(F.lit("out "), F.min("p_partkey").cast("string")).alias("output"))
    return decide.cached(rows, cache).select("p_partkey", "key", "output")


@_query(f"""WITH {_EVAL}, x AS (SELECT round_even(avg(c::INT) FILTER (doc_id % 2 = 0), 4) AS ca, round_even(avg(c::INT) FILTER (doc_id % 2 = 1), 4) AS cb, round_even(avg(j) FILTER (doc_id % 2 = 0), 4) AS ja, round_even(avg(j) FILTER (doc_id % 2 = 1), 4) AS jb FROM e)
SELECT round_even(cb - ca, 4) AS constraint_delta, round_even(jb - ja, 4) AS judge_delta, CASE WHEN cb - ca >= 0.05 OR jb - ja >= 0.5 THEN 'GO_5A' ELSE 'RUN_5B' END AS decision FROM x""")
def metric_delta_decision(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).withColumn("odd", F.col("row_id").cast("bigint") % 2)
    return decide.go_or_not(evals.summary(rows.where("odd = 0")), evals.summary(rows.where("odd = 1")))


@_query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE (props->>'k')::DOUBLE END AS score, event_id % 5 = 0 AS broken FROM events)
SELECT event_id, score, NOT broken AS found FROM e""")
def judge_json_extract(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.concat(F.lit("Verdict: "), F.when(k == 0, "none").when(k == 1, '{"overall_score": true}').when(k == 2, '{"overall_score": "1d"}').when(k == 3, F.concat(F.lit('{"a": {"b": 1}, "overall_score": " '), F.get_json_object("props", "$.k"), F.lit('"}'))).otherwise(F.concat(F.lit('{"overall_score": '), F.get_json_object("props", "$.k"), F.lit("}"))), F.lit(" end"))
    found = text.json_object(raw)
    return _t(spark, sf_dir, "events").select("event_id", text.optional_float(found, "$.overall_score").alias("score"), found.isNotNull().alias("found"))


@_query("""SELECT event_type, count(*)::BIGINT AS n, round_even(sum(value), 2) AS total FROM events WHERE event_id % 9 <> 0 GROUP BY event_type""")
def latency_log(spark, sf_dir):
    value = F.when(F.col("event_id") % 9 == 0, "bad").otherwise(F.col("value").cast("string"))
    rows = _t(spark, sf_dir, "events").select("event_type", text.strip(value).try_cast("double").alias("value")).where("value is not null")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.bround(F.sum("value"), 2).alias("total"))
