import json

from pyspark.sql import functions as F

from quern.functions import hashing, lexicon, messages, scoring, sections, text


def one(spark, column, kind="string", *values):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x")).alias("y")).collect()]


def test_r_vector(spark):
    cells = [None, "", "NA", "character(0)", "nan", "plain", 'c("a", "b c")', 'c("1", NA, "2")', "c(a, NA, b)", r'c("say \"hi\"", "x")', 'c("")']
    want = [[], [], [], [], [], ["plain"], ["a", "b c"], ["1", "2"], ["a", "b"], [r"say \"hi\"", "x"], []]
    assert one(spark, text.r_vector, "string", *cells) == want


def test_combine_keeps_places(spark):
    df = spark.createDataFrame([(["1", "2"], ["a", " ", "b"]), ([], ["a"]), (["NA"], ["a", "b"])], "q array<string>, p array<string>")
    assert [r[0] for r in df.select(text.combine(F.col("q"), F.col("p"))).collect()] == [["1 a", "b"], ["a"], ["a", "b"]]


def test_rating_and_numbers(spark):
    assert one(spark, text.rating, "string", "4.5", "0", "nan", None, "x", " 2 ") == [4.5, 3.0, 3.0, 3.0, 3.0, 2.0]
    assert one(spark, text.int_like, "string", "1,200", "3.0", "3.5", "true", "1d", None) == [1200, 3, None, None, None, None]
    assert one(spark, text.rate, "double", 1.5, 100.0, 0.5, 101.0, 1.0) == [0.015, 1.0, 0.5, 101.0, 1.0]


def test_optional_float(spark):
    docs = [json.dumps({"s": v}) for v in (7.5, "7.5", True, "abc", "1d", None, " 3 ", "1_0", {"a": 1})] + ["{}", "no"]
    got = one(spark, lambda c: text.optional_float(c, "$.s"), "string", *docs)
    assert got == [7.5, 7.5, None, None, None, None, 3.0, None, None, None, None]


def test_json_object_is_greedy(spark):
    assert one(spark, text.json_object, "string", 'x {"a": {"b": 1}} y', '{"a": 1} and {"b": 2}', "none", "[1]", '{"a"}') == ['{"a": {"b": 1}}', None, None, None, None]


def test_strip_takes_all_white_space(spark):
    assert one(spark, text.strip, "string", "  a b\t\n", "", " ") == ["a b", "", ""]


def test_singular(spark):
    words = ["cherries", "tomatoes", "halves", "peaches", "radishes", "boxes", "buses", "mushrooms", "rice", "hummus", ""]
    assert one(spark, text.singular, "string", *words) == ["cherry", "tomato", "half", "peach", "radish", "box", "bus", "mushroom", "rice", "hummu", ""]


def test_normal_item(spark):
    v = scoring.Vocabulary(("cup", "tbsp"), ("fresh", "finely chopped", "chopped"), {"scallion": "green onion"})
    got = one(spark, v.name, "string", "**2 cups** fresh Scallions (minced)", "½ cup milk, finely chopped", "1-2 tbsp. butter", "", None)
    # a unit's full stop stays, as its border must be a word's
    assert got == ["cups fresh scallion", "milk", ". butter", "", ""]


def test_md5_mod_is_the_whole_number(spark):
    import hashlib

    keys = [f"k{i}" for i in range(300)] + ["", "é"]
    for m in (2, 10, 100, 97):
        assert one(spark, lambda c, m=m: hashing.md5_mod(c, m), "string", *keys) == [int(hashlib.md5(k.encode()).hexdigest(), 16) % m for k in keys]


BAN = lexicon.Lexicon({"dairy": ["unsalted butter", "butter", "milk", "egg"]}, ["butter bean (no butter)"], {"dairy": {"butter": "fat", "unsalted butter": "salt_free_fat"}})


def test_greedy_scan(spark):
    rows = [["1 unsalted butter", "2 butter", "3 butter", "milk"], [], ["jalapeño", "_egg", "2egg", "egg"]]
    got = one(spark, lambda c: lexicon.violations(c, BAN, "dairy"), "array<string>", *rows)
    assert [[(v.ingredient, v.term) for v in r] for r in got] == [[("1 unsalted butter", "unsalted butter"), ("2 butter", "butter"), ("milk", "milk")], [], [("egg", "egg")]]
    assert [v.reason for v in got[0]] == ["salt_free_fat", "fat", "violates_dairy"]


def test_false_positive_modes(spark):
    text_ = ["butter bean stew", "butter bean with butter and milk", "butter bean"]
    literal = one(spark, lambda c: lexicon.passes(c, BAN, "dairy"), "string", *text_)
    stripped = lexicon.Lexicon(BAN.terms, BAN.false_positives, mode="stripped")
    assert literal == [0, 0, 0]
    assert one(spark, lambda c: lexicon.passes(c, stripped, "dairy"), "string", *text_) == [1, 0, 1]
    assert one(spark, lambda c: lexicon.occurrences(c, stripped, "dairy"), "string", *text_) == [0, 1, 0]
    assert one(spark, lambda c: lexicon.violations(c, stripped, "dairy"), "array<string>", ["1 butter bean"])[0] == []


def test_restrictions_have_three_values(spark):
    df = spark.createDataFrame([("no MILK_ here", ["Dairy"]), ("water", ["dairy", "x"]), ("milk", ["x"])], "t string, r array<string>")
    got = [r[0] for r in df.select(lexicon.check_restrictions(F.col("t"), F.col("r"), BAN)).collect()]
    assert [g.constraint_pass for g in got] == [False, True, None]
    assert got[0].violations[0].matched_terms == ["milk"] and got[1].unknown_restrictions == ["x"]


def test_sections_last_of_a_name_wins(spark):
    out = "a\n**Adapted Ingredients**:\n- x\n## adapted steps\n1. go\nAdapted Ingredients:\n- 1 cup y\n\n2) z"
    got = one(spark, sections.parse, "string", out, "", "nothing")
    assert got[0].ingredients == ["1 cup y", "z"] and got[0].steps == ["go"] and got[1].found == []
    # the evaluation's reading takes no bold headers
    assert [s.name for s in one(spark, sections.output_sections, "string", out)[0]] == ["adapted steps", "adapted ingredients"]


def test_three_forms_of_pairs(spark):
    arrow = "- **butter -> oil**: lighter\n* milk → soy milk (no dairy)\nplain"
    table = "| Original | Substitute |\n|---|---|\n| butter | oil |\n| | x |\nend\n| a | b |"
    prose = "We replace the heavy cream with coconut cream. Replaced eggs with flax, and so on"
    got = one(spark, sections.pairs, "string", arrow, table, prose, "")
    assert [[(p["from"], p["to"], p["reason"]) for p in r] for r in got] == [
        [("butter", "oil", "lighter"), ("milk", "soy milk", "no dairy")], [("butter", "oil", "")], [("avy cream", "coconut cream", ""), ("ggs", "flax", "")], [],  # letters of "the " go, as a set
    ]


def test_scan_text(spark):
    full = "Adapted Ingredients\nx\nConstraint Check\nno milk"
    only = "hello\nConstraint Check\nno milk\nSubstitution Plan\nmore"
    got = one(spark, sections.scan_text, "string", full, only, "plain", "Constraint Check\nno milk")
    assert [(g.text, g.mode) for g in got] == [
        ("x", "adapted_sections_only"), ("hello\n\nSubstitution Plan\nmore", "full_output_minus_constraint_check"), ("plain", "full_output"), ("Constraint Check\nno milk", "full_output"),
    ]


def test_completeness(spark):
    out = "Substitution Plan\n- butter -> oil\n- salt -> no change\nAdapted Ingredients\n- 1 cup oil\n- 2 butter\n- salt\nAdapted Steps\n1. Mix..."
    df = spark.createDataFrame([(out, [("1 stick butter", "r"), ("cream", "r")])], "t string, v array<struct<ingredient:string,reason:string>>")
    got = df.withColumn("p", sections.parse(F.col("t"))).select(scoring.completeness_failures(F.col("t"), F.col("p"), F.col("v"), scoring.Vocabulary())).first()[0]
    assert got == ["contains_ellipsis", "violation_unmapped_in_substitution_plan: cream", "banned_ingredient_in_adapted_content: butter"]


def test_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    rows = [[("system", "s"), ("user", " hi "), ("user", '[{"type": "text", "text": "a"}, {"content": "b"}]'), ("assistant", "ok ")], [("assistant", "x")], []]
    assert one(spark, messages.user_text, kind, *rows) == ["hi\n\na\nb", "", ""]
    assert one(spark, messages.gold, kind, *rows) == ["ok", "x", None]
    assert [None if m is None else len(m) for m in one(spark, messages.for_inference, kind, *rows)] == [3, None, None]


def test_restriction_sources(spark):
    df = spark.createDataFrame([(["Vegan", "vegan!"], "nut free, Vegan", ""), (None, None, "x\nRestrictions: a, b"), (None, "", 'categories: ["q r", "s"]'), (None, None, "none")], "a array<string>, b string, u string")
    got = [r[0] for r in df.select(messages.restrictions([(F.col("a"), "array<string>"), (F.col("b"), "string")], F.col("u"))).collect()]
    assert got == [["Vegan", "nut free"], ["a", "b"], ["q r", "s"], []]


def test_lexicons_of_hundreds_of_terms(spark):
    from quern.functions.lexicon import Lexicon, all_violations

    lex = Lexicon({f"c{k}": [f"w{k}x{i}" for i in range(184 if k == 0 else 60)] for k in range(10)}, reasons={"c0": {f"x{i}": f"r{i}" for i in range(60)}})
    rows = spark.range(40).select("id", F.array(*[F.concat(F.lit(f"2 w{k}x"), ((F.col("id") * (k + 1)) % 60).cast("string"), F.lit(" fresh")) for k in range(10)]).alias("items"))
    got = {(r.id, r.constraint): [(v.term, v.reason) for v in r.violations] for r in all_violations(rows, "items", lex).collect()}
    assert len(got) == 400 and all(got[i, f"c{k}"][0][0] == f"w{k}x{i * (k + 1) % 60}" and len(got[i, f"c{k}"]) == 1 for i in range(40) for k in range(10))
    assert got[12, "c0"] == [("w0x12", "r12")] and got[3, "c1"] == [("w1x6", "violates_c1")]


def test_relevance_of_joined_names(spark):
    lex, words = lexicon.Lexicon({"d": ["butter"]}), scoring.Vocabulary(("cup",), ("fresh",))
    rows = spark.createDataFrame([(1, ["1 cup butter", "2 eggs", "2 eggs", "fresh milk"], ["eggs", "oil"]), (2, ["butter"], ["oil"]), (3, ["milk"], [])], "id long, a array<string>, b array<string>")
    direct = {r.id: r.x for r in rows.select("id", scoring.relevance(F.col("a"), F.col("b"), lex, "d", words).alias("x")).collect()}
    a, b = scoring.with_names(rows, "a", lex, "d", words), scoring.with_names(rows, "b", lex, "d", words).select(F.col("id").alias("i"), F.col("names").alias("other"))
    both = a.join(b, F.col("id") == F.col("i"), "left").select("id", scoring.retained(F.col("names"), F.col("wanted"), F.coalesce("other", F.array().cast("array<string>"))).alias("x"))
    assert direct == {r.id: r.x for r in both.collect()} == {1: 0.6667, 2: 1.0, 3: 0.0}


def test_find_keys_at_once(spark):
    """All names in one walk give what a search for each gives."""
    import json
    import random

    from quern.functions.text import find_key, find_keys

    draw, names = random.Random(5), ["a", "b", "c", "a.b", "c.a", "d"]

    def tree(depth):
        kind = draw.randrange(5) if depth else 4
        if kind < 2:
            return {k: tree(depth - 1) for k in draw.sample("abcde", draw.randrange(4))}
        return [tree(depth - 1) for _ in range(draw.randrange(3))] if kind == 2 else draw.choice([None, 1, "x", True, 2.5])

    def plain(value, key):
        if isinstance(value, dict):
            if key in value:
                return value[key]
            value = list(value.values())
        for v in value if isinstance(value, list) else ():
            if (got := plain(v, key)) is not None:
                return got
        return None

    def want(t, keys):
        root = json.loads(t)
        for key in keys:
            at = root
            if "." in key:
                for part in key.split("."):
                    at = at.get(part) if isinstance(at, dict) else None
            else:
                at = plain(root, key)
            if at is not None:
                return json.dumps(at)
        return None

    texts = [json.dumps(tree(4)) for _ in range(300)]
    wanted = {"one": ["a"], "two": ["a.b", "b"], "three": ["d", "c.a", "c"], "none": ["zz"]}
    df = spark.createDataFrame([(t,) for t in [*texts, None, "no json"]], "t string")
    got = df.select("t", find_keys(F.col("t"), wanted).alias("f"), find_key(F.col("t"), names[:1]).alias("g")).collect()
    for r in got[:300]:
        assert r.f.asDict() == {n: want(r.t, keys) for n, keys in wanted.items()} and r.g == want(r.t, ["a"])
    assert all(set(r.f.asDict().values()) == {None} for r in got[300:])
