"""Registered queries for readers and writers: each writes rows of the tables in a form and reads them back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, scratch
from .functions import messages
from .operators import select, validate
from .plans import commands
from .queries import _CHECKED, _chats, _lines, _query, _t
from .sources import quoted, readers, sinks
from .streaming import jobs, snapshots


def _strings(spark, rows: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


# --- tables as text --------------------------------------------------------------------------------------------------


@_query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_name END AS name, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_type END AS category, 'c("' || p_size || '", "2")' AS quantities, 'a, "b"' || chr(10) || 'c' AS parts, 'x' AS instructions, p_retailprice::VARCHAR AS rating FROM part""")
def csv_scan(spark, sf_dir):
    k, path = F.col("p_partkey"), scratch(spark)
    rows = _t(spark, sf_dir, "part").select(
        k.alias(" RecipeId "), F.when(k % 7 == 0, "nan").otherwise(F.col("p_name")).alias("NAME"), F.when(k % 5 == 0, "N/A").when(k % 5 == 1, "").otherwise(F.col("p_type")).alias("RecipeCategory"), F.concat(F.lit('c("'), F.col("p_size").cast("string"), F.lit('", "2")')).alias("RecipeIngredientQuantities"),
        F.lit('a, "b"\nc').alias("Ingredients"), F.lit("x").alias("steps"), F.col("p_retailprice").cast("string").alias("AggregatedRating"), F.lit("z").alias("other"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.recipes_csv(spark, path)


_COMMENT = "'said \"' || l_returnflag || '\", ' || l_partkey || CASE WHEN l_suppkey % 3 = 0 THEN chr(10) || '\"' || l_quantity::INT || chr(10) ELSE ', \"\"' END || ' é'"


@_query(f"SELECT l_orderkey, l_linenumber, {_COMMENT} AS note, CASE WHEN l_linenumber <> 2 THEN l_suppkey END AS supplier FROM lineitem")
def csv_blocks(spark, sf_dir):
    """Lines of orders with remarks that hold line breaks, commas and quotes, in files that are read in many blocks."""
    path, k = scratch(spark), F.col("l_suppkey")
    broken = F.when(k % 3 == 0, F.concat(F.lit('\n"'), F.col("l_quantity").cast("int").cast("string"), F.lit("\n"))).otherwise(F.lit(', ""'))
    note = F.concat(F.lit('said "'), "l_returnflag", F.lit('", '), F.col("l_partkey").cast("string"), broken, F.lit(" é"))
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", note.alias("note"), F.when(F.col("l_linenumber") != 2, k).alias("supplier"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = quoted.scan(spark, path, block=1 << 18)
    return got.select(F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "note", F.col("supplier").cast("bigint").alias("supplier"))


@_query("""SELECT 'part-' || printf('%05d', (c_custkey % 3)::INT) AS file, count(*)::BIGINT AS n, max(r)::BIGINT AS last, sum(r)::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS r FROM customer) GROUP BY 1""")
def numbered_lines(spark, sf_dir):
    """Lines of three files; the numbers must be each file's own, whatever blocks it is read in."""
    path, shown = scratch(spark), F.format_string("part-%05d", F.col("k"))
    rows = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 3).cast("int").alias("k"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("value"))
    rows.repartition(4, "k").sortWithinPartitions("k", "value").select(shown.alias("f"), "value").write.partitionBy("f").text(path)
    got = readers.lines(spark, path).where(F.col("value") != "")
    file = F.regexp_extract("path", r"f=(part-\d+)", 1)
    return got.groupBy(file.alias("file")).agg(F.count("*").alias("n"), F.max("line").alias("last"), F.sum("line").alias("total"))


def _jsonl(spark, sf_dir, broken: bool) -> str:
    """Customers as JSON Lines; with some that are broken, blank or no objects."""
    path, k = scratch(spark), F.col("c_custkey")
    line = F.to_json(F.struct(k.alias("id"), F.concat(F.lit("é"), "c_name").alias("name")))
    if broken:
        line = F.when(k % 9 == 1, "{broken").when(k % 9 == 2, "[1]").when(k % 9 == 3, " ").otherwise(line)
    else:
        line = F.when(k % 9 == 3, "").otherwise(line)
    _t(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return path


@_query("SELECT c_custkey AS id, 'é' || c_name AS name FROM customer WHERE c_custkey % 9 <> 3")
def jsonl_strict(spark, sf_dir):
    return readers.jsonl(spark, _jsonl(spark, sf_dir, False), "id long, name string").select("id", "name")


@_query("SELECT c_custkey AS id, 'é' || c_name AS name FROM customer WHERE c_custkey % 9 NOT IN (1, 2, 3)")
def jsonl_lenient(spark, sf_dir):
    return readers.jsonl(spark, _jsonl(spark, sf_dir, True), "id long, name string", "lenient").select("id", "name")


@_query("SELECT count(*)::BIGINT AS n, sum(c_custkey)::BIGINT AS ids, true AS refused, true AS failed FROM customer")
def jsonl_failfast(spark, sf_dir):
    """Unchecked reading of clean rows, and that strict and unchecked reading refuse broken ones."""
    path = scratch(spark)
    sinks.jsonl(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), path)
    good = readers.jsonl(spark, path, "id long", "failfast").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    bad, raised = _jsonl(spark, sf_dir, True), []
    for mode in ("strict", "failfast"):
        try:
            readers.jsonl(spark, bad, "id long, name string", mode).count()
            raised.append(False)
        except Exception as e:  # Spark's own error, or the reader's
            raised.append(isinstance(e, readers.BadLines) if mode == "strict" else "MALFORMED" in str(e).upper())
    return good.withColumn("refused", F.lit(raised[0])).withColumn("failed", F.lit(raised[1]))


@_query("SELECT c_custkey AS id, true AS escaped FROM customer")
def jsonl_ascii(spark, sf_dir):
    path = scratch(spark)
    sinks.jsonl(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("é"), "c_name").alias("name")), path, ascii_only=True)
    raw = spark.read.text(path)
    return raw.select(F.get_json_object("value", "$.id").cast("bigint").alias("id"), (F.contains("value", F.lit("\\u00E9")) & (F.octet_length("value") == F.length("value"))).alias("escaped"))


@_query("SELECT kept, count(*)::BIGINT AS n, count(reason)::BIGINT AS reasons FROM (SELECT o_orderkey % 3 <> 0 AS kept, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'why' ELSE 'rejected' END END AS reason FROM orders UNION ALL SELECT true, NULL FROM region) GROUP BY kept")
def routed_rows(spark, sf_dir):
    path, k = scratch(spark), F.col("o_orderkey")
    sinks.routed(_t(spark, sf_dir, "orders").select(k.alias("id"), (k % 3 != 0).alias("kept"), F.when(k % 2 == 0, "why").alias("reject_reason")), path)
    sinks.routed(_t(spark, sf_dir, "region").select((-F.col("r_regionkey")).cast("bigint").alias("id"), F.lit(True).alias("kept"), F.lit("gone").alias("reject_reason")), path, resume=True)
    return readers.routed(spark, path, "id long, reject_reason string").groupBy("kept").agg(F.count("*").alias("n"), F.count("reject_reason").alias("reasons"))



@_query("SELECT o_orderkey AS id, o_orderkey % 3 <> 0 AS kept, (o_orderkey % 4 > 1)::INT AS batch, 1::BIGINT AS times FROM orders")
def resumed_rows(spark, sf_dir):
    """Orders in two runs, the second of which fails once behind its write and is repeated: each id is there once."""
    path, k = scratch(spark), F.col("o_orderkey")
    scored = _t(spark, sf_dir, "orders").select(k.alias("id"), (k % 3 != 0).alias("kept"), F.lit(None).cast("string").alias("reject_reason"))
    sinks.routed(scored.where(k % 4 <= 1), path)
    todo = lambda: select.unseen(scored, readers.routed(spark, path, "id long"))
    # what a run leaves that dies before it commits
    todo().write.partitionBy("kept").json(f"{path}/batch=1")
    number = sinks.routed(todo(), path, resume=True)
    sinks.routed(scored, path, resume=True, batch=number)  # a repeated batch writes nothing
    return readers.routed(spark, path, "id long").groupBy("id", "kept", "batch").agg(F.count("*").alias("times"))


@_query("""WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), k AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS r, count(*) OVER () AS all_ FROM c)
SELECT CASE WHEN r <= greatest(1, floor(all_ * 0.9)) THEN 'train' ELSE 'valid' END AS split, count(*)::BIGINT AS rows, sum(n)::BIGINT AS turns FROM k GROUP BY 1""")
def exported_messages(spark, sf_dir):
    path = scratch(spark)
    sinks.export_messages(select.split(_chats(spark, sf_dir), "conv_id"), path)
    got = readers.splits(spark, path, {"train": "split=train", "valid": "split=valid"}, "messages array<struct<role:string,content:string>>")
    rows = got["train"].select(F.lit("train").alias("split"), "messages").unionAll(got["valid"].select(F.lit("valid").alias("split"), "messages"))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.sum(F.size("messages")).cast("bigint").alias("turns"))


# --- documents -------------------------------------------------------------------------------------------------------


@_query("SELECT 3::BIGINT AS n, sum(o_totalprice > 100000)::BIGINT AS large, 'x' AS job, '{\"a\":1,\"b\":{\"c\":2,\"d\":[3]}}' AS settings, true AS missing FROM orders")
def documents(spark, sf_dir):
    """A one-row report as a document, merged twice into a manifest; a document that is not there is empty."""
    path = scratch(spark)
    sinks.document(_t(spark, sf_dir, "orders").agg(F.sum((F.col("o_totalprice") > 100000).cast("bigint")).alias("large")), f"{path}/report.json")
    sinks.update_manifest(spark, f"{path}/manifest.json", {"job": {"fine_tuned_model": " x "}, "settings": {"a": 1, "b": {"c": 1}}})
    sinks.update_manifest(spark, f"{path}/manifest.json", {"settings": {"b": {"c": 2, "d": [3]}}, "report": readers.document(spark, f"{path}/report.json")})
    d = readers.document(spark, f"{path}/manifest.json")
    row = (len(d), d["report"]["large"], readers.model_name(spark, f"{path}/manifest.json"), json.dumps(d["settings"], separators=(",", ":")), readers.optional_document(spark, f"{path}/none.json") == {})
    return spark.createDataFrame([row], "n long, large long, job string, settings string, missing boolean")


@_query("SELECT o_orderkey AS id, o_orderpriority AS title FROM orders")
def pool_document(spark, sf_dir):
    """Orders as one document that tasks write in pieces, read back in blocks of 64 KB."""
    path = scratch(spark)
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"))
    sinks.pool(rows, F.col("id"), path, kb_version="v0", counts={"recipes": [1, {"a": "}"}]})
    return readers.pool(spark, path, "struct<id:bigint,title:string>", 1 << 16)


@_query("""SELECT p_partkey, regexp_matches(p_name, '\\b(old rod|ring)\\b')::INT = 0 AS passed, CASE WHEN p_name LIKE '%ring' THEN 'band' WHEN p_name LIKE 'small %' THEN substr(p_name, 7) ELSE p_name END AS name FROM part""")
def lexicon_documents(spark, sf_dir):
    from .functions import lexicon

    path = scratch(spark)
    sinks.write_text(spark, f"{path}/lexicon.json", json.dumps({"_meta": {"known_false_positives": ["x (y)"]}, "no_metal": {"banned": ["ring", "old rod"]}}))
    sinks.write_text(spark, f"{path}/names.json", json.dumps({"aliases": {f"{a}ring": "band" for a in ("", "red ", "blue ", "cold ", "hot ", "large ", "new ", "old ")}, "prep_adjectives": ["small"], "units_to_strip": ["kg"]}))
    words, names = readers.lexicon(spark, f"{path}/lexicon.json"), readers.vocabulary(spark, f"{path}/names.json")
    return _t(spark, sf_dir, "part").select("p_partkey", (lexicon.passes(F.col("p_name"), words, "no_metal") == 1).alias("passed"), names.name(F.concat(F.lit("2 "), "p_name", F.lit(" kg"))).alias("name"))


@_query("""SELECT r_regionkey::VARCHAR AS rule_id, c AS "constraint", t AS term, r_name AS replacement FROM region, (VALUES ('vegan'), ('dairy')) c(c), (VALUES ('milk'), ('cream')) t(t)""")
def swap_rules(spark, sf_dir):
    path = scratch(spark)
    rules = [{"rule_id": str(r["r_regionkey"]), "applies_to_constraints": ["vegan", "dairy"], "match_terms": ["milk", "cream"], "replacement": [r["r_name"]], "rationale": "why"} for r in _t(spark, sf_dir, "region").collect()]
    sinks.write_text(spark, f"{path}/rules.json", json.dumps({"version": 0, "rules": rules}, indent=1))
    return readers.swap_rules(spark, f"{path}/rules.json").select("rule_id", "constraint", "term", F.array_join("replacement", "|").alias("replacement"))


@_query("SELECT (c_custkey / 7 - 20)::DECIMAL(18, 3)::DOUBLE AS value FROM customer WHERE c_custkey % 9 <> 0")
def number_lines(spark, sf_dir):
    path, k = scratch(spark), F.col("c_custkey")
    sinks.append_latency(_t(spark, sf_dir, "customer").where(k % 9 != 0).select((k / 7 - 20).cast("decimal(18,3)").alias("value")), path)
    _strings(spark, [("bad",), ("",), ("1,5",)], "value").write.mode("append").text(path)
    return readers.number_log(spark, path)


@_query("SELECT n_name AS pattern FROM nation WHERE n_nationkey % 4 = 0")
def ignore_file(spark, sf_dir):
    path, k = scratch(spark), F.col("n_nationkey") % 4
    line = F.when(k == 0, F.concat(F.lit(" "), "n_name")).when(k == 1, F.concat(F.lit("# "), "n_name")).when(k == 2, F.concat(F.lit("!"), "n_name")).otherwise(" ")
    _t(spark, sf_dir, "nation").select(line.alias("value")).write.text(path)
    return readers.ignore_patterns(spark, path)


@_query("""WITH f AS (SELECT o_orderpriority AS p, o_orderstatus = 'O' AS open, sum(strlen(o_orderkey || ',' || o_totalprice) + 1)::BIGINT AS bytes FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, o_totalprice::BIGINT AS o_totalprice FROM orders) GROUP BY 1, 2)
SELECT open, lower(CASE WHEN open AND p <> '5-LOW' THEN 'old recipes ' || p || '.csv' ELSE 'data ' || p || '.csv' END) AS name, bytes FROM f QUALIFY row_number() OVER (PARTITION BY open ORDER BY open AND p <> '5-LOW' DESC, bytes DESC, p) = 1""")
def largest_csv(spark, sf_dir):
    """Orders as a CSV for each status and priority, whose sizes come from the rows; of each folder the file that a run would take."""
    path, fs = scratch(spark), spark._jvm.org.apache.hadoop.fs
    is_open = F.col("o_orderstatus") == "O"
    rows = _t(spark, sf_dir, "orders").select(is_open.alias("open"), F.col("o_orderpriority").alias("p"), F.concat_ws(",", F.col("o_orderkey").cast("string"), F.bround("o_totalprice").cast("bigint").cast("string")).alias("value"))
    rows.repartition("open", "p").write.partitionBy("open", "p").text(f"{path}/parts")
    out, files = [], fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/parts").select("path").collect():
        open_, p = f["path"].split("/open=")[1].split("/")[:2]
        p = p.removeprefix("p=").replace("%20", " ")
        name = f"old Recipes {p}.csv" if open_ == "true" and p != "5-LOW" else f"data {p}.csv"
        files.mkdirs(fs.Path(f"{path}/{open_}"))
        files.rename(fs.Path(f["path"].replace("%20", " ").replace("%3D", "=")), fs.Path(f"{path}/{open_}/{name}"))
    sinks.write_text(spark, f"{path}/true/recipes.txt", "x" * 10_000_000)  # the largest, but no CSV
    for open_ in ("true", "false"):
        chosen = readers.largest_csv(spark, f"{path}/{open_}").replace("%20", " ")
        out.append((open_ == "true", chosen.rsplit("/", 1)[-1].lower(), files.getFileStatus(fs.Path(chosen)).getLen()))
    return spark.createDataFrame(out, "open boolean, name string, bytes long")


@_query("""SELECT '| rank | name |' AS head, (SELECT count(*) FROM region)::BIGINT AS rows, true AS cut, 'N/A YES [1]' AS shown""")
def markdown_reports(spark, sf_dir):
    table = sinks.markdown("Regions", _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("rank"), F.col("r_name").alias("name")))
    short = sinks.markdown("Nations", _t(spark, sf_dir, "nation").select("n_name"), most=3)
    lines = sinks.report("R", {"A": [("x", None), ("y", True), ("z", [1])]}).splitlines()
    row = (table.splitlines()[2], sum(x.startswith("| ") for x in table.splitlines()) - 1, "more than these 3 rows" in short, " ".join(x.split(": ")[1] for x in lines if ": " in x))
    return spark.createDataFrame([row], "head string, rows long, cut boolean, shown string")


# --- whole files and runs ----------------------------------------------------------------------------------------------


@_query(f"""WITH {_CHECKED}, f AS (SELECT path, count(*)::BIGINT AS lines, (count(*) FILTER (status = 'record'))::BIGINT AS records, (count(*) FILTER (status = 'parse_error'))::BIGINT AS parse_errors FROM v GROUP BY path)
SELECT * FROM (SELECT path, lines, records, parse_errors, false AS passed FROM f UNION ALL SELECT 'good', (SELECT count(*) FROM c WHERE a > 0)::BIGINT, (SELECT count(*) FROM c WHERE a > 0)::BIGINT, 0, true UNION ALL SELECT 'large', (SELECT count(*) FROM c WHERE a > 0)::BIGINT, (SELECT count(*) FROM c WHERE a > 0)::BIGINT, 0, false UNION ALL SELECT 'empty', 0, 0, 0, false)""")
def preflight_files(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    whole = _chats(spark, sf_dir).where(F.exists("messages", lambda m: m["role"] == "assistant")).select(F.col("conv_id").alias("line"), F.to_json(F.struct("messages")).alias("value"))
    rows = rows.unionByName(whole.withColumn("path", F.explode(F.array(F.lit("good"), F.lit("large")))))
    sizes = [("part0", 9), ("part1", 9), ("part2", 9), ("good", 1 << 20), ("large", (1 << 20) + 1), ("empty", 0)]
    out = validate.preflight(validate.file_stats(validate.validate_lines(rows)), spark.createDataFrame(sizes, "path string, bytes long"))
    return out.select("path", "lines", "records", "parse_errors", "passed")


@_query("SELECT user_id::VARCHAR AS job_id, lower(event_type) AS status, lower(event_type) IN ('success', 'failed') AS final FROM (SELECT DISTINCT user_id, CASE event_type WHEN 'purchase' THEN 'Success' ELSE event_type END AS event_type FROM events)")
def snapshot_stream(spark, sf_dir):
    """Status snapshots appended as JSON Lines, read as a file stream: each job's statuses once each."""
    path = scratch(spark)
    rows = _t(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"), F.col("event_id").cast("int").alias("poll_index"), F.when(F.col("event_type") == "purchase", "Success").otherwise(F.col("event_type")).alias("status"), F.col("user_id").cast("string").alias("job_id"), F.lit("{}").alias("payload"))
    sinks.append_snapshot(rows, f"{path}/in")
    snapshots.write(snapshots.transitions(snapshots.read(spark, f"{path}/in"), "100 days"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("job_id", "status", "final")


@_query("""WITH e AS (SELECT user_id::VARCHAR AS job_id, date_trunc('millisecond', ts) AS seen, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 9 = 0 THEN 'success' ELSE 'running' END WHEN 'signup' THEN CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'queued' END ELSE event_type END AS status, event_id FROM events),
n AS (SELECT *, row_number() OVER w AS k, lag(seen) OVER w AS before, lag(status) OVER w AS previous, min(seen) OVER w AS first, status IN ('success', 'failed') AS final FROM e WINDOW w AS (PARTITION BY job_id ORDER BY seen, status)),
d AS (SELECT *, least(first + INTERVAL 20 DAY, before + to_milliseconds((1000 * least(259200, 43200 * 1.5 ** (k - 2)))::BIGINT)) AS due FROM n),
l AS (SELECT job_id, max(seen) AS seen, min(first) AS first, count(*) AS k, max_by(status, (seen, status)) AS status FROM n GROUP BY job_id),
x AS (SELECT job_id, k, seen, status, previous, final, due, coalesce(seen > due, false) AS late FROM d UNION ALL
  SELECT job_id, k + 1, NULL, NULL, status, false, least(first + INTERVAL 20 DAY, seen + to_milliseconds((1000 * least(259200, 43200 * 1.5 ** (k - 1)))::BIGINT)), true FROM l),
s AS (SELECT job_id, min(k) AS stop FROM x WHERE late OR final GROUP BY job_id)
SELECT job_id, epoch_ms(CASE WHEN late THEN due ELSE seen END) AS at_ms, CASE WHEN late THEN 'timeout' ELSE status END AS status, previous, (CASE WHEN late THEN 3 WHEN status = 'success' THEN 0 WHEN status = 'failed' THEN 2 END)::INT AS exit_code
FROM x JOIN s USING (job_id) WHERE k <= stop AND (k = stop OR k = 1 OR status IS DISTINCT FROM previous)""")
def watched_jobs(spark, sf_dir):
    """Users as jobs, their events as snapshots in files that come out of order: changes of status, ends, and jobs that fall silent."""
    path, e = scratch(spark), F.col("event_id")
    kind = F.when(F.col("event_type") == "purchase", F.when(e % 9 == 0, "Success").otherwise("running")).when(F.col("event_type") == "signup", F.when(e % 9 == 0, "failed").otherwise("queued")).otherwise(F.col("event_type"))
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    events = _t(spark, sf_dir, "events")
    rows = events.select(F.date_format("ts", iso).alias("captured_at"), e.cast("int").alias("poll_index"), kind.alias("status"), F.col("user_id").cast("string").alias("job_id"), F.lit("{}").alias("payload"))
    files = max(5, 2 * spark.sparkContext.defaultParallelism)
    rows.repartition(files, "poll_index").write.json(f"{path}/in")
    # a snapshot far ahead moves the watermark over all that is held
    over = events.agg(F.date_format(F.timestamp_add("DAY", F.lit(200), F.max("ts")), iso).alias("captured_at"))
    snapshot = over.select("captured_at", F.lit(0).alias("poll_index"), F.lit("queued").alias("status"), F.lit("~").alias("job_id"), F.lit("{}").alias("payload"))
    patience = jobs.Patience(interval=43_200, backoff=1.5, most=259_200, all_=20 * 86_400, forget=400 * 86_400)
    for _ in range(2):  # the second run goes on from the first one's checkpoint
        with jobs.keyed_state(spark):
            snapshots.write(jobs.watched(snapshots.read(spark, f"{path}/in", -(-2 * files // 5)), patience, "60 days"), f"{path}/out", f"{path}/checkpoint").awaitTermination()
        snapshot.coalesce(1).write.mode("append").json(f"{path}/in")
    return spark.read.schema(jobs.OUT).parquet(f"{path}/out").where("job_id <> '~'").select("job_id", F.unix_millis("at").alias("at_ms"), "status", "previous", "exit_code")


@_query("""SELECT * FROM (VALUES ('gate', 2), ('export', 0), ('check-gate', 0), ('check-gate refused', 2), ('preflight', 0), ('compare', 1), ('watch', 2), ('watch late', 3), ('no such file', 1)) t(command, code)""")
def exit_codes(spark, sf_dir):
    """Commands on files made of the tables, and what they return."""
    p = scratch(spark)
    scores = F.from_json(F.lit('{"constraint_pass": 1, "semantic_completeness_pass": 0, "relevance_score": 0.6, "nontriviality_score": 0.9, "completeness_failures": []}'), "constraint_pass int, semantic_completeness_pass int, relevance_score double, nontriviality_score double, completeness_failures array<string>")
    master = _chats(spark, sf_dir).where(F.exists("messages", lambda m: m["role"] == "assistant")).select(F.col("conv_id").cast("string").alias("source_recipe_id"), F.lit("A").alias("template_id"), F.lit(True).alias("kept_for_training"), scores.alias("audit_scores"), "messages")
    sinks.jsonl(keep(master), f"{p}/master")
    report = {"kept_rows": 2000, "constraint_pass_rate_on_kept": 1, "semantic_completeness_pass_rate_on_kept": 1, "assistant_completeness_validation_pass_rate_on_kept": 1, "mean_relevance_on_kept": 0.6, "nontrivial_pass_rate_on_kept": 0.95, "template_distribution": {"A": 5, "B": 3, "C": 2}}
    sinks.write_text(spark, f"{p}/good.json", json.dumps(report))
    sinks.write_text(spark, f"{p}/bad.json", json.dumps(report | {"gate_passed": False}))
    for name, status in (("failed", "FAILED"), ("running", "RUNNING")):
        sinks.write_text(spark, f"{p}/{name}.json", json.dumps({"status": status, "id": "j"}))
    sinks.write_text(spark, f"{p}/one.jsonl", json.dumps({"messages": [{"role": "assistant", "content": "x"}]}) + "\n")
    for name, ids in (("a", (1, 2)), ("b", (1, 3))):
        sinks.write_text(spark, f"{p}/{name}.jsonl", "".join(json.dumps({"row_id": str(i), "judge": 5.0, "constraint_pass": True, "format_pass": True}) + "\n" for i in ids))
    run = lambda *args: commands.main([str(x) for x in args], spark)
    codes = [
        ("gate", run("gate", "--master", f"{p}/master")), ("export", run("export", f"{p}/out", "--master", f"{p}/master")), ("check-gate", run("check-gate", f"{p}/good.json")), ("check-gate refused", run("check-gate", f"{p}/bad.json")),
        ("preflight", run("preflight", f"{p}/one.jsonl", f"{p}/one.jsonl")), ("compare", run("compare", f"{p}/a.jsonl", f"{p}/b.jsonl", f"{p}/pairs")), ("watch", run("watch", f"{p}/failed.json", f"{p}/log")), ("watch late", run("watch", f"{p}/running.json", f"{p}/log", "--max-wait-seconds", 0)),
        ("no such file", run("check-gate", f"{p}/none.json")),
    ]
    return spark.createDataFrame(codes, "command string, code int")


@_query("""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'user' AND trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '') AS users FROM conversations GROUP BY conv_id)
SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS answered, 0::BIGINT AS endpoint_errors, count(*)::BIGINT AS passed FROM c WHERE users > 0""")
def endpoint_evaluation(spark, sf_dir):
    """All conversations through the endpoint command with the offline model: rows and metrics that it writes."""
    p = scratch(spark)
    chats = _chats(spark, sf_dir).select(F.col("conv_id").cast("string").alias("row_id"), F.array(F.lit("no_metal")).alias("restrictions"), "messages")
    sinks.jsonl(chats, f"{p}/chats")
    sinks.write_text(spark, f"{p}/lexicon.json", json.dumps({"no_metal": {"banned": ["ring", "rod"]}}))
    commands.main(["evaluate-endpoint", f"{p}/chats", f"{p}/out", "--lexicon", f"{p}/lexicon.json"], spark)
    rows = spark.read.schema("row_id string, output_text string, constraint_pass boolean").json(f"{p}/out/rows")
    errors = readers.document(spark, f"{p}/out/metrics.json")["endpoint_errors"]
    return rows.agg(F.count_distinct("row_id").alias("rows"), F.count("output_text").alias("answered"), F.lit(errors).cast("bigint").alias("endpoint_errors"), F.count_if("constraint_pass").alias("passed"))


@_query("SELECT conv_id, string_agg(role, ',' ORDER BY turn, role, text) AS roles FROM conversations GROUP BY conv_id")
def chat_documents(spark, sf_dir):
    """Chat rows through JSON Lines and back, as evaluation takes them."""
    path = scratch(spark)
    sinks.jsonl(_chats(spark, sf_dir), path)
    rows = readers.jsonl(spark, path, "conv_id long, messages array<struct<role:string,content:string>>")
    return rows.select("conv_id", F.array_join(F.transform(messages.valid(F.col("messages")), lambda m: m["role"]), ",").alias("roles"))
