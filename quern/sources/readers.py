"""Readers: CSV with loose column names, numbered text lines, JSON Lines in three strictnesses, small documents."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_json, strip
from . import elements, quoted


class MissingColumns(ValueError):
    pass


class BadLines(ValueError):
    pass


# Names under which a recipe table may have its columns.
RECIPE_COLUMNS = {
    "id": ("recipeid", "recipe_id", "id"),
    "name": ("name", "title", "recipename"),
    "category": ("recipecategory", "category"),
    "quantities": ("recipeingredientquantities", "quantities"),
    "parts": ("recipeingredientparts", "ingredients", "parts"),
    "instructions": ("recipeinstructions", "instructions", "steps"),
    "rating": ("aggregatedrating", "rating"),
}
REQUIRED = ("id", "name", "parts", "instructions")
NA = ("NA", "N/A", "", "nan")


def resolve(columns: list[str], wanted: dict[str, tuple[str, ...]] = RECIPE_COLUMNS, required: tuple[str, ...] = REQUIRED) -> dict[str, str | None]:
    """For each wanted name the first candidate that is there, whatever its case."""
    have = {c.strip().lower(): c for c in reversed(columns)}
    got = {name: next((have[c] for c in options if c in have), None) for name, options in wanted.items()}
    if lost := [n for n in required if got[n] is None]:
        raise MissingColumns(", ".join(lost))
    return got


def recipes_csv(spark: SparkSession, path: str, block: int = quoted.BLOCK) -> DataFrame:
    """The wanted columns of a recipe CSV as strings; NA tokens are null, records with too many fields are dropped. Files of any size are
    read in blocks, cells with line breaks and all."""
    found = resolve(quoted.header(spark, path))
    raw = quoted.scan(spark, path, list(dict.fromkeys(c for c in found.values() if c)), block)
    col = lambda c: F.when(~F.col(f"`{c}`").isin(*NA), F.col(f"`{c}`")) if c else F.lit(None).cast("string")
    return raw.select(*[col(c).alias(n) for n, c in found.items()])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 1), value: text lines with their numbers.

    A file of any size is read in blocks. Spark's running id counts within a block; how many lines a file's earlier blocks
    have is summed over a table of one row per block.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    raw = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("_i"), "value")
    blocks = raw.groupBy("at").agg(F.min("_i").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("at.path").orderBy("at.block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("at").alias("_at"), "_first", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return raw.join(blocks, F.col("at") == F.col("_at")).select("at.path", (F.col("_i") - F.col("_first") + F.col("_earlier") + 1).alias("line"), "value")


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """Rows of a JSON Lines file.

    strict: blank lines are skipped, anything else that is no object raises; lenient: it is dropped; failfast: Spark's own
    error. The strict check is an action of its own over the file.
    """
    if mode == "failfast":
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = lines(spark, path).where(strip(F.col("value")) != "").withColumn("_v", parse_json(F.col("value")))
    bad = ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    if mode == "strict" and (first := rows.where(bad).orderBy("path", "line").select("path", "line").first()):
        raise BadLines(f"{first['path']}:{first['line']} is no JSON object")
    return rows.where(~bad).select("path", "line", F.from_json("value", schema).alias("_r")).select("path", "line", "_r.*")


def document(spark: SparkSession, path: str) -> dict:
    """A small JSON document; its root must be an object."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    out = json.loads(text)
    if not isinstance(out, dict):
        raise BadLines(f"{path} is no JSON object")
    return out


def optional_document(spark: SparkSession, path: str) -> dict:
    """The document, or nothing where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return document(spark, path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else {}


def pool(spark: SparkSession, path: str, schema: T.StructType | str, block: int = quoted.BLOCK) -> DataFrame:
    """The ``recipes`` array of a summary document (of any size, in one file or several) as rows."""
    return elements.elements(spark, path, "recipes", schema, block)


def committed(spark: SparkSession, path: str) -> set[int]:
    """The numbers of a routed table's committed batches."""
    log = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    files = log.getFileSystem(spark._jsc.hadoopConfiguration())
    return {int(f.getPath().getName()) for f in files.listStatus(log) if f.getPath().getName().isdigit()} if files.exists(log) else set()


def routed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the committed batches of a table that :func:`sinks.routed` has written, with ``kept`` and ``batch``."""
    have = sorted(committed(spark, path))
    schema = f"{schema}, kept boolean, batch int"
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).json([f"{path}/batch={n}" for n in have])


def number_log(spark: SparkSession, path: str) -> DataFrame:
    """value: one number per line; what is no number is skipped."""
    return spark.read.text(path).select(strip(F.col("value")).try_cast("double").alias("value")).where("value is not null")


def ignore_patterns(spark: SparkSession, path: str) -> DataFrame:
    """Patterns of an ignore file, without blank lines, comments and exceptions."""
    return spark.read.text(path).select(strip(F.col("value")).alias("pattern")).where(~F.rlike("pattern", F.lit("^(?:[#!]|$)")))


def lexicon(spark: SparkSession, path: str):
    """A lexicon from a JSON document: constraint names with ``banned`` lists, and ``_meta.known_false_positives``."""
    from ..functions.lexicon import Lexicon

    d = document(spark, path)
    return Lexicon({k: list(v.get("banned", [])) for k, v in d.items() if not k.startswith("_") and isinstance(v, dict)}, list(d.get("_meta", {}).get("known_false_positives", [])))


def vocabulary(spark: SparkSession, path: str):
    """What item names are cleaned of, from a JSON document: ``aliases``, ``prep_adjectives``, ``units_to_strip``."""
    from ..functions.scoring import Vocabulary

    d = document(spark, path)
    return Vocabulary(tuple(d.get("units_to_strip", [])), tuple(d.get("prep_adjectives", [])), dict(d.get("aliases", {})))


def swap_rules(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, constraint, term, replacement, rationale: the ``rules`` of a JSON document, a row for each constraint and
    term of each."""
    shape = "rules array<struct<rule_id:string,applies_to_constraints:array<string>,match_terms:array<string>,replacement:array<string>,rationale:string>>"
    rules = spark.read.schema(shape).option("multiLine", True).json(path).select(F.explode("rules").alias("r")).select("r.*")
    each = rules.withColumn("constraint", F.explode("applies_to_constraints")).withColumn("term", F.explode("match_terms"))
    return each.select("rule_id", "constraint", "term", "replacement", "rationale")


def model_name(spark: SparkSession, path: str) -> str | None:
    """The fine-tuned model of a manifest; none where there is no manifest or it names none."""
    from ..functions.text import model_name as named

    d = optional_document(spark, path)
    return spark.createDataFrame([(json.dumps(d),)], "d string").select(named(F.col("d")).alias("m")).first()["m"]


def splits(spark: SparkSession, folder: str, files: dict[str, str], schema: T.StructType | str) -> dict[str, DataFrame]:
    """A frame for each named split (``{"train": "train.jsonl", ...}``) of a dataset's folder."""
    return {name: jsonl(spark, f"{folder.rstrip('/')}/{file}", schema, "lenient") for name, file in files.items()}


def largest_csv(spark: SparkSession, folder: str, name: str = "recipe") -> str | None:
    """The path of a folder's largest CSV whose name holds ``name``, else of its largest CSV."""
    from ..operators.select import largest_file

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    got = largest_file(files, name).first()
    return got["path"] if got else None


def snapshots_schema() -> str:
    return "captured_at string, poll_index int, status string, job_id string, payload string"
