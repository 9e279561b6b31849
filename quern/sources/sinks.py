"""Writers: JSON documents, JSON Lines, routed rows, manifests, Markdown, logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MISSING


def merge(old: dict, new: dict) -> dict:
    """Maps merge key by key, all the way down; elsewhere the new value wins."""
    out = dict(old)
    for k, v in new.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text to one file of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def document(one: DataFrame, path: str) -> dict:
    """A one-row frame as a readable JSON document."""
    out = json.loads(one.toJSON().first())
    write_text(one.sparkSession, path, json.dumps(out, indent=2, ensure_ascii=False) + "\n")
    return out


def pool(rows: DataFrame, order: Column, path: str, **fields) -> None:
    """A summary document with ``fields`` and its rows as the array ``recipes``, in order: tasks write the pieces, one file behind the other."""
    spark = rows.sparkSession
    head = json.dumps(fields, ensure_ascii=False)[:-1] + (", " if fields else "") + '"recipes": ['
    n = rows.count()
    # every element but the last has a comma; which that is the order says
    last = rows.select(order.alias("o")).agg(F.max("o")).first()[0]
    body = rows.select(F.lit(1).alias("part"), order.alias("o"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
    body = body.select("part", "o", F.when(F.col("o") < F.lit(last), F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value")) if n else body
    ends = spark.createDataFrame([(0, head), (2, "]}")], "part int, value string").select("part", F.lit(None).cast(body.schema["o"].dataType).alias("o"), "value")
    ends.unionAll(body).repartitionByRange("part", "o").sortWithinPartitions("part", "o").select("value").write.mode("overwrite").text(path)


def update_manifest(spark: SparkSession, path: str, new: dict) -> dict:
    from .readers import optional_document

    out = merge(optional_document(spark, path), new)
    write_text(spark, path, json.dumps(out, indent=2, ensure_ascii=False) + "\n")
    return out


def jsonl(df: DataFrame, path: str, mode: str = "overwrite", ascii_only: bool = False) -> None:
    df.write.mode(mode).option("writeNonAsciiCharacterAsCodePoint", str(ascii_only).lower()).json(path)


class Committed(RuntimeError):
    """Another run has committed a batch of this number."""


def routed(scored: DataFrame, path: str, resume: bool = False, batch: int | None = None) -> int:
    """Kept and rejected rows (which always carry their reason) to a table of batches; returns the batch's number.

    A batch is a folder of its own, and counts once its mark lies in the log beside the data: what a failed run has written is
    not read (:func:`readers.routed`), and is overwritten by the run that repeats the batch. ``batch`` names one that may be
    repeated (as a stream's batch id does): once committed, nothing is written again. Without it the next free number is taken. With
    ``resume`` batches are added, else the table begins anew.
    """
    from .readers import committed

    spark = scored.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not resume:
        files.delete(top, True)
    have = committed(spark, path)
    if batch in have:
        return batch
    number = batch if batch is not None else max(have, default=-1) + 1
    rows = scored.withColumn("reject_reason", F.when(~F.col("kept"), F.coalesce("reject_reason", F.lit("rejected"))))
    rows.write.mode("overwrite").partitionBy("kept").json(f"{path}/batch={number}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{number}")
    try:
        files.create(mark, False).close()
    except Exception as e:
        if batch is None:
            raise Committed(f"{path}: batch {number}") from e
        raise
    return number


def export_messages(rows: DataFrame, path: str) -> None:
    """The messages alone, by split."""
    rows.select("split", "messages").write.mode("overwrite").partitionBy("split").json(path)


def append_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_latency(df: DataFrame, path: str) -> None:
    """One number per line, three digits."""
    df.select(F.format_string("%.3f", F.col("value").cast("double")).alias("value")).write.mode("append").text(path)


def markdown(title: str, rows: DataFrame, most: int = 1000) -> str:
    """A small frame as a Markdown table. It is a report: of a larger frame the first ``most`` rows are shown, and a last
    line says that there are more."""
    names, got = rows.columns, rows.limit(most + 1).collect()
    body = ["| " + " | ".join("n/a" if r[c] is None else str(r[c]) for c in names) + " |" for r in got[:most]]
    more = [f"There are more than these {most} rows."] if len(got) > most else []
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names), *body, *more, ""])


def report(title: str, fields: dict[str, list[tuple[str, object]]]) -> str:
    """A Markdown report: sections of named values; what is missing is ``N/A``, flags are YES or NO."""
    def shown(v) -> str:
        if v is None or v == "":
            return MISSING
        return ("YES" if v else "NO") if isinstance(v, bool) else json.dumps(v, ensure_ascii=True) if isinstance(v, dict | list) else str(v)

    out = [f"# {title}", ""]
    for section, rows in fields.items():
        out += [f"## {section}", "", *[f"- {name}: {shown(v)}" for name, v in rows], ""]
    return "\n".join(out)
