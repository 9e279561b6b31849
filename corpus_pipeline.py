"""A training corpus from raw documents: language, near-duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, langid, minhash, packing, pii
from quern.llm.common import drop, keep

#: Words whose largest posteriors are below this on average have no language; texts of several languages in equal parts are
#: kept, however many those are.
LEAST_SCORE = 0.3
SHINGLE, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language can be told.

    Null, empty and letterless texts go; rows without doc_id, repeated rows and texts of any length are judged like others; with no
    labelled text to learn from all texts with letters stay; an empty table stays empty; other columns pass through.
    """
    return langid.known(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates.

    Null and wordless texts link with nothing and stay; of equal rows one stays; rows without doc_id stay; of different texts
    under one doc_id each is judged for itself; other columns pass through.
    """
    return minhash.deduplicate(docs, SHINGLE, PERCENT)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and wordless texts stay, as do all where the benchmark is empty; repeated rows are judged each by itself; other
    columns pass through.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars (where there is one) as the text now is.

    Null texts stay null (and n_chars with them); repeated rows are masked alike; other columns pass through.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into windows.

    Null and empty texts are one end id; repeated rows are packed each by itself; no documents make no pieces; other columns
    play no part.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal", personal), ("pack", pack)]

#: SQL can't express the language model, the span classifier or the tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage writes goes once the next one has been written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, keep(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
