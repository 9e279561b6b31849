"""Target-distribution importance resampling over hashed word n-grams.

A feature's bucket is its CRC-32 modulo ``buckets``. Each word's CRC is computed once; those of runs of words follow by the
algebra of :mod:`crc`, so no n-gram is ever written out. How often each bucket occurs is counted in each task and summed in
Spark, for the corpus and for the target; a bucket's gain is 1000 times the log of the ratio of its smoothed shares, floored.
A document's weight is the floored mean of its features' gains, and its score the weight plus Gumbel noise from a digest of
its id, so the highest scores are a draw without replacement by weight.

Ranks need no sort of all rows: how many documents have each score (scores are integers in a range of some 130,000, by the
range of logs of ratios of longs and of the noise) says where the cut falls and how many rank before each score. Those below the
cut get no rank; the rest are numbered within their score.

Defined cases: null and wordless texts have no features, weight 0, and are never drawn; rows without doc_id count among the
documents but have a null score and are never drawn; repeated rows are each scored and ranked for themselves, ties of equal
doc_id by features; an empty corpus gives no rows, an empty target counts as no features; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crc, textnum
from .common import keep, lean, only, workers

BUCKETS, WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7


def features(texts: pa.Array, words: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to ``words`` words: (bucket of each run that lies in one row, its row)."""
    raw, at = textnum.flat(texts)
    low = textnum.ALNUM[0][raw]
    start, end = textnum.bounds(raw, at, textnum.ALNUM)
    row = np.searchsorted(at, start, "right") - 1
    for k, run in enumerate(crc.runs(crc.of(low, start, end), end - start, words)):
        if not len(run):
            return
        whole = row[: len(run)] == row[k:]
        yield (run[whole] % np.uint32(buckets)).astype(np.int64), row[: len(run)][whole]


def counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for whole in batches:
            for b in textnum.slices(whole, "text"):
                for bucket, _ in features(b.column("text"), words, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    got = only(docs, text="string").where("text is not null").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, from how often it occurs in the corpus and in the target."""
    n = len(corpus)
    s, t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * s / ((float(x) + 1) * t))) for x, y in zip(corpus, target, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textnum.slices(whole, "text"):
                n, of, total = np.zeros((3, b.num_rows), np.int64)
                for k, (bucket, row) in enumerate(features(b.column("text"), words, len(gain))):
                    count = np.bincount(row, minlength=b.num_rows)
                    n += count if k == 0 else 0
                    of += count
                    np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), pa.array(of), pa.array(total // np.maximum(of, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    return only(docs, doc_id="long", text="string").mapInArrow(lean(run), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, words: int = WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of ``docs`` (doc_id, text); ``rank`` is null where it is not drawn."""
    spark = docs.sparkSession
    gain = gains(counts(docs, words, buckets), counts(target, words, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(share)))
    rows = keep(weighed(docs, gain, words).withColumn("score", F.col("weight") + noise))
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    most = percent * rows.where(F.col("n_words") >= least_words).count() // 100
    have = rows.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    score, n = have["score"].to_numpy(), have["n"].to_numpy()
    before = np.cumsum(n) - n
    named = ["doc_id", "n_features", "weight", "score"]
    some = int(np.searchsorted(before, most))  # scores that rank at all
    if not some:
        return rows.select(*named, F.lit(None).cast("long").alias("rank"))
    ahead = spark.createDataFrame(pa.table({"score": score[:some], "before": before[:some]}))
    in_draw = F.coalesce(able & (F.col("score") >= int(score[some - 1])), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features")) + F.col("before")
    # at most one row for each possible score
    drawn = rows.where(in_draw).join(F.broadcast(ahead), "score").select(*named, place.cast("long").alias("rank"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return drawn.unionAll(rows.where(~in_draw).select(*named, F.lit(None).cast("long").alias("rank")))
