"""Quality and toxicity by hierarchical empirical Bayes.

A document's evidence is a logistic classifier's over a few measures of form and of its words. A word (hashed, present or
not) weighs as the log-odds of its documents' labels, shrunk toward the base rate as if by ``SHRINK`` more documents;
the classifier sees a text's largest weight, what exceeds ``STRONG`` in sum, and the mean. Sites are hosts, and paths within them. For both, evidence is summed by grouped aggregation over all documents; a host's mean is
shrunk toward the global mean, and a path's toward its host's, by as much as the method of moments finds noise in the
means of small groups. A document's posterior, of quality and of toxicity alike, adds to its own log-odds how far its path's posterior is from the
global mean, times ``SITE_WEIGHT``.

The classifier is fitted on a bounded sample, the ``SAMPLE`` labelled rows with the smallest hashes of their ids, and of each
text on its first ``SAMPLE_CHARS`` characters; all else covers all documents and whole texts.

Defined cases: null and empty texts have the evidence of no words, and are not kept (score 0, toxic 0); null hosts or
paths are groups of their own; rows with repeated ids count each; labels that contradict each other count each; with no
labels the evidence is one half everywhere; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import drop, keep, lean, only, workers

SAMPLE = 5000
SAMPLE_CHARS = 100_000  # of a text that is learned from
BUCKETS = 1 << 18
MEASURES = 7
SHRINK, STRONG, RIDGE, NEWTON = 10.0, 1.5, 1.0, 25
SITE_WEIGHT = 0.5
SLICE = 1 << 20
TARGETS = ("quality", "toxic")

_PUNCT = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
_MARKS = np.array([chr(b) in "#$%&*|<>{}[]\\^_~=@" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


def evidence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each row's distinct words, where each row's start, measures of form by row)."""
    number, at = textnum.words(texts, textnum.ALNUM)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = np.unique((row.astype(np.int64) << 18) | (number >> textnum.U(46)).astype(np.int64))
    starts = np.searchsorted(pair, np.arange(len(at)) << 18)
    raw, edge = textnum.flat(texts)
    sums = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark)])[edge])
    size, space, words = np.diff(edge), sums(_SPACE[raw]), np.diff(at)
    solid = np.maximum(size - space, 1)
    form = [sums(_PUNCT[raw]) / solid, sums(_MARKS[raw]) / solid, sums(_UPPER[raw]) / solid, sums(_DIGIT[raw]) / solid, np.log1p(words) / 10, solid / np.maximum(words, 1) / 20, np.diff(starts) / np.maximum(words, 1)]
    return pair & (BUCKETS - 1), starts, np.stack(form, 1)


def _weights(with_: np.ndarray, all_: np.ndarray, base: float) -> np.ndarray:
    """Shrunk log-odds of words in ``all_`` documents, ``with_`` of them of the class, less the base rate's."""
    return np.log((with_ + SHRINK * base) / (all_ - with_ + SHRINK * (1 - base))) - np.log(base / (1 - base))


def _by_word(weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, 3): the largest weight of each row's words, the sum of what exceeds STRONG, and the mean."""
    run = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])
    count, full = np.diff(starts), np.flatnonzero(np.diff(starts))
    top = np.zeros(len(count))
    if len(full):
        top[full] = np.maximum.reduceat(weight, starts[:-1][full])
    return np.stack([top, np.minimum(run(np.maximum(weight - STRONG, 0)), 20), run(weight) / np.maximum(count, 1)], 1)


@dataclass
class Model:
    words: np.ndarray  # (BUCKETS, targets): weights
    beta: np.ndarray  # (targets, features)
    mean: np.ndarray  # of the measures of form
    scale: np.ndarray

    def rows(self, form: np.ndarray, by_word: np.ndarray) -> np.ndarray:
        z = np.clip((form - self.mean) / self.scale, -4, 4)
        return np.concatenate([z, z * z, by_word, np.ones((len(z), 1))], 1)

    def odds(self, bucket: np.ndarray, starts: np.ndarray, form: np.ndarray) -> np.ndarray:
        """(rows, targets): log-odds."""
        return np.stack([self.rows(form, _by_word(self.words[bucket, t], starts)) @ b for t, b in enumerate(self.beta)], 1)


def fit(bucket: np.ndarray, starts: np.ndarray, form: np.ndarray, target: np.ndarray) -> Model:
    """Word weights from counts, then Newton's method on the logistic loss of ``target`` (rows, targets; each 0 or 1).

    While fitting, a text's own label is left out of its words' weights.
    """
    n, k = target.shape
    model = Model(np.zeros((BUCKETS, k)), np.zeros((k, 2 * MEASURES + 4)), form.mean(0) if n else np.zeros(MEASURES), form.std(0) + 1e-3 if n else np.ones(MEASURES))
    if not n:
        return model
    row, all_ = np.repeat(np.arange(n), np.diff(starts)), np.bincount(bucket, minlength=BUCKETS)
    for t in range(k):
        y = target[:, t]
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        with_ = np.bincount(bucket, y[row], BUCKETS)
        model.words[:, t] = _weights(with_, all_, base)
        x = model.rows(form, _by_word(_weights(with_[bucket] - y[row], all_[bucket] - 1, base), starts))
        beta = model.beta[t]
        for _ in range(NEWTON):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(beta))
            step = np.linalg.solve(hess, x.T @ (y - p) - RIDGE * beta)
            beta += step / max(1.0, np.abs(step).max() / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on the labelled rows with the smallest hashes of their ids, ``sample`` at most."""
    picked = labels.where("doc_id is not null and quality is not null and toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", "toxic").limit(sample).collect()
    truth: dict[int, list] = {}
    for r in picked:
        truth.setdefault(r["doc_id"], []).append((int(r["quality"] > 0), int(r["toxic"] > 0)))
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(list(truth), np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for whole in batches:
            got = whole.column("doc_id").fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
            spot = np.minimum(np.searchsorted(ids, got), max(len(ids) - 1, 0))
            chosen = whole.filter(pa.array(ids[spot] == got if len(ids) else np.zeros(len(got), bool)))
            for b in textnum.slices(chosen, "text", SLICE):
                bucket, starts, form = evidence(b.column("text"))
                words = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(bucket.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), words, pa.array(list(form))], names=["doc_id", "words", "form"])

    excerpts = docs.where("text is not null").select("doc_id", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    rows = excerpts.mapInArrow(lean(run), "doc_id long, words array<int>, form array<double>")
    words, form, target = [np.zeros(0, np.int32)], [], []
    for r in sorted(((r["doc_id"], np.array(r["words"], np.int32), r["form"]) for r in rows.toLocalIterator()), key=lambda r: (r[0], len(r[1]), r[2])):
        for pair in truth[r[0]]:
            words.append(r[1])
            form.append(r[2])
            target.append(pair)
    starts = np.cumsum([0, *map(len, words[1:])])
    shared.destroy()
    return fit(np.concatenate(words), starts, np.array(form, float).reshape(-1, MEASURES), np.array(target, float).reshape(-1, len(TARGETS)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path, and the classifier's log-odds for each row of ``docs`` (doc_id, text, host, path)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in textnum.slices(whole, "text", SLICE):
                bucket, starts, form = evidence(b.column("text"))
                odds = shared.value.odds(bucket, starts, form)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), b.column("path"), pa.array(odds[:, 0]), pa.array(odds[:, 1]), pa.array(np.diff(starts) == 0)], names=["doc_id", "host", "path", "quality_odds", "toxic_odds", "empty"])

    return docs.select("doc_id", "text", "host", "path").mapInArrow(lean(run), "doc_id long, host string, path string, quality_odds double, toxic_odds double, empty boolean")


def _probability(odds):
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def _log_odds(p):
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def shrunk(groups: DataFrame, name: str, prior) -> DataFrame:
    """``groups`` (n, sum_<t>, square_<t> for each target) with <name>_<t>, each mean shrunk toward ``prior(t)``.

    The method of moments over all groups: the variance within groups, s2, and of the true means, t2, which is the
    squared distance of group means from their priors beyond what s2 explains. A mean of n documents counts
    n / (n + s2 / t2).
    """
    n, moments = F.col("n"), []
    for t in TARGETS:
        m = F.col(f"sum_{t}") / n
        moments.append((F.sum(F.col(f"square_{t}") - n * m * m) / F.greatest(F.sum(n - 1), F.lit(1))).alias(f"s2_{t}"))
        moments.append((F.sum(n * (m - prior(t)) ** 2) / F.sum(n)).alias(f"d2_{t}"))
    got = groups.agg(*moments, F.count("*").alias("groups"), F.sum("n").alias("rows")).first()
    for t in TARGETS:
        s2 = max(got[f"s2_{t}"] or 0.0, 1e-9)
        t2 = max((got[f"d2_{t}"] or 0.0) - s2 * (got["groups"] or 0) / max(got["rows"] or 1, 1), 1e-9)
        groups = groups.withColumn(f"{name}_{t}", (F.col(f"sum_{t}") + F.lit(s2 / t2) * prior(t)) / (n + F.lit(s2 / t2)))
    return groups


def posteriors(scored: DataFrame) -> DataFrame:
    """host, path, and path_<t>, host_<t> for each target: one row per path, as a written table."""
    p = {t: _probability(F.col(f"{t}_odds")) for t in TARGETS}
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p[t]).alias(f"sum_{t}") for t in TARGETS], *[F.sum(p[t] * p[t]).alias(f"square_{t}") for t in TARGETS])
    paths = keep(paths)
    sums = [c for c in paths.columns if c not in ("host", "path")]
    by_host = hosts = keep(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in sums]))
    total = hosts.agg(*[F.sum(c).alias(c) for c in sums]).first()
    mean = {t: (total[f"sum_{t}"] or 0.5) / (total["n"] or 1) for t in TARGETS}
    hosts = shrunk(hosts, "host", lambda t: F.lit(mean[t])).select("host", *[f"host_{t}" for t in TARGETS]).withColumnRenamed("host", "h")
    both = keep(paths.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").drop("h"))
    out = shrunk(both, "path", lambda t: F.col(f"host_{t}")).select("host", "path", *[f"{a}_{t}" for t in TARGETS for a in ("host", "path")], *[F.lit(mean[t]).alias(f"all_{t}") for t in TARGETS])
    out = keep(out)
    drop(paths, by_host, both)
    return out


def judge(docs: DataFrame, labels: DataFrame, host, path) -> DataFrame:
    """doc_id, evidence, host_quality, path_quality, quality, toxic, path_toxic, kept for each row of ``docs``.

    ``host`` and ``path``: columns of ``docs`` that name a document's site and the part of it.
    """
    workers(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    model = train(docs, only(labels, doc_id="long", quality="int", toxic="int"))
    scored = keep(score(docs, model))
    sites = posteriors(scored).withColumnRenamed("host", "h").withColumnRenamed("path", "p")
    known = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    for t in TARGETS:
        both = _probability(F.col(f"{t}_odds") + SITE_WEIGHT * (_log_odds(F.col(f"path_{t}")) - _log_odds(F.col(f"all_{t}"))))
        known = known.withColumn(t, F.when(F.col("empty"), 0.0).otherwise(both))
    return known.select("doc_id", _probability(F.col("quality_odds")).alias("evidence"), "host_quality", "path_quality", "quality", "toxic", "path_toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("kept"))
