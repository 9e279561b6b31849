"""Language identification of code-switched text by a linear-chain conditional random field.

Words (runs of letters, lower-cased) are labelled with languages. A word's features are its prefixes and suffixes (the
n-grams that touch its border), its inner n-grams of one to four letters, and the whole word, which is the lexicon:
each is a row of weights in a table of ``BUCKETS`` rows, learned together with the transitions between languages. Labels'
posteriors come from forward-backward over the whole text, however long, as one chain (training takes sequences of ``STEPS``
words); :func:`label_words` gives each word's. A text's language is the one with the largest sum of
posteriors over all its words, its score that sum's share. How ``sure`` a text's words are is the mean over them of each
one's largest posterior, so a text that switches between any number of languages is as sure as its words.

Training: on at most ``SAMPLE`` labelled documents of each language (those with the smallest hashes of their ids, whatever
their lengths), of each an excerpt of ``SAMPLE_CHARS`` characters from its first letter on, spliced into sequences that
switch between documents and so between languages.
The fit takes a fixed number of steps over at most ``SEQUENCES`` sequences. Prediction covers all documents and their
whole texts.

Defined cases: null and letterless texts are ``und`` with score 0; repeated rows get the same answer; if there is no
labelled text to learn from, all is ``und``; ties go to the language that sorts first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum
from .common import lean, numbered, only, workers

UNKNOWN = "und"
ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 17
STEPS = 64
FEW_LABELS = 16
SAMPLE = 150
SAMPLE_CHARS = 8_000
SEQUENCES = 2_400
EPOCHS, BATCH, RATE, DECAY = 6, 100, 0.15, 1e-4
MOST_LABELS = 500
ABOVE_CHANCE = 1.2
SLICE = 1 << 19

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For each code point: its lower case (0 where it is no letter)."""
    global _letter
    if _letter is None:
        low = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low[c] = ord(t) if len(t := s.lower()) == 1 else c
        _letter = low
    return _letter


class Features:
    """Words of some texts: places and letters; rows of weights for their n-grams are made order by order.

    N-grams are of the letters with one border sign on either side; a word of n letters has n + 3 - k of order k > 1.
    """

    def __init__(self, texts: list[str | None]):
        joined = "\n".join(t or "" for t in texts)
        code = _letters()[np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)]
        code = np.concatenate([np.zeros(1, np.int32), code, np.zeros(max(ORDERS), np.int32)])
        step = np.diff((code > 0).astype(np.int8))
        self.first, self.last = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1
        size = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        self.at = np.searchsorted(self.first - 1, np.concatenate([[0], np.cumsum(size)]))  # each text's first word, and the count behind
        self.wide = code.astype(textnum.U) + textnum.U(1)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the n-grams of order k, where each word's start)."""
        length = self.last - self.first
        n = np.maximum(length + 3 - k, 0) if k > 1 else length
        start = np.cumsum(n) - n
        place = np.repeat(self.first - (k > 1) - start, n) + np.arange(int(n.sum()))
        h = np.full(len(place), k, textnum.U)
        for j in range(k):
            h = (h + self.wide[place + j]) * textnum.U(0x9E3779B97F4A7C15)
            h ^= h >> textnum.U(29)
        return (h >> textnum.U(64 - 17)).astype(np.int32), start

    def words(self) -> np.ndarray:
        """The row of each whole word."""
        total = np.concatenate([np.zeros(1, textnum.U), np.cumsum(self.wide * textnum._pow(textnum._BASE, len(self.wide)))])
        whole = textnum.mix((total[self.last] - total[self.first]) * textnum._pow(textnum._INV, len(self.wide))[self.first])
        return (whole >> textnum.U(64 - 17)).astype(np.int32)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    start: np.ndarray
    change: np.ndarray  # (from, to)


def emissions(f: Features, weights: np.ndarray) -> np.ndarray:
    """(words, labels): the sum of each word's rows of weights."""
    out = weights[f.words()]
    for k in ORDERS:
        rows, start = f.grams(k)
        for c in range(weights.shape[1]):
            run = np.zeros(len(rows) + 1)
            np.cumsum(weights[rows, c], out=run[1:])
            out[:, c] += run[np.append(start[1:], len(rows))] - run[start] if len(start) else 0
    return out


def forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors (sequences, steps, labels), expected transitions (from, to) and log-likelihood terms.

    ``e``: potentials (exponentials, each step's largest 1); ``length`` in descending order.
    """
    n, steps, k = e.shape
    move, forward, backward, scale = np.exp(change), np.zeros_like(e), np.zeros_like(e), np.ones((n, steps))
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(steps)]  # sequences longer than t
    for t in range(steps):
        m = live[t]
        if not m:
            break
        now = (np.exp(start) if t == 0 else forward[:m, t - 1] @ move) * e[:m, t]
        scale[:m, t] = now.sum(1)
        forward[:m, t] = now / scale[:m, t, None]
    expected = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        m, next_ = live[t], live[t + 1] if t + 1 < steps else 0
        backward[next_:m, t] = 1
        if next_:
            right = e[:next_, t + 1] * backward[:next_, t + 1] / scale[:next_, t + 1, None]
            backward[:next_, t] = right @ move.T
            expected += (forward[:next_, t].T @ right) * move
    return forward * backward, expected, np.log(scale)


def _potentials(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(-1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def chains(e: np.ndarray, count: np.ndarray, start: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Posteriors (words, labels) of chains of ``count`` words each, one behind the other in ``e`` (potentials).

    Chains are cut into runs of at most STEPS words (of any length for more than FEW_LABELS labels). A run is one matrix,
    from the labels before it to those at its end; messages go from run to run along each chain with those, and then
    through all runs at once, so a long chain does not hold up the rest, and nothing is lost at the cuts.
    """
    if not len(e):
        return np.zeros_like(e)
    k, move = e.shape[1], np.exp(change)
    size = STEPS if k <= FEW_LABELS else max(1, int(count.max()))
    runs = -(-count // size)  # of each chain
    chain = np.repeat(np.arange(len(count)), runs)
    turn = np.arange(len(chain)) - np.repeat(np.cumsum(runs) - runs, runs)  # which of its chain's
    first = (np.cumsum(count) - count)[chain] + turn * size
    length = np.minimum(count[chain] - turn * size, size)
    order = np.argsort(-length, kind="stable")  # the longest first, so that those that go on stand in front
    first, length, chain, turn = first[order], length[order], chain[order], turn[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length[0]))]  # runs of more than t words
    # into each run: the message from before it (along the chain), and from behind it
    ahead, behind = np.ones((len(chain), k)), np.ones((len(chain), k))
    if runs.max() > 1:
        # a chain's first run has no move before it: its matrix is from the labels of its first word
        whole = np.where((turn == 0)[:, None, None], np.eye(k), move) * e[first][:, None]
        for t, m in enumerate(live[1:], 1):
            step = (whole[:m].reshape(-1, k) @ move).reshape(m, k, k) * e[first[:m] + t][:, None]
            whole[:m] = step / step.sum((1, 2), keepdims=True)
        opened = np.broadcast_to(np.exp(start), (len(chain), k))
        table = np.full((len(count), int(runs.max())), -1)
        table[chain, turn] = np.arange(len(chain))
        for r in range(1, int(runs.max())):
            now = table[:, r][table[:, r] >= 0]
            before = table[chain[now], r - 1]
            into = opened[before] if r == 1 else ahead[before]
            ahead[now] = _scaled(np.einsum("ij,ijk->ik", into, whole[before]))
        for r in range(int(runs.max()) - 2, -1, -1):
            now = table[:, r]
            now = now[(now >= 0) & (table[:, r + 1] >= 0)]
            after = table[chain[now], r + 1]
            behind[now] = _scaled(np.einsum("ijk,ik->ij", whole[after], behind[after]))
    forward = np.empty_like(e)
    now = np.where((turn == 0)[:, None], np.exp(start), ahead @ move) * e[first]
    forward[first] = _scaled(now)
    for t, m in enumerate(live[1:], 1):
        at = first[:m] + t
        forward[at] = _scaled((forward[at - 1] @ move) * e[at])
    out = np.empty_like(e)
    backward = behind
    for t in range(len(live) - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        out[at] = _scaled(forward[at] * backward[:m])
        if t:
            backward[:m] = _scaled((e[at] * backward[:m]) @ move.T)
    return out


def posteriors(f: Features, model: Model) -> np.ndarray:
    """(words, labels) for all words of the texts, each text one chain."""
    return chains(_potentials(emissions(f, model.weights)), np.diff(f.at), model.start, model.change)


def _sequences(texts: list[str], label: np.ndarray, n: int, seed: int) -> tuple[Features, np.ndarray, np.ndarray]:
    """Features, and word places and labels of spliced sequences: one to three stretches of different documents."""
    f = Features(texts)
    draw = np.random.default_rng(seed)
    count = np.diff(f.at)
    by = [np.flatnonzero((label == k) & (count > 0)) for k in range(label.max() + 1)]
    by = [b for b in by if len(b)]
    place, gold = np.zeros((n, STEPS), np.int64), np.zeros((n, STEPS), np.int64)
    for s in range(n):
        cuts = np.sort(draw.integers(4, STEPS - 3, draw.integers(0, 3)))
        for a, b in zip([0, *cuts], [*cuts, STEPS], strict=True):
            while a < b:
                kind = by[draw.integers(len(by))]
                doc = kind[draw.integers(len(kind))]
                size = min(b - a, int(count[doc]))
                place[s, a : a + size] = f.at[doc] + draw.integers(count[doc] - size + 1) + np.arange(size)
                gold[s, a : a + size] = label[doc]
                a += size
    return f, place, gold


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """A model by AdaGrad on the log-likelihood of spliced sequences."""
    labels = sorted(set(langs))
    k = len(labels)
    model = Model(labels, np.zeros((BUCKETS, k)), np.zeros(k), np.zeros((k, k)))
    if k < 2 or not any(any(c.isalpha() for c in t) for t in texts):
        return model
    label = np.array([labels.index(x) for x in langs])
    f, place, gold = _sequences(texts, label, SEQUENCES, seed)
    every = [f.grams(o) for o in ORDERS]
    every.append((f.words(), np.arange(len(f.first))))
    every = [(rows, start, np.append(start[1:], len(rows))) for rows, start in every]
    size = [np.full((BUCKETS, k), 1e-2), np.full(k, 1e-2), np.full((k, k), 1e-2)]
    length = np.full(BATCH, STEPS)
    draw = np.random.default_rng(seed + 1)
    for _ in range(EPOCHS):
        order = draw.permutation(SEQUENCES)
        for at in range(0, SEQUENCES - BATCH + 1, BATCH):
            chosen = order[at : at + BATCH]
            word, want = place[chosen].ravel(), gold[chosen]
            found, whose = [], []
            for rows, start, end in every:
                n = end[word] - start[word]
                base = np.repeat(start[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                found.append(rows[base])
                whose.append(np.repeat(np.arange(len(word)), n))
            rows, whose = np.concatenate(found), np.concatenate(whose)
            score = np.stack([np.bincount(whose, model.weights[rows, c], len(word)) for c in range(k)], 1).reshape(BATCH, STEPS, k)
            marginal, expected, _ = forward_backward(_potentials(score), length, model.start, model.change)
            true = np.eye(k)[want]
            gap = ((true - marginal).reshape(-1, k)) / BATCH
            used, back = np.unique(rows, return_inverse=True)
            grad = np.stack([np.bincount(back, gap[whose, c], len(used)) for c in range(k)], 1) - DECAY * model.weights[used]
            size[0][used] += grad**2
            model.weights[used] += RATE * grad / np.sqrt(size[0][used])
            seen = np.zeros((k, k))
            np.add.at(seen, (want[:, :-1].ravel(), want[:, 1:].ravel()), 1)
            for g, s, p in (((true[:, 0] - marginal[:, 0]).mean(0), size[1], model.start), ((seen - expected) / BATCH, size[2], model.change)):
                s += g**2
                p += RATE * g / np.sqrt(s)
    return model


def held_out(doc_id):
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of ``docs`` (doc_id, text, lang) that are not held out."""
    usable = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~F.coalesce(held_out(docs["doc_id"]), F.lit(True)))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} languages to learn")
    if not counts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    # about twice the wanted share by hash, then the smallest hashes of each language
    space = 1 << 30
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(space, 2 * sample * space // r["count"] + space // 1000))])
    h = F.xxhash64(F.col("doc_id"))
    near = usable.withColumn("h", h).where(F.pmod("h", F.lit(space)) < share[F.col("lang")])
    rows: dict[str, list] = {r["lang"]: [] for r in counts}
    excerpt = F.substring(F.col("text"), F.greatest(F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(1)), F.lit(SAMPLE_CHARS))
    for r in near.select("lang", "h", excerpt.alias("text")).toLocalIterator():
        have = rows[r["lang"]]
        have.append((r["h"], r["text"]))
        if len(have) >= 4 * sample:
            have.sort()
            del have[sample:]
    picked = [(t, lang) for lang in sorted(rows) for _, t in sorted(rows[lang])[:sample]]
    return fit([t for t, _ in picked], [lang for _, lang in picked])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, one row for one, with ``lang_pred``, ``score`` and ``sure`` (names it must not have already) behind its
    columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    workers(docs.sparkSession)
    names = docs.columns
    out = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("sure")).schema
    schema, shared = to_arrow_schema(out), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in textnum.slices(whole, "text", SLICE):
                n, k = b.num_rows, len(m.labels)
                best, score, sure = np.full(n, -1), np.zeros(n), np.zeros(n)
                if k:
                    f = Features(b.column("text").to_pylist())
                    run_, most = np.zeros((int(f.at[-1]) + 1, k)), np.zeros(int(f.at[-1]) + 1)
                    if len(run_) > 1:
                        each = posteriors(f, m)
                        np.cumsum(each, axis=0, out=run_[1:])
                        np.cumsum(each.max(1), out=most[1:])
                        del each
                    mass, count = run_[f.at[1:]] - run_[f.at[:-1]], np.diff(f.at)
                    best = np.where(count > 0, mass.argmax(1), -1)
                    score = np.clip(np.where(count > 0, mass.max(1) / np.maximum(count, 1), 0), 0, 1)
                    sure = np.clip(np.where(count > 0, (most[f.at[1:]] - most[f.at[:-1]]) / np.maximum(count, 1), 0), 0, 1)
                lang = pa.array(np.array([*m.labels, UNKNOWN], object)[best], pa.string())
                cols = [b.column(x).cast(schema.field(i).type) for i, x in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*cols, lang, pa.array(score), pa.array(sure)], schema=schema)

    return docs.mapInArrow(lean(run), out)


_WORD = "struct<start:int,end:int,lang:string,p:double>"


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words: of each word of each row of ``docs`` (doc_id, text) in order where it starts and ends (code points,
    end exclusive), its language and that one's posterior; null texts have no words."""
    workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in textnum.slices(whole, "text", SLICE):
                texts = b.column("text").to_pylist()
                f = Features(texts)
                each = posteriors(f, m) if m.labels else np.ones((int(f.at[-1]), 1))
                best = each.argmax(1)
                begin = np.cumsum([0, *(len(t or "") + 1 for t in texts)])[:-1]
                shift = np.repeat(begin, np.diff(f.at)) + 1
                lang = np.array(m.labels or [UNKNOWN], object)[best]
                words = pa.StructArray.from_arrays([pa.array((f.first - shift).astype(np.int32)), pa.array((f.last - shift).astype(np.int32)), pa.array(lang, pa.string()), pa.array(each[np.arange(len(best)), best])], ["start", "end", "lang", "p"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(f.at.astype(np.int32)), words).cast(kind)], names=["doc_id", "words"])

    return only(docs, doc_id="long", text="string").mapInArrow(lean(run), f"doc_id long, words array<{_WORD}>")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang)."""
    docs = only(docs, doc_id="long", text="string", lang="string")
    model = train(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def known(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """``docs`` (doc_id, text, lang and others) without the texts that have no language or whose words are not sure of
    theirs: under ``least``, or ABOVE_CHANCE times what chance gives where that is less (with over four languages). Where
    there is no labelled text to learn from, all texts with a letter stay."""
    model = train(only(docs, doc_id="long", text="string", lang="string"))
    plain = numbered(docs, "text")
    if not model.labels:
        return plain.where(F.rlike("text", F.lit(r"\p{L}"))).toDF(*docs.columns)
    least = min(least, ABOVE_CHANCE / max(1, len(model.labels)))
    return predict(plain, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("sure") >= least)).select(*plain.columns).toDF(*docs.columns)
