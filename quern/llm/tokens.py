"""Token counts of whole texts by compiled transducers (see :mod:`transducer`), as the tokenizer library would give them.

The driver reads the vocabulary file and sends its entries and merges (their size is the file's); each worker compiles them once and
keeps the transitions it has met for its next tasks. A pass over the texts is all there is: no shuffle, and no token is ever written.

Defined cases: null counts as empty, with 0 bytes and 0 tokens; special tokens' strings inside texts are one token each, as is
the library's default; rows without doc_id and repeated rows are counted each by itself; an empty table gives no rows; other columns
play no part.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textnum
from .common import lean, only, workers
from .transducer import Counter, load

LIMIT = 1024

_compiled: dict[str, Counter] = {}


def _counter(name: str, vocabulary) -> Counter:
    """The worker's compiled vocabulary; one is kept."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Counter(pickle.loads(vocabulary.value))
    return _compiled[name]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of ``docs`` (doc_id, text), by the tokenizer file at ``path``."""
    spark = docs.sparkSession
    workers(spark)
    data = pickle.dumps(load(path))
    name, vocabulary = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(name, vocabulary)
        for whole in batches:
            for b in textnum.slices(whole, "text"):
                raw, at = textnum.flat(b.column("text"))
                n = counter.counts(raw, at)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, doc_id="long", text="string").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
