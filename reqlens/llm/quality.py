"""Quality classifier: hashed word n-gram logistic regression.

Words are runs of letters, digits and non-ASCII characters, or runs of
punctuation. Features are the hashes of single words and of neighbouring pairs
(a word followed by itself has one common feature), taken modulo
``2**feature_bits``; each distinct one has the value 1/sqrt(number of distinct
features). Training runs follow-the-regularised-leader (FTRL-proximal) updates,
one document at a time, over a sample of at most ``max_training_rows`` labelled
rows, chosen and ordered by a hash of their id. Scoring is one sparse dot
product per text, in one pass over the documents without a shuffle; the
broadcast weights have a fixed size (4 bytes times ``2**feature_bits``).

Defined results: a null or empty text has no feature and gets the score of the
bias. Null labels, ids and texts are never trained on. Without training rows, or
with one class only, the weights stay 0 and the bias gives the smoothed share
of label 1. A document with several labels trains on each of them. Empty tables
give empty results; other columns of the documents are kept unless named like a
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.textscan import ALNUM, LOWER, NOT_SPACE, Words, mix, slices
from reqlens.llm.util import clash_free, free_name, frugal

_KIND = np.where(ALNUM[LOWER], 1, 2).astype(np.uint8)
_PAIR = np.uint64(0xA24BAED4963EE407)
_SAME = np.uint64(0x9FB21C651E98DF25)


#: text bytes whose features are made at once (some 100 bytes of memory each)
SLICE = 1 << 18


@dataclass(frozen=True)
class Settings:
    feature_bits: int = 18
    #: bound of the training sample
    max_training_rows: int = 20_000
    epochs: int = 8
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4


def _features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text offsets): the distinct features of each text, sorted."""
    w = Words(column, NOT_SPACE, lower=False, runs_of=_KIND)
    n = len(w.count)
    h = w.hashes()
    doc = w.text_of()
    shift = np.uint64(64 - bits)
    keys = [(doc.astype(np.uint64) << np.uint64(bits)) | (mix(h ^ _SAME) >> shift)]
    if len(h) > 1:
        together = doc[:-1] == doc[1:]
        pair = np.where(h[:-1] == h[1:], _SAME, h[:-1] * _PAIR + h[1:])
        keys.append(((doc[:-1].astype(np.uint64) << np.uint64(bits)) | (mix(pair) >> shift))[together])
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    ends = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(bits))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), ends


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def _ftrl(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL."""
    size = (1 << s.feature_bits) + 1  # the last coordinate is the bias
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in rows)
    prior = math.log((positive + 1.0) / (len(rows) - positive + 1.0))

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= s.l1, 0.0,
                        -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    if 0 < positive < len(rows):
        for _ in range(s.epochs):
            for features, y in rows:
                i = np.append(features, size - 1)
                x = np.full(len(i), 1.0 / math.sqrt(max(len(features), 1)))
                x[-1] = 1.0
                w = weights(i)
                g = (_sigmoid(prior + float(w @ x)) - y) * x
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha
                z[i] += g - sigma * w
                n[i] += g * g
    w = weights(np.arange(size))
    return w[:-1].astype(np.float32), prior + float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id",
          text: str = "text", label: str = "quality", usable=None) -> tuple[np.ndarray, float]:
    """(weights, bias) learned from the labelled rows for which the condition
    ``usable`` (a column over the id) holds. The sample goes through one task
    and has at most ``max_training_rows`` rows; the documents are joined to its
    ids, so their texts aren't sorted or moved beyond that join."""
    s = settings
    labelled = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")) \
        .where("id is not null and y in (0, 1)")
    if usable is not None:
        labelled = labelled.where(usable("id"))
    sample = labelled.distinct().orderBy(F.xxhash64("id"), "id", "y").limit(s.max_training_rows)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null") \
        .join(F.broadcast(sample), "id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                f, ends = _features(part.column("text"), s.feature_bits)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("y").cast(pa.int32()),
                     pa.array([f[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())],
                    ["id", "y", "f"])

    kind = rows.schema["id"].dataType
    encoded = rows.mapInArrow(frugal(encode), T.StructType([T.StructField("id", kind), T.StructField("y", T.IntegerType()),
                                                    T.StructField("f", T.BinaryType())]))

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("o")), kind="stable")
        y, f = table.column("y").to_pylist(), table.column("f").to_pylist()
        w, bias = _ftrl([(np.frombuffer(f[i], np.int32).astype(np.int64), y[i]) for i in order], s)
        return pa.table({"w": pa.array([w.tobytes()], pa.binary()), "bias": pa.array([bias], pa.float64())})

    # a group of its own holds the bounded sample
    ordered = encoded.withColumn("o", F.xxhash64("id", "y", "f")).withColumn("all", F.lit(0))
    got = ordered.groupBy("all").applyInArrow(fit, "w binary, bias double").collect()
    if not got:
        return np.zeros(1 << s.feature_bits, np.float32), 0.0
    return np.frombuffer(got[0]["w"], np.float32), got[0]["bias"]


@clash_free(lambda a: [a["result"]])
def score(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(),
          text: str = "text", result: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1 of every whole text."""
    bits = settings.feature_bits
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != result]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for batch in batches:
            for part in slices(batch, text, SLICE):
                f, ends = _features(part.column(text), bits)
                sums = np.concatenate(([0.0], np.cumsum(w[f].astype(np.float64))))
                n = np.diff(ends)
                z = bias + (sums[ends[1:]] - sums[ends[:-1]]) / np.sqrt(np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_sigmoid(z))],
                                                 [*part.schema.names, result])

    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(result, T.DoubleType())])
    return docs.select(*kept).mapInArrow(frugal(run), schema)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3,
              settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents scored at least ``threshold``, with their columns as they are."""
    name = free_name(docs, "quality_score")
    return score(docs, model, settings, text, name).where(F.col(name) >= threshold).drop(name)
