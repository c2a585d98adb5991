"""Plug-in scoring surface (M6, M8, A4): any user model applied in Arrow batches.

Two contracts. ``score_with`` hands whole texts to a scorer, which returns a loss and
a token count each. ``token_losses`` hands padded batches of ids with their
attention mask and labels (-100 where there is none) to a scorer, which returns a loss (or logits) for every position; a
task reads a bounded number of samples ahead, orders them by length and cuts them into
batches of about ``batch_tokens`` padded positions, across requests and stride passes, so little is padding.
``score_masked_with`` and ``score_causal_with`` build the samples (T6, T10) and
take the losses to scores (F4, A18, A3) with DataFrame functions.

The scorer is made once a task (a model is loaded there). The wall time of a batch
is spread over its samples (``time_taken``), as the per-sample timing log does.
GPU placement, if any, is the user's (Spark resource profiles).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.functions.logits import token_nll
from reqlens.operators.tokens import IGNORE_LABEL, stride_expand, stride_ids

OUTPUT_SCHEMA = ("original_index long, loss double, perplexity double, tokens_count long, "
                 "time_taken double")

Scorer = Callable[[list], tuple]
#: (ids, attention mask, labels), all (samples, width) -> losses (samples, width) or logits (samples, width, vocabulary)
TokenScorer = Callable[..., object]

#: samples that a task reads ahead
READ_AHEAD = 1024


def timing_sum(timings: DataFrame) -> DataFrame:
    """A4/M8: time and token count summed per sample."""
    return timings.groupBy("original_index").agg(
        F.sum("time_taken").alias("time_taken"), F.sum("tokens_count").cast("long").alias("tokens_count"))


def score_with(df: DataFrame, make_scorer: Callable[[], Scorer], text_col: str = "request") -> DataFrame:
    """``(original_index, loss, perplexity, tokens_count, time_taken)`` of every text."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scorer = make_scorer()
        for b in batches:
            t0 = time.perf_counter()
            texts = b.column(text_col).to_pylist()
            loss, ntok = scorer(texts)
            loss = np.asarray(loss, dtype="float64")
            dt = (time.perf_counter() - t0) / max(len(texts), 1)
            yield pa.RecordBatch.from_arrays(
                [b.column("original_index").cast(pa.int64()), pa.array(loss), pa.array(np.exp(loss)),
                 pa.array(np.asarray(ntok, dtype="int64")), pa.array(np.full(len(texts), dt))],
                names=["original_index", "loss", "perplexity", "tokens_count", "time_taken"])

    return df.select("original_index", text_col).mapInArrow(run, OUTPUT_SCHEMA)


def batch_plan(lengths: list[int], batch_tokens: int) -> list[list[int]]:
    """Sample numbers in batches whose padded size is about ``batch_tokens``,
    similar lengths together; a longer sample is a batch of its own."""
    out: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        if out and (len(out[-1]) + 1) * lengths[i] <= batch_tokens:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def token_losses(samples: DataFrame, make_scorer: Callable[[], TokenScorer], keys: list[str], output: str = "loss",
                 batch_tokens: int = 16_384, pad_id: int = 0, sums: bool = False) -> DataFrame:
    """``(keys, labels, values, tokens_count, time_taken)``: samples hold ``keys``,
    ``input_ids`` and ``labels``; ``values`` has the scorer's loss (or logits) for each position.
    Samples without ids don't reach the scorer and have no values. With ``sums``, only the sum of the
    losses at labelled positions and their number (``loss_sum``, ``n_labels``) leave the task."""
    if output not in ("loss", "logits") or (sums and output != "loss"):
        raise ValueError(f"unknown output {output!r}")
    kind = T.ArrayType(T.DoubleType()) if output == "loss" else T.ArrayType(T.ArrayType(T.FloatType()))
    own = [T.StructField("loss_sum", T.DoubleType()), T.StructField("n_labels", T.LongType())] if sums else \
        [T.StructField("labels", T.ArrayType(T.IntegerType())), T.StructField("values", kind)]
    schema = T.StructType([*(samples.schema[k] for k in keys), *own, T.StructField("tokens_count", T.LongType()), T.StructField("time_taken", T.DoubleType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        scorer = make_scorer()

        def scored(table: pa.Table) -> pa.RecordBatch:
            lists = table.column("input_ids").combine_chunks()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            start = np.cumsum(size) - size
            ids, wanted = (c.flatten().to_numpy(zero_copy_only=False) for c in (lists, table.column("labels").combine_chunks()))
            values, seconds = None, np.zeros(len(size))
            for own in batch_plan(size.tolist(), batch_tokens):
                own = np.array([i for i in own if size[i]], np.int64)
                if not len(own):
                    continue
                width = int(size[own].max())
                inside = np.arange(width) < size[own][:, None]
                at = (start[own][:, None] + np.arange(width))[inside]  # the samples' places among all ids
                block, mask = np.full(inside.shape, pad_id, np.int64), inside.astype(np.int64)
                target = np.full(inside.shape, IGNORE_LABEL, np.int64)
                block[inside], target[inside] = ids[at], wanted[at]
                t0 = time.perf_counter()
                found = np.asarray(scorer(block, mask, target))
                seconds[own] = (time.perf_counter() - t0) / len(own)
                if values is None:
                    values = np.zeros((len(ids), *found.shape[2:]), np.float64 if output == "loss" else np.float32)
                values[at] = found[inside]
            if values is None:
                values = np.zeros((0,) if output == "loss" else (0, 0))
            counts = [pa.array(size), pa.array(seconds)]
            columns = [table.column(k).combine_chunks() for k in keys]
            if sums:
                row, counted = np.repeat(np.arange(len(size)), size), wanted != IGNORE_LABEL
                own = [pa.array(np.bincount(row[counted], values[counted], len(size)).astype(np.float64)), pa.array(np.bincount(row[counted], minlength=len(size)))]
                return pa.RecordBatch.from_arrays([*columns, *own, *counts], names=[*keys, "loss_sum", "n_labels", "tokens_count", "time_taken"])
            flat = pa.array(values, pa.float64()) if output == "loss" else pa.ListArray.from_arrays(
                pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel().astype(np.float32)))
            ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([*columns, table.column("labels").combine_chunks(), pa.ListArray.from_arrays(ends, flat), *counts],
                                              names=[*keys, "labels", "values", "tokens_count", "time_taken"])

        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, READ_AHEAD):
                held.append(batch.slice(at, READ_AHEAD))
                rows += held[-1].num_rows
                if rows >= READ_AHEAD:
                    yield scored(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield scored(pa.Table.from_batches(held))

    return samples.select(*keys, F.col("input_ids").cast("array<int>").alias("input_ids"), F.col("labels").cast("array<int>").alias("labels")) \
        .mapInArrow(run, schema)


def labelled_nll(found: DataFrame, keys: list[str], output: str = "loss") -> DataFrame:
    """``(keys, pos, nll)`` of the positions that have a label; from logits by
    cross entropy."""
    rows = found.select(*keys, F.posexplode(F.arrays_zip(F.col("labels").alias("label"), F.col("values").alias("value"))).alias("pos", "x")) \
        .filter(F.col("x.label") != IGNORE_LABEL)
    nll = F.col("x.value") if output == "loss" else token_nll(F.col("x.value"), F.col("x.label"))
    return rows.select(*keys, "pos", nll.alias("nll"))


def _labelled_sums(samples: DataFrame, make_scorer: Callable[[], TokenScorer], keys: list[str], output: str, batch_tokens: int) -> DataFrame:
    """``(keys, loss_sum, n_labels, tokens_count, time_taken)``: the losses at labelled positions summed."""
    found = token_losses(samples, make_scorer, keys, output, batch_tokens, sums=output == "loss")
    if output == "loss":
        return found
    hit = F.filter(F.arrays_zip(F.col("labels").alias("label"), F.col("values").alias("value")), lambda x: x["label"] != IGNORE_LABEL)
    nll = F.transform(hit, lambda x: token_nll(x["value"], x["label"]))
    return found.select(*keys, F.aggregate(nll, F.lit(0.0), lambda a, x: a + x).alias("loss_sum"), F.size(nll).alias("n_labels"), "tokens_count", "time_taken")


def score_masked_with(df: DataFrame, make_scorer: Callable[[], TokenScorer], stride: int = 5, output: str = "loss",
                      batch_tokens: int = 16_384) -> DataFrame:
    """M2 with a plug-in: ``df`` holds (original_index, ids), ids without sentinels,
    the first at position 1. Pass ``shift`` masks the positions ``pos % stride = shift``;
    losses are read where the label isn't -100, a pass without one counts as loss 0."""
    passes = stride_expand(df.select("original_index", "ids"), stride)
    masked, labels = stride_ids(F.col("ids"), stride, F.col("shift_index"))
    samples = passes.select("original_index", "shift_index", masked.alias("input_ids"), labels.alias("labels"))
    keys = ["original_index", "shift_index"]
    found = _labelled_sums(samples, make_scorer, keys, output, batch_tokens)
    loss = F.when(F.col("n_labels") > 0, F.col("loss_sum") / F.col("n_labels")).otherwise(F.lit(0.0))
    per = found.select(*keys, loss.alias("loss"), "tokens_count", "time_taken")
    return per.groupBy("original_index").agg(F.avg("loss").alias("loss"), F.avg(F.exp("loss")).alias("perplexity"),
                                             F.sum("tokens_count").alias("tokens_count"), F.sum("time_taken").alias("time_taken"))


def score_causal_with(df: DataFrame, make_scorer: Callable[[], TokenScorer], output: str = "loss", batch_tokens: int = 16_384) -> DataFrame:
    """M3 with a plug-in: the scorer's value at a position is for that position's
    token given the ones before it; the first token has no label."""
    from reqlens.operators.lm import CAUSAL_EPS
    labels = F.transform("ids", lambda x, i: F.when(i == 0, F.lit(IGNORE_LABEL)).otherwise(x))
    found = _labelled_sums(df.select("original_index", F.col("ids").alias("input_ids"), labels.alias("labels")), make_scorer,
                           ["original_index"], output, batch_tokens)
    loss = F.col("loss_sum") / (F.col("n_labels") + F.lit(CAUSAL_EPS))
    return found.select("original_index", loss.alias("loss"), F.exp(loss).alias("perplexity"), "tokens_count", "time_taken")


def char_class_scorer() -> Scorer:
    """Demo scorer: entropy (nats) of the character classes of each text
    (letter, digit, space, punctuation, other) and its regex token count."""
    import re

    import numpy as np

    token_re = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")

    def classes(t: str) -> np.ndarray:
        a = np.frombuffer(t.encode("utf-32-le"), dtype="<u4") if t else np.zeros(0, dtype="<u4")
        letter = ((a >= 65) & (a <= 90)) | ((a >= 97) & (a <= 122))
        digit = (a >= 48) & (a <= 57)
        space = (a == 32) | ((a >= 9) & (a <= 13))
        punct = (a < 128) & ~letter & ~digit & ~space
        return np.array([letter.sum(), digit.sum(), space.sum(), punct.sum(), (a >= 128).sum()], dtype="float64")

    def score(texts: list) -> tuple:
        losses, counts = [], []
        for t in texts:
            t = t or ""
            c = classes(t)
            p = c[c > 0] / c.sum() if c.sum() else np.zeros(0)
            losses.append(float(-(p * np.log(p)).sum()) if len(p) else 0.0)
            counts.append(len(token_re.findall(t)))
        return losses, counts

    return score
