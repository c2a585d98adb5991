"""Greedy packing of tokenised samples into fixed blocks.

Batch-local next fit: samples are taken in order, ``batch_rows`` to a batch (their
dense position comes from bucketed prefix sums, no single-task window). A batch is
one row of addresses: sample lengths are folded from the left, a sample begins
where the last one ended if it fits what is left of that block, else at the next
block. So a sample that fits a block is never split, and a longer one begins a block,
fills as many as it needs and leaves the rest of its last one to the next samples;
with ``truncate`` it is cut to one block instead, as in the source.

Only lengths are gathered by batch (a thousand numbers); the ids join their
addresses by position, are cut at block borders, and the pieces of a block are put
together. Blocks are padded with ``pad_id`` and labels ``-100``; an optional
separator follows each sample; ``n_samples`` counts the samples with tokens in a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.operators.ranking import global_position
from reqlens.operators.tokens import IGNORE_LABEL


def start_addresses(lengths: Column, block_size: int) -> Column:
    """Where each sample of a batch begins, counted in tokens from the first block."""
    size = F.lit(block_size).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))

    def place(acc: Column, n: Column) -> Column:
        used = acc["at"] % size
        begin = F.when((used == 0) | (n <= size - used), acc["at"]).otherwise(acc["at"] - used + size)
        return F.struct((begin + n).alias("at"), F.concat(acc["starts"], F.array(begin)).alias("starts"))

    return F.aggregate(lengths, start, place)["starts"]


def pack(df: DataFrame, ids_col: str = "ids", block_size: int = 4096, batch_rows: int = 1000,
         sep_id: int | None = None, pad_id: int = 0, truncate: bool = False) -> DataFrame:
    """``(batch, block, n_samples, input_ids, attention_mask, labels)``."""
    seq = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    if sep_id is not None:
        seq = F.concat(seq, F.array(F.lit(sep_id)))
    if truncate:
        seq = F.slice(seq, 1, block_size)
    samples = global_position(df.select("original_index", seq.alias("seq")), "original_index", "pos", weight=F.size("seq")) \
        .select("pos", "seq", F.floor((F.col("pos") - 1) / batch_rows).cast("long").alias("batch"))
    lengths = samples.select("batch", "pos", F.size("seq").cast("long").alias("n"))
    starts = lengths.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("s")) \
        .select(F.explode(F.arrays_zip(F.col("s.pos").alias("pos"), start_addresses(F.col("s.n"), block_size).alias("start"))).alias("z")) \
        .select("z.pos", "z.start")
    placed = samples.filter(F.size("seq") > 0).join(starts, "pos")
    first = F.floor(F.col("start") / block_size).cast("int")
    last = F.floor((F.col("start") + F.size("seq") - 1) / block_size).cast("int")
    begin = F.greatest(F.col("block") * F.lit(block_size).cast("long"), F.col("start"))
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last))) \
        .select("batch", "block", begin.alias("at"),
                F.slice("seq", (begin - F.col("start") + 1).cast("int"),
                        ((F.col("block") + 1) * F.lit(block_size).cast("long") - begin).cast("int")).alias("piece"))
    blocks = pieces.groupBy("batch", "block").agg(F.count(F.lit(1)).cast("int").alias("n_samples"),
                                                  F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p")) \
        .withColumn("ids", F.flatten("p.piece"))
    rest = F.lit(block_size) - F.size("ids")
    return blocks.select("batch", "block", "n_samples",
                         F.concat("ids", F.array_repeat(F.lit(pad_id), rest)).alias("input_ids"),
                         F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
                         F.concat("ids", F.array_repeat(F.lit(IGNORE_LABEL), rest)).alias("labels"))
