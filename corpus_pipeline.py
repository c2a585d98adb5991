"""Corpus pipeline: quality classifier, line dedup, near-dedup, benchmark
decontamination, byte-level BPE. Each stage works on what the one before it
kept; its result is written as Parquet and read again.

Defined results: a null text has score, lines, shingles, windows and ids of an empty
one; rows without id lose nothing to others and stay if they are good; repeated
rows stay or go together; other columns pass through, but for ones named like the
last stage's results; empty tables give an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reqlens.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from reqlens.llm.util import remainder, stored, work_dir
from reqlens.sources.tables import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled
    ones among its input that are outside the held-out fold."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=lambda c: remainder(c, 5) > 0)
    return quality.keep_good(docs, model, 0.3)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one up to two byte edits (one per eight bytes) go from
    the texts; every document stays."""
    return line_dedup.strip_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return near_dedup.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the texts that are left, with counts and digests."""
    import public_tokenizers
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality classifier", quality_stage), ("line dedup", line_stage), ("MinHash near-dedup", near_stage),
          ("benchmark decontamination", benchmark_stage), ("byte-level BPE", bpe_stage)]

#: The classifier's scores and the token ids can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    folder = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
