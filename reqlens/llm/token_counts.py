"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, n_tokens).
A text's key is the SHA-256 of its normalised content: runs of ASCII white space
become one space and the ends are trimmed, which the tokenizer's own
normaliser would do before it splits, so such texts have one count. Per call:
the distinct keys without an entry are encoded once each, their counts are
appended to the cache, and the documents get their counts by joining the cache.

Tokens never span white space and the library's special strings hold none, so a
text's count is the sum over its white-space separated chunks; each task encodes
each distinct chunk once, with the library. ``tests/llm`` compares with whole
texts.

The distinct misses are picked by a grouped aggregate that combines map-side, so
a text held by a third of the rows moves once per map task. Texts move once, to
their key's partition. A lost executor only repeats its own tasks.

Defined results: a null text counts as empty (0 tokens); null ids and repeated
rows each keep their row; an empty table gives an empty result and leaves the
cache as it is; columns besides id and text are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.textscan import slices

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens bigint"
SLICE = 4 << 20
#: chunks remembered by a task before it starts anew
MEMO = 1_000_000


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".json"):
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda words: [len(e.ids) for e in t.encode_batch_fast(words, add_special_tokens=False)]
    raise ValueError(f"no chunk-wise tokenizer for {path}")


def tokenizer_digest(path: str) -> str:
    """Digest of the vocabulary file and the library's version."""
    import tokenizers
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


def chunk_counts(column: pa.Array, count, memo: dict[str, int]) -> np.ndarray:
    """Tokens of each text of the column, by its distinct chunks."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    codes = lists.flatten().dictionary_encode()
    words = codes.dictionary.to_pylist()
    if len(memo) > MEMO:
        memo.clear()
    new = [w for w in words if w not in memo]
    if new:
        memo.update(zip(new, count(new)))
    n = np.fromiter((memo[w] for w in words), np.int64, len(words))
    sums = np.concatenate(([0], np.cumsum(n[codes.indices.to_numpy(zero_copy_only=False)]))) if len(words) \
        else np.zeros(1, np.int64)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
    return sums[ends[1:]] - sums[ends[:-1]]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r ]+", " "))


def token_counts(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; ``cache`` is the cache's
    folder on storage that all machines share (made if absent)."""
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)

    def known() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)

    content = normalised(F.col(text))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.unhex(F.sha2(content, 256)).alias("digest"))
    misses = docs.select(content.alias("content")) \
        .select(F.unhex(F.sha2("content", 256)).alias("digest"), "content") \
        .groupBy("digest").agg(F.first("content").alias("content")) \
        .join(known().select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = _tokenizer(tokenizer), {}
        for batch in batches:
            for part in slices(batch, "content", SLICE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array([version] * part.num_rows, pa.string()),
                     pa.array(chunk_counts(part.column("content"), count, memo), pa.int64())],
                    ["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    # two writers may have appended one key
    counts = known().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
