"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of ``window`` consecutive words (a shorter item
is one window); equal windows are one. The elements of a window are its shingles
of ``shingle`` words, ordered by rarity: how often they occur in all documents,
counted in a first pass. A document holds a window only if it holds all its
elements, so the necessary prefix is the rarest one. The second pass looks the
documents' shingles up in these prefix shingles; a match fixes where the window
would begin, which must lie within the document with room for its length, and
there the words are compared exactly.

Documents are read twice and never shuffled: no key is hot. Items come in blocks
of at most ``block`` windows, each block broadcast (its size is bounded by that
and by the words of a window); every block is matched in the same pass, one
after another, so a larger item table needs more blocks and nothing else.

Defined results: words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after
lower-casing A-Z. Null and empty texts have no words and no hits; items without
words or id take no part; an id given twice is one item. Null ids of documents,
repeated rows and other columns pass through (columns named like a result are
replaced). Without documents the result is empty, without items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.textscan import ALNUM, Words, combine, hash_words, slices
from reqlens.llm.util import clash_free, free_name, frugal, stored, work_dir


@dataclass(frozen=True)
class Settings:
    window: int = 13
    shingle: int = 5
    #: windows of a broadcast block
    block: int = 100_000


def item_windows(items: DataFrame, s: Settings, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(words, item_ids, n, elements): a row for each distinct window; elements
    are (offset, length, hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"), ALNUM)
                raw = w.buf.tobytes()
                words = [raw[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
                ids = part.column("id").to_pylist()
                rows = [(ids[d], b" ".join(words[i:i + n]), n) for d in range(len(ids))
                        for n in [min(s.window, int(w.count[d]))] if n
                        for i in range(w.first[d], w.first[d + 1] - n + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                                  pa.array([r[1] for r in rows], pa.binary()),
                                                  pa.array([r[2] for r in rows], pa.int32())], ["id", "words", "n"])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for words in batch.column("words").to_pylist():
                h = hash_words(words.split(b" "))
                k = min(s.shingle, len(h))
                out.append([{"hash": int(x), "length": k, "offset": i}
                            for i, x in enumerate(combine(h, k).view(np.int64))])
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("length", pa.int32()), ("offset", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "elements"])

    rows = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where("id is not null")
    windows = rows.mapInArrow(frugal(run), "id string, words binary, n int") \
        .groupBy("words").agg(F.first("n").alias("n"), F.collect_set("id").alias("ids"))
    return windows.mapInArrow(frugal(elements), "words binary, n int, ids array<string>, "
                                        "elements array<struct<hash bigint, length int, offset int>>")


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in keys, positions in the sorted table) of equal values."""
    if not len(table) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    found = np.flatnonzero(table[at] == keys)
    return found, at[found]


def rarity(docs: DataFrame, elements: DataFrame, text: str, block: int) -> DataFrame:
    """(hash, seen): occurrences in all documents of every element (hash, length)."""
    spark = docs.sparkSession
    n = elements.count()
    texts, found = docs.select(F.col(text).alias("text")), []
    for b in range(max(1, -(-n // block))):
        own = elements.where(F.pmod(F.xxhash64("hash", "length"), F.lit(max(1, -(-n // block)))) == b).toPandas()
        shared = spark.sparkContext.broadcast(
            {int(k): np.sort(g["hash"].to_numpy(np.int64)) for k, g in own.groupby("length")})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            counts = {k: np.zeros(len(t), np.int64) for k, t in shared.value.items()}
            for batch in batches:
                for part in slices(batch, "text"):
                    w = Words(part.column("text"), ALNUM)
                    h = w.hashes()
                    for k, t in shared.value.items():
                        _, at = _lookup(t, w.shingles(h, k)[1].view(np.int64))
                        counts[k] += np.bincount(at, minlength=len(t))
            for k, t in shared.value.items():
                seen = np.flatnonzero(counts[k])
                yield pa.RecordBatch.from_arrays([pa.array(t[seen]), pa.array(np.full(len(seen), k, np.int32)),
                                                  pa.array(counts[k][seen])], ["hash", "length", "seen"])

        found.append(texts.mapInArrow(frugal(run), "hash bigint, length int, seen bigint"))
    total = found[0]
    for f in found[1:]:
        total = total.unionByName(f)
    return total.groupBy("hash", "length").agg(F.sum("seen").alias("seen"))


def _match(w: Words, h: np.ndarray, block: dict) -> list[tuple[int, int, int]]:
    """(text, first word, window) of every occurrence of the block's windows."""
    out, raw = [], None
    doc = w.text_of()
    for k, (table, first, window, offset) in block["prefix"].items():
        at, keys = w.shingles(h, k)
        i, j = _lookup(table, keys.view(np.int64))
        n = first[j + 1] - first[j]
        entry = np.repeat(first[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = np.repeat(at[i], n)
        own = window[entry]
        begin = hit - offset[entry]
        text = doc[hit]
        fits = (begin >= w.first[text]) & (begin + block["n"][own] <= w.first[text + 1])
        for d, b, x in zip(text[fits].tolist(), begin[fits].tolist(), own[fits].tolist()):
            raw = w.buf.tobytes() if raw is None else raw
            words = block["words"][x]
            if all(raw[s:e] == word for s, e, word in zip(w.start[b:b + len(words)].tolist(),
                                                         w.end[b:b + len(words)].tolist(), words)):
                out.append((d, b, x))
    return out


@clash_free(lambda a: ["n_words", "n_hit", "spans", "item_ids", "contaminated"])
def contamination(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with n_words, n_hit, spans (word ranges that hold an
    occurrence, merged), item_ids and contaminated (hit words are at least a
    twentieth of all)."""
    s, spark = settings, docs.sparkSession
    folder = work_dir(spark)
    windows = stored(item_windows(items, s, item_id, item_text), folder, "windows")
    each = windows.select("words", F.explode("elements").alias("e")).select("words", "e.*")
    seen = rarity(docs, each.select("hash", "length").distinct(), text, s.block * s.window)
    chosen = each.join(seen, ["hash", "length"], "left") \
        .groupBy("words").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "hash", "offset", "length")).alias("p"))
    prefixes = stored(windows.join(chosen, "words").select("words", "n", "ids", "p.hash", "p.offset", "p.length"),
                      folder, "prefixes")
    blocks = max(1, -(-prefixes.count() // s.block))

    added = ["n_words", "n_hit", "spans", "item_ids", "contaminated"]
    docs = docs.select(*(c for c in docs.columns if c not in added))
    names = docs.columns
    begins, ids = free_name(docs, "found_ranges"), free_name(docs, "found_items")
    found = docs.withColumns({begins: F.array().cast("array<int>"), ids: F.array().cast("array<string>")})
    steps = []  # of one task: a chain of tasks would hold a Python worker for each
    for b in range(blocks):
        own = prefixes.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == b).toPandas() \
            .sort_values(["length", "hash"], ignore_index=True)
        block = {"words": [bytes(x).split(b" ") for x in own["words"]], "n": own["n"].to_numpy(np.int64),
                 "ids": [list(x) for x in own["ids"]], "prefix": {}}
        for k, g in own.groupby("length"):
            table, first = np.unique(g["hash"].to_numpy(np.int64), return_index=True)
            block["prefix"][int(k)] = (table, np.append(first, len(g)), g.index.to_numpy(np.int64), g["offset"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for part in slices(batch, text):
                    w = Words(part.column(text), ALNUM)
                    ranges, items = part.column(begins).to_pylist(), [set(x) for x in part.column(ids).to_pylist()]
                    for d, at, x in _match(w, w.hashes(), block):
                        ranges[d] += [at - int(w.first[d]), at - int(w.first[d]) + int(block["n"][x])]
                        items[d].update(block["ids"][x])
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in names), pa.array(ranges, pa.list_(pa.int32())),
                         pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*names, begins, ids])

        steps.append(run)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                words = Words(part.column(text), ALNUM).count.tolist()
                merged = []
                for flat in part.column(begins).to_pylist():
                    spans: list[dict] = []
                    for a, b in sorted(zip(flat[::2], flat[1::2])):
                        if spans and a <= spans[-1]["end"]:
                            spans[-1]["end"] = max(b, spans[-1]["end"])
                        else:
                            spans.append({"start": a, "end": b})
                    merged.append(spans)
                hit = [sum(x["end"] - x["start"] for x in spans) for spans in merged]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(words, pa.int64()), pa.array(hit, pa.int64()),
                     pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), part.column(ids),
                     pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, words)], pa.bool_())], [*names, *added])

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in [*steps, finish]:
            batches = step(batches)
        return batches

    return found.mapInArrow(frugal(every), T.StructType([
        *docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]))


def items_digest(ids: str = "item_ids"):
    """SHA-256 of the comma-joined ids, sorted as strings."""
    return F.sha2(F.array_join(F.array_sort(F.col(ids)), ",").cast("binary"), 256)


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their columns as they are."""
    plain = {f"column_{i}": c for i, c in enumerate(docs.columns)}  # columns named like a result stay, too
    own = next(k for k, c in plain.items() if c == text)
    kept = contamination(docs.toDF(*plain), items, settings, own).where("not contaminated")
    return kept.select(*plain).toDF(*plain.values())
