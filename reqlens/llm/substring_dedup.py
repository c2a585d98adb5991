"""Substring dedup on the compacted graph of repeated token k-mers.

A window is ``WINDOW`` consecutive words, an edge of a de Bruijn graph. Of its
words' runs of ``ANCHOR`` words, the one with the smallest hash (the first, on a
tie) is its anchor, so equal windows have equal anchors at equal places.
Neighbouring windows with one anchor are a nonbranching piece of a path: they are
handled as one row, about a sixth of the windows.

1. Anchors are counted over all documents. Those that come once can't lie in a
   repeated window; a bitmap of the others (of bounded size,
   broadcast) keeps most pieces of once-only text out. It may let some through,
   which costs time only.
2. Pieces with equal words are one path piece; its source is its first
   occurrence. Where one anchor has different pieces, paths branch or end: there
   (and only there) the source pieces' windows are compared one by one.
3. Source pieces that follow one another and occur equally often are joined to
   paths, and a document's pieces along one path become one span.
4. Each repeated piece is verified against the words at its source's coordinates
   by a second, independent 64-bit hash; one that differs is not removed.
5. The documents join their spans and drop the covered words.

A window is thus covered exactly if its words also start earlier: at a smaller
(doc_id, start). Counts and minima combine map-side, joins on common passages
are equi-joins that AQE can split, and the list a document gets is bounded by
its own length.

Defined results: null and empty texts have no words; documents shorter than a
window lose nothing. Rows without id neither lose words nor make others lose
some. Rows that share an id share their coordinates: equal windows at one place
don't count as earlier. Other columns pass through ``strip`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.bitmaps import bitmap, marked
from reqlens.llm.textscan import NOT_SPACE, Words, combine, mix, range_hashes, slices
from reqlens.llm.util import clash_free, free_name, stored, work_dir

WINDOW = 20
ANCHOR = 10


class Pieces:
    """The pieces of a slice of texts: ``n`` windows from word ``start`` on (of
    text ``doc``) with one anchor; ``key`` is a hash of all their words."""

    def __init__(self, column: pa.Array) -> None:
        self.words = w = Words(column, NOT_SPACE, lower=False)
        self.hashes = h = w.hashes()
        at, _ = w.shingles(h, WINDOW)
        if not len(at):
            self.doc = self.start = self.n = np.empty(0, np.int64)
            self.anchor = self.key = np.empty(0, np.uint64)
            return
        runs = combine(h, ANCHOR)
        low = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - ANCHOR + 1)
        place = np.concatenate([low[at[i:i + 65536]].argmin(axis=1) for i in range(0, len(at), 65536)]) + at
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.n = np.diff(np.append(first, len(at)))
        begin = at[first]
        self.doc = w.text_of()[begin]
        self.start = begin - w.first[self.doc]
        self.anchor = runs[place[first]]
        self.key = self.keys(begin, self.n, place[first] - begin)

    def keys(self, begin: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
        return mix(range_hashes(self.hashes, begin, begin + n + WINDOW - 1) ^ mix(offset.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _place(doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + start.astype(np.uint64))


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([_signed(Pieces(part.column("text")).anchor)], ["anchor"])

    return docs.select("text").mapInArrow(run, "anchor bigint")


def _pieces(docs: DataFrame, repeated) -> DataFrame:
    """(anchor, key, proof, doc_id, start, n) of the pieces whose anchor is
    marked in the broadcast bitmap; proof is an independent hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = Pieces(part.column("text"))
                own = np.flatnonzero(marked(repeated.value, p.anchor))
                begin, n = p.words.first[p.doc[own]] + p.start[own], p.n[own]
                proof = range_hashes(p.words.hashes(True), begin, begin + n + WINDOW - 1)
                yield pa.RecordBatch.from_arrays(
                    [_signed(p.anchor[own]), _signed(p.key[own]), _signed(proof), part.column("doc_id").take(pa.array(p.doc[own])),
                     pa.array(p.start[own].astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["anchor", "key", "proof", "doc_id", "start", "n"])

    return docs.mapInArrow(run, "anchor bigint, key bigint, proof bigint, doc_id bigint, start int, n int")


def _windows(docs: DataFrame, repeated, places) -> DataFrame:
    """(window, proof, doc_id, start): the windows of the pieces whose place is
    marked in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                p = Pieces(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                own = np.flatnonzero(marked(repeated.value, p.anchor) & marked(places.value, _place(ids[p.doc], p.start)))
                n, doc = p.n[own], np.repeat(p.doc[own], p.n[own])
                start = np.repeat(p.start[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                begin = p.words.first[doc] + start
                yield pa.RecordBatch.from_arrays(
                    [_signed(range_hashes(p.hashes, begin, begin + WINDOW)),
                     _signed(range_hashes(p.words.hashes(True), begin, begin + WINDOW)),
                     pa.array(ids[doc], pa.int64()), pa.array(start.astype(np.int32))], ["window", "proof", "doc_id", "start"])

    return docs.mapInArrow(run, "window bigint, proof bigint, doc_id bigint, start int")


def repeated_spans(docs: DataFrame, folder: str) -> DataFrame:
    """(doc_id, spans): per document the (start, n) of its runs of n windows
    whose words also start earlier."""
    context = docs.sparkSession.sparkContext
    counted = stored(_anchors(docs).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), folder, "anchors")
    repeated = context.broadcast(bitmap(counted, "anchor"))
    pieces = _pieces(docs, repeated)
    first = F.min(F.struct("doc_id", "start", "proof")).alias("s")
    runs = pieces.groupBy("anchor", "key").agg(first, F.max("n").alias("n"), F.count("*").alias("c")).select(
        "anchor", "key", F.col("s.doc_id").alias("source_id"), F.col("s.start").alias("source_start"),
        F.col("s.proof").alias("source_proof"), "n", "c")
    runs = stored(runs, folder, "runs")

    # branches: one anchor, different pieces
    branching = runs.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor")
    wanted = runs.join(branching, "anchor").select("source_id", "source_start")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [_signed(_place(batch.column("source_id").to_numpy(), batch.column("source_start").to_numpy()))], ["place"])

    places = context.broadcast(bitmap(stored(wanted.mapInArrow(place, "place bigint"), folder, "places"), "place"))
    windows = stored(_windows(docs, repeated, places), folder, "windows")
    least = windows.groupBy("window").agg(first, F.count("*").alias("c")).where("c > 1")
    at_branches = windows.join(least, "window") \
        .where("proof = s.proof and (doc_id <> s.doc_id or start <> s.start)") \
        .select("doc_id", "start", F.lit(1).alias("n"), F.col("s.doc_id").alias("source_id"),
                F.col("s.start").alias("path"), (F.col("start") - F.col("s.start")).alias("shift"))

    # paths: source pieces that follow one another and occur equally often
    many = runs.where("c > 1").select("key", "source_id", "source_start", "source_proof", "n", "c")
    follows = many.select("source_id", (F.col("source_start") + F.col("n")).alias("source_start"), "c").distinct() \
        .withColumn("follows", F.lit(True))
    order = "partition by source_id order by source_start"
    paths = many.join(follows, ["source_id", "source_start", "c"], "left").select(
        "key", "source_id", "source_start", "source_proof",
        F.expr(f"max(case when follows is null then source_start end) over ({order})").alias("path"))
    along_paths = _pieces(docs, repeated).select("key", "proof", "doc_id", "start", "n").join(paths, "key") \
        .where("proof = source_proof and (doc_id <> source_id or start <> source_start)") \
        .select("doc_id", "start", "n", "source_id", "path", (F.col("start") - F.col("source_start")).alias("shift"))
    # a document's pieces along one path are one span, if none is missing between
    spans = along_paths.unionByName(at_branches).repartition("doc_id") \
        .groupBy("doc_id", "source_id", "path", "shift") \
        .agg(F.min("start").alias("a"), F.max(F.col("start") + F.col("n")).alias("z"), F.sum("n").alias("all"),
             F.collect_list(F.struct("start", "n")).alias("each"))
    whole = F.array(F.struct(F.col("a").alias("start"), (F.col("z") - F.col("a")).alias("n")))
    return spans.select("doc_id", F.when(F.expr("all = z - a"), whole).otherwise(F.col("each")).alias("each")) \
        .groupBy("doc_id").agg(F.flatten(F.collect_list("each")).alias("spans"))


def _squeezed(w: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of a slice with one space between those of a text, and
    where each kept word begins."""
    start, end = w.start[kept], w.end[kept]
    doc = w.text_of()[kept]
    size = end - start
    gap = np.zeros(len(size), np.int64)
    gap[:-1] = doc[1:] == doc[:-1]
    at = np.concatenate(([0], np.cumsum(size + gap)))
    out = np.full(at[-1], 0x20, np.uint8)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at[:-1], size) + place] = w.buf[np.repeat(start, size) + place]
    return out, at


@clash_free(lambda a: ["n_words", "n_removed", "kept"], ("doc_id", "text"))
def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with n_words, n_removed and kept (the remaining words,
    joined by one space, as bytes); columns named like these are replaced."""
    added = ["n_words", "n_removed", "kept"]
    docs = docs.select(*(c for c in docs.columns if c not in added))
    folder = work_dir(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    name, other = free_name(docs, "span_list"), free_name(docs, "span_doc")
    lists = repeated_spans(narrow, folder).toDF(other, name)
    names = docs.columns
    joined = docs.join(lists, docs[doc_id].cast("bigint") == lists[other], "left").select(*(docs[c] for c in names), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                w = Words(part.column(text), NOT_SPACE, lower=False)
                change = np.zeros(len(w) + 1, np.int64)
                for d, spans in enumerate(part.column(name).to_pylist()):
                    for p in spans or ():
                        a = int(w.first[d]) + p["start"]
                        z = a + p["n"] + WINDOW - 1
                        if z <= w.first[d + 1]:
                            change[a] += 1
                            change[z] -= 1
                kept = np.cumsum(change[:-1]) == 0
                out, at = _squeezed(w, kept)
                before = np.concatenate(([0], np.cumsum(kept)))[w.first]
                raw, ends = out.tobytes(), at[before]
                left = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(w.count, pa.int64()), pa.array(w.count - np.diff(before), pa.int64()),
                     pa.array(left, pa.binary())], [*names, *added])

    return joined.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()),
                                                T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]))
