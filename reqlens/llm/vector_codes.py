"""Product codes of vectors; entries are found through GNATs over the codebooks.

Each component becomes the integer ``floor(1024 * x)`` and a vector is cut into
equal consecutive parts with a codebook each. A round gives every part its
codebook's nearest entry and replaces each entry by the floored mean of its
parts; sums and counts are combined in the tasks, then grouped, so the driver sees
one row an entry.

The nearest entry is searched in a GNAT (geometric near-neighbour access tree): a
node has split points, every other entry belongs to its nearest split point, and
for each pair (split i, child j) the node keeps the range of distances from i to
j's entries. With r the distance to the best entry so far, child j is left
out for a query at distance d of split i only if ``d + r < low`` or
``d - r > high``: strictly, with d, r and the range rounded to the safe side, so
an entry as near as the best one is never lost. Entries are compared by exact
integer squared distances, ties by index.

Defined results: rows whose vector is null or holds a null or non-finite
component are dropped; null ids and repeated rows each keep their row (null
ids come last in the first codebook); fewer rows than entries give smaller codebooks; empty
vectors get code 0 for each part; an empty table gives no rows; other columns
are ignored. Vectors of several lengths, of a length that the number of parts
doesn't divide, or so large that squared distances leave 64 bits, are refused
with a ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.util import stored, work_dir

#: labels with more than a thousandth of the rows: at most as many of them
HOT_SHARE = 1000


def finite(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))),
                      F.lit(False))


def matrix(column: pa.Array, n_components: int) -> np.ndarray:
    """A list column without nulls as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), n_components)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all rows of b."""
    if a.shape[1] == 0:
        return np.zeros((len(a), len(b)), np.int64)
    top = 2.0 * max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if a.shape[1] * top * top < 2.0 ** 53:  # every sum below is an integer that a double holds
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2.0 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - p) ** 2).sum(1) for p in b], axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


class Gnat:
    """Nearest entry, ties to the lower index, by strict elimination of subtrees."""

    def __init__(self, entries: np.ndarray, degree: int = 8, leaf: int = 12) -> None:
        self.entries, self.degree, self.leaf = entries, degree, leaf
        #: exact distances computed by searches
        self.compared = 0
        self.root = self._build(np.arange(len(entries)))

    def _build(self, ids: np.ndarray) -> dict:
        if len(ids) <= self.leaf:
            return {"own": ids, "children": []}
        x = self.entries[ids]
        splits, far = [0], squared(x, x[:1])[:, 0]
        while len(splits) < self.degree and far.max() > 0:  # the entry farthest from all splits is the next
            splits.append(int(far.argmax()))
            far = np.minimum(far, squared(x, x[splits[-1:]])[:, 0])
        rest = np.setdiff1d(np.arange(len(ids)), splits)
        if len(splits) < 2:  # all equal
            return {"own": ids, "children": []}
        d2 = squared(x[rest], x[splits])
        distance, owner = np.sqrt(d2.astype(np.float64)), d2.argmin(axis=1)
        children = []
        for j in range(len(splits)):
            mine = owner == j
            if mine.any():
                children.append((j, _down(distance[mine].min(axis=0)), _up(distance[mine].max(axis=0)),
                                 self._build(ids[rest[mine]])))
        return {"own": ids[splits], "children": children}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        index = np.full(len(x), len(self.entries), np.int64)
        best = np.full(len(x), np.iinfo(np.int64).max, np.int64)

        def visit(node: dict, rows: np.ndarray) -> None:
            if not len(rows):
                return
            own = np.sort(node["own"])
            d2 = squared(x[rows], self.entries[own])
            self.compared += d2.size
            at = d2.argmin(axis=1)
            low, who = d2[np.arange(len(rows)), at], own[at]
            better = (low < best[rows]) | ((low == best[rows]) & (who < index[rows]))
            best[rows[better]], index[rows[better]] = low[better], who[better]
            if not node["children"]:
                return
            d = np.sqrt(d2[:, np.searchsorted(own, node["own"])].astype(np.float64))
            near, far, first = _down(d), _up(d), d.argmin(axis=1)
            for turn in (True, False):  # the nearest split's child first: it shortens r for the others
                for j, lo, hi, child in node["children"]:
                    turns = np.flatnonzero((first == j) == turn)
                    r = _up(np.sqrt(best[rows[turns]].astype(np.float64)))[:, None]
                    out = (_up(far[turns] + r) < lo) | (_down(near[turns] - r) > hi)
                    visit(child, rows[turns[~out.any(axis=1)]])

        if len(self.entries):
            visit(self.root, np.arange(len(x)))
        return index, best


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
           entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every usable
    row. ``entries`` is at most 256, as the code has two hex digits a part."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("g")) \
        .where(finite("v"))
    n, shortest, dim, top = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")),
                                     F.max(F.array_max(F.transform("v", F.abs)))).first()
    dim, top = dim or 0, abs(top or 0.0) * scale + 1
    if n and (shortest != dim or dim % parts):
        raise ValueError(f"vectors of {shortest} to {dim} components can't be cut into {parts} equal parts")
    if dim * (2 * top) ** 2 >= 2.0 ** 63 or n * top >= 2.0 ** 63:
        raise ValueError("components too large for 64-bit squared distances")
    width = dim // parts

    def pieces(batch: pa.RecordBatch) -> np.ndarray:
        """(part, row, component) integers."""
        x = np.floor(scale * matrix(batch.column("v"), dim)).astype(np.int64)
        return x.reshape(len(x), parts, width).transpose(1, 0, 2)

    start = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).toArrow().combine_chunks()
    books = np.zeros((parts, 0, width), np.int64)
    for batch in start.to_batches():
        books = np.concatenate([books, pieces(batch)], axis=1)

    def sums(books: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [Gnat(b) for b in books]
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                for p, x in enumerate(pieces(batch)):
                    index, _ = trees[p].nearest(x)
                    np.add.at(total[p], index, x)
                    count[p] += np.bincount(index, minlength=books.shape[1])
            part, entry = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
                 pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])
        return run

    for _ in range(rounds if n else 0):
        found = rows.select("v").mapInArrow(sums(books), "part int, entry int, n bigint, s array<bigint>") \
            .groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
        books = books.copy()
        for r in found.collect():  # one row an entry
            books[r.part, r.entry] = np.array(r.s, np.int64) // r.n

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            index, error = zip(*(trees[p].nearest(x) for p, x in enumerate(pieces(batch))))
            text = ["".join(f"{i:02x}" for i in c) for c in np.stack(index, axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("g"), pa.array(text, pa.string()),
                                              pa.array(np.sum(error, axis=0, dtype=np.int64))], ["id", "g", "code", "error"])

    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    types = dict(rows.dtypes)
    coded = stored(rows.mapInArrow(codes, f"id {types['id']}, g {types['g']}, code string, error bigint"), work_dir(rows.sparkSession), "codes")
    totals = coded.groupBy("g").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hot = F.col("n") * HOT_SHARE > n
    frequent = totals.where(hot).select(F.col("g").alias("h"), "label_error")  # fewer than HOT_SHARE rows
    split = coded.join(F.broadcast(frequent), F.col("g").eqNullSafe(F.col("h")), "left").drop("h")
    seldom = totals.where(~hot).select(F.col("g").alias("h"), "label_error")
    rest = split.where("label_error is null").drop("label_error").join(seldom, F.col("g").eqNullSafe(F.col("h"))).drop("h")
    return split.where("label_error is not null").unionByName(rest).select(
        F.col("id").alias("vec_id"), F.col("g").alias("label"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
