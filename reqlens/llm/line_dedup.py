"""Line dedup by a segment-partition edit join.

Two lines are alike if inserting, deleting and replacing bytes turns one into the
other in as many steps as the shorter one allows: one for every ``EDIT_BYTES``
bytes, ``threshold`` at most (lines shorter than that are alike if equal). A line
that allows t steps is cut into t + 1
segments; a line within t holds one of them unchanged, at a place
that the edits before and after it allow. So every line is indexed by its
segments (with its length and their number), and probes, for its own and each
smaller length that allows the difference, the substrings at those places. A broadcast
bitmap of the index (of bounded size) drops nearly all probes at once.

Lines that meet under a key are dealt into parts, every pair of parts is a cell,
and a cell verifies its pairs: first by the counts of their bytes, then by a
banded bit-parallel edit distance over all pairs at once. It returns links that
span what it joined, so a large group of copies makes no rows for its pairs.
Linked lines are one class (connected components); equal lines are one line.
Of every class the first occurrence, by (doc_id, line number), stays.

Lines are told apart by a 64-bit hash; an occurrence whose second, independent
hash differs from its line's is not removed. Defined results: empty lines always stay; null texts have no lines and stay null; documents without id neither lose
lines nor make others lose some; rows that share an id share their lines' places.
Other columns pass through ``strip_lines`` as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.llm.bitmaps import bitmap, marked
from reqlens.llm.graph import components
from reqlens.llm.textscan import Words, mix, range_hashes, slices
from reqlens.llm.util import clash_free, free_name, frugal, stored, work_dir

THRESHOLD = 2
#: bytes of the shorter line for each edit
EDIT_BYTES = 8
#: text bytes whose keys are made at once (some 100 bytes of memory each)
SLICE = 1 << 18
#: lines of a part
PART = 512
#: rows that one call verifies, about, and pairs at once
BUNDLE = 2000
PAIRS = 1 << 12

_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[0x0A] = False


def allowed(size: np.ndarray, threshold: int) -> np.ndarray:
    """Edits between lines of which the shorter one has so many bytes."""
    return np.minimum(size // EDIT_BYTES, threshold)


class Lines(Words):
    """The non-empty lines of a slice of texts, as words cut at line breaks."""

    def __init__(self, column: pa.Array) -> None:
        super().__init__(column, _NOT_BREAK, lower=False)
        self.size = self.end - self.start
        breaks = np.concatenate(([0], np.cumsum(self.buf == 0x0A)))
        doc = self.text_of()
        self.number = breaks[self.start] - breaks[self.offsets[:-1]][doc]  # empty lines count

    def keys(self, threshold: int, own_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, whether it's the line's own segment) of all lines that allow
        an edit; the lines' own segments alone if asked for."""
        prefix = self.buf.astype(np.uint64) + np.uint64(1)
        line, begin, end, tag, own = [], [], [], [], []
        for edits in range(1, threshold + 1):
            for less in range(1 if own_only else edits + 1):  # the other line is shorter by so much
                mine = np.flatnonzero(allowed(self.size - less, threshold) == edits)
                start, size = self.start[mine], self.size[mine]
                n = size - less
                short, extra = n // (edits + 1), n % (edits + 1)
                for i in range(edits + 1):
                    # the last ``extra`` segments are one longer
                    length = short + (i >= edits + 1 - extra)
                    place = i * short + np.maximum(0, i - (edits + 1 - extra))
                    # edits before and after the segment allow these shifts, whatever the line
                    for shift in (0,) if own_only else range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                        at = place + shift
                        k = np.flatnonzero((at >= 0) & (at <= size - length))
                        line.append(mine[k])
                        begin.append(start[k] + at[k])
                        end.append(start[k] + at[k] + length[k])
                        tag.append((n[k].astype(np.uint64) << np.uint64(8)) | np.uint64(i))
                        own.append(np.full(len(k), less == 0 and shift == 0))
        line, begin, end, tag, own = (np.concatenate(x) for x in (line, begin, end, tag, own))
        return line, mix(range_hashes(prefix, begin, end) ^ mix(tag)), own


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(line, proof, doc_id, number) of every line that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = Lines(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [_signed(x.hashes()), _signed(x.hashes(True)), part.column("doc_id").take(pa.array(x.text_of())),
                     pa.array(x.number.astype(np.int32))], ["line", "proof", "doc_id", "number"])

    return docs.mapInArrow(frugal(run), "line bigint, proof bigint, doc_id bigint, number int")


def _keys(docs: DataFrame, threshold: int, index=None) -> DataFrame:
    """(key, line, own): the lines' own segments, or, given the broadcast bitmap
    of those, also the probes it lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = Lines(part.column("text"))
                line, key, own = x.keys(threshold, own_only=index is None)
                keep = own if index is None else own | marked(index.value, key)
                yield pa.RecordBatch.from_arrays([_signed(key[keep]), _signed(x.hashes()[line[keep]]), pa.array(own[keep])],
                                                 ["key", "line", "own"])

    return docs.mapInArrow(frugal(run), "key bigint, line bigint, own boolean")


def _texts(docs: DataFrame, wanted) -> DataFrame:
    """(line, raw): the bytes of the lines marked in the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                x = Lines(part.column("text"))
                h = x.hashes()
                _, first = np.unique(h, return_index=True)
                own = first = first[marked(wanted.value, h[first])]
                raw = x.buf.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [_signed(h[first]), pa.array([raw[a:b] for a, b in zip(x.start[own].tolist(), x.end[own].tolist())], pa.binary())],
                    ["line", "raw"])

    return docs.select("text").mapInArrow(frugal(run), "line bigint, raw binary").dropDuplicates(["line"])


def within(xs: list[bytes], ys: list[bytes], threshold: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Whether each pair (x, y), len(x) <= len(y) <= len(x) + threshold, is within
    the threshold, or within its own limit, which is no larger."""
    out = np.zeros(len(xs), bool)
    limit = np.full(len(xs), threshold) if limit is None else limit
    order = np.argsort([len(x) for x in xs], kind="stable")
    for p in range(0, len(order), PAIRS):
        own = order[p:p + PAIRS]
        out[own] = _banded([xs[k] for k in own], [ys[k] for k in own], threshold) <= limit[own]
    return out


def _padded(lines: list[bytes], lead: int, fill: int) -> np.ndarray:
    """(bytes, lines): the lines as columns, after ``lead`` equal bytes and
    before bytes that equal nothing."""
    size = np.array([len(x) for x in lines])
    out = np.full((len(lines), lead + int(size.max())), fill, np.uint16)
    out[:, :lead] = 0
    out[:, lead:][np.arange(int(size.max())) < size[:, None]] = np.frombuffer(b"".join(lines), np.uint8)
    return np.ascontiguousarray(out.T)


def _banded(xs: list[bytes], ys: list[bytes], threshold: int) -> np.ndarray:
    """The distances, right up to the threshold and larger beyond it: the columns
    of the edit matrices of all pairs at once, in bit vectors of
    the 2 * threshold + 1 cells around the diagonal. Pairs whose distance can't
    come down to the threshold any more are left out as they are found."""
    lead = threshold + 1
    m, n = (np.array([len(t) for t in z], np.int64) + lead for z in (xs, ys))
    x, y = _padded(xs, lead, 300), _padded(ys, lead, 301)
    width = 2 * threshold + 1
    full = np.uint64((1 << width) - 1)
    one = np.uint64(1)
    pair = np.arange(len(xs))
    plus = np.full(len(xs), ((1 << (threshold + 1)) - 1) << threshold, np.uint64)  # rows that are one more than the row above
    minus = np.zeros(len(xs), np.uint64)
    score = np.full(len(xs), threshold, np.int64)
    out = np.full(len(xs), threshold + 1)
    for j in range(int(n.max())):
        match = np.zeros(len(pair), np.uint64)
        for b in range(width):
            row = j - threshold + b
            if 0 <= row < len(x):
                match |= (x[row] == y[j]).astype(np.uint64) << np.uint64(b)
        same = ((((match & plus) + plus) ^ plus) | match | minus) & full  # equal to the cell up left
        right = (minus | ~(same | plus)) & full
        left = plus & same
        diagonal = j < m - threshold
        last_row = np.clip(m - 1 - j + threshold, 0, width - 1).astype(np.uint64)
        beside = ((right >> last_row) & one).astype(np.int64) - ((left >> last_row) & one).astype(np.int64)
        score += np.where(diagonal, 1 - ((same >> np.uint64(width - 1)) & one).astype(np.int64), np.where(j < n, beside, 0))
        down = same >> one
        plus = (left | ~(down | right)) & full
        minus = down & right
        if j % 16 == 15:
            open_ = (score <= 3 * threshold) & (j < n)
            if 4 * open_.sum() < 3 * len(pair):
                done = j >= n
                out[pair[done]] = score[done]
                pair, plus, minus, score, m, n = (z[open_] for z in (pair, plus, minus, score, m, n))
                if not len(pair):
                    return out
                x, y = x[:, open_], y[:, open_]
    out[pair] = score
    return out


class _Cell:
    """The lines of a cell and which of them are joined."""

    def __init__(self, lines: list[bytes], own: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
        self.lines, self.own, self.left, self.right = lines, own, left, right
        self.size = np.array([len(x) for x in lines])
        self.bags = np.stack([np.bincount(np.frombuffer(x, np.uint8) & 63, minlength=64) for x in lines]).astype(np.int16)
        self.part = np.arange(len(lines))

    def open_pairs(self, rows: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of these lines of the left with lines of the right, at least one
        of them indexed, that aren't joined and may be within the threshold."""
        found = []
        for x in rows.tolist():
            limit = allowed(np.minimum(self.size[self.right], self.size[x]), threshold)
            fits = (self.part[self.right] != self.part[x]) & (np.abs(self.size[self.right] - self.size[x]) <= limit) \
                & (self.own[self.right] | self.own[x])
            y, limit = self.right[fits], limit[fits]
            if len(y):
                y = y[np.abs(self.bags[y] - self.bags[x]).sum(axis=1) <= 2 * limit]
                swap = self.size[y] < self.size[x]
                found.append((np.where(swap, y, x), np.where(swap, x, y)))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        a, b = (np.concatenate(z) for z in zip(*found))
        keep = np.unique(np.minimum(a, b) * len(self.lines) + np.maximum(a, b), return_index=True)[1]
        return a[keep], b[keep]

    def join(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        links = []
        for x, y in zip(a.tolist(), b.tolist()):
            if self.part[x] != self.part[y]:
                self.part[self.part == self.part[y]] = self.part[x]
                links.append((x, y))
        return links


def _verified(pairs: list[tuple[_Cell, np.ndarray, np.ndarray]], threshold: int) -> list[list[tuple[int, int]]]:
    """Joins the pairs of each cell that are within the threshold, all verified at
    once; returns the links that joined something."""
    xs = [c.lines[k] for c, a, _ in pairs for k in a.tolist()]
    ys = [c.lines[k] for c, _, b in pairs for k in b.tolist()]
    good = within(xs, ys, threshold, allowed(np.array([len(x) for x in xs]), threshold)) if xs else np.empty(0, bool)
    out, at = [], 0
    for c, a, b in pairs:
        ok = good[at:at + len(a)]
        at += len(a)
        out.append(c.join(a[ok], b[ok]))
    return out


def cell_links(cells: list[_Cell], threshold: int) -> list[list[tuple[int, int]]]:
    """For each cell, links that span its pairs within the threshold."""
    # most of a group of copies is joined by comparing with one line
    links = _verified([(c, *c.open_pairs(c.left[:1], threshold)) for c in cells], threshold)
    waiting: list[tuple[int, np.ndarray, np.ndarray]] = []

    def verify() -> None:
        for (k, _, _), more in zip(waiting, _verified([(cells[k], a, b) for k, a, b in waiting], threshold)):
            links[k] += more
        waiting.clear()

    for k, c in enumerate(cells):
        for at in range(0, len(c.left), 64):
            waiting.append((k, *c.open_pairs(c.left[at:at + 64], threshold)))
            if sum(len(a) for _, a, _ in waiting) >= PAIRS:
                verify()
    verify()
    return links


def _batches(groups: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """The groups in runs of about BUNDLE rows: so many are held as cells at once."""
    some, rows = [], 0
    for g in groups:
        some.append(g)
        rows += len(g)
        if rows >= BUNDLE:
            yield some
            some, rows = [], 0
    if some:
        yield some


def _cells(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows of all cells, in bundles of about BUNDLE rows."""
    pair = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1),
                       lambda i: F.struct(F.least(i, F.col("part")).alias("i"), F.greatest(i, F.col("part")).alias("j")))
    # every row is copied into as many cells as its key has parts
    bundles = max(1, (dealt.agg(F.sum("parts").alias("n")).first()["n"] or 0) // BUNDLE)
    return dealt.select("key", "line", "own", "part", F.explode(pair).alias("cell")) \
        .select("key", "line", "own", "part", "cell.i", "cell.j").join(texts, "line") \
        .withColumn("bundle", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bundles)))


def line_links(docs: DataFrame, threshold: int, folder: str) -> DataFrame:
    """(a, b): links that span the lines within the threshold of each other."""
    context = docs.sparkSession.sparkContext
    index = context.broadcast(bitmap(stored(_keys(docs, threshold).groupBy("key").agg(F.count("*").alias("c")).select("key"), folder, "index"), "key"))
    rows = _keys(docs, threshold, index).groupBy("key", "line").agg(F.max("own").alias("own"))
    rows = stored(rows, folder, "keys")
    useful = rows.groupBy("key").agg(F.min("line").alias("x"), F.max("line").alias("y"), F.max("own").alias("own"), F.count("*").alias("n")) \
        .where("own and x <> y").select("key", F.ceil(F.col("n") / PART).alias("parts"))
    dealt = stored(rows.join(useful, "key").withColumn("part", F.pmod(F.xxhash64("line"), "parts")), folder, "dealt")
    wanted = stored(dealt.select("line").distinct().select("line"), folder, "wanted")
    texts = stored(_texts(docs, context.broadcast(bitmap(wanted, "line"))), folder, "texts")
    cells = _cells(dealt, texts)

    def verify(bundle: pa.Table) -> pa.Table:
        key, i, j, part, own, ids = (bundle.column(c).to_numpy() for c in ("key", "i", "j", "part", "own", "line"))
        raw = bundle.column("raw").to_pylist()
        order = np.lexsort((ids, j, i, key))
        change = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)) + 1
        groups = np.split(order, change)
        links = []
        for some in _batches(groups):
            cells = [_Cell([raw[k] for k in g], own[g], np.flatnonzero(part[g] == i[g]), np.flatnonzero(part[g] == j[g])) for g in some]
            links += [(ids[g[x]], ids[g[y]]) for g, found in zip(some, cell_links(cells, threshold)) for x, y in found]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return stored(cells.groupBy("bundle").applyInArrow(verify, "a bigint, b bigint").distinct(), folder, "links")


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, folder: str | None = None) -> DataFrame:
    """(doc_id, number, first_id, first_number, near): the lines that go, the
    first of their class, and whether they differ from all earlier lines."""
    folder = folder or work_dir(docs.sparkSession)
    seen = stored(_occurrences(docs), folder, "occurrences")
    lines = stored(seen.groupBy("line").agg(F.min(F.struct("doc_id", "number", "proof")).alias("s"), F.count("*").alias("c"))
                   .select("line", "s.doc_id", "s.number", "s.proof", "c"), folder, "lines")
    labels = components(line_links(docs, threshold, folder), f"{folder}/classes").withColumnRenamed("node", "line")
    first = F.min(F.struct("doc_id", "number")).alias("f")
    linked = lines.join(labels, "line")
    near = linked.join(linked.groupBy("label").agg(first), "label").select("line", "doc_id", "number", "proof", "f")
    equal = lines.where("c > 1").join(labels, "line", "left_anti") \
        .select("line", "doc_id", "number", "proof", F.struct("doc_id", "number").alias("f"))
    known = near.unionByName(equal).select("line", F.col("doc_id").alias("own_id"), F.col("number").alias("own_number"),
                                           F.col("proof").alias("own_proof"), F.col("f.doc_id").alias("first_id"), F.col("f.number").alias("first_number"))
    return seen.join(known, "line").where("proof = own_proof and (doc_id <> first_id or number <> first_number)") \
        .select("doc_id", "number", "first_id", "first_number", F.expr("doc_id = own_id and number = own_number").alias("near"))


@clash_free(lambda a: ["n_lines", "n_removed", "n_near"] * a["counts"], ("doc_id", "text"))
def strip_lines(docs: DataFrame, threshold: int = THRESHOLD, doc_id: str = "doc_id", text: str = "text",
                counts: bool = False) -> DataFrame:
    """The documents without the lines that go, and without their line breaks;
    with n_lines, n_removed and n_near (removed though no equal line came
    earlier) if asked for (columns named so are then replaced)."""
    named = ["n_lines", "n_removed", "n_near"] * counts
    docs = docs.select(*(c for c in docs.columns if c not in named))
    narrow = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    name, other = free_name(docs, "line_list"), free_name(docs, "line_doc")
    lists = removed_lines(narrow, threshold).groupBy(F.col("doc_id").alias(other)) \
        .agg(F.collect_set(F.struct("number", "near")).alias(name))
    names = docs.columns
    joined = docs.join(lists, docs[doc_id].cast("bigint") == lists[other], "left").select(*(docs[c] for c in names), name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, gone, near = batch.column(text).to_pylist(), [], [], []
            for i, (t, removed) in enumerate(zip(texts, batch.column(name).to_pylist())):
                lines = [] if t is None else t.split("\n")
                drop = {r["number"] for r in removed or () if r["number"] < len(lines)}
                if drop:
                    texts[i] = "\n".join([x for k, x in enumerate(lines) if k not in drop])
                n.append(len(lines))
                gone.append(len(drop))
                near.append(len({r["number"] for r in removed or () if r["near"]} & drop))
            kind = batch.schema.field(text).type
            columns = [pa.array(texts, kind) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in (n, gone, near)][:len(named)]], [*names, *named])

    return joined.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in named)]))
