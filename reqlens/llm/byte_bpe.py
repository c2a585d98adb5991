"""Byte-level BPE by recursive DuckDB queries inside Spark's partitions.

Encoding, per task: a text is cut before spaces that precede a byte with which no
white-space character begins (no match of the splitting pattern crosses such a cut),
the distinct units are split by the pattern into words, and the words not seen
before become token-position rows, one per byte. A recursive query joins
neighbouring rows with the merge table (every split of every token into two
tokens) and contracts each word's leftmost pair of minimum rank until none is
left. Ordered aggregation gives a word's ids and, through the vocabulary, its
decoded bytes. A text's ids are those of its words in order.

Words longer than ``LONG`` bytes go through a second recursive query that
contracts, in one step, all occurrences of the minimum-rank pair, taken from the
left without overlap. That is the same as one at a time if no pair with the new
token ranks lower than it; for the other tokens it contracts the leftmost only.

Memory per task: one slice of texts, its distinct words, the rows of one query (at
most ``QUERY_BYTES``, or one longer word) and the words and units remembered while the
worker lives, ``REMEMBERED`` bytes of each. DuckDB's own limit is ``DUCKDB_MB``. Nothing is shuffled and the vocabulary is read from its file by every
worker, so a lost executor costs only its own tasks.

Defined results: a null text counts as empty (no ids, no bytes); null ids,
repeated rows and other columns pass through; an empty table stays empty.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
import threading
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reqlens.llm.textscan import NOT_SPACE, slices, text_buffer
from reqlens.llm.util import clash_free, frugal, give_back

SLICE = 1 << 20
LONG = 96
#: bytes of words, and of units, with ids and Python objects, that a worker remembers
REMEMBERED = 40 << 20
_OBJECTS = 190  # of one remembered word
#: token-position rows of one recursive query, which holds the rows of all its steps
QUERY_BYTES = 1 << 18
DUCKDB_MB = 160
#: a worker without tasks drops its memory after so long
IDLE_SECONDS = 3.0

#: bytes that no white-space character begins with
_NOT_SPACE_START = NOT_SPACE.copy()
_NOT_SPACE_START[[0xC2, 0xE1, 0xE2, 0xE3]] = False

_STEPS = """
with recursive t(step, w, pos, id) as (
  select 0, w, pos, id from start
  union all
  select t.step + 1, t.w, t.pos, case when t.pos = l.p then l.r else t.id end
  from t join (
    select w, (min(pair) >> 32)::int as r, (min(pair) & 4294967295)::int as p, arg_min(q, pair) as q
    from (
      select n.w, n.q, (m.r::bigint << 32) | n.pos as pair
      from (select w, pos, id, lead(id) over (order by w, pos) as nid, lead(pos) over (order by w, pos) as q
            from t) n
      join merges m on n.id = m.a and n.nid = m.b
      where n.q > n.pos)
    group by w) l on t.w = l.w
  where t.pos <> l.q
)"""

_LONG_STEPS = """
with recursive t(step, w, pos, id) as (
  select 0, w, pos, id from start
  union all
  select step + 1, w, pos, case when joined then r else id end
  from (
    select *, lag(joined, 1, false) over (order by w, pos) as consumed
    from (
      select *, hit and (row_number() over (partition by w, run, hit order by pos)) % 2 = 1
                and (safe or pos = leftmost) as joined
      from (
        select *, sum(case when hit and not hit_before then 1 else 0 end) over (order by w, pos) as run
        from (
          select *, lag(hit, 1, false) over (order by w, pos) as hit_before
          from (
            select *, coalesce(r = low, false) as hit, min(case when r = low then pos end) over (partition by w) as leftmost
            from (
              select n.step, n.w, n.pos, n.id, m.r, m.safe, min(m.r) over (partition by n.w) as low
              from (select *, lead(id) over (partition by w order by pos) as nid from t) n
              left join merges m on n.id = m.a and n.nid = m.b)
            where low is not null)))))
  where not consumed
)"""

_RESULT = """
select w, list(id order by pos) as ids, string_agg(hex, '' order by pos) as hex
from t join vocabulary using (id)
where (w, step) in (select w, max(step) from t group by w)
group by w
"""


class Codec:
    """Vocabulary, merge table and the worker's own DuckDB."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.zeros(256, np.int32)
        for b in range(256):
            self.byte_id[b] = self.ranks[bytes([b])]
        left, right, rank = array("i"), array("i"), array("i")  # every split of every token into two tokens
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                if (x := self.ranks.get(token[:i])) is not None and (y := self.ranks.get(token[i:])) is not None:
                    left.append(x)
                    right.append(y)
                    rank.append(r)
        pairs = [np.frombuffer(x, np.int32) for x in (left, right, rank)]
        size = max(self.ranks.values(), default=0) + 1
        lowest = np.arange(size, dtype=np.int32)  # of the pairs that a token is part of, or itself
        lower = np.full(size, np.iinfo(np.int32).max, np.int32)
        for side in pairs[:2]:
            np.minimum.at(lower, side, pairs[2])
        lowest = np.where(lower < np.iinfo(np.int32).max, lower, lowest)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": tempfile.gettempdir()})
        self._table("merges", {"a": pa.array(pairs[0]), "b": pa.array(pairs[1]), "r": pa.array(pairs[2]),
                               "safe": pa.array(lowest[pairs[2]] >= pairs[2])})
        self._table("vocabulary", {"id": pa.array(list(self.tokens), pa.int32()),
                                   "hex": pa.array([t.hex() for t in self.tokens.values()], pa.string())})
        # ids by word and by unit; what they decode to has been compared with the word
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.room = {"words": REMEMBERED, "units": REMEMBERED}

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create or replace temp table {name} as select * from given")
        self.con.unregister("given")

    def encode_words(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """word -> (ids as little-endian 32-bit integers, decoded bytes)."""
        out, todo, long = {}, [], []
        for word in words:
            raw = word.encode("utf-8")
            rank = self.ranks.get(raw)
            if rank is not None:
                out[word] = (rank.to_bytes(4, "little"), self.tokens[rank])
            else:
                (long if len(raw) > LONG else todo).append((word, raw))
        for found, steps in ((todo, _STEPS), (long, _LONG_STEPS)):
            ends = np.cumsum([len(raw) for _, raw in found])
            at = 0
            while at < len(found):  # as many words as fit
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + QUERY_BYTES, side="right")), at + 1)
                out.update(self._contracted(found[at:to], steps))
                at = to
        return out

    def _contracted(self, part: list[tuple[str, bytes]], steps: str) -> Iterator[tuple[str, tuple[bytes, bytes]]]:
        buf, offsets = text_buffer(pa.array([raw for _, raw in part], pa.binary()))
        size = np.diff(offsets)
        self.con.register("start", pa.table({
            "w": np.repeat(np.arange(len(part), dtype=np.int32), size),
            "pos": (np.arange(len(buf)) - np.repeat(offsets[:-1], size)).astype(np.int32),
            "id": self.byte_id[buf]}))
        got = self.con.sql(steps + _RESULT).to_arrow_table()
        self.con.unregister("start")
        ids = got.column("ids").combine_chunks()
        ends = np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))
        flat = ids.flatten().to_numpy().astype("<u4").tobytes()
        for k, w, text in zip(range(len(got)), got.column("w").to_pylist(), got.column("hex").to_pylist()):
            yield part[w][0], (flat[4 * ends[k]:4 * ends[k + 1]], bytes.fromhex(text))

    def _remember(self, kind: str, new: dict[str, bytes]) -> None:
        memory, room = getattr(self, kind), self.room[kind]
        for k, v in new.items():
            cost = _OBJECTS + 2 * len(k) + len(v)
            if cost > room:
                break
            if len(k) <= LONG:
                memory[k] = v
                room -= cost
        self.room[kind] = room

    def encode_units(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each unit."""
        known, old = self.words, self.units
        new = [u for u in units if u not in old]
        parts = list(map(self.split, new))
        fresh = self.encode_words(list(set(chain.from_iterable(parts)).difference(known)))
        if all(raw == w.encode("utf-8") for w, (_, raw) in fresh.items()):
            ids = {w: i for w, (i, _) in fresh.items()}
            made = {u: b"".join([known.get(w) or ids[w] for w in p]) for u, p in zip(new, parts)}
            out = [(old.get(u) or made[u], u.encode("utf-8")) for u in units]
            self._remember("words", ids)
            self._remember("units", made)
            return out
        # a word that decodes to something else is kept as it is, and not remembered
        both = {w: (i, w.encode("utf-8")) for w, i in known.items()} | fresh
        made = {u: (b"".join([both[w][0] for w in p]), b"".join([both[w][1] for w in p])) for u, p in zip(new, parts)}
        return [(old[u], u.encode("utf-8")) if u in old else made[u] for u in units]

    def encode_texts(self, column: pa.Array) -> Iterator[tuple[bytes, bytes]]:
        """(ids, decoded bytes) of each text."""
        buf, offsets = text_buffer(column)
        n = len(buf)
        cut = np.zeros(n + 1, dtype=bool)
        cut[:max(n - 1, 0)] = (buf[:-1] == 0x20) & _NOT_SPACE_START[buf[1:]] if n > 1 else False
        cut[offsets] = True
        at = np.flatnonzero(cut).astype(np.int64)
        if at[-1] != n:
            at = np.append(at, n)
        units = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf)))
        coded = units.dictionary_encode()
        made = self.encode_units(coded.dictionary.to_pylist())
        ids = [m[0] for m in made]
        raw = [m[1] for m in made]
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.searchsorted(at, offsets)
        for a, b in zip(ends[:-1], ends[1:]):
            own = codes[a:b].tolist()
            yield b"".join([ids[c] for c in own]), b"".join([raw[c] for c in own])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker, until it has been idle for a while."""
    return Codec(path, pattern)


_idle: list[threading.Timer] = []


def _used() -> None:
    while _idle:
        _idle.pop().cancel()


def _unused() -> None:
    """Workers live on after their last task of this kind: drop the codecs then."""
    def drop() -> None:
        codec.cache_clear()
        give_back()
    _used()
    timer = threading.Timer(IDLE_SECONDS, drop)
    timer.daemon = True
    timer.start()
    _idle.append(timer)


@clash_free(lambda a: ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * a["with_ids"]])
def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The documents with n_tokens, ids_sha256 and decoded_sha256, and with the
    ids themselves if asked for; columns named like these are replaced. The text
    column is dropped unless the ids are kept out."""
    named = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    kept = [c for c in docs.columns if c not in named]
    through = [c for c in kept if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _used()
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                n, one, two, lists = [], [], [], []
                for ids, raw in own.encode_texts(part.column(text)):
                    n.append(len(ids) // 4)
                    one.append(hashlib.sha256(ids).hexdigest())
                    two.append(hashlib.sha256(raw).hexdigest())
                    if with_ids:
                        lists.append(np.frombuffer(ids, "<u4").astype(np.int32))
                new = [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
                if with_ids:
                    new.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in through), *new], [*through, *named])
        _unused()

    schema = T.StructType([*(docs.schema[c] for c in through), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
                           *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])
    return docs.select(*kept).mapInArrow(frugal(run), schema)


@clash_free(lambda a: ["decoded"], ("ids",))
def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """The rows with ``decoded``, the bytes of their ids: positions join the
    vocabulary and are aggregated in order. Ids outside the vocabulary and null
    elements give an error; a null list gives null."""
    kept = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            own.con.register("given", pa.table({"n": np.arange(batch.num_rows), "ids": batch.column(ids)}))
            got = own.con.execute("""
                select any_value(g.ids is null) as missing, count(i.pos) as total, count(v.id) as known,
                       coalesce(string_agg(v.hex, '' order by i.pos), '') as hex
                from given g
                left join (select n, unnest(ids) as id, generate_subscripts(ids, 1) as pos from given) i on i.n = g.n
                left join vocabulary v on v.id = i.id
                group by g.n order by g.n""").fetchall()
            own.con.unregister("given")
            if any(total != known for _, total, known, _ in got):
                raise ValueError("an id is not in the vocabulary")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([None if m else bytes.fromhex(h) for m, _, _, h in got], pa.binary())],
                [*kept, "decoded"])

    return rows.select(*kept).mapInArrow(frugal(run), T.StructType([*(rows.schema[c] for c in kept), T.StructField("decoded", T.BinaryType())]))
