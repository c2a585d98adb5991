"""Language-model scores by logistic context mixing.

A text is its lower-cased words, each followed by one space, and an end byte.
Every byte is coded as eight binary choices. Six hashed contexts (none; the
last one to four bytes; the word so far) each predict a bit from how often it
was 0 or 1 before; those counts' levels are turned into log odds by a learned map, the odds are
combined by weights, picked by a gate (the bit's place and how often the word's
and the four bytes' contexts were seen), and an adaptive map (last byte,
quantised odds) refines the result. A text's score is
the sum of log10 of its bits' probabilities.

What is learned, over all training texts:

* counts of tokens, and of the first bytes of words with the four bytes before
  them (with those, later bytes of words depend on the token alone). Both are
  combined in each task and grow with the corpus; they are kept as Parquet;
* from them the bit counts, hashed into tables of a fixed size (``TABLE_BITS``):
  a task counts for one section of the slots, then chunks are summed, in 64 bits;
* maps and weights, by online gradient steps over the same counts in every
  partition, each occurrence predicted without itself; the partitions' weights are
  averaged, the maps' counts summed. The number of partitions follows the number
  of counts, rows are dealt and ordered by hashes: the number of cores plays no part.

Tables and weights have a fixed size and are broadcast. Tokens of the scored texts
are looked up among the most frequent ones (at most ``HEAD``, broadcast); the rest
joins the token counts by a shuffle. A word's score is that of its beginning (up to
four bytes, after the four before them), which a task remembers in a table of a fixed
size, and that of its tail (after four bytes), computed once for every token.

Tokens are told apart by 64-bit hashes. Defined results: null texts are empty (the
end token alone); documents without id are scored but never learned from, and
``held_out`` is false for them; without training texts the base is log10(1) = 0 a
token and the model uninformed. Repeated rows keep their rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.llm.textscan import NOT_SPACE, Words, _power_tables, mix, slices
from reqlens.llm.util import frugal, stored, work_dir

SLICE = 1 << 20
#: bytes whose contexts are computed at once (some 100 bytes of memory each)
PART_BYTES = 1 << 18
#: log2 of the scores that a task remembers: of beginnings, and of bytes in their contexts
BEGINNINGS, BYTES = 20, 20
#: text bytes whose tokens and beginnings are counted at once
COUNT_SLICE = 1 << 22
END = 0xFF  # in no UTF-8 text
LEAD = 4
#: log2 of the slots: no context, 1, 2, 3, 4 bytes, the word so far
TABLE_BITS = (8, 16, 18, 20, 21, 24)
CONTEXTS = len(TABLE_BITS)
HEAD = 1 << 18
#: slots are counted in sections, a task holds one
SECTION = 1 << 22
#: rows for a counting task of a section, and the most such tasks
COUNT_ROWS, COUNT_TASKS = 1_000_000, 64
CHUNK = 1 << 16
#: tokens whose tails a task computes
TAIL_ROWS = 200_000
#: rows that one mixer learns from
LESSON = 50_000
GATES = 8 * 4 * 4
MAP_STEPS = 24
MAP_PRIOR = 32.0
STATE_PRIOR = 4.0
STEP_ROWS = 4096
ODDS_ROWS = 4 * STEP_ROWS
RATE = 0.1
END_TOKEN = int(mix(np.array([0x656E64], np.uint64)).view(np.int64)[0])

_SALT = mix(np.arange(1, CONTEXTS + 1, dtype=np.uint64))
_NODE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_BASE = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS])))


class Stream:
    """The byte stream of a slice of texts: ``LEAD`` end bytes (context only),
    each word and a space, an end byte."""

    def __init__(self, w: Words) -> None:
        self.size = w.end - w.start
        n = len(w.count)
        sums = np.concatenate(([0], np.cumsum(self.size + 1)))
        self.word = sums[:-1] + (LEAD + 1) * w.text_of() + LEAD  # where each word begins
        self.end = sums[w.first[1:]] + (LEAD + 1) * np.arange(1, n + 1) - 1  # of each text's end byte
        begin = sums[w.first[:-1]] + (LEAD + 1) * np.arange(n)
        total = int(sums[-1]) + (LEAD + 1) * n
        self.scored = np.ones(total, bool)
        self.scored[(begin[:, None] + np.arange(LEAD)).ravel()] = False
        inside = self.scored.copy()
        inside[self.end] = inside[self.word + self.size] = False
        self.buf = np.full(total, END, np.uint8)
        self.buf[self.word + self.size] = 0x20
        self.buf[inside] = w.buf[NOT_SPACE[w.buf]]

    def parts(self) -> Iterator[tuple[int, int]]:
        """Ranges of about ``PART_BYTES`` bytes that begin with a word or a text."""
        cuts = np.concatenate((self.word, self.end))
        cuts.sort()
        p = 0
        while p < len(self.buf):
            q = len(self.buf)
            if q - p > 2 * PART_BYTES:
                k = int(np.searchsorted(cuts, p + PART_BYTES))
                q = int(cuts[k]) if k < len(cuts) and cuts[k] > p else q
            yield p, q
            p = q

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, and of each text's end byte: the four bytes before it, then its
        first four (those after its space or end byte are 0), as one integer."""
        eight = np.ndarray(len(self.buf), ">u8", np.concatenate((self.buf, np.zeros(8, np.uint8))), strides=(1,))
        word = eight[self.word - LEAD].astype(np.uint64)
        for size in (1, 2):
            short = np.flatnonzero(self.size == size)
            word[short] &= ~np.uint64((1 << 24 - 8 * size) - 1)
        return word, eight[self.end - LEAD].astype(np.uint64) & ~np.uint64((1 << 24) - 1)

    def rows(self, p: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, last four bytes, hash of the word so far, its length) of
        the scored bytes in p..q."""
        lead = self.buf[max(0, p - LEAD):q]
        if p < LEAD:
            lead = np.concatenate((np.full(LEAD - p, END, np.uint8), lead))
        b = lead.astype(np.uint64)
        n = q - p
        last = b[3:3 + n] | b[2:2 + n] << np.uint64(8) | b[1:1 + n] << np.uint64(16) | b[:n] << np.uint64(24)
        own = lead[LEAD:]
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b[LEAD:] + np.uint64(1)) * up[:n], out=sums[1:])
        at = np.arange(n)
        closed = np.zeros(n, np.int64)  # the word's first byte
        stop = (own[:-1] == 0x20) | (own[:-1] == END)
        closed[1:] = np.where(stop, at[1:], 0)
        np.maximum.accumulate(closed, out=closed)
        word = (sums[:n] - sums[closed]) * down[closed]
        keep = np.flatnonzero(self.scored[p:q])
        return keep + p, last[keep], word[keep], (at - closed)[keep]


def _spelled(beginnings: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which beginning, last four bytes and the next one) of the first bytes, the
    second ones, and so on."""
    which = np.arange(len(beginnings))
    for k in range(LEAD):
        key = (beginnings[which] >> np.uint64(24 - 8 * k)) & np.uint64((1 << 40) - 1)
        yield which, key
        byte = key & np.uint64(255)
        which = which[(byte != 0x20) & (byte != END)]


def _start_rows(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last four bytes, hash of the word so far, byte) of a beginning's key."""
    last = key >> np.uint64(8)
    word = np.zeros(len(key), np.uint64)
    up, _ = _power_tables(8)
    for known in (1, 2, 3):  # the word so far lies within the last bytes
        own = [(last >> np.uint64(8 * k)) & np.uint64(255) for k in range(known + 1)]
        inside = np.all([(o != 0x20) & (o != END) for o in own[:known]], axis=0) & ((own[known] == 0x20) | (own[known] == END))
        value = sum((own[known - 1 - j] + np.uint64(1)) * up[j] for j in range(known))
        word = np.where(inside, value, word)
    return last, word, (key & np.uint64(255)).astype(np.uint8)


def _contexts(last: np.ndarray, word: np.ndarray, wanted: list[int] | None = None) -> list[np.ndarray | None]:
    """The hashed contexts (those wanted)."""
    def hashed(i: int) -> np.ndarray:
        if i == 0:
            return np.zeros(len(last), np.uint64)
        return mix((word if i == CONTEXTS - 1 else last & np.uint64((1 << 8 * i) - 1)) ^ _SALT[i])
    return [hashed(i) if wanted is None or i in wanted else None for i in range(CONTEXTS)]


def _slots(contexts: list[np.ndarray], node: np.ndarray, wanted: list[int] | None = None) -> Iterator[np.ndarray]:
    """Per (wanted) context the place in the tables of the choice ``node``."""
    step = node.astype(np.uint64) * _NODE
    for i in range(CONTEXTS) if wanted is None else wanted:
        c = contexts[i]
        if i == 0:
            yield node.astype(np.int64)
        else:
            yield (((c + step) * _SPREAD) >> np.uint64(64 - TABLE_BITS[i])).astype(np.int64) + int(_BASE[i])


def _choices(byte: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, node, bit) of the eight choices."""
    node = np.ones(len(byte), np.int64)
    for k in range(8):
        bit = (byte >> (7 - k)) & 1
        yield k, node, bit
        node = 2 * node + bit


#: counts are kept in 16 bits: as they are below EXACT, their logarithms above
EXACT = 4096
_FINE = 1500.0
_COUNT = np.where(np.arange(1 << 16) < EXACT, np.arange(1 << 16), EXACT * np.exp((np.arange(1 << 16) - EXACT) / 4000.0))
_LOG = np.log(np.maximum(_COUNT, 1)).astype(np.float32)
_LEVEL = np.searchsorted([1, 2, 3, 4, 6, 9, 16, 32, 128, 1024], _COUNT, side="right").astype(np.uint8)
LEVELS = int(_LEVEL[-1]) + 1
STATES = LEVELS * LEVELS
#: codes below are states; above, the log odds of counts that are all large
DIRECT = 1 << 12


def _kept(count: np.ndarray) -> np.ndarray:
    """Counts in 16 bits."""
    large = EXACT + np.rint(4000.0 * np.log(np.maximum(count, EXACT) / EXACT))
    return np.where(count < EXACT, np.rint(count), np.minimum(large, (1 << 16) - 1)).astype(np.uint16)


def _code(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """What a mixer reads of a slot's counts, given in 16 bits (as integers)."""
    out = _LEVEL[zero].astype(np.int64) * LEVELS + _LEVEL[one]
    large = np.flatnonzero((np.minimum(zero, one) >= 4) & (zero + one >= 32))
    out[large] = DIRECT + ((np.clip(_LOG[one[large]] - _LOG[zero[large]], -16, 16) + 16) * _FINE).astype(np.int64)
    return out


def _first_weights() -> np.ndarray:
    """By gate: the word so far counts most where it was seen before."""
    w = np.zeros((4, 4, 8, CONTEXTS + 1))
    w[0, :, :, 2:5] = 0.35
    w[1:, :, :, 3:6] = 0.2
    w[2:, :, :, 5] = 0.6
    w[3:, :, :, 5], w[3:, :, :, 3:5] = 0.9, 0.05
    return w.reshape(GATES, CONTEXTS + 1)


class Mixer:
    """State maps (what follows when a context has seen so many zeros and ones),
    weights by gate, and the final map; all learned online."""

    def __init__(self, learned: dict[str, np.ndarray] | None = None) -> None:
        self.memory: Remembered | None = None
        if learned is None:
            low = np.array([_COUNT[np.flatnonzero(_LEVEL == i)[0]] for i in range(LEVELS)])
            zero, one = (x.ravel() for x in np.meshgrid(low, low, indexing="ij"))
            middle = 1 / (1 + np.exp(-(np.arange(MAP_STEPS) - (MAP_STEPS - 1) / 2)))
            learned = {
                "weights": _first_weights(), "mass": np.zeros(GATES),
                "seen": np.full((256, MAP_STEPS), MAP_PRIOR), "ones": np.tile(MAP_PRIOR * middle, (256, 1)),
                "state_seen": np.full((CONTEXTS * 8, STATES), STATE_PRIOR),
                "state_ones": np.tile(STATE_PRIOR * (one + 0.1) / (zero + one + 0.2), (CONTEXTS * 8, 1))}
        self.learned = learned
        self.__dict__.update(learned)
        self.code_odds = np.empty((CONTEXTS * 8, 1 << 16), np.float32)
        self.code_odds[:, DIRECT:] = (np.arange(DIRECT, 1 << 16) - DIRECT + 0.5) / _FINE - 16
        self.odds()

    def odds(self) -> None:
        p = np.clip(self.state_ones / self.state_seen, 1e-5, 1 - 1e-5)
        self.code_odds[:, :STATES] = np.log(p / (1 - p))

    def mixed(self, codes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, gate, log odds of a 1) from the codes of the contexts."""
        x = np.empty((CONTEXTS + 1, len(codes[0])))
        x[-1] = 1
        for i, s in enumerate(codes):
            x[i] = self.code_odds[i * 8 + k][s]
        word, four = (_STRENGTH[codes[i]] for i in (CONTEXTS - 1, CONTEXTS - 2))
        gate = (word * 4 + four) * 8 + k
        z = np.zeros(len(gate))
        for i in range(CONTEXTS + 1):
            z += x[i] * self.weights[:, i][gate]
        return x, gate, np.clip(z, -20, 20)

    def refined(self, z: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Probability of a 1."""
        byte, low, part = self.place(z, last)
        mapped = (1 - part) * self.ones[byte, low] / self.seen[byte, low] \
            + part * self.ones[byte, low + 1] / self.seen[byte, low + 1]
        return np.clip(0.5 / (1 + np.exp(-z)) + 0.5 * mapped, 1e-6, 1 - 1e-6)

    @staticmethod
    def place(z: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip(z + (MAP_STEPS - 1) / 2, 0, MAP_STEPS - 1.001)
        low = at.astype(np.int64)
        return (last & np.uint64(255)).astype(np.int64), low, at - low

    def learn(self, codes: np.ndarray, last: np.ndarray, word: np.ndarray, byte: np.ndarray, times: np.ndarray) -> None:
        """One online pass over contexts and the bytes that followed; each
        occurrence is taken out of the counts that predict it (:func:`left_out`)."""
        for at in range(0, len(last), STEP_ROWS):
            own = slice(at, at + STEP_ROWS)
            contexts, n = _contexts(last[own], word[own]), times[own].astype(np.float64)
            for k, node, bit in _choices(byte[own].astype(np.int64)):
                states = [codes[2 * s + bit].astype(np.int64) for s in _slots(contexts, node)]
                x, gate, z = self.mixed(states, k)
                error = (bit - 1 / (1 + np.exp(-z))) * n
                mass = np.bincount(gate, n, GATES)
                self.mass += mass
                for i in range(CONTEXTS + 1):
                    self.weights[:, i] += RATE * np.bincount(gate, error * x[i], GATES) / np.maximum(mass, 1e-9)
                ones = n * bit
                for i, s in enumerate(states):
                    few = np.flatnonzero(s < STATES)
                    own_state, own_n = s[few], n[few]
                    self.state_seen[i * 8 + k] += np.bincount(own_state, own_n, STATES)
                    self.state_ones[i * 8 + k] += np.bincount(own_state, ones[few], STATES)
                c, low, part = self.place(z, last[own])
                for to, share in ((c * MAP_STEPS + low, 1 - part), (c * MAP_STEPS + low + 1, part)):
                    self.seen += np.bincount(to, n * share, self.seen.size).reshape(self.seen.shape)
                    self.ones += np.bincount(to, n * share * bit, self.ones.size).reshape(self.ones.shape)
            if at % ODDS_ROWS == 0:
                self.odds()

    def remembered(self, table: np.ndarray, last: np.ndarray, word: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``log10``, computed once for each byte in its context while the
        mixer remembers it."""
        if self.memory is None:
            self.memory = Remembered(BYTES)
        return self.memory.get(mix(mix(last ^ word * _SPREAD) + byte), lambda own: self.log10(table, last[own], word[own], byte[own]))

    def log10(self, table: np.ndarray, last: np.ndarray, word: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """log10 of the probability of each byte, by the slots' codes."""
        out = np.ones(len(last))  # eight factors of 1e-6 at least
        for at in range(0, len(last), 1 << 15):
            own = slice(at, at + (1 << 15))
            contexts = _contexts(last[own], word[own])
            for k, node, bit in _choices(byte[own].astype(np.int64)):
                p = self.refined(self.mixed([table[s].astype(np.int64) for s in _slots(contexts, node)], k)[2], last[own])
                out[own] *= np.where(bit == 1, p, 1 - p)
        return np.log10(out)


#: how often a slot of this code was seen: never, 1 or 2 times, some, many times
_STRENGTH = np.full(1 << 16, 3, np.int64)
_STRENGTH[:STATES] = np.searchsorted([1, 3, 8], np.arange(STATES) // LEVELS + np.arange(STATES) % LEVELS, side="right")


class Remembered:
    """The last values computed for 64-bit keys, one for each slot of a table of
    ``2**bits``."""

    def __init__(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits)
        self.keys[0] = ~np.uint64(0)  # key 0 belongs to slot 0: none is known

    def get(self, keys: np.ndarray, compute: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The keys' values; ``compute`` gives those at the places it gets."""
        slots = ((keys * _NODE) >> self.shift).astype(np.int64)
        out = self.values[slots]
        lost = np.flatnonzero(self.keys[slots] != keys)
        if len(lost):
            _, first, of = np.unique(keys[lost], return_index=True, return_inverse=True)
            own = lost[first]
            values = compute(own)
            out[lost] = values[of]
            order = np.unique(slots[own], return_index=True)[1]  # one for each slot
            own = own[order]
            self.keys[slots[own]], self.values[slots[own]] = keys[own], values[order]
        return out


def left_out(tables: np.ndarray) -> np.ndarray:
    """The codes of every slot without one 0, and without one 1, side by side: what
    predicts an occurrence, if its count is exact."""
    out = np.empty((tables.shape[1], 2), np.uint16)
    for at in range(0, len(out), 1 << 18):
        zero, one = (t[at:at + (1 << 18)].astype(np.int64) for t in tables)
        out[at:at + (1 << 18), 0] = _code(zero - ((zero > 0) & (zero < EXACT)), one)
        out[at:at + (1 << 18), 1] = _code(zero, one - ((one > 0) & (one < EXACT)))
    return out.ravel()


def slot_codes(tables: np.ndarray) -> np.ndarray:
    """The code of every slot (two bytes)."""
    out = np.empty(tables.shape[1], np.uint16)
    for at in range(0, len(out), 1 << 18):
        out[at:at + (1 << 18)] = _code(*(t[at:at + (1 << 18)].astype(np.int64) for t in tables))
    return out


def _tokens_at(w: Words, which: np.ndarray) -> pa.Array:
    """The words of these numbers."""
    if not len(which):
        return pa.array([], pa.binary())
    ends = np.column_stack((w.start, w.end)).astype(np.int32).ravel()  # words and what lies between them
    parts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(w.buf))])
    return parts.take(pa.array(2 * which))


def _token_counts(docs: DataFrame) -> DataFrame:
    """(hash, token, c, n) of the words of ``text``: how often they occur in texts of
    which ``training`` holds, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = batch.column("training")
            for own, share in ((learned, 1), (pc.invert(learned), 0)):
                for part in slices(batch.filter(own), "text", COUNT_SLICE):
                    w = Words(part.column("text"), NOT_SPACE)
                    h, first, n = np.unique(w.hashes(), return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), _tokens_at(w, first), pa.array(n * share), pa.array(n)],
                                                     ["hash", "token", "c", "n"])

    return docs.mapInArrow(frugal(run), "hash bigint, token binary, c bigint, n bigint") \
        .groupBy("hash", "token").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def _start_counts(docs: DataFrame) -> DataFrame:
    """(key, c): last four bytes and next byte where fewer than four bytes of
    the word are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", COUNT_SLICE):
                begun = np.concatenate(Stream(Words(part.column("text"), NOT_SPACE)).beginnings())
                key, n = np.unique(np.concatenate([k for _, k in _spelled(begun)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "c"])

    return docs.mapInArrow(frugal(run), "key bigint, c bigint").groupBy("key").agg(F.sum("c").alias("c"))


def _learning_rows(batch: pa.RecordBatch, limit: int = 20_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(last four bytes, hash of the word so far, byte, count) from stored
    counts: a key's own, or those of a token after its first four bytes."""
    for begin in range(0, batch.num_rows, limit):
        part = batch.slice(begin, limit)
        times = part.column("c").to_numpy()
        keys = part.column("key")
        starts = np.asarray(keys.is_valid())
        if starts.any():
            yield *_start_rows(keys.filter(keys.is_valid()).to_numpy().view(np.uint64)), times[starts]
        if not starts.all():
            tokens = part.column("token").filter(pa.array(~starts))
            w = Words(pa.array([b" ".join(tokens.to_pylist())], pa.binary()), NOT_SPACE, lower=False)
            stream = Stream(w)
            for p, q in stream.parts():
                at, last, word, known = stream.rows(p, q)
                far = known >= LEAD
                of = np.searchsorted(stream.word, at[far], side="right") - 1
                yield last[far], word[far], stream.buf[at[far]], times[~starts][of]


def _bit_tables(rows: DataFrame, n_rows: int) -> np.ndarray:
    """The counts of zeros and of ones in every slot, in 16 bits."""
    size = int(_BASE[-1])
    sections = -(-size // SECTION)
    tasks = min(max(1, -(-n_rows // COUNT_ROWS)), COUNT_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}  # one at a time: rows come ordered by section
        for batch in batches:
            section = batch.column("section").to_numpy()
            for own in np.unique(section).tolist():
                if own not in tables:
                    yield from emptied(tables)
                    tables[own] = np.zeros(2 * SECTION, np.int64)
                table, low = tables[own], own * SECTION
                wanted = [i for i in range(CONTEXTS) if _BASE[i] < low + SECTION and _BASE[i + 1] > low]
                for last, word, byte, n in _learning_rows(batch.filter(pa.array(section == own))):
                    contexts, n = _contexts(last, word, wanted), n.astype(np.int64)
                    for _, node, bit in _choices(byte.astype(np.int64)):
                        for s in _slots(contexts, node, wanted):
                            place = s + (bit * SECTION - low)
                            inside = np.flatnonzero((s >= low) & (s < low + SECTION))
                            if len(inside) == len(s):
                                np.add.at(table, place, n)
                            else:
                                np.add.at(table, place[inside], n[inside])
        yield from emptied(tables)

    def emptied(tables: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        while tables:
            own, table = tables.popitem()
            table = table.reshape(2, SECTION)
            for c in range(0, min(SECTION, size - own * SECTION), CHUNK):
                part = np.ascontiguousarray(table[:, c:c + CHUNK])
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([own * SECTION + c]), pa.array([_packed(part)], pa.binary())],
                                                     ["chunk", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(_unpacked(x.as_py(), np.int64) for x in group.column("counts"))
        return pa.table({"chunk": group.column("chunk")[:1], "counts": pa.array([_kept(total.astype(np.float64)).tobytes()], pa.binary())})

    schema = "chunk bigint, counts binary"
    # all rows go to the tasks of every section: tokens and beginnings, not texts
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "token"), F.lit(tasks))) \
        .withColumn("section", F.explode(F.sequence(F.lit(0), F.lit(sections - 1)))) \
        .repartition(4 * sections * tasks, "section", "bucket").sortWithinPartitions("section")
    chunks = dealt.mapInArrow(frugal(count), schema).groupBy("chunk").applyInArrow(add, schema)
    out = np.zeros((2, size), np.uint16)
    for r in chunks.toLocalIterator():  # a fixed size in all
        counts = np.frombuffer(r["counts"], np.uint16).reshape(2, -1)
        width = min(CHUNK, size - r["chunk"])
        out[:, r["chunk"]:r["chunk"] + width] = counts[:, :width]
    return out


class Known:
    """Places of 64-bit keys: found by one look at a table of slots; where keys
    share a slot, by a search."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys  # sorted
        self.shift = np.uint64(64 - max(4, (2 * len(keys)).bit_length()))
        slots = self.slot(keys)
        self.at = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.at[slots] = np.arange(len(keys))
        self.shared = np.bincount(slots, minlength=len(self.at)) > 1

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _NODE) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether the key is known); places of unknown keys mean nothing."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        slots = self.slot(keys)
        at = self.at[slots]
        found = self.keys[at] == keys
        lost = np.flatnonzero(~found)
        lost = lost[self.shared[slots[lost]]]
        if len(lost):
            again = np.minimum(np.searchsorted(self.keys, keys[lost]), len(self.keys) - 1)
            at[lost], found[lost] = again, self.keys[again] == keys[lost]
        return at, found


def _tails(m: Mixer, table: np.ndarray, tokens: pa.Array) -> np.ndarray:
    """Of each token log10 of the bytes (and the space) that follow its first
    four: they depend on the token alone."""
    stream = Stream(Words(pa.array([b" ".join(tokens.to_pylist())], pa.binary()), NOT_SPACE, lower=False))
    out = np.zeros(len(stream.word))
    for p, q in stream.parts():
        at, last, word, known = stream.rows(p, q)
        far = known >= LEAD
        of = np.searchsorted(stream.word, at[far], side="right") - 1
        out += np.bincount(of, m.remembered(table, last[far], word[far], stream.buf[at[far]]), len(out))
    return out


class Beginnings:
    """What the model gives the beginnings of words: frequent bytes of them are looked
    up, others computed; the sum is remembered."""

    def __init__(self, m: Mixer, table: np.ndarray, keys: np.ndarray, values: np.ndarray) -> None:
        self.m, self.table = m, table
        self.known, self.values = Known(keys), values
        self.memory = Remembered(BEGINNINGS)

    def scores(self, begun: np.ndarray) -> np.ndarray:
        """Of beginnings as ``Stream.beginnings`` gives them."""
        return self.memory.get(begun, lambda own: self.spelled(begun[own]))

    def spelled(self, begun: np.ndarray) -> np.ndarray:
        out = np.zeros(len(begun))
        for which, key in _spelled(begun):
            j, found = self.known.find(key)
            value = self.values[j] if len(self.values) else np.zeros(len(j))
            rest = np.flatnonzero(~found)
            value[rest] = self.m.remembered(self.table, *_start_rows(key[rest]))
            out[which] += value
        return out


def _start_scores(rows: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log10), by key: of the bytes that follow four what the model gives them;
    ``rows`` are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, fitted = shared.value
        m, table = Mixer(fitted), _unpacked(packed)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                value = m.log10(table, *_start_rows(part.column("key").to_numpy().view(np.uint64)))
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(value)], ["key", "value"])

    got = rows.mapInArrow(frugal(run), "key bigint, value double").toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("value").to_numpy()[order]


def _tail_scores(tokens: DataFrame, shared) -> DataFrame:
    """(hash, c, n, tail) of (hash, token, c, n): log10 of what follows the token's first four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, fitted = shared.value
        m, table = Mixer(fitted), _unpacked(packed)
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                tail = pa.array(_tails(m, table, part.column("token")))
                yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("c"), part.column("n"), tail], ["hash", "c", "n", "tail"])

    return tokens.mapInArrow(frugal(run), "hash bigint, c bigint, n bigint, tail double")


def _frequent(counts: DataFrame, count: str) -> int:
    """The least count of the frequent ones: as many powers of two as ``HEAD`` rows hold."""
    sizes = counts.groupBy(F.floor(F.log2(count)).alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    least, total = 1 << 62, 0
    for r in sizes:
        total += r["n"]
        if total > HEAD:
            break
        least = 1 << r["k"]
    return least


def _packed(table: np.ndarray) -> bytes:
    """Most slots of a small corpus are empty. The size comes first."""
    return table.nbytes.to_bytes(8, "little") + pa.compress(np.ascontiguousarray(table), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, dtype: type = np.uint16) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), "zstd"), dtype)


def _fit(rows: DataFrame, tables: np.ndarray) -> dict[str, np.ndarray]:
    """What the mixers learned in all partitions: weights averaged by how much
    each gate was used, counts summed."""
    shared = rows.sparkSession.sparkContext.broadcast(_packed(left_out(tables)))
    begin = Mixer().learned
    sizes = {k: v.size for k, v in begin.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, codes = Mixer({k: v.copy() for k, v in begin.items()}), _unpacked(shared.value)
        for batch in batches:
            for part in _learning_rows(batch):
                mixed = np.random.default_rng(len(part[0])).permutation(len(part[0]))
                m.learn(codes, *(x[mixed] for x in part))
        values = np.concatenate([(m.weights * m.mass[:, None] if k == "weights" else m.learned[k] - begin[k]).ravel() for k in sizes])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["i", "v"])

    got = rows.mapInArrow(frugal(run), "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().sort_by("i")
    shared.destroy()
    if not got.num_rows:
        return begin
    split = np.split(got.column("v").to_numpy(), np.cumsum(list(sizes.values()))[:-1])
    total = {k: v.reshape(begin[k].shape) for k, v in zip(sizes, split)}
    out = {k: total[k] + begin[k] for k in sizes}
    mass = total["mass"][:, None]
    out["weights"] = np.where(mass > 0, total["weights"] / np.maximum(mass, 1e-9), begin["weights"])
    return out


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row;
    the model is learned from the rows where ``training`` holds."""
    folder = work_dir(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    tokens = stored(_token_counts(texts), folder, "tokens")
    starts = stored(_start_counts(texts.where("training").select("text")), folder, "starts")
    n_texts = texts.where("training").count()
    words, kinds, every = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.count("*")).first()
    n, v = words + n_texts, kinds + (n_texts > 0)
    unseen = math.log10(n + v + 1)

    rows = starts.select("key", F.lit(None).cast("binary").alias("token"), "c") \
        .unionByName(tokens.where((F.octet_length("token") >= LEAD) & (F.col("c") > 0)).select(F.lit(None).cast("bigint").alias("key"), "token", "c"))
    n_rows = rows.count()
    tables = _bit_tables(rows, n_rows)
    order = F.xxhash64("key", "token")
    lessons = rows.repartition(max(1, -(-n_rows // LESSON)), order).sortWithinPartitions(order, "key", "token")
    fitted = _fit(lessons, tables)

    # what the model gives tokens and frequent beginnings is computed once
    model = context.broadcast((_packed(slot_codes(tables)), fitted))
    spread = context.defaultParallelism
    alone = tokens.groupBy("hash").agg(F.min("token").alias("token"), F.sum("c").alias("c"), F.sum("n").alias("n"))
    tails = stored(_tail_scores(alone.repartition(max(spread, -(-every // TAIL_ROWS)), "hash"), model), folder, "tails")
    least = _frequent(tails, "n")
    head = tails.where(F.col("n") >= least).select("hash", "c", "tail").toArrow()
    hashes = head.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, logs, head_tails = hashes[order], np.log10(head.column("c").to_numpy()[order] + 1.0), head.column("tail").to_numpy()[order]
    begins, begin_scores = _start_scores(starts.where(F.col("c") >= _frequent(starts, "c")).select("key").repartition(spread, "key"), model)
    shared = context.broadcast((hashes, logs, head_tails, begins, begin_scores, n_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (packed, fitted), (hashes, head_logs, head_tails, begins, begin_scores, n_texts) = model.value, shared.value
        known, begun = Known(hashes), Beginnings(Mixer(fitted), _unpacked(packed), begins, begin_scores)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                w = Words(part.column("text"), NOT_SPACE)
                h = w.hashes()
                i, found = known.find(h)
                starting, ending = Stream(w).beginnings()
                value = begun.scores(starting)
                value += np.where(found, head_tails[i] if len(head_tails) else 0.0, 0.0)
                sums = np.concatenate(([0.0], np.cumsum(value)))
                total = sums[w.first[1:]] - sums[w.first[:-1]] + begun.scores(ending)
                h = h.view(np.int64)
                log = np.where(found, head_logs[i] if len(head_logs) else 0.0, 0.0)
                logs = np.concatenate(([0.0], np.cumsum(log)))
                n_found = np.concatenate(([0], np.cumsum(log > 0)))  # those counted in training
                rest = np.flatnonzero(~found)
                ends = np.searchsorted(rest, w.first)
                end_log = math.log10(n_texts + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(w.count + 1, pa.int64()),
                     pa.array(np.diff(n_found[w.first]) + (n_texts > 0), pa.int64()),
                     pa.array(logs[w.first[1:]] - logs[w.first[:-1]] + end_log), pa.array(total),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[rest]))],
                    ["doc_id", "n_tokens", "n_known", "logs", "score", "rest"])

    first = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .mapInArrow(frugal(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_tokens bigint, n_known bigint, "
                         "logs double, score double, rest array<bigint>")
    first = stored(first.withColumn("row", F.monotonically_increasing_id()), folder, "scored")
    rest = first.select("row", F.explode("rest").alias("hash")).join(tails.where(F.col("n") < least), "hash") \
        .groupBy("row").agg(F.count(F.when(F.col("c") > 0, 1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("more_logs"),
                            F.sum("tail").alias("more_score"))
    return first.drop("rest").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * unseen).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
