"""Operators over whole corpora against brute force: duplicates of all kinds,
null and empty texts, null ids, repeated rows, extra columns, empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.llm import graph, line_dedup, lm_score, near_dedup, substring_dedup
from reqlens.llm.util import remainder, work_dir

SCHEMA = "doc_id bigint, text string, kept string, node string"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus(seed=1, n=40):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeéüABC") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = say(45), say(80)
    docs = []
    for i in range(n):
        t = say(r.randint(0, 90))
        if i % 4 == 0:
            t[10:10] = passage[r.randint(0, 10):r.randint(30, 45)]
        if i % 5 == 0:
            t = list(base)
            for _ in range(r.randint(0, 6)):
                t[r.randrange(len(t))] = r.choice(vocabulary)
        lines = "".join(w + r.choice([" ", " ", " ", "\n", "  "]) for w in t)
        docs.append((i, lines))
    docs += [(100, docs[0][1]), (101, docs[0][1].upper()), (102, None), (103, ""), (104, " \n "), (105, "De " * 200),
             (106, "one two"), (107, "One\ttwo"), (108, "De " * 30), (3, docs[3][1])]
    r.shuffle(docs)
    return docs


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def jaccard_components(docs):
    sets = []
    for _, t in docs:
        w = words(low(t))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 75 * (len(a) + len(sets[j]) - common):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(d, least.get(top(i), d))
    return [len(s) for s in sets], [least[top(i)] for i in range(len(docs))]


def test_near_duplicates_brute_force(spark):
    docs = corpus()
    got = near_dedup.near_duplicates(table(spark, docs + [(None, docs[0][1]), (None, None)])).collect()
    assert len(got) == len(docs) + 2
    by_id = {r.doc_id: r for r in got}
    for (d, _), n, c in zip(docs, *jaccard_components(docs)):
        assert (by_id[d].n_shingles, by_id[d].component_id, by_id[d].kept) == (n, c, d == c)
    assert by_id[None].component_id is None
    kept = near_dedup.deduplicate(table(spark, docs + [(None, docs[0][1])]))
    assert kept.columns == ["doc_id", "text", "kept", "node"]
    expected = sorted(d for (d, _), c in zip(docs, jaccard_components(docs)[1]) if d == c)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == expected


def test_near_duplicates_across_cells(spark, monkeypatch):
    """A group whose first document isn't like all others: the rest is compared
    in several cells."""
    monkeypatch.setattr(near_dedup, "PART", 4)
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(60):
        t = list(base)
        for _ in range(r.choice([0, 1, 2, 4, 6, 8])):
            t[r.randrange(len(t))] = f"x{r.randint(0, 10**6)}"
        docs.append((i, " ".join(t)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, docs)).collect()}
    assert [got[d] for d, _ in docs] == jaccard_components(docs)[1]
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_small_sets_skip_the_estimate(spark):
    """Registers that agree nowhere rule out a pair of large sets only."""
    unlike = [np.full(near_dedup.BUCKETS, k, np.uint16).tobytes() for k in range(4)]
    nodes = spark.createDataFrame([(b"a", bytearray(unlike[0]), 3), (b"b", bytearray(unlike[1]), 4),
                                   (b"c", bytearray(unlike[2]), 500), (b"d", bytearray(unlike[3]), 600)],
                                  "node binary, registers binary, n_shingles bigint")
    pairs = spark.createDataFrame([(b"a", b"b"), (b"c", b"d"), (b"a", b"c")], "a binary, b binary")
    got = {(bytes(r.a), bytes(r.b)) for r in near_dedup._likely(pairs, nodes, 0.75).collect()}
    assert got == {(b"a", b"b"), (b"a", b"c")}


def test_registers_estimate_similarity():
    r = np.random.default_rng(1)
    for n, share in ((4, 0.75), (40, 0.8), (2000, 0.5), (2000, 0.9)):
        common = int(2 * n * share / (1 + share))
        pool = r.integers(0, 1 << 63, size=2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:common], pool[n:2 * n - common])))
        true = common / (2 * n - common)
        x, y = near_dedup.registers([a, b, np.empty(0, np.uint64)])[:2]
        assert abs(near_dedup.estimate(x, y) - true) < 0.25
    assert not near_dedup.registers([np.empty(0, np.uint64)]).any()


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(500, k) for k in range(400, 440)] + [(7, 7), (None, 3)]
    edges += [(k, k + 1) for k in range(600, 640)]
    got = {x.node: x.label for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), work_dir(spark)).collect()}
    root = {}

    def top(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    assert got == {k: top(k) for k in root}


def test_substring_dedup_brute_force(spark):
    docs = corpus(2)
    texts = dict(docs)
    first, gone = {}, {d: set() for d in texts}
    for d in sorted(texts):
        w = words(texts[d])
        for s in range(len(w) - 19):
            if first.setdefault(tuple(w[s:s + 20]), (d, s)) != (d, s):
                gone[d] |= set(range(s, s + 20))
    assert sum(map(len, gone.values())) > 300
    got = substring_dedup.strip(table(spark, docs + [(None, docs[0][1])])).collect()
    assert len(got) == len(docs) + 1
    for x in got:
        if x.doc_id is None:
            assert x.n_removed == 0
            continue
        w = words(texts[x.doc_id])
        left = " ".join(t for k, t in enumerate(w) if k not in gone[x.doc_id])
        assert (x.n_words, x.n_removed, bytes(x.kept).decode()) == (len(w), len(gone[x.doc_id]), left)
        assert x.node == "y"
    assert substring_dedup.strip(table(spark, [])).count() == 0


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def changed(r, line, edits):
    b = bytearray(line)
    for _ in range(edits):
        k, kind = r.randrange(len(b)), r.randrange(3)
        if kind == 0:
            b.insert(k, r.choice(b"xyz"))
        elif kind == 1 and len(b) > 1:
            del b[k]
        else:
            b[k] = r.choice(b"xyz")
    return bytes(b)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_banded_distance(threshold):
    r = random.Random(threshold)
    pairs = []
    for _ in range(600):
        x = bytes(r.choice(b"ab c") for _ in range(r.randint(1, 90)))
        x, y = sorted((x, changed(r, x, r.randint(0, 4)) if r.random() < 0.7 else bytes(r.choice(b"ab c") for _ in x)), key=len)
        if len(y) - len(x) <= threshold:
            pairs.append((x, y))
    got = line_dedup.within([x for x, _ in pairs], [y for _, y in pairs], threshold)
    assert got.tolist() == [distance(x, y) <= threshold for x, y in pairs] and 0 < got.sum() < len(got)


def test_line_dedup_brute_force(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PART", 8)
    r = random.Random(6)
    bases = [bytes(r.choice(b"abcdefgh ") for _ in range(n)) for n in [*range(1, 41), *range(42, 62, 4)]]
    lines = [changed(r, r.choice(bases), r.choice([0, 0, 1, 1, 2, 3, 5])).decode() for _ in range(400)]
    docs = [(i, "\n".join(lines[i * 5:i * 5 + 5])) for i in range(80)]
    docs += [(140, None), (141, ""), (142, "\n\n" + lines[0] + "\n"), (143, "short\nshort"), (144, "y" * 200_000), (145, "z" + "y" * 200_000)]
    all_lines = sorted({x for _, t in docs for x in (t or "").split("\n") if x})
    root = {x: x for x in all_lines}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(all_lines):
        for y in all_lines[:i]:
            limit = min(len(x) // 8, len(y) // 8, 2)
            if abs(len(x) - len(y)) <= limit and (len(x) > 1000 or distance(x.encode(), y.encode()) <= limit):
                root[top(x)] = top(y)
    seen, expected = set(), {}
    for d, t in docs:
        out = []
        for x in (t or "").split("\n"):
            if not x or top(x) not in seen:
                out.append(x)
            if x:
                seen.add(top(x))
        expected[d] = None if t is None else "\n".join(out)
    got = line_dedup.strip_lines(table(spark, docs + [(None, lines[0])]), counts=True).collect()
    assert len(got) == len(docs) + 1
    for x in got:
        if x.doc_id is not None:
            assert x.text == expected[x.doc_id] and x.node == "y"
            assert x.n_removed == (0 if x.text is None else dict(docs)[x.doc_id].count("\n") - x.text.count("\n") + (x.text == "" != dict(docs)[x.doc_id]))
    assert line_dedup.strip_lines(table(spark, [])).count() == 0


def test_short_lines(spark, tmp_path):
    """The query and the pipeline's stage drop repeats of lines of any length."""
    import corpus_pipeline
    from reqlens.llm.queries import QUERIES
    menu, long = "Read more", "a line that is long enough to be compared by edits"
    docs = [(1, f"{menu}\nReed more\n\n{long}\nMenu"), (2, f"x\n{menu}\nMenü\n\n{long[:-1]}"), (3, "短行\n短行\nx"), (None, menu), (4, None)]
    expected = {1: f"{menu}\n\n{long}\nMenu", 2: "x\nMenü\n", 3: "短行", 4: None}
    df = table(spark, docs)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, df, "").collect()}
    assert got == {**expected, None: menu}
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: (r.n_removed, r.n_near) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert rows == {1: (1, 1), 2: (2, 1), 3: (2, 0), 4: (0, 0), None: (0, 0)}
    assert {(r.doc_id, r.number) for r in line_dedup.removed_lines(df.select("doc_id", "text").where("doc_id is not null")).collect()} \
        == {(1, 1), (2, 1), (2, 4), (3, 1), (3, 2)}


def test_line_bundles_hold_about_so_many_rows(spark):
    """2,000 lines of one key in 200 parts are 400,000 rows of cells."""
    lines = spark.range(2000).withColumnRenamed("id", "line")
    dealt = lines.select(F.lit(7).cast("bigint").alias("key"), "line", F.lit(True).alias("own"),
                         F.lit(200).cast("bigint").alias("parts"), F.pmod("line", F.lit(200).cast("bigint")).alias("part"))
    cells = line_dedup._cells(dealt, lines.select("line", F.col("line").cast("string").cast("binary").alias("raw")))
    sizes = [r["count"] for r in cells.groupBy("bundle").count().collect()]
    assert sum(sizes) == 400_000 and max(sizes) < 2 * line_dedup.BUNDLE
    groups = [np.arange(900)] * 7
    assert [len(b) for b in line_dedup._batches(groups)] == [3, 3, 1]


def test_lm_scores(spark):
    docs = corpus(3, 60) + [(None, "De De")]
    fold = remainder("doc_id", 7)
    got = lm_score.score(table(spark, docs), (fold >= 0) & (fold != 2)).collect()
    assert len(got) == len(docs)
    counts, texts = Counter(), 0
    for d, t in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(words(low(t)))
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + 1
    by_id = {r.doc_id: r for r in got}
    for d, t in docs:
        w, x = words(low(t)), by_id[d]
        base = sum(math.log10((counts[k] + 1) / (n + v + 1)) for k in w) + math.log10((texts + 1) / (n + v + 1))
        assert abs(x.base_score - base) < 1e-6 * abs(base)
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w) + 1, sum(counts[k] > 0 for k in w) + 1, n)
        assert x.score < 0
    # equal sequences of words have equal scores
    assert math.isclose(by_id[106].score, by_id[107].score, rel_tol=1e-9)
    empty = lm_score.score(table(spark, docs[:5]), F.lit(False)).collect()
    assert len(empty) == 5 and all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in empty)
    assert lm_score.score(table(spark, []), F.lit(True)).count() == 0


def test_lm_probabilities_sum_to_one():
    """The eight choices of a byte share out all probability."""
    r = np.random.default_rng(2)
    m = lm_score.Mixer()
    codes = r.integers(0, lm_score.STATES, size=int(lm_score._BASE[-1])).astype(np.uint16)
    every = np.arange(256, dtype=np.uint8)
    last = np.full(256, 0x74686520, np.uint64)
    p = 10 ** m.log10(codes, last, np.full(256, 77, np.uint64), every)
    assert math.isclose(p.sum(), 1.0, rel_tol=1e-9)


def test_lm_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Rows dealt otherwise, and lessons of a few rows, give the same scores."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]
    rows = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(80)]
    monkeypatch.setattr(lm_score, "LESSON", 100)

    def scores(df):
        return {x.doc_id: x.score for x in lm_score.score(df, F.col("doc_id") % 7 != 2).collect()}
    one = scores(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    r.shuffle(rows)
    other = scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    assert set(one) == set(other) and all(abs(one[i] - other[i]) <= 1e-9 * abs(one[i]) for i in one)


def test_slots_count_in_64_bits(spark):
    """A count beyond 2**24 still takes one more; sections give what one table would."""
    big = (1 << 24) + 1
    rows = spark.createDataFrame([(int.from_bytes(b" \xff\xff\xffa", "big"), None, big), (None, b"abcdefg", 3), (None, b"abcdxyz", 2)],
                                 "key bigint, token binary, c bigint")
    tables = lm_score._bit_tables(rows, 3)
    exact = np.zeros(tables.shape, np.int64)
    for last, word, byte, n in lm_score._learning_rows(rows.toArrow().combine_chunks().to_batches()[0]):
        contexts = lm_score._contexts(last, word)
        for _, node, bit in lm_score._choices(byte.astype(np.int64)):
            for s in lm_score._slots(contexts, node):
                np.add.at(exact, (bit, s), n)
    assert exact.max() >= big and (tables == lm_score._kept(exact.astype(np.float64))).all()


def test_lm_scores_by_token_equal_scores_by_byte(spark, monkeypatch):
    """Frequent tokens and beginnings are scored once and looked up; without any
    (``HEAD`` 0) every byte is scored where it stands."""
    rows = [(i, t) for i, t in enumerate(["the older house the river", "a bb ccc dddd eeeee", "", None, "unseen-word THE", "été über the"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for head in (lm_score.HEAD, 8, 0):
        monkeypatch.setattr(lm_score, "HEAD", head)
        found.append({r.doc_id: tuple(r)[1:] for r in lm_score.score(docs, F.col("doc_id") % 3 != 1).collect()})
    for other in found[1:]:
        assert all(found[0][k] == pytest.approx(other[k], rel=1e-9) for k in found[0]) and len(other) == len(rows)


def test_known_keys_that_share_slots():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    known = lm_score.Known(keys)
    assert known.shared.any()
    at, found = known.find(np.concatenate((keys[::-1], keys + np.uint64(1))))
    assert found[:len(keys)].all() and (at[:len(keys)] == np.arange(len(keys))[::-1]).all()
    assert (found[len(keys):] == np.isin(keys + np.uint64(1), keys)).all()


def test_lm_codes_without_one_occurrence():
    """What predicts an occurrence while learning is read from one table: the counts but for that one."""
    r = np.random.default_rng(3)
    tables = r.choice(np.array([0, 1, 2, 5, 40, lm_score.EXACT - 1, lm_score.EXACT, 60_000], np.uint16), size=(2, 500))
    codes = lm_score.left_out(tables)
    for slot in range(500):
        for bit in (0, 1):
            counts = tables[:, slot].astype(np.int64)
            if 0 < counts[bit] < lm_score.EXACT:
                counts[bit] -= 1
            assert codes[2 * slot + bit] == lm_score._code(counts[:1], counts[1:])[0]


def test_lm_beginnings_are_scored_once():
    """Beginnings of words hold the bytes that depend on the text before; the model is
    asked once for each byte in its context, and not again for words it remembers."""
    texts = ["the a of été theory", "", "a bb ccc dddd eeeee", "the a of the a"] * 3
    stream = lm_score.Stream(lm_score.Words(lm_score.pa.array(texts), lm_score.NOT_SPACE))
    at, last, word, known = stream.rows(0, len(stream.buf))
    near = known < lm_score.LEAD
    expected = Counter(zip(last[near].tolist(), word[near].tolist(), stream.buf[at[near]].tolist()))
    words_begun, ended = stream.beginnings()
    begun = np.concatenate((words_begun, ended))
    found, asked = Counter(), []
    for _, key in lm_score._spelled(begun):
        found.update(zip(*(x.tolist() for x in lm_score._start_rows(key))))
    assert found == expected

    class Asked(lm_score.Mixer):
        def log10(self, table, last, word, byte):
            asked.extend(zip(last.tolist(), word.tolist(), byte.tolist()))
            return super().log10(table, last, word, byte)

    table = np.random.default_rng(4).integers(0, lm_score.STATES, size=int(lm_score._BASE[-1])).astype(np.uint16)
    m, nothing = Asked(), np.empty(0)
    scores = lm_score.Beginnings(m, table, nothing.astype(np.uint64), nothing)
    total = scores.scores(begun).sum()
    assert sorted(asked) == sorted(expected)  # each once
    assert scores.scores(begun).sum() == total and len(asked) == len(expected)
    assert total == pytest.approx(lm_score.Mixer().log10(table, last[near], word[near], stream.buf[at[near]]).sum(), rel=1e-9)


def test_lm_remembered_values():
    """Keys that share a slot, and key 0, have their own values."""
    memory = lm_score.Remembered(3)
    r, computed = np.random.default_rng(5), 0

    def value(own):
        nonlocal computed
        computed += len(own)
        return keys[own].astype(np.float64) + 0.5
    for _ in range(5):
        keys = r.integers(0, 40, 100).astype(np.uint64)
        assert (memory.get(keys, value) == keys + 0.5).all()
    before, keys = computed, keys[-1:]
    memory.get(keys, value)
    memory.get(keys, value)
    assert computed <= before + 1
