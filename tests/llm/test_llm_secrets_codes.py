"""Secret scans, vector codes and whitening against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from reqlens.llm import secrets, vector_codes, whitening
from pyspark.sql import functions as F

WORD = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("passwd", "secret", "token", "api_?key"))
BASE = [("assign", rf"""({WORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, g, least) in enumerate(BASE) for m in re.finditer(p, text or "")
             if len(m.group(g)) >= least]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))


def scanned(spark, rows, schema="doc_id bigint, text string, Spans string, RUNS string, `a.b` int"):
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    out = secrets.scan(df).select("doc_id", secrets.written(F.col("base")).alias("base"), secrets.written(F.col("spans")).alias("spans"))
    return [(r.doc_id, r.base, r.spans) for r in out.collect()]


def key(r, n, alphabet=B62):
    return "".join(r.choice(alphabet) for _ in range(n))


def test_base_spans_equal_brute_force(spark):
    r = random.Random(3)
    bits = ["PassWord", "api_key", "token", "=", ":", " ", '"', "'", "abc", "AKIA", "token=token: abcdefgh", "é", "😀", "\n", "ſecret=1234567",
            "deadbeefdeadbeefdeadbeef", "ABCDEFGH01234567", "secret : 'x-y.z=9", "toKen=123456"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(300)]
    texts += ["", None, "token=" + "a" * 100_000, "secret=1234567 " * 3000, "deadbeef" * 3 + "x", "x" + "AKIA" + "Z" * 16]
    rows = list(enumerate(texts)) + [(None, "token=123456"), (0, texts[0])]
    got = scanned(spark, rows)
    assert len(got) == len(rows)
    assert sorted((str(i), b) for i, b, _ in got) == sorted((str(i), base_spans(t)) for i, t in rows)
    for _, base, spans in got:
        assert set(base.split(",")) <= set(spans.split(",")) or not base
    assert scanned(spark, []) == []


def test_random_keys_stay_and_identifiers_go(spark):
    r = random.Random(9)
    words = ["user", "Name", "Path", "config", "Value", "index", "Table", "row2", "handler", "Service", "v1", "data"]
    assert secrets.least_length(32) > 24  # too short a run over 32 letters to tell from text
    drawn = [(a, r.choice([32, 48, 64] if len(a) == 32 else [24, 32, 48, 64])) for a in (B62, B62 + "+/", B62 + "-_", B62[:26] + "234567") * 75]
    keys = [(i, f"see {key(r, n, a)} .") for i, (a, n) in enumerate(drawn)]
    plain = [(1000 + i, "see " + r.choice(["_", "/", ""]).join(r.choice(words) for _ in range(8)) + " .") for i in range(300)]
    got = {i: s for i, _, s in scanned(spark, keys + plain)}
    assert sum("random" in got[i] for i, _ in keys) >= 0.95 * len(keys)
    assert sum("random" in got[i] for i, _ in plain) <= 0.05 * len(plain)
    for i, t in keys:
        if "random" in got[i]:
            kind, a, b = got[i].split(":")
            assert re.fullmatch("[A-Za-z0-9+/_-]+", t[int(a):int(b)])


def test_statistics_equal_plain_ones(spark):
    from math import erfc, sqrt
    r = random.Random(4)
    texts = [key(r, n, a) for n, a in ((24, "0123456789ABCDEF"), (40, B62), (64, B62), (33, B62 + "+/"), (30, B62[:26] + "234567"))] + ["Ab1" * 20]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {x.doc_id: x for x in secrets.tested(df).select("doc_id", F.inline("runs")).collect()}
    for i, t in enumerate(texts):
        if i not in got:
            continue
        alphabet = got[i].family.split(" ")[0]
        k, n = len(alphabet), len(t)
        at = [2 * alphabet.index(c) + 1 - k for c in t]
        x2 = k / n * sum(t.count(c) ** 2 for c in alphabet) - n
        z = [((x2 / (k - 1)) ** (1 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1)))]
        high = [v > 0 for v in at]
        n1 = sum(high)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean, var = 2 * n1 * (n - n1) / n + 1, 2 * n1 * (n - n1) * (2 * n1 * (n - n1) - n) / (n * n * (n - 1))
        z.append(abs(runs - mean) / sqrt(var))
        z.append(abs(sum(a * b for a, b in zip(at, at[1:]))) / (sqrt(n - 1) * (k * k - 1) / 3))
        tail = [erfc(v / sqrt(2)) / 2 for v in z]
        assert got[i].p == pytest.approx(min(1, 3 * min(tail[0], 2 * tail[1], 2 * tail[2])), rel=0.02, abs=1e-4)
    assert len(got) == len(texts)
    assert got[5].p < 1e-6


def test_false_discovery_rule(spark):
    r = np.random.default_rng(0)
    classes = np.concatenate([np.floor(-np.log10(r.random(500)) * 8), np.full(40, 60)]).astype(int).tolist()
    df = spark.createDataFrame([("f", c) for c in classes] + [("g", 0)], "family string, class int")
    got = {x.family: x.limit for x in secrets.rejection_limits(df, 0.05).collect()}
    good = [c for c in set(classes) if 10 ** (-c / 8) * len(classes) <= 0.05 * sum(x >= c for x in classes)]
    assert got == {"f": min(good)}


def test_scan_runs_without_python(spark):
    df = spark.createDataFrame([(1, "token=123456")], "doc_id int, text string")
    plan = secrets.tested(df)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "Python" not in plan and "Arrow" not in plan


VECTORS = "vec_id bigint, embedding array<float>, label int, CODE string, `x.y` int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], VECTORS)


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(v is not None and np.isfinite(v) for v in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[np.floor(1024 * float(np.float32(v))) for v in r[1]] for r in kept]).astype(np.int64)
    x = x.reshape(len(kept), parts, -1)
    books = x[:entries].copy()

    def assigned():
        d = ((x[:, None] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=1), d.min(axis=1)
    for _ in range(rounds):
        index, _ = assigned()
        for p in range(parts):
            for j in set(index[:, p].tolist()):
                mine = x[index[:, p] == j, p]
                books[j, p] = mine.sum(axis=0) // len(mine)
    index, error = assigned()
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for b in books[:, p].tolist() for v in b).encode()).hexdigest()
    error = error.sum(axis=1).tolist()
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    return sorted((str(r[0]), "".join(f"{i:02x}" for i in c), e, by_label[r[2]], digest) for r, c, e in zip(kept, index.tolist(), error))


def test_gnat_equals_exhaustive_search():
    r = np.random.default_rng(1)
    for case in range(5):
        entries = r.integers(-300, 300, (256, 16))
        if case == 1:
            entries[100:180] = entries[3]
        if case == 2:
            entries = r.integers(-2, 2, (200, 3))
        if case == 3:
            entries = entries * 10 ** 6
        x = entries[r.integers(0, len(entries), 2000)] + r.integers(-20, 20, (2000, entries.shape[1]))
        tree = vector_codes.Gnat(entries)
        index, best = tree.nearest(x)
        full = np.stack([((x - p) ** 2).sum(axis=1) for p in entries], axis=1)
        assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
        assert tree.compared < full.size


def test_vector_codes_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(v)) for v in r.normal(0, 0.2, 16)], int(r.integers(0, 3)) if i % 7 else None) for i in r.permutation(700)]
    rows += rows[:40] + [(None, rows[0][1], 1), (5000, None, 1), (5001, [float("nan")] * 16, 2), (5002, [None] + [0.0] * 15, 2), (5003, [float("inf")] * 16, 2)]
    rows += [(6000 + i, rows[3][1], 9) for i in range(300)]  # a large group of copies
    got = vector_codes.encode(vectors(spark, rows)).collect()
    assert sorted((str(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in got) == plain_codes(rows)
    few = rows[:5]
    got = vector_codes.encode(vectors(spark, few)).collect()
    assert sorted((str(x.vec_id), x.code, x.error, x.label_error, x.codebooks_sha256) for x in got) == plain_codes(few)
    assert vector_codes.encode(vectors(spark, [])).collect() == []
    assert vector_codes.encode(vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError):
        vector_codes.encode(vectors(spark, [(1, [0.0] * 6, 1)]))


def test_labels_frequent_and_seldom(spark):
    rows = [(i, [float(i % 13), 0.5, 1.0, float(i % 7)], 1 if i < 1500 else i) for i in range(3000)]
    got = vector_codes.encode(vectors(spark, rows), entries=4).collect()
    sums = {}
    for x in got:
        sums[x.label] = sums.get(x.label, 0) + x.error
    assert len(got) == 3000 and all(x.label_error == sums[x.label] for x in got)


def test_eigenpairs_equal_a_dense_solver():
    r = np.random.default_rng(0)
    for dim, wanted, rank in ((64, 32, 3000), (120, 32, 3000), (150, 32, 50), (10, 32, 300), (33, 32, 300), (1, 32, 10)):
        a = r.standard_normal((rank, dim)) @ (r.standard_normal((dim, dim)) * 0.3 + np.eye(dim))
        v = a.T @ a / len(a)
        values, basis, residual = whitening.leading_eigenpairs(lambda w, v=v: v @ w, dim, wanted)
        k = min(dim, wanted)
        assert values == pytest.approx(np.linalg.eigvalsh(v)[::-1][:k], abs=1e-12 * values[0])
        assert residual.max() <= 1e-12 * values[0]
        assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-12


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(5)
    values = (r.normal(0, 1, (400, 40)) @ r.normal(0, 0.2, (40, 40))).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(values)]
    rows += rows[:30] + [(None, rows[0][1], 1), (900, None, 1), (901, [float("nan")] * 40, 1), (902, [None] * 40, 1)]
    kept = [v for _, v, _ in rows[:431]]
    x = np.floor(64 * np.array(kept)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1][:32], basis[:, ::-1][:, :32]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert len(got) == n * 32 and {x.n for x in got} == {n}
    expected = np.abs(c @ basis / np.sqrt(values))
    for g in got:
        if g.vec_id is not None:
            assert abs(g.whitened) == pytest.approx(expected[g.vec_id, g.component - 1], abs=1e-7)
            assert g.deviation == int(((n * x[g.vec_id] - s) ** 2).sum())
            assert g.explained == pytest.approx(values[g.component - 1] / (c * c).sum() * n, rel=1e-9)
    assert got[0].identity_error < 1e-9


def test_whitening_of_few_rows(spark):
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5] * 8, 1)] * 5)).collect() == []
    three = [(i, [float(i == j) for j in range(6)], 0) for i in range(3)]
    got = whitening.whiten(vectors(spark, three)).collect()
    assert len(got) == 6 and got[0].identity_error < 1e-9  # two directions vary
    with pytest.raises(ValueError):
        whitening.whiten(vectors(spark, [(1, [0.0] * 6, 1), (2, [0.0] * 5, 1)]))
