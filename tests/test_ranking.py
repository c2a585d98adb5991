"""Bucketed global operators equal their single-task definitions."""

import math
import random

import pandas as pd
import pytest

from reqlens.operators import ranking, threshold


def test_prefix_sums(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.v_before for r in ranking.prefix_sums(df, "k", ["v"], part_rows=100).collect()}
    run = 0
    for k, v in rows:
        assert got[k] == run
        run += v


@pytest.mark.parametrize("window", [3, 30])
def test_rolling_std_matches_pandas(spark, window):
    rnd = random.Random(7)
    vals = [rnd.random() for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(vals)), "original_index long, loss double")
    got = {r.original_index: r.rolling_std for r in
           threshold.rolling_std(df, "original_index", "loss", window, part_rows=400).collect()}
    s = pd.Series(vals)
    exp = s.rolling(window=window).std().fillna(s.std())
    for i, e in enumerate(exp):
        assert got[i] == pytest.approx(e, abs=1e-9)


def test_halo_rolling_matches_plain(spark):
    rnd = random.Random(9)
    vals = [rnd.random() for _ in range(5000)]
    df = spark.createDataFrame(list(enumerate(vals)), "original_index long, loss double")
    got = {r.original_index: r.rolling_std for r in
           ranking.rolling_stddev(df, "original_index", "loss", 30, chunk_rows=500, part_rows=400).collect()}
    exp = pd.Series(vals).rolling(window=30).std()
    for i, e in enumerate(exp):
        if math.isnan(e):
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(e, abs=1e-9)


def test_exact_percentiles_match_numpy(spark):
    import numpy as np
    rnd = random.Random(11)
    vals = [round(rnd.random() * 10, 1) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in vals], "loss double")
    got = {r.q: r.value for r in threshold.exact_percentiles(df, "loss", [0.25, 0.5, 0.99], part_rows=400).collect()}
    for q in (0.25, 0.5, 0.99):
        assert got[q] == pytest.approx(float(np.percentile(vals, q * 100)), abs=1e-9)


def test_kde_binned_close_to_brute_force(spark):
    rnd = random.Random(13)
    vals = [rnd.gauss(0, 1) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in vals], "loss double")
    got = sorted(threshold.kde_curve(df, "loss", bins=1500, points=20).collect(), key=lambda r: r.i)
    s = pd.Series(vals)
    h = s.std() * len(vals) ** -0.2
    for r in got:
        brute = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in vals) / (len(vals) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(brute, rel=1e-3, abs=1e-6)  # binning error


@pytest.mark.parametrize("part_rows", [7, 100, None])
def test_slices_read_their_parts_only(spark, part_rows):
    rnd = random.Random(3)
    keys = rnd.sample(range(10_000), 700)
    df = spark.createDataFrame([(k, -k) for k in keys], "original_index long, loss long")
    for offset, window in ((0, 5), (650, 20), (690, 100), (900, 10), (3, 600)):
        got = sorted(r.original_index for r in ranking.slice_of(df, "original_index", offset, window, part_rows).collect())
        assert got == sorted(keys)[offset:offset + window]
    assert ranking.slice_of(df.limit(0), "original_index", 0, 5).count() == 0


def test_positions_are_dense(spark):
    keys = random.Random(4).sample(range(5000), 900)
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.pos for r in ranking.global_position(df, "k", part_rows=50).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}
    r = ranking.ranges(df, "k", ["k"], 50)
    assert r.totals.count() == 18 and df.select(r.total("k")).first()[0] == sum(keys)
