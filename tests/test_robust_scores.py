"""NULL, NaN and constant scores, several input files, rolling thresholds."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from reqlens.operators import evaluate as ev
from reqlens.operators import requests as rq
from reqlens.operators import threshold as th


def scores(spark, values):
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(values)], "original_index bigint, loss double")


def test_rolling_std_with_null_and_nan(spark):
    values = [((i * 37) % 101) / 10 for i in range(200)]
    values[50], values[120] = None, float("nan")
    real = [v for v in values if v is not None and not math.isnan(v)]
    got = {r.original_index: r.rolling_std for r in th.rolling_std(scores(spark, values), "original_index", "loss", 10).collect()}
    for i in range(200):
        frame = [v for v in values[max(0, i - 9):i + 1] if v is not None and not math.isnan(v)]
        expected = statistics.stdev(frame) if len(frame) == 10 else statistics.stdev(real)
        assert got[i + 1] == pytest.approx(expected, abs=1e-9)


def test_nan_scores_leave_thresholds_alone(spark):
    df = scores(spark, [1.0, 2.0, 3.0, float("nan"), None])
    row = th.gaussian_threshold(df).first()
    assert (row.mu, row.sigma) == (pytest.approx(2.0), pytest.approx(statistics.pstdev([1, 2, 3])))
    assert th.upside_deviation(df).first()[0] == pytest.approx(math.sqrt(0.5))
    assert sum(r["count"] for r in th.histogram(df, bins=3).collect()) == 3


def test_constant_scores_have_curves(spark):
    df = scores(spark, [2.0] * 5)
    assert all(r.density is None for r in th.gaussian_curve(df, points=5).collect())
    assert all(r.density is None for r in th.kde_curve(df, bins=10, points=5).collect())


def test_exact_kernel_density(spark):
    values = [1.0, 1.5, 4.0, 4.0, 9.0]
    h = statistics.stdev(values) * 5 ** -0.2
    for r in th.kde_curve(scores(spark, values), bins=None, points=7).collect():
        want = sum(math.exp(-0.5 * ((r.x - v) / h) ** 2) for v in values) / (5 * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want)


def test_index_follows_files_and_not_sizes(spark, tmp_path):
    first = 0
    for k, n in enumerate([5, 3000, 40, 9000, 200]):
        spark.range(first, first + n, 1, 1).write.parquet(str(tmp_path / "p" / f"f{k}"))
        spark.range(first, first + n, 1, 1).write.csv(str(tmp_path / "c" / f"f{k}"))
        first += n
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for df in (spark.read.parquet(*[str(tmp_path / "p" / f"f{k}") for k in range(5)]),
                   spark.read.schema("id bigint").csv([str(tmp_path / "c" / f"f{k}") for k in range(5)])):
            got = rq.assign_index(df, start=0)
            assert got.count() == first and got.where("original_index <> id").count() == 0
            assert got.columns == ["id", "original_index"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_rolling_thresholds(spark):
    values = [((i * 37) % 101) / 10 for i in range(60)]
    values[7] = float("nan")
    joined = scores(spark, values).withColumn("anomalous", (F.col("original_index") % 3 == 0).cast("int"))
    p = spark.createDataFrame([(0, 5, 4.0, False, 0.0), (1, 5, 1.0, True, 0.5), (2, 5, 3.0, True, 0.5), (3, 5, 0.0, True, 2.0)],
                              "param_id bigint, window_size int, threshold_offset double, use_std_as_offset boolean, std_multiplier double") \
        .selectExpr("*", "'loss' as metric", "true as average_anomalies", "false as estimated")
    std = {r.original_index: r.rolling_std for r in th.rolling_std(joined, "original_index", "loss", 5).collect()}
    got = {r.param_id: r for r in ev.rolling_threshold_sweep(joined, p, digits=None).collect()}
    for x in p.collect():
        limit = {i: x.threshold_offset + std[i] * x.std_multiplier for i in std}
        hit = {i for i in limit if not math.isnan(values[i - 1]) and values[i - 1] > limit[i]}
        normal = {i for i in limit if i % 3}
        assert got[x.param_id].false_positives == len(hit & normal)
        assert got[x.param_id].true_positives == len(hit - normal)
        assert got[x.param_id].calculated_thresholds_avg == pytest.approx(statistics.mean(limit.values()))
    with pytest.raises(Exception, match="rolling_threshold_sweep"):
        ev.threshold_sweep(joined, p).collect()
