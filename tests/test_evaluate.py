"""Threshold sweep, AUC/AP and best-result rules against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from reqlens.operators import evaluate as ev


def _joined(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [(i, round(rnd.random(), 2), rnd.choice([0, 0, 1])) for i in range(n)]
    return spark.createDataFrame(rows, "original_index long, loss double, anomalous int") \
        .withColumn("perplexity", F.exp("loss")), rows


def test_sweep_equals_brute_force(spark):
    df, rows = _joined(spark)
    params = ev.param_grid(spark)
    got = {r.param_id: r for r in ev.threshold_sweep(df, params, digits=None).collect()}
    for i in range(1, 100):
        t = 0.01 * i
        fp = sum(1 for _, s, a in rows if s > t and a == 0)
        tp = sum(1 for _, s, a in rows if s > t and a != 0)
        fn = sum(1 for _, s, a in rows if not s > t and a != 0)
        tn = sum(1 for _, s, a in rows if not s > t and a == 0)
        r = got[i - 1]
        assert (r.false_positives, r.true_positives, r.false_negatives, r.true_negatives) == (fp, tp, fn, tn)
        assert r.correct == tp + tn


def _auc_brute(rows):
    pos = [s for _, s, a in rows if a == 1]
    neg = [s for _, s, a in rows if a == 0]
    u = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return u / (len(pos) * len(neg))


def _ap_brute(rows):
    P = sum(1 for *_, a in rows if a == 1)
    ap = 0.0
    for v in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for _, s, a in rows if s >= v and a == 1)
        fp = sum(1 for _, s, a in rows if s >= v and a == 0)
        pos_v = sum(1 for _, s, a in rows if s == v and a == 1)
        ap += pos_v / P * tp / (tp + fp)
    return ap


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_auc_and_ap_with_ties(spark, buckets):
    df, rows = _joined(spark, 300, seed=2)
    r = ev.auc_scores(df, "loss", part_rows=buckets).collect()[0]
    assert r.auc_roc == pytest.approx(_auc_brute(rows), abs=1e-12)
    assert r.auc_pr == pytest.approx(_ap_brute(rows), abs=1e-12)


def test_best_result_tie_rules(spark):
    schema = ("param_id long, correct long, true_positives long, false_positives long, "
              "false_negatives long, true_negatives long, estimated boolean")
    # param 0 and 1: same f1, same correct -> first by param id; param 2: lowest fnr tie -> last in scan
    e = spark.createDataFrame([
        (0, 10, 5, 5, 5, 5, False), (1, 10, 5, 5, 5, 5, False), (2, 12, 6, 6, 0, 6, True),
        (3, 13, 6, 7, 0, 7, True)], schema)
    assert ev.best_result(e, "f1").collect()[0].param_id in (2, 3)
    assert ev.best_result(e, "fn").collect()[0].param_id == 3       # last with fnr 0 (higher correct)
    assert ev.best_result(e, "estimated").collect()[0].param_id == 2  # first estimated by correct
    zero = spark.createDataFrame([(0, 0, 0, 5, 5, 0, False)], schema)
    assert ev.best_result(zero, "f1").count() == 0                   # never chosen at f1 <= 0


def test_error_indexes_match_counts(spark):
    df, rows = _joined(spark, 200, seed=3)
    params = ev.param_grid(spark)
    errs = ev.error_indexes(df, params).groupBy("param_id", "kind").count().collect()
    sweep = {r.param_id: r for r in ev.threshold_sweep(df, params).collect()}
    for r in errs:
        s = sweep[r.param_id]
        assert r["count"] == (s.false_positives if r.kind == "fp" else s.false_negatives)
