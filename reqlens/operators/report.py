"""Reports over the request table and evaluation results (A5, A6, U2, R7,
R8, R10, R11). Per-class tables have at most one row per attack class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqlens.operators.evaluate import classify, clean_score, is_normal
from reqlens.operators.requests import label_filter


def class_counts(truth: DataFrame) -> DataFrame:
    """Number of requests per attack class (``normal`` and NULL left
    out), largest first."""
    return label_filter(truth, "drop_normal_class").groupBy("ano_class") \
        .agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "ano_class")


def class_fn_rates(truth: DataFrame, fn_rows: DataFrame, fp_rows: DataFrame | None = None,
                   min_rate: float = 0.001) -> DataFrame:
    """A5 (+ P15): per class total, false-negative count, false-positive count
    and FN rate, keeping classes with ``fn_rate > min_rate``.

    ``fn_rows``/``fp_rows`` hold the error indexes (J2 membership by a left
    join to the distinct index set)."""
    t = label_filter(truth, "drop_normal_class").select("original_index", "ano_class")
    fn = fn_rows.select("original_index").distinct().withColumn("is_fn", F.lit(1))
    t = t.join(fn, "original_index", "left")
    if fp_rows is not None:
        fp = fp_rows.select("original_index").distinct().withColumn("is_fp", F.lit(1))
        t = t.join(fp, "original_index", "left")
    else:
        t = t.withColumn("is_fp", F.lit(None).cast("int"))
    stats = t.groupBy("ano_class").agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum("is_fn"), F.lit(0)).cast("long").alias("fn_count"),
        F.coalesce(F.sum("is_fp"), F.lit(0)).cast("long").alias("fp_count"))
    stats = stats.withColumn("fn_rate", F.col("fn_count") / F.col("total"))
    return stats.filter(F.col("fn_rate") > min_rate)


def errors_at_threshold(joined: DataFrame, threshold, metric: str = "loss"):
    """FN and FP rows of one threshold, straight from the scored rows (the
    evaluation's index lists without building them)."""
    c = classify(clean_score(metric), threshold)
    n = is_normal()
    fn = joined.filter(~c & ~n).select("original_index")
    fp = joined.filter(c & n).select("original_index")
    return fn, fp


def class_fn_rates_multi(truth: DataFrame, models: list[tuple[str, DataFrame, object, str]]) -> DataFrame:
    """Per-class FN rates for several models, each at its estimated
    threshold; ``models`` holds (label, scored rows joined with truth,
    threshold, metric). Sorted by FN rate, highest first."""
    out = None
    for label, joined, thr, metric in models:
        fn, fp = errors_at_threshold(joined, thr, metric)
        part = class_fn_rates(truth, fn, fp).withColumn("model", F.lit(label))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("fn_rate", F.round("fn_rate", 6)).orderBy(F.desc("fn_rate"), "model", "ano_class")


def train_curves(log: DataFrame, tags: list[str]) -> DataFrame:
    """One row per step with a column per tag (S6 rows of the newest run)."""
    from reqlens.sources.readers import latest_run_log
    rows = latest_run_log(log, tags)
    return rows.groupBy("step").pivot("tag", tags).agg(F.max("value"))


def sample_distribution(joined: DataFrame, metric: str = "loss", window: int = 1000,
                        w_offset: int = 1000, sort: bool = True,
                        hide_anomalous: bool = False, hide_normal: bool = False) -> DataFrame:
    """A positional slice of the scored rows (in index order), optionally
    sorted by the metric and renumbered, with the display category (P8, P9,
    O4, P14); ``window=0`` takes all rows."""
    from reqlens.operators.requests import positional_slice, sample_category
    df = joined
    if hide_anomalous:
        df = label_filter(df, "hide_anomalous")
    if hide_normal:
        df = label_filter(df, "hide_normal")
    sl = positional_slice(df, "original_index", w_offset, window)
    sl = sl.select("original_index", F.col(metric).alias("value"), sample_category(True).alias("category"))
    if sort:
        from reqlens.operators.ranking import global_position
        sl = global_position(sl.withColumn("__order", F.struct("value", "original_index")), "__order", "rank") \
            .withColumn("rank", F.col("rank") - 1).drop("__order")
    return sl


def eval_curves(evals: DataFrame, x_metric: str = "threshold_offset", y_metric: str = "f1") -> DataFrame:
    """Curve points per model (``model`` column, e.g. from S5); x is a
    parameter column or a metric, y a metric; the estimated row is a marker."""
    from reqlens.functions import metrics as M
    e = M.with_metrics(evals)
    return e.select("model", "param_id", F.col(x_metric).alias("x"), F.col(y_metric).alias("y"),
                    F.col("estimated").alias("is_marker"))


def k_sweep(spark, eval_scored: DataFrame, test_scored: DataFrame, metric: str = "loss") -> DataFrame:
    """For k = 0.01..1.99 step 0.02 the threshold ``mu + k*sigma`` of the
    eval scores; FPR on the eval rows, F1 on the test rows. Both are one
    bucketed threshold sweep each (A2), whatever the grid size."""
    from reqlens.functions import metrics as M
    from reqlens.operators.evaluate import k_grid, threshold_sweep
    from reqlens.operators.threshold import gaussian_threshold
    st = gaussian_threshold(eval_scored, metric, 0.0)
    mu, sd = st.select("mu").scalar(), st.select("sigma").scalar()
    ks = k_grid(spark).withColumn("param_id", (F.col("k") * 100).cast("long"))
    params = ks.select("param_id", F.lit(3000).alias("window_size"),
                       (mu + F.col("k") * sd).alias("threshold_offset"), F.lit(metric).alias("metric"),
                       F.lit(True).alias("average_anomalies"), F.lit(False).alias("use_std_as_offset"),
                       F.lit(0.0).alias("std_multiplier"), F.lit(True).alias("estimated"))
    fpr = M.with_metrics(threshold_sweep(eval_scored, params, metric), ["fpr"]).select("param_id", "fpr")
    f1 = M.with_metrics(threshold_sweep(test_scored, params, metric), ["f1"]).select("param_id", "f1")
    return ks.join(fpr, "param_id").join(f1, "param_id").select(
        "k", F.col("fpr").alias("FPR"), F.col("f1").alias("F1"))
