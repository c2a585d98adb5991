"""Evaluation of scores against truth (J1, J2, P13, A1, A2, A12-A14, A17, A20,
W2, R1-R5).

Design at scale: a threshold grid is never crossed with the rows. Each row
gets a bucket = the number of grid thresholds below its score (the grid is a
bounded scalar array), rows are counted per (bucket, label) with a map-side
partial aggregate, and a reverse running sum over the small bucket table gives
every threshold's confusion counts in one pass, whatever the grid size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqlens.functions import metrics as M
from reqlens.operators.ranking import prefix_sums

PARAM_COLUMNS = ["param_id", "window_size", "threshold_offset", "metric", "average_anomalies",
                 "use_std_as_offset", "std_multiplier", "estimated"]
COUNT_COLUMNS = ["false_positives", "false_negatives", "true_negatives", "true_positives", "correct"]


def join_pred_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner equi-join on ``original_index``. AQE picks broadcast or
    sort-merge from runtime sizes; both sides scale with the data, so no hint."""
    t = truth.select("original_index", "anomalous", "ano_class")
    return pred.join(t, "original_index", "inner")


def clean_score(col: str) -> Column:
    """NaN becomes NULL (NaN > t is false in the source, true in Spark)."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def classify(metric: Column, threshold: Column) -> Column:
    """Strict ``metric > threshold``; NULL or NaN metric is not anomalous."""
    return F.coalesce((~F.isnan(metric)) & (metric > threshold), F.lit(False))


def is_normal() -> Column:
    return F.coalesce(F.col("anomalous") == 0, F.lit(False))


def membership_flags(df: DataFrame, index_set: DataFrame, name: str) -> DataFrame:
    """``name`` = row's index is in ``index_set``; a left join to the
    distinct index set, never a driver-side list."""
    s = index_set.select("original_index").distinct().withColumn(name, F.lit(True))
    return df.join(s, "original_index", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def param_grid(spark: SparkSession, thresholds: DataFrame | None = None, metric: str = "loss",
               window_size: int = 3000) -> DataFrame:
    """the default grid ``0.01*i`` for i in 1..99 (double arithmetic),
    one parameter row each, plus optional extra threshold rows (estimated)."""
    grid = spark.range(1, 100).select(
        (F.col("id") - 1).alias("param_id"),
        F.lit(window_size).alias("window_size"),
        (F.col("id").cast("double") * F.lit(0.01)).alias("threshold_offset"),
        F.lit(metric).alias("metric"), F.lit(True).alias("average_anomalies"),
        F.lit(False).alias("use_std_as_offset"), F.lit(0.0).alias("std_multiplier"),
        F.lit(False).alias("estimated"))
    if thresholds is not None:
        extra = thresholds.select(
            (F.lit(99) + F.monotonically_increasing_id()).alias("param_id"),
            F.lit(window_size).alias("window_size"),
            F.col("threshold").cast("double").alias("threshold_offset"),
            F.lit(metric).alias("metric"), F.lit(True).alias("average_anomalies"),
            F.lit(False).alias("use_std_as_offset"), F.lit(0.0).alias("std_multiplier"),
            F.lit(True).alias("estimated"))
        grid = grid.unionByName(extra)
    return grid


def k_grid(spark: SparkSession) -> DataFrame:
    """k = 0.01..1.99 step 0.02 (``i/100`` for odd i)."""
    return spark.range(1, 200, 2).select((F.col("id").cast("double") / F.lit(100.0)).alias("k"))


def confusion_counts(joined: DataFrame, threshold: Column, metric: str = "loss") -> DataFrame:
    """A1: confusion counts for one threshold expression (a literal, or a
    per-row column such as ``offset + rolling_std * multiplier``)."""
    m = F.col(metric).cast("double")
    c = classify(m, threshold)
    n = is_normal()
    return joined.agg(
        F.count_if(c & n).alias("false_positives"),
        F.count_if(~c & ~n).alias("false_negatives"),
        F.count_if(~c & n).alias("true_negatives"),
        F.count_if(c & ~n).alias("true_positives"),
        F.avg(threshold.cast("double")).alias("calculated_thresholds_avg"),
    ).withColumn("correct", F.col("true_negatives") + F.col("true_positives"))


def _bucket(score: Column, grid: Column) -> Column:
    return F.when(score.isNull(), F.lit(0)).otherwise(F.size(F.filter(grid, lambda t: t < score)))


def threshold_sweep(joined: DataFrame, params: DataFrame, metric: str = "loss",
                    digits: int | None = 6) -> DataFrame:
    """A2: the evaluation table for a grid of constant thresholds, one pass.

    A row is anomalous at threshold t iff (#thresholds < score) >=
    (#thresholds <= t), so positives at t are a reverse running sum over
    buckets. Parameter rows with ``use_std_as_offset`` are an error here:
    :func:`rolling_threshold_sweep` takes them.
    """
    grid = params.select(F.array_sort(F.collect_list(F.col("threshold_offset").cast("double")))).scalar()
    s = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    # Scalar subqueries cannot sit inside a lambda: project them first.
    per_row = joined.withColumn("__grid", grid).select(_bucket(s, F.col("__grid")).alias("b"),
                                                       is_normal().alias("n"))
    counts = per_row.groupBy("b").agg(F.count_if("n").alias("n_norm"), F.count_if(~F.col("n")).alias("n_anom"))
    keyed = params.withColumn("__grid", grid) \
        .withColumn("b", F.when(F.col("use_std_as_offset"), F.raise_error(F.lit("a rolling threshold needs rolling_threshold_sweep")).cast("int"))
                    .otherwise(F.size(F.filter("__grid", lambda x: x <= F.col("threshold_offset"))))).drop("__grid")
    cols = PARAM_COLUMNS
    stacked = counts.select("b", "n_norm", "n_anom", F.lit(False).alias("is_param"),
                            *[F.lit(None).alias(c) for c in cols]) \
        .unionByName(keyed.select("b", F.lit(0).cast("long").alias("n_norm"),
                                  F.lit(0).cast("long").alias("n_anom"),
                                  F.lit(True).alias("is_param"), *cols))
    # Bounded table (buckets + parameter rows): single-partition windows are cheap.
    rev = Window.orderBy(F.desc("b")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    out = stacked.select(
        *cols, "is_param",
        F.sum("n_norm").over(rev).alias("fp"), F.sum("n_anom").over(rev).alias("tp"),
        F.sum("n_norm").over(whole).alias("tot_norm"), F.sum("n_anom").over(whole).alias("tot_anom"),
    ).filter("is_param")
    thr = F.col("threshold_offset")
    res = out.select(
        "param_id", F.col("window_size").cast("int").alias("window_size"),
        (F.round(thr, digits) if digits is not None else thr).alias("threshold_offset"),
        "metric", "average_anomalies", "use_std_as_offset",
        F.col("std_multiplier").cast("double").alias("std_multiplier"),
        F.when(F.col("tot_norm") + F.col("tot_anom") > 0,
               F.round(thr, digits) if digits is not None else thr).alias("calculated_thresholds_avg"),
        F.col("fp").cast("long").alias("false_positives"),
        (F.col("tot_anom") - F.col("tp")).cast("long").alias("false_negatives"),
        (F.col("tot_norm") - F.col("fp")).cast("long").alias("true_negatives"),
        F.col("tp").cast("long").alias("true_positives"),
        (F.col("tot_norm") - F.col("fp") + F.col("tp")).cast("long").alias("correct"),
        "estimated")
    return res


def rolling_threshold_sweep(joined: DataFrame, params: DataFrame, metric: str = "loss", digits: int | None = 6,
                            order_col: str = "original_index") -> DataFrame:
    """A2 + J5 + W1: the evaluation table of parameter rows of both kinds. With
    ``use_std_as_offset`` a row's threshold is ``threshold_offset +
    rolling_std * std_multiplier``, which it exceeds iff ``metric - rolling_std *
    std_multiplier`` exceeds the offset: one sweep over that difference for each
    (window, multiplier) of the bounded parameter table, whatever the number of
    offsets. ``calculated_thresholds_avg`` is the mean of the rows' thresholds."""
    from reqlens.operators.threshold import rolling_std

    rolling = params.where("use_std_as_offset")
    out = threshold_sweep(joined, params.where("not use_std_as_offset"), metric, digits)
    for r in rolling.select("window_size", "std_multiplier").distinct().collect():
        own = rolling.where((F.col("window_size") == r["window_size"]) & (F.col("std_multiplier") == r["std_multiplier"]))
        m = F.lit(float(r["std_multiplier"]))
        stds = rolling_std(joined, order_col, metric, r["window_size"], "__std")
        mean = stds.select(F.avg("__std")).scalar()
        part = threshold_sweep(stds.withColumn(metric, clean_score(metric) - F.col("__std") * m).drop("__std"),
                               own.withColumn("use_std_as_offset", F.lit(False)), metric, None)
        avg = F.col("threshold_offset") + mean * m
        rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
        out = out.unionByName(part.withColumn("use_std_as_offset", F.lit(True))
                              .withColumn("calculated_thresholds_avg", F.when(F.col("calculated_thresholds_avg").isNotNull(), rounded(avg)))
                              .withColumn("threshold_offset", rounded(F.col("threshold_offset"))))
    return out


def ranked_params(params: DataFrame) -> DataFrame:
    """``(rank, param_id, threshold_offset)``: the parameter rows (a bounded
    table) by rising threshold."""
    listed = params.agg(F.array_sort(F.collect_list(F.struct(F.col("threshold_offset").cast("double").alias("t"), "param_id"))).alias("a"))
    return listed.select(F.posexplode("a").alias("rank", "x")) \
        .select("rank", F.col("x.param_id").alias("param_id"), F.col("x.t").alias("threshold_offset"))


def error_intervals(joined: DataFrame, params: DataFrame, metric: str = "loss") -> DataFrame:
    """A17 as intervals: ``(original_index, kind, first, last)``, one row for each
    scored row that is an error anywhere in the grid. A normal row is a false positive for the thresholds
    below its score, an anomalous one a false negative for the others; both are
    consecutive in :func:`ranked_params`. The output doesn't grow with the grid."""
    grid = params.select(F.array_sort(F.collect_list(F.col("threshold_offset").cast("double")))).scalar()
    below = _bucket(clean_score(metric), F.col("__grid"))
    rows = joined.withColumn("__grid", grid).select("original_index", is_normal().alias("normal"), below.alias("below"), F.size("__grid").alias("n"))
    return rows.select("original_index", F.when(F.col("normal"), "fp").otherwise("fn").alias("kind"),
                       F.when(F.col("normal"), 0).otherwise(F.col("below")).alias("first"),
                       F.when(F.col("normal"), F.col("below") - 1).otherwise(F.col("n") - 1).alias("last")).filter("first <= last")


def errors_of(intervals: DataFrame, ranked: DataFrame, param_ids: list[int] | None = None) -> DataFrame:
    """``(param_id, kind, original_index)`` of the given parameter rows (all by
    default), from their intervals. Each interval is opened once; the ranks meet a bounded broadcast table."""
    if param_ids is not None:
        ranked = ranked.filter(F.col("param_id").isin(param_ids))
        ranks = ranked.select(F.array_sort(F.collect_list("rank"))).scalar()
        opened = intervals.withColumn("__ranks", ranks).select(
            "original_index", "kind", F.explode(F.filter("__ranks", lambda r: (r >= F.col("first")) & (r <= F.col("last")))).alias("rank"))
    else:
        opened = intervals.select("original_index", "kind", F.explode(F.sequence("first", "last")).alias("rank"))
    return opened.join(F.broadcast(ranked), "rank").select("param_id", "kind", "original_index")


def error_indexes(joined: DataFrame, params: DataFrame, metric: str = "loss") -> DataFrame:
    """Long table ``(param_id, kind, original_index)`` of false positives
    and false negatives for every parameter row, from the intervals."""
    return errors_of(error_intervals(joined, params, metric), ranked_params(params))


def with_index_lists(evals: DataFrame, errors: DataFrame) -> DataFrame:
    """Evaluation table with ``fp_indexes``/``fn_indexes`` arrays, for small
    results only (each list is one group); large runs keep the long table."""
    lists = errors.groupBy("param_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "fp", F.col("original_index")))).alias("fp_indexes"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "fn", F.col("original_index")))).alias("fn_indexes"))
    empty = F.array().cast("array<bigint>")
    return evals.join(lists, "param_id", "left") \
        .withColumn("fp_indexes", F.coalesce("fp_indexes", empty)) \
        .withColumn("fn_indexes", F.coalesce("fn_indexes", empty))


def score_label_counts(joined: DataFrame, score_col: str, label_col: str = "anomalous") -> DataFrame:
    """Pre-aggregate by distinct score: ties and hot values become one row."""
    s = clean_score(score_col)
    return joined.filter(s.isNotNull()).groupBy(s.alias("score")).agg(
        F.count_if(F.col(label_col) == 1).alias("pos"), F.count_if(F.col(label_col) == 0).alias("neg"))


def auc_scores(joined: DataFrame, score_col: str, label_col: str = "anomalous",
               part_rows: int | None = None) -> DataFrame:
    """A12 + A13 in one pass: ROC AUC (tie-corrected rank sum) and average
    precision (step sum over distinct scores, descending). NULL when a class
    is empty.

    Distinct scores are counted per label (ties and hot values become one
    row), then one running sum in descending score order gives the
    positives and negatives above each score: ``tp = pos_above + pos``,
    ``fp = neg_above + neg`` and
    ``AUC = (P*N - sum(pos * (neg_above + neg/2))) / (P*N)`` (half-integers,
    exact in doubles); ``P`` and ``N`` come from the same final aggregate.
    """
    counts = score_label_counts(joined, score_col, label_col).withColumn("__desc", -F.col("score"))
    g = prefix_sums(counts, "__desc", ["pos", "neg"], part_rows)
    tp = F.col("pos_before") + F.col("pos")
    fp = F.col("neg_before") + F.col("neg")
    agg = g.agg(F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"),
                F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("a"),
                F.sum(F.when(F.col("pos") > 0, F.col("pos") * (tp / (tp + fp)))).alias("ap_num"))
    pn = F.col("P") * F.col("N")
    return agg.select(
        F.when((F.col("P") > 0) & (F.col("N") > 0), (pn - F.col("a")) / pn).alias("auc_roc"),
        F.when(F.col("P") > 0, F.col("ap_num") / F.col("P")).alias("auc_pr"))


def best_result(evals: DataFrame, by: str = "f1") -> DataFrame:
    """Best evaluation row with the source's tie rules.

    Rows are scanned by ``correct`` ascending; ``f1``/``acc``/``f1fn`` keep
    the first strict improvement over a running best starting at 0 (so the
    maximum, first in scan order, and nothing when it is <= 0); ``fn`` keeps
    the last row with the lowest FNR; ``estimated`` the first estimated row.
    Ties in ``correct`` are ordered by ``param_id``. One aggregate (max_by on
    a struct key), no window.
    """
    e = M.with_metrics(evals, ["f1", "accuracy", "fnr"], digits=None)
    row = F.struct(*[F.col(c) for c in evals.columns])
    neg_correct, neg_id = -F.col("correct"), -F.col("param_id")
    if by == "estimated":
        pick = F.min_by(row, F.struct("correct", "param_id"))
        e = e.filter("estimated")
    elif by in ("f1", "acc", "f1fn"):
        metric = {"f1": F.col("f1"), "acc": F.col("accuracy"), "f1fn": F.col("f1") - F.col("fnr")}[by]
        e = e.filter(metric > 0)
        pick = F.max_by(row, F.struct(metric, neg_correct, neg_id))
    elif by == "fn":
        pick = F.min_by(row, F.struct(F.col("fnr"), neg_correct, neg_id))
    else:
        raise ValueError(f"unknown criterion {by!r}")
    return e.agg(pick.alias("best")).filter(F.col("best").isNotNull()).select("best.*")


def summary_best_f1(evals: DataFrame) -> DataFrame:
    """R2 'Best F1': scan by (correct, false_negatives, false_positives); the
    first row with the highest F1 (none when all are <= 0)."""
    e = M.with_metrics(evals, ["f1"], digits=None).filter(F.col("f1") > 0)
    key = F.struct(F.col("f1"), -F.col("correct"), -F.col("false_negatives"),
                   -F.col("false_positives"), -F.col("param_id"))
    return e.agg(F.max_by(F.struct(*[F.col(c) for c in evals.columns]), key).alias("b")) \
        .filter(F.col("b").isNotNull()).select("b.*")


def summary_estimated(evals: DataFrame) -> DataFrame:
    """R2 'Estimated': the last estimated row in the same scan order."""
    key = F.struct("correct", "false_negatives", "false_positives", "param_id")
    return evals.filter("estimated").agg(
        F.max_by(F.struct(*[F.col(c) for c in evals.columns]), key).alias("b")) \
        .filter(F.col("b").isNotNull()).select("b.*")


SUMMARY_METRICS = ["f1", "accuracy", "fpr", "tpr", "fnr", "tnr"]


def evaluation_summary(evals: DataFrame) -> DataFrame:
    """R2: best F1, estimated, best F1-FNR and lowest FNR rows with six
    metrics, the multiplier and the window."""
    parts = [("best_f1", summary_best_f1(evals)), ("estimated", summary_estimated(evals)),
             ("best_f1fn", best_result(evals, "f1fn")), ("lowest_fn", best_result(evals, "fn"))]
    out = None
    for label, df in parts:
        d = M.with_metrics(df, SUMMARY_METRICS).select(
            F.lit(label).alias("entry"), "param_id", *SUMMARY_METRICS, "std_multiplier", "window_size")
        out = d if out is None else out.unionByName(d)
    return out


def roc_points(evals: DataFrame) -> DataFrame:
    """(FPR, TPR) per evaluation row."""
    return M.with_metrics(evals, ["fpr", "tpr"]).select("param_id", "threshold_offset", "fpr", "tpr")


def roc_nearest(evals: DataFrame) -> DataFrame:
    """The row nearest to (0, 1); first in table order on ties; only a
    distance below 1 counts (the source's running best starts at 1)."""
    e = M.with_metrics(evals, ["fpr", "tpr"], digits=None)
    d = F.sqrt(F.pow(F.col("fpr"), 2) + F.pow(F.col("tpr") - 1, 2))
    return _nearest(e.withColumn("dist", d))


def pr_points(evals: DataFrame) -> DataFrame:
    """(precision, recall) per row; undefined precision is dropped."""
    return M.with_metrics(evals, ["precision", "recall"]) \
        .filter(F.col("precision").isNotNull()).select("param_id", "threshold_offset", "precision", "recall")


def pr_nearest(evals: DataFrame) -> DataFrame:
    """The row nearest to (1, 1) among defined points."""
    e = M.with_metrics(evals, ["precision", "recall"], digits=None).filter(F.col("precision").isNotNull())
    d = F.sqrt(F.pow(F.col("precision") - 1, 2) + F.pow(F.col("recall") - 1, 2))
    return _nearest(e.withColumn("dist", d))


def _nearest(e: DataFrame) -> DataFrame:
    e = e.filter(F.col("dist") < 1)
    row = F.struct("param_id", "threshold_offset", "dist")
    return e.agg(F.min_by(row, F.struct("dist", "param_id")).alias("b")) \
        .filter(F.col("b").isNotNull()) \
        .select("b.param_id", "b.threshold_offset", F.round("b.dist", 6).alias("dist"))


def confusion_matrix(entry: DataFrame, normalize: bool = False) -> DataFrame:
    """``[[tn, fp], [fn, tp]]`` in long form (actual, predicted, value);
    ``normalize`` divides by the row (actual class) sum."""
    long = entry.select(F.expr(
        "stack(4, 0, 0, true_negatives, 0, 1, false_positives, 1, 0, false_negatives, 1, 1, true_positives)"
        " as (actual, predicted, n)"))
    if not normalize:
        return long.select("actual", "predicted", F.col("n").cast("double").alias("value"))
    w = Window.partitionBy("actual")
    return long.select("actual", "predicted",
                       F.round(F.col("n") / F.sum("n").over(w), 6).alias("value"))


def validation_report(joined: DataFrame, prefix: str = "eval_", digits: int = 6) -> DataFrame:
    """Mean loss, per-label mean loss and perplexity (0 when a label is
    absent) and the ROC AUC of the perplexity (NULL when a class is empty)."""
    auc = auc_scores(joined, "perplexity").select("auc_roc").scalar()
    lab = F.col("anomalous")
    r = lambda c: F.round(c, digits)
    return joined.agg(
        r(F.avg("loss")).alias(f"{prefix}loss"),
        r(F.coalesce(F.avg(F.when(lab == 0, F.col("loss"))), F.lit(0.0))).alias(f"{prefix}loss_normal"),
        r(F.coalesce(F.avg(F.when(lab == 1, F.col("loss"))), F.lit(0.0))).alias(f"{prefix}loss_anomalous"),
        r(F.coalesce(F.avg(F.when(lab == 0, F.col("perplexity"))), F.lit(0.0))).alias(f"{prefix}perplexity_normal"),
        r(F.coalesce(F.avg(F.when(lab == 1, F.col("perplexity"))), F.lit(0.0))).alias(f"{prefix}perplexity_anomalous"),
    ).withColumn(f"{prefix}auc_roc", r(auc))
