"""Query keys for thresholds, evaluation and reports on the ``predictions``
fixture joined with the rebuilt request table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.functions import metrics as M
from reqlens.operators import evaluate as ev
from reqlens.operators import report as rp
from reqlens.operators import threshold as th
from reqlens.plans.catalog import register
from reqlens.plans.oracle import with_views
from reqlens.sources import fixtures as fx
from reqlens.sources import readers

# ---------------------------------------------------------------- spark side


def joined(spark, sf_dir):
    return ev.join_pred_truth(fx.predictions(spark, sf_dir), fx.request_table(spark, sf_dir))


def estimated(spark, sf_dir, metric="loss", k=0.5):
    """Gaussian threshold on the normal rows (the validation role)."""
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    return th.gaussian_threshold(j, metric, k).select("threshold")


def params(spark, sf_dir, metric="loss"):
    return ev.param_grid(spark, estimated(spark, sf_dir, metric), metric=metric)


def sweep(spark, sf_dir, metric="loss"):
    return ev.threshold_sweep(joined(spark, sf_dir), params(spark, sf_dir, metric), metric)


def evals(spark, sf_dir, metric="loss"):
    """The stored evaluation table (K6), as the report functions read it."""
    from reqlens.sources.stage import stage_table
    return stage_table(spark, ("evals", sf_dir, metric), lambda: sweep(spark, sf_dir, metric))


# ---------------------------------------------------------------- oracle side

JOINED = ("joined", "select p.original_index, p.loss, p.perplexity, r.anomalous, r.ano_class "
          "from predictions p join requests r on p.original_index = r.original_index")


def _est(metric):
    return (f"est_{metric}", f"select avg({metric}) + 0.5 * stddev_pop({metric}) as threshold "
                             f"from joined where anomalous = 0")


def _params(metric):
    return (f"params_{metric}", f"""
select i - 1 as param_id, 3000 as window_size, cast(i as double) * 0.01::double as threshold_offset,
  '{metric}' as metric, true as average_anomalies, false as use_std_as_offset, 0.0::double as std_multiplier,
  false as estimated from range(1, 100) t(i)
union all
select 99::bigint, 3000, threshold, '{metric}', true, false, 0.0::double, true from est_{metric}""")


def _evals(metric):
    return (f"evals_{metric}", f"""
select p.param_id, p.window_size, round(p.threshold_offset, 6) as threshold_offset, p.metric, p.average_anomalies,
  p.use_std_as_offset, p.std_multiplier, round(p.threshold_offset, 6) as calculated_thresholds_avg,
  count(*) filter (where j.{metric} > p.threshold_offset and j.anomalous = 0) as false_positives,
  count(*) filter (where not (j.{metric} > p.threshold_offset) and not (j.anomalous = 0)) as false_negatives,
  count(*) filter (where not (j.{metric} > p.threshold_offset) and j.anomalous = 0) as true_negatives,
  count(*) filter (where j.{metric} > p.threshold_offset and not (j.anomalous = 0)) as true_positives,
  count(*) filter (where (j.{metric} > p.threshold_offset) = not (j.anomalous = 0)) as correct,
  p.estimated
from params_{metric} p cross join joined j
group by p.param_id, p.window_size, p.threshold_offset, p.metric, p.average_anomalies, p.use_std_as_offset,
  p.std_multiplier, p.estimated""")


def _metrics(src, name):
    f = lambda x: f"cast({x} as double)"
    tp, fp, tn, fn = f("true_positives"), f("false_positives"), f("true_negatives"), f("false_negatives")
    return (name, f"""
select *,
  case when {tp}+{tn}+{fp}+{fn} <> 0 then ({tp}+{tn})/({tp}+{tn}+{fp}+{fn}) end as accuracy,
  case when {tp}+{fn} = 0 then 0.0 else {tp}/({tp}+{fn}) end as tpr,
  case when {fp}+{tn} = 0 then 0.0 else {fp}/({fp}+{tn}) end as fpr,
  case when {tp}+{fp} <> 0 then {tp}/({tp}+{fp}) end as "precision",
  case when {tp}+{fn} = 0 then 0.0 else {tp}/({tp}+{fn}) end as recall,
  case when 2*{tp}+{fp}+{fn} <> 0 then 2*{tp}/(2*{tp}+{fp}+{fn}) end as f1,
  case when {fn}+{tp} = 0 then 0.0 else {fn}/({fn}+{tp}) end as fnr,
  case when {tn}+{fp} = 0 then 0.0 else {tn}/({tn}+{fp}) end as tnr
from {src}""")


def eval_views(metric="loss", with_metrics=False):
    extra = [JOINED, _est(metric), _params(metric), _evals(metric)]
    if with_metrics:
        extra.append(_metrics(f"evals_{metric}", f"m_{metric}"))
    return extra


def osql(body, *extra, metric="loss", metrics=False, views=("predictions", "requests")):
    return with_views(body, *views, extra=eval_views(metric, metrics) + list(extra))


EVAL_COLS = ("param_id, window_size, threshold_offset, metric, average_anomalies, use_std_as_offset, "
             "std_multiplier, calculated_thresholds_avg, false_positives, false_negatives, true_negatives, "
             "true_positives, correct, estimated")

# ---------------------------------------------------------------- queries


@register("join_pred_truth", osql("select original_index, loss, perplexity, anomalous, ano_class from joined"))
def q_join_pred_truth(spark, sf_dir):
    return joined(spark, sf_dir).select("original_index", "loss", "perplexity", "anomalous", "ano_class")


@register("classify_threshold", osql(
    "select original_index, coalesce(not isnan(loss) and loss > threshold, false) as classified "
    "from joined cross join est_loss"))
def q_classify_threshold(spark, sf_dir):
    t = estimated(spark, sf_dir).select("threshold").scalar()
    return joined(spark, sf_dir).select("original_index", ev.classify(F.col("loss"), t).alias("classified"))


@register("confusion_counts", osql("""
select count(*) filter (where j.loss > e.threshold and j.anomalous = 0) as false_positives,
  count(*) filter (where not (j.loss > e.threshold) and j.anomalous <> 0) as false_negatives,
  count(*) filter (where not (j.loss > e.threshold) and j.anomalous = 0) as true_negatives,
  count(*) filter (where j.loss > e.threshold and j.anomalous <> 0) as true_positives,
  round(avg(e.threshold), 6) as calculated_thresholds_avg,
  count(*) filter (where (j.loss > e.threshold) = (j.anomalous <> 0)) as correct
from joined j cross join est_loss e"""))
def q_confusion_counts(spark, sf_dir):
    t = estimated(spark, sf_dir).select("threshold").scalar()
    return ev.confusion_counts(joined(spark, sf_dir), t) \
        .withColumn("calculated_thresholds_avg", F.round("calculated_thresholds_avg", 6))


@register("threshold_gaussian", osql(
    "select round(avg(loss), 6) as mu, round(stddev_pop(loss), 6) as sigma, "
    "round(avg(loss) + 0.5 * stddev_pop(loss), 6) as threshold from joined where anomalous = 0"))
def q_threshold_gaussian(spark, sf_dir):
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    return th.gaussian_threshold(j, "loss", 0.5).select(*[F.round(c, 6).alias(c) for c in ("mu", "sigma", "threshold")])


@register("threshold_percentile", osql(
    "select round(quantile_cont(loss, 0.99), 6) as threshold from joined where anomalous = 0"))
def q_threshold_percentile(spark, sf_dir):
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    return th.percentile_threshold(j, "loss", 99).select(F.round("threshold", 6).alias("threshold"))


@register("percentile_profile", osql("""
select cast(p as integer) as percentile, round(v, 6) as value from (
  select unnest([25, 50, 75, 95, 99]) as p, unnest(q) as v
  from (select quantile_cont(loss, [0.25, 0.5, 0.75, 0.95, 0.99]) as q from joined where anomalous = 0) a) b"""))
def q_percentile_profile(spark, sf_dir):
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    return th.percentile_profile(j, "loss").select("percentile", F.round("value", 6).alias("value"))


@register("upside_deviation", osql("""
select case when count(loss) < 2 then 0.0 else
  round(sqrt(sum(pow(greatest(loss - (select avg(loss) from joined), 0.0), 2)) / (count(loss) - 1)), 6) end
  as upside_deviation from joined"""))
def q_upside_deviation(spark, sf_dir):
    return th.upside_deviation(joined(spark, sf_dir), "loss") \
        .select(F.round("upside_deviation", 6).alias("upside_deviation"))


@register("histogram", osql("""
select b.bin, round(s.mn + b.bin * (s.mx - s.mn) / 100.0, 6) as lo, round(s.mn + (b.bin + 1) * (s.mx - s.mn) / 100.0, 6) as hi,
  coalesce(c.n, 0) as count, round(coalesce(c.n, 0) / (s.cnt * (s.mx - s.mn) / 100.0), 6) as density
from (select cast(i as integer) as bin from range(0, 100) t(i)) b
cross join (select min(loss) as mn, max(loss) as mx, count(loss) as cnt from joined) s
left join (select cast(least(floor((loss - mn) * 100.0 / (mx - mn)), 99) as integer) as bin, count(*) as n
           from joined cross join (select min(loss) as mn, max(loss) as mx from joined) s2 group by 1) c
  on c.bin = b.bin"""))
def q_histogram(spark, sf_dir):
    h = th.histogram(joined(spark, sf_dir), "loss", bins=100, density=True)
    return h.select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count",
                    F.round("density", 6).alias("density"))


@register("gaussian_curve", osql("""
select i, round(lo + i * (hi - lo) / 999.0, 6) as x,
  round(exp(-0.5 * pow((lo + i * (hi - lo) / 999.0 - mu) / sd, 2)) / (sd * sqrt(2 * pi())), 6) as density
from (select cast(i as integer) as i from range(0, 1000) t(i)) g
cross join (select avg(loss) as mu, stddev_pop(loss) as sd, min(loss) - (max(loss) - min(loss)) * 0.05 as lo,
                   max(loss) + (max(loss) - min(loss)) * 0.05 as hi from joined where anomalous = 0) s"""))
def q_gaussian_curve(spark, sf_dir):
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    g = th.gaussian_curve(j, "loss")
    return g.select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@register("rolling_std_threshold", osql("""
select original_index, round(coalesce(case when count(loss) over w = 3000 then stddev_samp(loss) over w end,
  (select stddev_samp(loss) from joined)), 6) as rolling_std
from joined window w as (order by original_index rows between 2999 preceding and current row)"""))
def q_rolling_std_threshold(spark, sf_dir):
    r = th.rolling_std(joined(spark, sf_dir), "original_index", "loss", 3000)
    return r.select("original_index", F.round("rolling_std", 6).alias("rolling_std"))


@register("threshold_sweep", osql(f"select {EVAL_COLS} from evals_loss"))
def q_threshold_sweep(spark, sf_dir):
    return sweep(spark, sf_dir)


@register("param_cross_join", osql(f"select {EVAL_COLS} from evals_perplexity", metric="perplexity"))
def q_param_cross_join(spark, sf_dir):
    """Every parameter set against every prediction, via the one-pass
    bucket sweep (no row x parameter product is built)."""
    return sweep(spark, sf_dir, "perplexity")


@register("rolling_param_sweep", osql("""
select p.param_id, p.window_size, round(p.threshold_offset, 6) as threshold_offset, p.metric, p.average_anomalies,
  p.use_std_as_offset, p.std_multiplier, round(avg(p.threshold_offset + r.s * p.std_multiplier), 6) as calculated_thresholds_avg,
  count(*) filter (where r.loss > p.threshold_offset + r.s * p.std_multiplier and r.anomalous = 0) as false_positives,
  count(*) filter (where not (r.loss > p.threshold_offset + r.s * p.std_multiplier) and not (r.anomalous = 0)) as false_negatives,
  count(*) filter (where not (r.loss > p.threshold_offset + r.s * p.std_multiplier) and r.anomalous = 0) as true_negatives,
  count(*) filter (where r.loss > p.threshold_offset + r.s * p.std_multiplier and not (r.anomalous = 0)) as true_positives,
  count(*) filter (where (r.loss > p.threshold_offset + r.s * p.std_multiplier) = not (r.anomalous = 0)) as correct, p.estimated
from (select param_id + cast(100 * m as bigint) as param_id, cast(1000 as integer) as window_size, threshold_offset, metric,
        average_anomalies, m > 0 as use_std_as_offset, cast(m as double) as std_multiplier, estimated
      from params_loss cross join (select unnest([0.0, 0.5, 1.0]) as m)) p
cross join (select loss, anomalous, coalesce(case when count(loss) over w = 1000 then stddev_samp(loss) over w end,
              (select stddev_samp(loss) from joined)) as s
            from joined window w as (order by original_index rows between 999 preceding and current row)) r
group by all"""))
def q_rolling_param_sweep(spark, sf_dir):
    """Parameter rows with constant and with rolling-std thresholds."""
    m = F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))
    p = params(spark, sf_dir).drop("use_std_as_offset", "std_multiplier", "window_size").withColumn("std_multiplier", m) \
        .withColumn("use_std_as_offset", F.col("std_multiplier") > 0).withColumn("window_size", F.lit(1000)) \
        .withColumn("param_id", F.col("param_id") + (F.col("std_multiplier") * 100).cast("long"))
    return ev.rolling_threshold_sweep(joined(spark, sf_dir), p)


@register("error_indexes", osql("""
select p.param_id, case when j.anomalous = 0 then 'fp' else 'fn' end as kind, j.original_index
from params_loss p cross join joined j
where (j.anomalous = 0 and j.loss > p.threshold_offset) or (j.anomalous <> 0 and not (j.loss > p.threshold_offset))"""))
def q_error_indexes(spark, sf_dir):
    return ev.error_indexes(joined(spark, sf_dir), params(spark, sf_dir))


def _auc_sql(score):
    return f"""
select round(sum(pos * (neg_before + neg / 2.0)) / (max(tp) * max(tn)), 6) as auc_roc,
  round(sum(case when pos > 0 then pos * ((max_p - pos_before) / ((max_p - pos_before) + (max_n - neg_before))) end) / max(max_p), 6) as auc_pr
from (select score, pos, neg,
        coalesce(sum(pos) over (order by score rows between unbounded preceding and 1 preceding), 0) as pos_before,
        coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as neg_before,
        cast(sum(pos) over () as double) as tp, cast(sum(neg) over () as double) as tn,
        cast(sum(pos) over () as double) as max_p, cast(sum(neg) over () as double) as max_n
      from (select {score} as score, count(*) filter (where anomalous = 1) as pos,
                   count(*) filter (where anomalous = 0) as neg from joined group by {score}) g) c"""


@register("auc_roc", osql(f"""
select l.auc_roc as auc_roc_loss, p.auc_roc as auc_roc_perplexity
from ({_auc_sql('loss')}) l cross join ({_auc_sql('perplexity')}) p"""))
def q_auc_roc(spark, sf_dir):
    j = joined(spark, sf_dir)
    a = ev.auc_scores(j, "loss").select(F.round("auc_roc", 6).alias("auc_roc_loss")).scalar()
    b = ev.auc_scores(j, "perplexity").select(F.round("auc_roc", 6).alias("auc_roc_perplexity")).scalar()
    return spark.range(1).select(a.alias("auc_roc_loss"), b.alias("auc_roc_perplexity"))


@register("auc_pr", osql(f"""
select l.auc_pr as auc_pr_loss, p.auc_pr as auc_pr_perplexity
from ({_auc_sql('loss')}) l cross join ({_auc_sql('perplexity')}) p"""))
def q_auc_pr(spark, sf_dir):
    j = joined(spark, sf_dir)
    a = ev.auc_scores(j, "loss").select(F.round("auc_pr", 6)).scalar()
    b = ev.auc_scores(j, "perplexity").select(F.round("auc_pr", 6)).scalar()
    return spark.range(1).select(a.alias("auc_pr_loss"), b.alias("auc_pr_perplexity"))


METRIC_COLS = ["accuracy", "tpr", "fpr", "precision", "recall", "f1", "fnr", "tnr"]


@register("metric_formulas", osql(
    "select param_id, " + ", ".join(f"round({c}, 6) as {c}" for c in METRIC_COLS) + " from m_loss",
    metrics=True))
def q_metric_formulas(spark, sf_dir):
    return M.with_metrics(evals(spark, sf_dir)).select("param_id", *METRIC_COLS)


def _best_sql():
    cols = "param_id, threshold_offset, false_positives, false_negatives, true_negatives, true_positives, correct"
    return f"""
select * from (select 'f1' as by, {cols} from m_loss where f1 > 0 order by f1 desc, correct, param_id limit 1)
union all select * from (select 'acc', {cols} from m_loss where accuracy > 0 order by accuracy desc, correct, param_id limit 1)
union all select * from (select 'fn', {cols} from m_loss order by fnr, correct desc, param_id desc limit 1)
union all select * from (select 'f1fn', {cols} from m_loss where f1 - fnr > 0 order by f1 - fnr desc, correct, param_id limit 1)
union all select * from (select 'estimated', {cols} from m_loss where estimated order by correct, param_id limit 1)"""


BEST_COLS = ["param_id", "threshold_offset", "false_positives", "false_negatives", "true_negatives",
             "true_positives", "correct"]


@register("best_result", osql(_best_sql(), metrics=True))
def q_best_result(spark, sf_dir):
    e = evals(spark, sf_dir)
    out = None
    for by in ("f1", "acc", "fn", "f1fn", "estimated"):
        part = ev.best_result(e, by).select(F.lit(by).alias("by"), *BEST_COLS)
        out = part if out is None else out.unionByName(part)
    return out


SUMMARY = ["f1", "accuracy", "fpr", "tpr", "fnr", "tnr"]


@register("evaluation_summary", osql("""
select entry, param_id, """ + ", ".join(f"round({c}, 6) as {c}" for c in SUMMARY) + """, std_multiplier, window_size from (
  select * from (select 'best_f1' as entry, * from m_loss where f1 > 0
                 order by f1 desc, correct, false_negatives, false_positives, param_id limit 1)
  union all select * from (select 'estimated', * from m_loss where estimated
                 order by correct desc, false_negatives desc, false_positives desc, param_id desc limit 1)
  union all select * from (select 'best_f1fn', * from m_loss where f1 - fnr > 0 order by f1 - fnr desc, correct, param_id limit 1)
  union all select * from (select 'lowest_fn', * from m_loss order by fnr, correct desc, param_id desc limit 1)) s""",
    metrics=True))
def q_evaluation_summary(spark, sf_dir):
    return ev.evaluation_summary(evals(spark, sf_dir))


@register("evaluation_sorted", osql(
    "select param_id, correct, false_negatives, false_positives from evals_loss "
    "order by correct, false_negatives, false_positives"))
def q_evaluation_sorted(spark, sf_dir):
    return evals(spark, sf_dir).orderBy("correct", "false_negatives", "false_positives") \
        .select("param_id", "correct", "false_negatives", "false_positives")


@register("roc_points", osql("select param_id, threshold_offset, round(fpr, 6) as fpr, round(tpr, 6) as tpr from m_loss",
                             metrics=True))
def q_roc_points(spark, sf_dir):
    return ev.roc_points(evals(spark, sf_dir))


@register("roc_nearest", osql("""
select param_id, threshold_offset, round(d, 6) as dist from (
  select param_id, threshold_offset, sqrt(pow(fpr, 2) + pow(tpr - 1, 2)) as d from m_loss) s
where d < 1 order by d, param_id limit 1""", metrics=True))
def q_roc_nearest(spark, sf_dir):
    return ev.roc_nearest(evals(spark, sf_dir))


@register("pr_points", osql(
    'select param_id, threshold_offset, round("precision", 6) as "precision", round(recall, 6) as recall '
    'from m_loss where "precision" is not null', metrics=True))
def q_pr_points(spark, sf_dir):
    return ev.pr_points(evals(spark, sf_dir))


@register("pr_nearest", osql("""
select param_id, threshold_offset, round(d, 6) as dist from (
  select param_id, threshold_offset, sqrt(pow("precision" - 1, 2) + pow(recall - 1, 2)) as d from m_loss
  where "precision" is not null) s
where d < 1 order by d, param_id limit 1""", metrics=True))
def q_pr_nearest(spark, sf_dir):
    return ev.pr_nearest(evals(spark, sf_dir))


@register("confusion_matrix", osql("""
select false as normalized, actual, predicted, cast(n as double) as value from e
union all
select true, actual, predicted, round(n / sum(n) over (partition by actual), 6) from e""",
    ("e", """select * from (select 0 as actual, 0 as predicted, true_negatives as n from evals_loss where estimated
             union all select 0, 1, false_positives from evals_loss where estimated
             union all select 1, 0, false_negatives from evals_loss where estimated
             union all select 1, 1, true_positives from evals_loss where estimated)""")))
def q_confusion_matrix(spark, sf_dir):
    entry = ev.best_result(evals(spark, sf_dir), "estimated")
    raw = ev.confusion_matrix(entry, False).withColumn("normalized", F.lit(False))
    norm = ev.confusion_matrix(entry, True).withColumn("normalized", F.lit(True))
    return raw.unionByName(norm).select("normalized", "actual", "predicted", "value")


@register("eval_curves", with_views("""
select 'loss' as model, param_id, threshold_offset as x, round(f1, 6) as y, estimated as is_marker from m_loss
union all
select 'perplexity', param_id, threshold_offset, round(f1, 6), estimated from m_perplexity""",
    "predictions", "requests", extra=eval_views("loss", True) + [_est("perplexity"), _params("perplexity"),
                                                                  _evals("perplexity"),
                                                                  _metrics("evals_perplexity", "m_perplexity")]))
def q_eval_curves(spark, sf_dir):
    from reqlens.operators.report import eval_curves
    both = evals(spark, sf_dir).withColumn("model", F.lit("loss")).unionByName(
        evals(spark, sf_dir, "perplexity").withColumn("model", F.lit("perplexity")))
    return eval_curves(both, x_metric="threshold_offset", y_metric="f1")


@register("scan_evaluations", with_views("""
select 'loss' as model, param_id, threshold_offset, true_positives, false_positives from evals_loss
union all
select 'perplexity', param_id, threshold_offset, true_positives, false_positives from evals_perplexity""",
    "predictions", "requests", extra=eval_views("loss") + [_est("perplexity"), _params("perplexity"),
                                                            _evals("perplexity")]))
def q_scan_evaluations(spark, sf_dir):
    """S5/K6 round trip: two evaluation tables are written, then read back
    together with a path that does not exist (skipped with a warning)."""
    import warnings

    from reqlens.plans.q_requests import scratch_path
    from reqlens.sources.sinks import write_evaluations
    p1, p2, missing = (scratch_path(spark, n) for n in ("eval-loss", "eval-ppl", "eval-missing"))
    write_evaluations(sweep(spark, sf_dir), p1)
    write_evaluations(sweep(spark, sf_dir, "perplexity"), p2)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        both = readers.read_evaluations(spark, [p1, missing, p2], ["loss", "missing", "perplexity"])
    return both.select("model", "param_id", "threshold_offset", "true_positives", "false_positives")


@register("class_fn_rates", osql("""
select ano_class, count(*) as total, count(*) filter (where not (loss > threshold)) as fn_count, 0::bigint as fp_count,
  round(count(*) filter (where not (loss > threshold)) / count(*), 6) as fn_rate
from joined cross join est_loss where ano_class <> 'normal' and ano_class is not null and anomalous <> 0
group by ano_class having count(*) filter (where not (loss > threshold)) / count(*) > 0.001"""))
def q_class_fn_rates(spark, sf_dir):
    j = joined(spark, sf_dir)
    t = estimated(spark, sf_dir).select("threshold").scalar()
    fn, fp = rp.errors_at_threshold(j, t)
    return rp.class_fn_rates(fx.request_table(spark, sf_dir), fn, fp).withColumn("fn_rate", F.round("fn_rate", 6))


def _fn_rates_sql(metric):
    return f"""
select '{metric}' as model, ano_class, count(*) as total,
  count(*) filter (where not ({metric} > threshold)) as fn_count, 0::bigint as fp_count,
  round(count(*) filter (where not ({metric} > threshold)) / count(*), 6) as fn_rate
from joined cross join est_{metric} where ano_class <> 'normal' and ano_class is not null and anomalous <> 0
group by ano_class having count(*) filter (where not ({metric} > threshold)) / count(*) > 0.001"""


@register("class_fn_rates_multi", with_views(
    _fn_rates_sql("loss") + " union all " + _fn_rates_sql("perplexity"), "predictions", "requests",
    extra=[JOINED, _est("loss"), _est("perplexity")]))
def q_class_fn_rates_multi(spark, sf_dir):
    j = joined(spark, sf_dir)
    models = [(m, j, estimated(spark, sf_dir, m).select("threshold").scalar(), m) for m in ("loss", "perplexity")]
    return rp.class_fn_rates_multi(fx.request_table(spark, sf_dir), models) \
        .select("model", "ano_class", "total", "fn_count", "fp_count", "fn_rate")


@register("membership_flags", osql("""
select j.original_index, coalesce(f.hit, false) as is_fn
from joined j left join (select distinct original_index, true as hit from joined cross join est_loss
                         where anomalous <> 0 and not (loss > threshold)) f on f.original_index = j.original_index"""))
def q_membership_flags(spark, sf_dir):
    j = joined(spark, sf_dir)
    t = estimated(spark, sf_dir).select("threshold").scalar()
    fn, _ = rp.errors_at_threshold(j, t)
    return ev.membership_flags(j.select("original_index"), fn, "is_fn")


@register("sample_distribution", osql("""
select original_index, loss as value, case when anomalous = 1 then 'red' else 'gray' end as category,
  row_number() over (order by loss, original_index) - 1 as rank
from (select * from joined order by original_index limit 1000 offset 1000) s"""))
def q_sample_distribution(spark, sf_dir):
    return rp.sample_distribution(joined(spark, sf_dir), "loss", 1000, 1000, sort=True)


TAGS = ["click", "view", "purchase"]


@register("train_log_latest_run", with_views("""
select run, tag, step, value from train_log
where run = (select run from train_log order by mtime desc, run desc limit 1) and tag in ('click', 'view', 'purchase')""",
    "train_log"))
def q_train_log_latest_run(spark, sf_dir):
    return readers.latest_run_log(fx.train_log(spark, sf_dir), TAGS).select("run", "tag", "step", "value")


@register("train_curves", with_views("""
select step, max(value) filter (where tag = 'click') as click, max(value) filter (where tag = 'view') as view,
  max(value) filter (where tag = 'purchase') as purchase
from train_log where run = (select run from train_log order by mtime desc, run desc limit 1)
  and tag in ('click', 'view', 'purchase') group by step""", "train_log"))
def q_train_curves(spark, sf_dir):
    return rp.train_curves(fx.train_log(spark, sf_dir), TAGS)


@register("timing_sum", with_views("""
select original_index, round(sum(time_taken), 6) as time_taken, cast(sum(tokens_count) as bigint) as tokens_count
from timings group by original_index""", "timings"))
def q_timing_sum(spark, sf_dir):
    from reqlens.operators.plugin import timing_sum
    return timing_sum(fx.timings(spark, sf_dir)).withColumn("time_taken", F.round("time_taken", 6))


@register("error_intervals", osql("""
select original_index, kind, cast(min(r) as integer) as "first", cast(max(r) as integer) as "last" from (
  select j.original_index, case when anomalous = 0 then 'fp' else 'fn' end as kind, g.r
  from joined j cross join (select i - 1 as r, cast(i as double) * 0.01::double as t from range(1, 100) x(i)) g
  where (anomalous = 0 and loss > t) or (anomalous <> 0 and not (loss > t))) e group by original_index, kind"""))
def q_error_intervals(spark, sf_dir):
    """The error sets of the whole grid, one interval for each row."""
    return ev.error_intervals(joined(spark, sf_dir), ev.param_grid(spark))
