"""Query keys for explanation (M4, M5, F3, F5-F9, T7, T8), logits (F4),
index lists (F2), density (A21), validation report (A14), k sweep (R6),
explaining errors (R12) and the plug-in scorer (M6, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import evaluate as ev
from reqlens.operators import explain as xp
from reqlens.operators import lm
from reqlens.operators import threshold as th
from reqlens.plans.catalog import register
from reqlens.plans.oracle import with_views
from reqlens.plans.q_evaluate import joined
from reqlens.plans.q_evaluate import osql as eval_osql
from reqlens.plans.q_model import LM_VIEWS, model, splits
from reqlens.plans.q_model import osql as lm_osql
from reqlens.sources import fixtures as fx
from reqlens.sources.tables import table


CAUSAL_ROWS_SQL = ("xrows", """select original_index, pos, tok, nll from causal_tok
  union all select original_index, pos, tok, 0.0 from lt where pos = 1""")

MASKED_ROWS_SQL = ("xrows", """select original_index, pos, tok,
  -ln(case when coalesce(c_ab, 0) > 0 then 0.7 * cast(coalesce(c_atb, 0) as double) / c_ab + 0.3 * p_bi else p_bi end) as nll
  from probs""")


def _terminal_sql():
    return """select original_index, round(avg(exp(-nll)), 6) as mean_prob,
  replace(string_agg(chr(27) || '[38;2;255;' || cast(cast(round_even(exp(-nll) * 255, 0) as integer) as varchar)
    || ';255m' || tok || chr(27) || '[0m', '' order by pos) || chr(27) || '[0m', 'Ġ', ' ') as explained
from xrows group by original_index"""


@register("explain_causal", lm_osql(_terminal_sql(), CAUSAL_ROWS_SQL))
def q_explain_causal(spark, sf_dir):
    """M5 over all splits: per-token probabilities, gradient
    colours, terminal markup and the mean probability of real tokens."""
    out = xp.explain_requests(model(spark, sf_dir), splits(spark, sf_dir))
    return out.select("original_index", F.round("mean_prob", 6).alias("mean_prob"), "explained")


@register("explain_masked", lm_osql(_terminal_sql(), MASKED_ROWS_SQL))
def q_explain_masked(spark, sf_dir):
    """M4 over all splits (one masked position per token, T7/T8)."""
    out = xp.explain_requests(model(spark, sf_dir), splits(spark, sf_dir), kind="masked")
    return out.select("original_index", F.round("mean_prob", 6).alias("mean_prob"), "explained")


@register("single_position_rows", lm_osql(
    "select original_index, pos, tok, round(nll, 6) as nll from xrows", MASKED_ROWS_SQL))
def q_single_position_rows(spark, sf_dir):
    """One row per explained (masked) position with its loss."""
    rows = xp.masked_token_rows(model(spark, sf_dir), splits(spark, sf_dir))
    return rows.select("original_index", F.col("pos").cast("bigint").alias("pos"), "tok",
                       F.round("nll", 6).alias("nll"))


@register("token_probability", lm_osql(
    "select original_index, pos, round(exp(-nll), 6) as prob from xrows", CAUSAL_ROWS_SQL))
def q_token_probability(spark, sf_dir):
    """``exp(-loss)`` per token."""
    rows = xp.token_probabilities(xp.causal_token_rows(model(spark, sf_dir), splits(spark, sf_dir)))
    return rows.select("original_index", F.col("pos").cast("bigint").alias("pos"), F.round("prob", 6).alias("prob"))


@register("explain_gradient", lm_osql("""
select original_index, pos, lpad(lower(hex(cast(round_even(exp(-nll) * 255, 0) as integer))), 2, '0') as normal_hex,
  lpad(lower(hex(cast(round_even((1 - exp(-nll)) * 255, 0) as integer))), 2, '0') as anomaly_hex from xrows""",
    CAUSAL_ROWS_SQL))
def q_explain_gradient(spark, sf_dir):
    """F5 (+F7 with contrast 1): two-digit hex of the half-even rounded
    ``p*255`` and ``(1-p)*255``."""
    rows = xp.token_probabilities(xp.causal_token_rows(model(spark, sf_dir), splits(spark, sf_dir)))
    return rows.select("original_index", F.col("pos").cast("bigint").alias("pos"),
                       xp.hex2(F.col("prob")).alias("normal_hex"), xp.hex2(1 - F.col("prob")).alias("anomaly_hex"))


@register("explain_percentile", lm_osql("""
select x.original_index, x.pos, case when exp(-x.nll) < q.l[1] then 'FF0000' when exp(-x.nll) < q.l[2] then 'FFA500'
  when exp(-x.nll) < q.l[3] then 'FFFF00' end as colour
from xrows x join (select original_index, quantile_cont(exp(-nll), [0.02, 0.06, 0.14]) as l from xrows
                   group by original_index) q on q.original_index = x.original_index""", CAUSAL_ROWS_SQL))
def q_explain_percentile(spark, sf_dir):
    """per-request percentile colours."""
    rows = xp.request_tokens(model(spark, sf_dir), splits(spark, sf_dir))
    return xp.percentile_colours_of(rows).select("original_index", F.col("pos").cast("bigint").alias("pos"), "colour")


@register("explain_markup", lm_osql("""
select original_index, '<div style="background-color: #cccccc; color: white; padding: 20px; font-family: monospace; line-height: 1.5;">'
  || string_agg('<span style="color: #' || lpad(lower(hex(cast(round_even((1 - exp(-nll)) * 255, 0) as integer))), 2, '0')
     || '00' || lpad(lower(hex(cast(round_even(exp(-nll) * 255, 0) as integer))), 2, '0') || ';">'
     || replace(replace(replace(replace(tok, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ', '&nbsp;') || '</span>', '' order by pos)
  || '</div>' as explained
from xrows group by original_index""", CAUSAL_ROWS_SQL))
def q_explain_markup(spark, sf_dir):
    """HTML markup (special tokens dropped, text escaped)."""
    return xp.explain_requests(model(spark, sf_dir), splits(spark, sf_dir), ("html",)).select("original_index", "explained")


_LEVEL = "case when p < l[1] then 1 when p < l[2] then 2 when p < l[3] then 3 else 4 end"


@register("explain_markup_percentile", lm_osql(f"""
select original_index, fmt, case fmt when 'terminal' then body || chr(27) || '[0m'
    when 'html' then '<div style="background-color: #cccccc; color: white; padding: 20px; font-family: monospace; line-height: 1.5;">' || body || '</div>'
    else body end as explained
from (select original_index, fmt, string_agg(piece, '' order by pos) as body from (
  select original_index, pos, fmt, case fmt
    when 'terminal' then case when v < 4 then chr(27) || '[38;2;' || ['255;0;0', '255;165;0', '255;255;0'][v] || 'm' || tok || chr(27) || '[0m' else tok end
    when 'html' then '<span style="color: ' || ['#ff6b6b', '#ff8000', '#ffff00', '#000000'][v] || ';">'
      || replace(replace(replace(replace(tok, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ', '&nbsp;') || '</span>'
    else case when v < 4 then '|\\hlhex{{' || ['FF0000', 'FFA500', 'FFFF00'][v] || '}}{{' || latex || '}}|' else latex end end as piece
  from (select *, {_LEVEL} as v, replace(replace(replace(replace(tok, '_', '\\_'), '$', '\\$'), '%', '\\%'), '&', '\\&') as latex
        from (select x.original_index, x.pos, x.tok, exp(-x.nll) as p, q.l from xrows x join (
                select original_index, quantile_cont(exp(-nll), [0.02, 0.06, 0.14]) as l from xrows group by original_index) q
              on q.original_index = x.original_index) a) b
  cross join (select unnest(['terminal', 'html', 'latex']) as fmt) f) c group by original_index, fmt) d""", CAUSAL_ROWS_SQL))
def q_explain_markup_percentile(spark, sf_dir):
    """percentile colours as a marked-up string, in the three formats."""
    return xp.explain_requests(model(spark, sf_dir), splits(spark, sf_dir), ("terminal", "html", "latex"), gradient=False).select("original_index", "fmt", "explained")


@register("explain_contrast", lm_osql("""
select original_index, string_agg('|\\hlhex{ff' || lpad(lower(hex(cast(round_even(power(exp(-nll), 3) * 255, 0) as integer))), 2, '0') || 'ff}{'
    || replace(replace(replace(replace(tok, '_', '\\_'), '$', '\\$'), '%', '\\%'), '&', '\\&') || '}|', '' order by pos) as explained
from xrows group by original_index""", CAUSAL_ROWS_SQL))
def q_explain_contrast(spark, sf_dir):
    """gradient colours of the cubed probabilities, in LaTeX."""
    return xp.explain_requests(model(spark, sf_dir), splits(spark, sf_dir), ("latex",), contrast=3.0).select("original_index", "explained")


_ENTRIES_SQL = [
    ("scored", """select 'causal' as model, original_index, anomalous, split, loss from causal_scores
  union all select 'masked', original_index, anomalous, split, loss from masked_scores"""),
    ("grid", """select model, cast(i - 1 as bigint) as param_id, cast(i as double) * 0.01::double as t
  from range(1, 100) g(i) cross join (select distinct model from scored) m
  union all select model, 99, avg(loss) + 0.5 * stddev_pop(loss) from scored where split = 'eval' group by model"""),
    ("counted", """select g.model, g.param_id, g.t, count(*) filter (where s.loss > g.t and s.anomalous <> 0) as tp,
  count(*) filter (where s.loss > g.t and s.anomalous = 0) as fp, count(*) filter (where not (s.loss > g.t) and s.anomalous <> 0) as fn,
  count(*) filter (where not (s.loss > g.t) and s.anomalous = 0) as tn
  from grid g join scored s on s.model = g.model where s.split = 'test' group by g.model, g.param_id, g.t"""),
    ("entry", """select model, t from (select *, row_number() over (partition by model order by f1 - fnr desc, tp + tn, param_id) as k
  from (select *, 2.0 * tp / (2 * tp + fp + fn) as f1, case when tp + fn = 0 then 0.0 else fn / (tp + fn) end as fnr from counted) a where f1 - fnr > 0) b
  where k = 1"""),
    ("xrows", """select 'causal' as model, original_index, anomalous, pos, tok, nll from causal_tok
  union all select 'causal', original_index, anomalous, pos, tok, 0.0 from lt where pos = 1
  union all select 'masked', original_index, anomalous, pos, tok, nll from masked_tok"""),
]


@register("explain_errors", lm_osql("""
select x.original_index, x.model, coalesce(any_value(s.anomalous <> 0 and not (s.loss > e.t)), false) as is_fn,
  coalesce(any_value(s.anomalous = 0 and s.loss > e.t), false) as is_fp, round(avg(exp(-x.nll)), 6) as mean_prob,
  replace(string_agg(chr(27) || '[38;2;255;' || cast(cast(round_even(exp(-x.nll) * 255, 0) as integer) as varchar)
    || ';255m' || x.tok || chr(27) || '[0m', '' order by x.pos) || chr(27) || '[0m', 'Ġ', ' ') as explained
from xrows x left join entry e on e.model = x.model
left join scored s on s.model = x.model and s.original_index = x.original_index and s.split = 'test'
where x.anomalous = 1 group by x.original_index, x.model""", *_ENTRIES_SQL))
def q_explain_errors(spark, sf_dir):
    """Every anomalous request explained by both models, with the flags of the
    entry that has the best F1 - FNR on the test split."""
    from reqlens.plans.pipeline import PipelineConfig, run_stages
    s, m = splits(spark, sf_dir), model(spark, sf_dir)
    out = run_stages(spark, s, PipelineConfig(stages=("score", "threshold", "evaluate"), grid=True, best_by="f1fn"), model=m)
    test = out["predictions"].filter("split = 'test'")
    x = xp.explain_dataset(m, s.filter(F.col("anomalous") == 1), test, out["best"])
    return x.withColumn("mean_prob", F.round("mean_prob", 6))


@register("token_nll_from_logits", with_views("""
select original_index, pos, round(lse - cast(logits[label + 1] as double), 6) as nll from (
  select original_index, pos, logits, label,
    list_max(list_transform(logits, lambda x: cast(x as double)))
    + ln(list_sum(list_transform(logits, lambda x: exp(cast(x as double) - list_max(list_transform(logits, lambda y: cast(y as double))))))) as lse
  from token_logits where label <> -100) s""", "token_logits"))
def q_token_nll_from_logits(spark, sf_dir):
    """cross entropy ``logsumexp(logits) - logits[label]`` per token,
    max-shifted, label -100 ignored."""
    from reqlens.functions.logits import token_nll
    t = fx.token_logits(spark, sf_dir)
    return t.filter(F.col("label") != -100).select(
        "original_index", "pos", F.round(token_nll(F.col("logits"), F.col("label")), 6).alias("nll"))


@register("parse_index_list", """
select event_id + 1 as original_index,
  try_cast('[' || cast(user_id as varchar) || ', ' || cast(event_id as varchar) || ']' as bigint[]) as parsed,
  try_cast(props as bigint[]) is null as bad_is_null from events""")
def q_parse_index_list(spark, sf_dir):
    """parse a list literal (``[a, b]``) into ``ARRAY<BIGINT>``; text that
    is not a list (a JSON object here) gives NULL instead of an error."""
    from reqlens.functions.lists import parse_index_list
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(", "), F.col("event_id").cast("string"),
                    F.lit("]"))
    return e.select((F.col("event_id") + 1).alias("original_index"), parse_index_list(text).alias("parsed"),
                    parse_index_list(F.col("props")).isNull().alias("bad_is_null"))


@register("kde_curve", eval_osql("""
select cast(g.i as integer) as i, round(mn + g.i * step, 6) as x,
  round(sum(b.n * exp(-0.5 * power((mn + g.i * step - b.c) / h, 2))) / (max(total) * max(h) * sqrt(2 * pi())), 6) as density
from (select mn, (mx - mn) / 199.0::double as step, total, sd * power(total, -0.2::double) as h from (
        select min(loss) as mn, max(loss) as mx, cast(count(loss) as double) as total, stddev_samp(loss) as sd from joined where anomalous = 0) m) s
cross join (select least(floor((loss - lo) * 1500.0::double / nullif(hi - lo, 0)), 1499) as bin, avg(loss) as c, count(*) as n
            from joined cross join (select min(loss) as lo, max(loss) as hi from joined where anomalous = 0) l
            where anomalous = 0 and loss is not null group by 1) b
cross join (select unnest(range(0, 200)) as i) g group by g.i, mn, step"""))
def q_kde_curve(spark, sf_dir):
    """Gaussian KDE of the normal losses over 200 points, of 1500 bins."""
    j = joined(spark, sf_dir).filter(F.col("anomalous") == 0)
    return th.kde_curve(j, "loss", bins=1500, points=200).select("i", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@register("validation_report", eval_osql("""
select round(avg(loss), 6) as eval_loss,
  round(coalesce(avg(loss) filter (where anomalous = 0), 0), 6) as eval_loss_normal,
  round(coalesce(avg(loss) filter (where anomalous = 1), 0), 6) as eval_loss_anomalous,
  round(coalesce(avg(perplexity) filter (where anomalous = 0), 0), 6) as eval_perplexity_normal,
  round(coalesce(avg(perplexity) filter (where anomalous = 1), 0), 6) as eval_perplexity_anomalous,
  (select round(sum(pos * (neg_before + neg / 2.0)) / (max(p) * max(n)), 6) from (
     select pos, neg, coalesce(sum(neg) over (order by score rows between unbounded preceding and 1 preceding), 0) as neg_before,
       cast(sum(pos) over () as double) as p, cast(sum(neg) over () as double) as n
     from (select perplexity as score, count(*) filter (where anomalous = 1) as pos,
                  count(*) filter (where anomalous = 0) as neg from joined group by perplexity) g) c) as eval_auc_roc
from joined"""))
def q_validation_report(spark, sf_dir):
    """Validation metrics with the ``eval_`` prefix; per-label means are
    0 when a label is absent, the AUC NULL when a class is empty."""
    from reqlens.operators.evaluate import validation_report
    return validation_report(joined(spark, sf_dir), prefix="eval_")


@register("k_sweep", lm_osql("""
select k, round(case when fp + tn = 0 then 0.0 else fp / (fp + tn) end, 6) as FPR,
  round(case when 2 * tp2 + fp2 + fn2 <> 0 then 2.0 * tp2 / (2 * tp2 + fp2 + fn2) end, 6) as F1
from (select g.k,
        cast(count(*) filter (where c.split = 'eval' and c.anomalous = 0 and c.loss > s.mu + g.k * s.sd) as double) as fp,
        cast(count(*) filter (where c.split = 'eval' and c.anomalous = 0 and not (c.loss > s.mu + g.k * s.sd)) as double) as tn,
        count(*) filter (where c.split = 'test' and c.anomalous <> 0 and c.loss > s.mu + g.k * s.sd) as tp2,
        count(*) filter (where c.split = 'test' and c.anomalous = 0 and c.loss > s.mu + g.k * s.sd) as fp2,
        count(*) filter (where c.split = 'test' and c.anomalous <> 0 and not (c.loss > s.mu + g.k * s.sd)) as fn2
      from (select cast(i as double) / 100.0 as k from range(1, 200, 2) t(i)) g
      cross join (select avg(loss) as mu, stddev_pop(loss) as sd from causal_scores where split = 'eval') s
      cross join causal_scores c where c.split in ('eval', 'test') group by g.k) a"""))
def q_k_sweep(spark, sf_dir):
    """Threshold ``mu + k*sigma`` (eval losses) for k = 0.01..1.99 step
    0.02; FPR on the eval split and F1 on the test split, each one bucketed
    sweep over its rows (no rows x k product)."""
    from reqlens.operators.report import k_sweep
    m = model(spark, sf_dir)
    s = splits(spark, sf_dir)
    ev_set = s.filter(F.col("split") == "eval")
    te_set = s.filter(F.col("split") == "test")
    ev_scored = ev.join_pred_truth(lm.score_causal(m, ev_set), ev_set)
    te_scored = ev.join_pred_truth(lm.score_causal(m, te_set), te_set)
    return k_sweep(spark, ev_scored, te_scored)


@register("score_plugin")
def q_score_plugin(spark, sf_dir):
    """M6 + M8: a user-supplied scorer applied in Arrow batches
    (``mapInArrow``; the scorer is built once per task). The demo scorer is
    a character-class surprisal in numpy; rows only (model-defined)."""
    from reqlens.operators.plugin import char_class_scorer, score_with
    return score_with(fx.request_table(spark, sf_dir), char_class_scorer)


BUCKETS = 1024


def hashed_ids(tokens):
    """Ids of tokens in a fixed number of buckets, after the special ones."""
    return F.transform(tokens, lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % BUCKETS + 5))


@register("score_plugin_masked", lm_osql(f"""
select original_index, round(avg(loss), 6) as loss, round(avg(exp(loss)), 6) as perplexity, cast(max(n) * 5 as bigint) as tokens_count from (
  select k.original_index, sh.s, len(k.toks) as n,
    coalesce(avg(nll) filter (where (p.pos % 5) = sh.s), 0.0) as loss
  from tk k cross join (select unnest(range(0, 5)) as s) sh left join (
    select h.original_index, h.pos, -ln((coalesce(c.c, 0) + 1.0) / (t.n + {BUCKETS})) as nll
    from (select original_index, pos, ('0x' || substr(md5(tok), 1, 6))::integer % {BUCKETS} as b from lt) h
    left join (select ('0x' || substr(md5(tok), 1, 6))::integer % {BUCKETS} as b, count(*) as c from trn group by 1) c on c.b = h.b
    cross join (select count(*) as n from trn) t) p on p.original_index = k.original_index
  group by k.original_index, sh.s, len(k.toks)) x group by original_index"""))
def q_score_plugin_masked(spark, sf_dir):
    """M6 + T6 + F4 + A18 + A3: masked strided scores of a plug-in that gets padded
    batches of ids; its token losses are those of a bucketed unigram model fitted in Spark."""
    import math

    from reqlens.operators import plugin
    from reqlens.operators import tokens as tk
    from reqlens.sources.stage import stage_table
    # the ids are made once, for the fit and the scores
    s = stage_table(spark, ("hashed-ids", sf_dir), lambda: splits(spark, sf_dir).select("original_index", "split", "anomalous", hashed_ids(tk.all_tokens()).alias("ids")))
    counts = s.filter("split = 'train' and anomalous = 0").select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("c")).collect()
    n = sum(r.c for r in counts)  # at most BUCKETS rows
    known = {r.id: r.c for r in counts}
    losses = {i: -math.log((known.get(i, 0) + 1.0) / (n + BUCKETS)) for i in range(5, BUCKETS + 5)}

    def make():
        import numpy as np
        table = np.array([0.0] * 5 + [losses[i] for i in range(5, BUCKETS + 5)])
        return lambda ids, mask, labels: table[np.where(labels >= 0, labels, 0)]

    out = plugin.score_masked_with(s.select("original_index", "ids"), make, 5)
    return out.select("original_index", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "tokens_count")
