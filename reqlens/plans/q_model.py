"""Query keys for tokens and the count language model (T3-T6, T9, T10, W4,
W5, J6, M1-M3, M7, A3, A18) and the flagship pipeline (R13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import lm
from reqlens.operators import split as sp
from reqlens.operators import tokens as tk
from reqlens.plans.catalog import register
from reqlens.plans.oracle import with_views
from reqlens.plans.q_split import SPLIT_SQL
from reqlens.sources import fixtures as fx

PATTERN_SQL = r"'[A-Za-z0-9]+|[^A-Za-z0-9\s]'"

# ---------------------------------------------------------------- spark side


def splits(spark, sf_dir):
    from reqlens.plans.q_split import stored_splits
    return stored_splits(spark, sf_dir).select("original_index", "anomalous", "ano_class", "request", "split")


def fit_model(spark, sf_dir):
    s = splits(spark, sf_dir)
    return lm.fit(s.filter((F.col("split") == "train") & (F.col("anomalous") == 0)))


def model(spark, sf_dir):
    """The stored count model (K8) that scoring reads."""
    from reqlens.sources.stage import stage_table
    # the token rows are counted once: the other tables are sums of the stored context table
    context = stage_table(spark, ("model", sf_dir, "context"), lambda: fit_model(spark, sf_dir).context)
    sums = lm.CountModel.of_context(context)
    return lm.CountModel(*(stage_table(spark, ("model", sf_dir, n), lambda n=n: getattr(sums, n)) for n in ("unigram", "bigram")), context)


# ---------------------------------------------------------------- oracle side

LM_VIEWS = [
    SPLIT_SQL,
    ("sp", "select s.original_index, s.anomalous, s.split, r.request from split s join requests r "
           "on s.original_index = r.original_index"),
    ("tk", f"select original_index, split, anomalous, regexp_extract_all(request, {PATTERN_SQL}) as toks from sp"),
    ("lt", """select original_index, split, anomalous, i as pos, toks[i] as tok,
  case when i = 1 then '[CLS]' else toks[i - 1] end as prev,
  case when i = len(toks) then '[SEP]' else toks[i + 1] end as nxt
  from (select *, unnest(range(1, len(toks) + 1)) as i from tk) x"""),
    ("trn", "select * from lt where split = 'train' and anomalous = 0"),
    ("uni", "select tok, count(*) as c from trn group by tok"),
    ("bi", "select prev, tok, count(*) as c from trn group by prev, tok"),
    ("ctx", "select prev, tok, nxt, count(*) as c from trn group by prev, tok, nxt"),
    ("nv", "select cast(sum(c) as double) as n, cast(count(*) as double) as v from uni"),
    ("ca", "select prev, sum(c) as c_a from bi group by prev"),
    ("cab", "select prev, nxt, sum(c) as c_ab from ctx group by prev, nxt"),
    ("probs", """select l.original_index, l.split, l.anomalous, l.pos, l.tok,
  (coalesce(u.c, 0) + 1.0) / (nv.n + (nv.v + 1)) as p1,
  case when coalesce(ca.c_a, 0) > 0 then 0.7 * cast(coalesce(b.c, 0) as double) / ca.c_a
       + 0.3 * ((coalesce(u.c, 0) + 1.0) / (nv.n + (nv.v + 1)))
       else (coalesce(u.c, 0) + 1.0) / (nv.n + (nv.v + 1)) end as p_bi,
  x.c as c_atb, cab.c_ab
  from lt l cross join nv left join uni u on u.tok = l.tok
  left join bi b on b.prev = l.prev and b.tok = l.tok left join ca on ca.prev = l.prev
  left join ctx x on x.prev = l.prev and x.tok = l.tok and x.nxt = l.nxt
  left join cab on cab.prev = l.prev and cab.nxt = l.nxt"""),
    ("causal_tok", "select original_index, split, anomalous, pos, tok, -ln(p_bi) as nll from probs where pos >= 2"),
    ("masked_tok", """select original_index, split, anomalous, pos, tok,
  -ln(case when coalesce(c_ab, 0) > 0 then 0.7 * cast(coalesce(c_atb, 0) as double) / c_ab + 0.3 * p_bi else p_bi end) as nll
  from probs"""),
    ("causal_scores", """select s.original_index, s.split, s.anomalous,
  coalesce(sum(t.nll), 0) / (count(t.nll) + 1e-9) as loss from sp s
  left join causal_tok t on t.original_index = s.original_index group by s.original_index, s.split, s.anomalous"""),
    ("passes", """select s.original_index, s.split, s.anomalous, sh.shift_index,
  case when count(t.nll) > 0 then sum(t.nll) / count(t.nll) else 0.0 end as loss
  from sp s cross join (select unnest(range(0, 5)) as shift_index) sh
  left join masked_tok t on t.original_index = s.original_index and t.pos % 5 = sh.shift_index
  group by s.original_index, s.split, s.anomalous, sh.shift_index"""),
    ("masked_scores", """select original_index, split, anomalous, avg(loss) as loss, avg(exp(loss)) as perplexity
  from passes group by original_index, split, anomalous"""),
]


def osql(body, *extra):
    return with_views(body, "split_keys", "requests", extra=LM_VIEWS + list(extra))


# ---------------------------------------------------------------- queries


@register("tokenize_truncate", with_views(f"""
select original_index, len(regexp_extract_all(request, {PATTERN_SQL})) as n_total,
  regexp_extract_all(request, {PATTERN_SQL})[1:510] as tokens from doc_requests""", "doc_requests"))
def q_tokenize_truncate(spark, sf_dir):
    """T3 on the long document texts: the whole text is tokenised
    (``n_total``) and the sequence truncated to the 512-position window."""
    return tk.tokenize(fx.doc_requests(spark, sf_dir), max_tokens=tk.MAX_TOKENS).select(
        "original_index", F.col("n_total").cast("long").alias("n_total"), "tokens")


def _seq_sql(src="doc_requests"):
    return ("seq", f"""select original_index,
  list_concat(['[CLS]'], regexp_extract_all(request, {PATTERN_SQL}), ['[SEP]'],
              list_transform(range(0, greatest(510 - len(regexp_extract_all(request, {PATTERN_SQL})), 0)), lambda x: '[PAD]')) as seq
  from {src}""")


@register("special_mask", with_views("""
select original_index,
  list_transform(seq, lambda x: cast(list_contains(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], x) as integer)) as special_tokens_mask,
  list_transform(seq, lambda x: cast(x <> '[PAD]' as integer)) as attention_mask from seq""",
    "doc_requests", extra=[_seq_sql()]))
def q_special_mask(spark, sf_dir):
    t = tk.tokenize(fx.doc_requests(spark, sf_dir)).withColumn("seq", tk.padded())
    return t.select("original_index", tk.special_mask(F.col("seq")).alias("special_tokens_mask"),
                    tk.attention_mask(F.col("seq")).alias("attention_mask"))


@register("token_counts", with_views("""
select original_index, cast(len(list_filter(seq, lambda x: x <> '[PAD]')) as integer) as tokens_count from seq""",
    "doc_requests", extra=[_seq_sql()]))
def q_token_counts(spark, sf_dir):
    t = tk.tokenize(fx.doc_requests(spark, sf_dir)).withColumn("seq", tk.padded())
    return t.select("original_index", tk.token_count(tk.attention_mask(F.col("seq"))).alias("tokens_count"))


@register("stride_expand", with_views(
    "select original_index, shift_index from requests cross join (select cast(unnest(range(0, 5)) as integer) as shift_index) s",
    "requests"))
def q_stride_expand(spark, sf_dir):
    return tk.stride_expand(fx.request_table(spark, sf_dir).select("original_index"), 5)


@register("stride_mask", with_views("""
select original_index, shift_index,
  list_transform(generate_series(0, len(seq) - 1), lambda i: case when i % 5 = shift_index
      and not list_contains(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], seq[i + 1]) then '[MASK]' else seq[i + 1] end) as masked,
  cast(len(list_filter(generate_series(0, len(seq) - 1), lambda i: i % 5 = shift_index
      and not list_contains(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], seq[i + 1]))) as integer) as n_masked
from seq cross join (select cast(unnest(range(0, 5)) as integer) as shift_index) s""",
    "requests", extra=[_seq_sql("requests")]))
def q_stride_mask(spark, sf_dir):
    """Padding is never masked, so it is added to the masked sequence. A request becomes
    five times 512 positions, so the tasks follow the number of requests, not their bytes; which pass
    masks a position is found once a request."""
    r = fx.request_table(spark, sf_dir).select("original_index", "request")
    t = tk.tokenize(r.repartition(max(1, -(-r.count() // 5000)), "original_index", "request")).withColumn("seq", tk.between_sentinels())
    t = tk.stride_expand(t.select("original_index", "seq", tk.mask_passes(F.col("seq"), 5).alias("passes")), 5)
    seq, passes, shift = F.col("seq"), F.col("passes"), F.col("shift_index")
    masked, _ = tk.stride_mask(seq, 5, shift, passes)
    return t.select("original_index", "shift_index", tk.pad(masked, like=seq).alias("masked"),
                    tk.masked_count(seq, masked, passes, shift).alias("n_masked"))


@register("causal_labels", with_views("""
select original_index, list_transform(ids, lambda x: case when x = 0 then -100 else x end) as labels from (
  select original_index, list_transform(seq, lambda x: case x when '[PAD]' then 0 when '[CLS]' then 2 when '[SEP]' then 3
         else cast(5 + len(x) as integer) end) as ids from seq) s""", "requests", extra=[_seq_sql("requests")]))
def q_causal_labels(spark, sf_dir):
    """T10 on id sequences (ids here: specials 0..4, others ``5 + length``,
    a stand-in vocabulary that needs no fitted table)."""
    t = tk.tokenize(fx.request_table(spark, sf_dir).select("original_index", "request")).withColumn("seq", tk.padded())
    ids = F.transform("seq", lambda x: F.when(x == tk.PAD, 0).when(x == tk.CLS, 2).when(x == tk.SEP, 3)
                      .otherwise(F.length(x) + 5))
    return t.select("original_index", tk.causal_labels(ids).alias("labels"))


@register("random_mask", with_views(f"""
select original_index, list_transform(range(1, len(t) + 1), lambda i: case
  when not list_contains(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], t[i])
    and cast(('0x' || substr(md5('42|' || cast(original_index as varchar) || '|' || cast(i - 1 as varchar)), 1, 8))::bigint as double) / 4294967296.0 < 0.3
  then '[MASK]' else t[i] end) as masked
from (select original_index, regexp_extract_all(request, {PATTERN_SQL}) as t from requests)""", "requests"))
def q_random_mask(spark, sf_dir):
    """Seeded 30 % masking of the request tokens (the source's training
    mask; mask token only), by an md5-derived uniform."""
    t = tk.tokenize(fx.request_table(spark, sf_dir).select("original_index", "request"))
    return t.select("original_index", tk.random_mask(F.col("tokens"), F.col("original_index"), 0.30, 42).alias("masked"))


@register("next_token_pairs", osql("select original_index, pos, prev, tok from lt where pos >= 2"))
def q_next_token_pairs(spark, sf_dir):
    """(previous token, token) pairs of all requests."""
    rows = lm.long_tokens(splits(spark, sf_dir)).filter(F.col("pos") >= 2)
    return rows.select("original_index", F.col("pos").cast("bigint").alias("pos"), "prev", "tok")


@register("lm_fit_unigram", osql("select tok, c from uni"))
def q_lm_fit_unigram(spark, sf_dir):
    return fit_model(spark, sf_dir).unigram


@register("lm_fit_bigram", osql("select prev, tok, c from bi"))
def q_lm_fit_bigram(spark, sf_dir):
    return fit_model(spark, sf_dir).bigram


@register("lm_fit_context", osql("select prev, tok, nxt, c from ctx"))
def q_lm_fit_context(spark, sf_dir):
    return fit_model(spark, sf_dir).context


@register("sample_loss", osql("""
select original_index, round(loss, 6) as loss, round(exp(loss), 6) as perplexity from causal_scores"""))
def q_sample_loss(spark, sf_dir):
    """A18 (causal): per-request loss from token losses."""
    t = splits(spark, sf_dir)
    s = lm.sample_loss_causal(t, lm.causal_token_nll(model(spark, sf_dir), t))
    return s.select("original_index", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register("score_causal", osql("""
select original_index, round(loss, 6) as loss, round(exp(loss), 6) as perplexity from causal_scores"""))
def q_score_causal(spark, sf_dir):
    s = splits(spark, sf_dir)
    out = lm.score_causal(model(spark, sf_dir), s)
    return out.select("original_index", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register("causal_align", osql("""
select original_index, list_concat([0.0], list(round(nll, 6) order by pos)) as losses
from causal_tok group by original_index"""))
def q_causal_align(spark, sf_dir):
    """Per-request loss arrays, first token padded with 0."""
    t = splits(spark, sf_dir)
    found = lm.request_losses(lm.marked_texts(t, by_index=True), t, model(spark, sf_dir), {"nll": "causal"}, digits=6)
    scored = F.arrays_zip(F.col("tokens.pos").alias("pos"), F.col("tokens.nll").alias("nll"))
    arr = found.select("original_index", F.filter(F.sort_array(scored), lambda x: x["pos"] >= 2).alias("a")).filter(F.size("a") > 0)
    return arr.select("original_index", tk.causal_align(F.col("a.nll")).alias("losses"))


@register("stride_mean", osql("""
select original_index, round(loss, 6) as loss, round(perplexity, 6) as perplexity from masked_scores"""))
def q_stride_mean(spark, sf_dir):
    t = splits(spark, sf_dir)
    p = lm.pass_losses(t, lm.masked_token_nll(model(spark, sf_dir), t, 5), 5)
    m = lm.stride_mean(p)
    return m.select("original_index", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register("score_masked_strided", osql("""
select original_index, round(loss, 6) as loss, round(perplexity, 6) as perplexity from masked_scores"""))
def q_score_masked_strided(spark, sf_dir):
    s = splits(spark, sf_dir)
    out = lm.score_masked_strided(model(spark, sf_dir), s, 5)
    return out.select("original_index", F.round("loss", 6).alias("loss"), F.round("perplexity", 6).alias("perplexity"))


@register("lm_finetune_counts", osql("""
select tok, sum(c) as c from (select tok, cast(c as double) as c from uni
  union all select tok, cast(count(*) as double) from lt where split = 'eval' group by tok) u group by tok"""))
def q_lm_finetune_counts(spark, sf_dir):
    """M7: base model counts plus the counts of new data (the eval split)."""
    base = fit_model(spark, sf_dir)
    tuned = lm.finetune(base, splits(spark, sf_dir).filter(F.col("split") == "eval"))
    return tuned.unigram


@register("lm_finetune_bigram", osql("""
select prev, tok, sum(c) as c from (select prev, tok, 2.0::double * c as c from bi
  union all select prev, tok, cast(count(*) as double) from lt where split = 'eval' group by prev, tok) u group by prev, tok"""))
def q_lm_finetune_bigram(spark, sf_dir):
    """M7: the pair counts, the base's with weight 2."""
    return lm.finetune(model(spark, sf_dir), splits(spark, sf_dir).filter(F.col("split") == "eval"), 2.0).bigram


@register("lm_finetune_context", osql("""
select prev, tok, nxt, sum(c) as c from (select prev, tok, nxt, 2.0::double * c as c from ctx
  union all select prev, tok, nxt, cast(count(*) as double) from lt where split = 'eval' group by prev, tok, nxt) u group by prev, tok, nxt"""))
def q_lm_finetune_context(spark, sf_dir):
    """M7: the context counts, the base's with weight 2."""
    return lm.finetune(model(spark, sf_dir), splits(spark, sf_dir).filter(F.col("split") == "eval"), 2.0).context


def _pipeline_sql() -> str:
    te = ("te", """select 'causal' as model, original_index, anomalous, loss from causal_scores where split = 'test'
  union all select 'masked', original_index, anomalous, loss from masked_scores where split = 'test'""")
    est = ("est", """select 'causal' as model, avg(loss) + 0.5 * stddev_pop(loss) as threshold from causal_scores
  where split = 'eval' union all
  select 'masked', avg(loss) + 0.5 * stddev_pop(loss) from masked_scores where split = 'eval'""")
    cnt = ("cnt", """select te.model, max(e.threshold) as threshold,
  count(*) filter (where loss > threshold and anomalous <> 0) as tp,
  count(*) filter (where loss > threshold and anomalous = 0) as fp,
  count(*) filter (where not (loss > threshold) and anomalous <> 0) as fn,
  count(*) filter (where not (loss > threshold) and anomalous = 0) as tn
  from te join est e on e.model = te.model group by te.model""")
    auc = ("auc", """select model, sum(pos * (neg_before + neg / 2.0)) / (max(p) * max(n)) as auc_roc from (
  select model, pos, neg,
    coalesce(sum(neg) over (partition by model order by score rows between unbounded preceding and 1 preceding), 0) as neg_before,
    cast(sum(pos) over (partition by model) as double) as p, cast(sum(neg) over (partition by model) as double) as n
  from (select model, round(loss, 9) as score, count(*) filter (where anomalous = 1) as pos,
               count(*) filter (where anomalous = 0) as neg from te group by model, round(loss, 9)) g) c group by model""")
    global _PIPELINE_EXTRA
    _PIPELINE_EXTRA = (te, est, cnt, auc)
    return osql("""
select c.model, round(c.threshold, 6) as threshold, c.tp as true_positives, c.fp as false_positives,
  c.fn as false_negatives, c.tn as true_negatives,
  round(2.0 * c.tp / (2 * c.tp + c.fp + c.fn), 6) as f1, round(a.auc_roc, 6) as auc_roc
from cnt c join auc a on a.model = c.model""", te, est, cnt, auc)


@register("pipeline_report", _pipeline_sql())
def q_pipeline_report(spark, sf_dir):
    """R13 flagship: rebuild -> split -> fit -> score -> threshold -> evaluate
    (relabel stage off: the configuration the regression values hold for)."""
    from reqlens.plans.pipeline import PipelineConfig, run
    cfg = PipelineConfig(stages=("split", "fit", "score", "threshold", "evaluate"))
    return run(spark, fx.requests(spark, sf_dir), cfg)


def _pipeline_relabel_sql() -> str:
    from reqlens.plans.q_requests import RELABELLED_SQL
    base = _pipeline_sql()
    # Same chain, but the split keys come from the relabelled request table.
    body_start = base.index("\nselect c.model")
    body = base[body_start:]
    te, est, cnt, auc = _PIPELINE_EXTRA
    return with_views(body, "requests", extra=[
        ("relabelled", RELABELLED_SQL),
        ("split_keys", "select original_index, anomalous, md5('42|' || cast(original_index as varchar)) as shuffle_key "
                       "from relabelled"),
        *LM_VIEWS, te, est, cnt, auc])


@register("pipeline_report_relabel", _pipeline_relabel_sql())
def q_pipeline_report_relabel(spark, sf_dir):
    """R13 flagship with every stage: rebuild -> relabel -> split -> fit ->
    score -> threshold -> evaluate."""
    from reqlens.plans.pipeline import PipelineConfig, run
    return run(spark, fx.requests(spark, sf_dir), PipelineConfig())


def _experiment_sql(body: str) -> str:
    """The pipeline's scores, a 99th percentile threshold and the grid."""
    pipeline = _pipeline_sql()
    te = _PIPELINE_EXTRA[0]
    del pipeline
    est = ("est", "select model, quantile_cont(loss, 0.99) as threshold from (select 'causal' as model, loss from causal_scores where split = 'eval' "
                  "union all select 'masked', loss from masked_scores where split = 'eval') e group by model")
    grid = ("grid", "select model, cast(i - 1 as bigint) as param_id, cast(i as double) * 0.01::double as t, false as estimated "
                    "from range(1, 100) g(i) cross join est union all select model, 99, threshold, true from est")
    cnt = ("cnt", """select g.model, g.param_id, g.t, g.estimated,
  count(*) filter (where te.loss > g.t and te.anomalous <> 0) as tp, count(*) filter (where te.loss > g.t and te.anomalous = 0) as fp,
  count(*) filter (where not (te.loss > g.t) and te.anomalous <> 0) as fn, count(*) filter (where not (te.loss > g.t) and te.anomalous = 0) as tn
  from grid g join te on te.model = g.model group by g.model, g.param_id, g.t, g.estimated""")
    return osql(body, te, est, grid, cnt)


_EXPERIMENT = dict(stages=("split", "fit", "score", "threshold", "evaluate"), method="percentile", grid=True, best_by="f1fn")


@register("pipeline_evaluations", _experiment_sql("""
select model, param_id, round(t, 6) as threshold_offset, estimated, tp as true_positives, fp as false_positives,
  fn as false_negatives, tn as true_negatives from cnt"""))
def q_pipeline_evaluations(spark, sf_dir):
    """The evaluation table of a run with a percentile threshold and the grid."""
    from reqlens.plans.pipeline import PipelineConfig, run_stages
    e = run_stages(spark, fx.requests(spark, sf_dir), PipelineConfig(**_EXPERIMENT))["evaluations"]
    return e.select("model", "param_id", F.round("threshold_offset", 6).alias("threshold_offset"), "estimated", "true_positives",
                    "false_positives", "false_negatives", "true_negatives")


@register("pipeline_best", _experiment_sql("""
select model, param_id, round(t, 6) as threshold_offset, tp as true_positives, fp as false_positives from (
  select *, row_number() over (partition by model order by f1 - fnr desc, tp + tn, param_id) as k from (
    select *, 2.0 * tp / (2 * tp + fp + fn) as f1, case when tp + fn = 0 then 0.0 else fn / (tp + fn) end as fnr from cnt) m
  where f1 - fnr > 0) r where k = 1"""))
def q_pipeline_best(spark, sf_dir):
    """R13 + R1: each model's entry with the best F1 - FNR."""
    from reqlens.plans.pipeline import PipelineConfig, run_stages
    b = run_stages(spark, fx.requests(spark, sf_dir), PipelineConfig(**_EXPERIMENT))["best"]
    return b.select("model", "param_id", F.round("threshold_offset", 6).alias("threshold_offset"), "true_positives", "false_positives")
