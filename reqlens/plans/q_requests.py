"""Query keys for request rebuilding, rules and scans."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reqlens.operators import requests as rq
from reqlens.operators import rules
from reqlens.plans.catalog import register
from reqlens.plans.oracle import sql_str, with_views
from reqlens.session import ensure_checkpoint_dir
from reqlens.sources import fixtures as fx
from reqlens.sources import readers, sinks
from reqlens.sources.tables import table


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _lit_any_sql(col: str = "request") -> str:
    return "(" + " or ".join(f"contains({col}, {sql_str(p)})" for p in rules.distinct_literals()) + ")"


def _regex_any_sql(col: str = "request") -> str:
    return "(" + " or ".join(f"regexp_matches({col}, {sql_str(r)})" for r in rules.RELABEL_REGEXES) + ")"


RELABELLED_SQL = f"""
select original_index, case when anomalous = 1 or ({_lit_any_sql()} or {_regex_any_sql()}) then 1 else 0 end as anomalous,
  ano_class, request, (anomalous <> 1 and ({_lit_any_sql()} or {_regex_any_sql()})) as relabelled
from requests"""


@register("http_reconstruct", with_views("select original_index, request from requests", "requests"))
def q_http_reconstruct(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("original_index", "request")


@register("http_essential_filter", with_views(
    "select original_index from http_raw where request_http_method is not null "
    "and request_http_request is not null and request_http_protocol is not null", "http_raw"))
def q_http_essential_filter(spark, sf_dir):
    return rq.essential_filter(fx.http_raw(spark, sf_dir)).select("original_index")


@register("class_first_match", with_views("select original_index, ano_class from requests", "requests"))
def q_class_first_match(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("original_index", "ano_class")


@register("anomalous_flag", with_views("select original_index, anomalous from requests", "requests"))
def q_anomalous_flag(spark, sf_dir):
    return fx.requests(spark, sf_dir).select("original_index", "anomalous")


@register("assign_index",
          "select row_number() over (order by event_id) as original_index, event_id from events")
def q_assign_index(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_id")
    return rq.assign_index(ev).select("original_index", "event_id")


@register("pattern_any", with_views(f"select original_index, {_lit_any_sql()} as hit from requests", "requests"))
def q_pattern_any(spark, sf_dir):
    return fx.request_table(spark, sf_dir).select("original_index", rules.literal_hit().alias("hit"))


@register("pattern_regex", with_views(f"select original_index, {_regex_any_sql()} as hit from requests", "requests"))
def q_pattern_regex(spark, sf_dir):
    return fx.request_table(spark, sf_dir).select("original_index", rules.regex_hit().alias("hit"))


@register("relabel_by_pattern", with_views(
    "select original_index, anomalous, ano_class, relabelled from relabelled", "requests",
    extra=[("relabelled", RELABELLED_SQL)]))
def q_relabel_by_pattern(spark, sf_dir):
    return rules.relabel(fx.request_table(spark, sf_dir)).select(
        "original_index", "anomalous", "ano_class", "relabelled")


@register("mislabeled_semi_join", with_views(
    "select original_index, ano_class from requests where original_index in "
    "(select original_index from relabelled where relabelled)", "requests",
    extra=[("relabelled", RELABELLED_SQL)]))
def q_mislabeled_semi_join(spark, sf_dir):
    req = fx.request_table(spark, sf_dir)
    idx = rules.mislabeled_indexes(rules.relabel(req))
    return rules.mislabeled_rows(req, idx).select("original_index", "ano_class")


@register("relabel_summary", with_views(
    "select count(*) filter (where relabelled) as relabelled, count(*) as total, "
    "round(count(*) filter (where relabelled) / count(*), 6) as share from relabelled", "requests",
    extra=[("relabelled", RELABELLED_SQL)]))
def q_relabel_summary(spark, sf_dir):
    return rules.relabel_summary(rules.relabel(fx.request_table(spark, sf_dir)))


def _hit_counts_sql() -> str:
    lits = ", ".join(sql_str(p) for p in rules.distinct_literals())
    regs = ", ".join(sql_str(r) for r in rules.RELABEL_REGEXES)
    return with_views(f"""
select 'literal' as kind, p as pattern, count(*) as hits
from requests cross join unnest([{lits}]) t(p) where contains(request, p) group by p
union all
select 'regex' as kind, p as pattern, count(*) as hits
from requests cross join unnest([{regs}]) t(p) where regexp_matches(request, p) group by p""", "requests")


@register("pattern_hit_counts", _hit_counts_sql())
def q_pattern_hit_counts(spark, sf_dir):
    return rules.pattern_hit_counts(fx.request_table(spark, sf_dir))


@register("class_counts", with_views(
    "select ano_class, count(*) as total from requests where ano_class <> 'normal' and ano_class is not null "
    "group by ano_class order by total desc", "requests"))
def q_class_counts(spark, sf_dir):
    from reqlens.operators.report import class_counts
    return class_counts(fx.request_table(spark, sf_dir))


@register("label_filter", with_views("""
select original_index, 'hide_anomalous' as mode from requests where not (anomalous = 1)
union all select original_index, 'hide_normal' from requests where not (anomalous = 0)
union all select original_index, 'anomalous_only' from requests where anomalous = 1
union all select original_index, 'drop_normal_class' from requests where ano_class <> 'normal' and ano_class is not null""",
    "requests"))
def q_label_filter(spark, sf_dir):
    req = fx.request_table(spark, sf_dir)
    out = None
    for mode in ("hide_anomalous", "hide_normal", "anomalous_only", "drop_normal_class"):
        part = rq.label_filter(req, mode).select("original_index", F.lit(mode).alias("mode"))
        out = part if out is None else out.unionByName(part)
    return out


@register("valid_text_filter", with_views(
    r"select original_index from doc_requests where request is not null and regexp_matches(request, '\S')",
    "doc_requests"))
def q_valid_text_filter(spark, sf_dir):
    return rq.valid_text_filter(fx.doc_requests(spark, sf_dir)).select("original_index")


@register("positional_slice", with_views(
    "select original_index, loss from predictions order by original_index limit 1000 offset 1000",
    "predictions"))
def q_positional_slice(spark, sf_dir):
    return rq.positional_slice(fx.predictions(spark, sf_dir), "original_index", 1000, 1000) \
        .select("original_index", "loss")


@register("sample_category", with_views(
    "select p.original_index, case when r.anomalous = 1 then 'red' else 'gray' end as category "
    "from predictions p join requests r on p.original_index = r.original_index", "predictions", "requests"))
def q_sample_category(spark, sf_dir):
    from reqlens.operators.evaluate import join_pred_truth
    j = join_pred_truth(fx.predictions(spark, sf_dir), fx.request_table(spark, sf_dir))
    return j.select("original_index", rq.sample_category(True).alias("category"))


RAW_KEEP = ["request_http_method", "request_http_request", "request_http_protocol", "request_host",
            "request_user_agent", "request_accept", "request_referer", "request_cookie", "request_body"]


@register("scan_raw_requests", with_views(
    "select original_index, " + ", ".join(f"nullif({c}, '') as {c}" for c in RAW_KEEP)
    + ", is_normal as normal_flag from http_raw", "http_raw"))
def q_scan_raw_requests(spark, sf_dir):
    """S1 round trip: the raw view is written as a wide CSV with the source
    column names, then scanned back with the declared schema + NA cleanup."""
    from pyspark.sql import types as T
    from reqlens.schemas import NORMAL_FLAG, RAW_REQUEST_SCHEMA
    raw = fx.http_raw(spark, sf_dir)
    path = scratch_path(spark, "raw-csv")
    wide = raw.select("original_index", *RAW_KEEP, F.col("is_normal").alias(NORMAL_FLAG),
                      *[F.col(c).alias(n) for n, c in fx.FIXTURE_CLASS_COLUMNS])
    wide.write.mode("overwrite").option("header", True).option("quote", '"') \
        .option("escape", '"').csv(path)
    schema = T.StructType([T.StructField("original_index", T.LongType())] + list(RAW_REQUEST_SCHEMA.fields))
    back = readers.read_raw_requests(spark, path, schema=schema)
    return back.select("original_index", *RAW_KEEP, F.col(f"`{NORMAL_FLAG}`").alias("normal_flag"))


@register("scan_requests", with_views("select original_index, anomalous, ano_class, request from requests",
                                      "requests"))
def q_scan_requests(spark, sf_dir):
    """S2/K1 round trip through a CSV request table."""
    path = scratch_path(spark, "requests-csv")
    sinks.write_requests(fx.requests(spark, sf_dir), path, fmt="csv")
    return readers.read_requests(spark, path, fmt="csv")
