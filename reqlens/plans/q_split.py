"""Query keys for the seeded split."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import split as sp
from reqlens.plans.catalog import register
from reqlens.plans.oracle import with_views
from reqlens.sources import fixtures as fx
from reqlens.sources import readers, sinks


def split_table(spark, sf_dir):
    return sp.stratified_split(fx.request_table(spark, sf_dir))


def stored_splits(spark, sf_dir):
    """The stored split table (K3)."""
    from reqlens.sources.stage import stage_table
    return stage_table(spark, ("splits", sf_dir), lambda: split_table(spark, sf_dir).select(
        "original_index", "anomalous", "ano_class", "request", "shuffle_key", "split"))


def _frac(split: str) -> str:
    f = sp.DEFAULT_FRACTIONS
    return (f"(case when anomalous = 0 then {f[split + '_frac_normals']!r}::double "
            f"else {f[split + '_frac_anomalous']!r}::double end)")


SPLIT_SQL = ("split", f"""
select original_index, anomalous, shuffle_key,
  case when rn <= floor({_frac('train')} * n) then 'train'
       when rn <= floor({_frac('train')} * n) + floor({_frac('eval')} * n) then 'eval'
       when rn <= floor({_frac('train')} * n) + floor({_frac('eval')} * n) + floor({_frac('test')} * n) then 'test'
       else 'unused' end as split
from (select original_index, anomalous, shuffle_key,
        row_number() over (partition by anomalous order by shuffle_key, original_index) as rn,
        count(*) over (partition by anomalous) as n from split_keys) r""")


def osql(body, *extra):
    return with_views(body, "split_keys", extra=[SPLIT_SQL, *extra])


@register("stratified_split", osql("select original_index, anomalous, split from split"))
def q_stratified_split(spark, sf_dir):
    return split_table(spark, sf_dir).select("original_index", "anomalous", "split")


@register("split_anti_join", osql(
    "select original_index from split_keys where original_index not in "
    "(select original_index from split where split = 'train')"))
def q_split_anti_join(spark, sf_dir):
    s = stored_splits(spark, sf_dir)
    train = s.filter(F.col("split") == "train")
    return sp.split_anti_join(fx.request_table(spark, sf_dir), train).select("original_index")


@register("split_sizes", with_views(f"""
select anomalous as cls, count(*) as n,
  cast(floor({_frac('train')} * count(*)) as bigint) as n_train,
  cast(floor({_frac('eval')} * count(*)) as bigint) as n_eval,
  cast(floor({_frac('test')} * count(*)) as bigint) as n_test
from requests group by anomalous""", "requests"))
def q_split_sizes(spark, sf_dir):
    return sp.split_sizes(fx.request_table(spark, sf_dir))


@register("split_stats", osql("""
select split, count(*) as rows, count(*) filter (where anomalous = 0) as normal,
  count(*) filter (where anomalous = 1) as anomalous,
  round(count(*) / (select count(*) from split), 6) as split_share,
  round(count(*) filter (where anomalous = 0) / count(*), 6) as normal_share,
  round(count(*) filter (where anomalous = 1) / count(*), 6) as anomalous_share
from split group by split"""))
def q_split_stats(spark, sf_dir):
    st = sp.split_stats(stored_splits(spark, sf_dir))
    return st.select("split", "rows", "normal", "anomalous",
                     *[F.round(c, 6).alias(c) for c in ("split_share", "normal_share", "anomalous_share")])


@register("seeded_shuffle", with_views(
    "select original_index, shuffle_key from split_keys order by shuffle_key", "split_keys"))
def q_seeded_shuffle(spark, sf_dir):
    return fx.request_table(spark, sf_dir).select("original_index", sp.shuffle_key(42).alias("shuffle_key")) \
        .orderBy("shuffle_key")


@register("scan_split", osql("select original_index, anomalous, split from split where split = 'test'"))
def q_scan_split(spark, sf_dir):
    """K3/S3 round trip: splits written partitioned by ``split``, the test
    split read back through partition pruning."""
    from reqlens.plans.q_requests import scratch_path
    path = scratch_path(spark, "splits")
    sinks.write_splits(split_table(spark, sf_dir).select("original_index", "anomalous", "request", "split"), path)
    return readers.read_split(spark, path, "test").select("original_index", "anomalous", "split")


@register("split_overlapping", osql("""
select original_index, anomalous, split from split where split in ('train', 'eval')
union all
select original_index, anomalous, 'test' from (
  select k.original_index, k.anomalous, t.n, row_number() over (
    partition by k.anomalous order by md5('43|' || cast(k.original_index as varchar)), k.original_index) as rn
  from split_keys k join (select anomalous, count(*) as n from split_keys group by anomalous) t on t.anomalous = k.anomalous
  where k.original_index not in (select original_index from split where split = 'train')) r
where rn <= floor((case when anomalous = 0 then 0.2::double else 1.0::double end) * n)"""))
def q_split_overlapping(spark, sf_dir):
    """Eval and test drawn independently from what train leaves."""
    return sp.overlapping_split(fx.request_table(spark, sf_dir)).select("original_index", "anomalous", "split")
