"""Views of the driver tables that stand in for the request-log data model.

Each builder derives its rows from the driver tables with Spark, so the work
grows with them. The same views exist as SQL text for the DuckDB oracle in
``reqlens.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.sources.tables import table

# Column name of each class flag in the ``http_raw`` view (absent flags are 0).
FIXTURE_CLASS_COLUMNS = [
    ("272 - Protocol Manipulation", "c01"),
    ("126 - Path Traversal", "c04"),
    ("66 - SQL Injection", "c05"),
    ("33 - HTTP Request Smuggling", "c13"),
]
FIXTURE_NORMAL_COLUMN = "is_normal"


def http_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide request log from ``events`` and ``pages``."""
    ev = table(spark, sf_dir, "events")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # The page count is a scalar subquery: no cross join, one value per row.
    n_pages = table(spark, sf_dir, "pages").select(F.count(F.lit(1))).scalar()
    e = ev.withColumn("page_no", F.col("event_id") % n_pages)
    j = e.join(pages, e["page_no"] == pages["page_id"])
    eid, et = F.col("event_id"), F.col("event_type")
    is_err = et == "error"
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)", 1)
    suffix = (F.when(is_err & (eid % 3 == 0), "/../../etc/passwd")
              .when(is_err & (eid % 3 == 1), "?id=1+ORDER+BY+3")
              .when(~is_err & (eid % 53 == 0), "/.git/config")
              .when(~is_err & (eid % 59 == 0), "/index.bak")
              .otherwise(""))
    classed = is_err & (eid % 29 != 0)
    m13 = eid % 13
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    return j.select(
        (eid + 1).alias("original_index"),
        F.when(eid % 97 == 0, F.lit(None).cast("string"))
         .when(et.isin("purchase", "signup"), "POST").otherwise("GET").alias("request_http_method"),
        F.concat(path, suffix).alias("request_http_request"),
        F.lit("HTTP/1.1").alias("request_http_protocol"),
        F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("request_host"),
        F.concat(F.lit("agent/"), (F.col("user_id") % 5).cast("string")).alias("request_user_agent"),
        F.when(eid % 2 == 0, "text/html").alias("request_accept"),
        F.when(eid % 7 == 0, F.col("url")).alias("request_referer"),
        F.concat(F.lit("uid="), F.col("user_id").cast("string")).alias("request_cookie"),
        F.when(et.isin("purchase", "signup"), F.col("props"))
         .when(eid % 11 == 0, "").alias("request_body"),
        flag(~is_err).alias("is_normal"),
        flag(classed & (m13 == 0)).alias("c01"),
        flag(classed & m13.isin(1, 2, 3, 4, 5)).alias("c04"),
        flag(classed & m13.isin(5, 6, 7, 8)).alias("c05"),
        flag(classed & (m13 >= 8)).alias("c13"),
        (F.col("value") / 500).alias("loss"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request table built by the P1-P4 operators from ``http_raw``."""
    from reqlens.operators.requests import preprocess
    return preprocess(http_raw(spark, sf_dir), normal_col=FIXTURE_NORMAL_COLUMN, class_cols=FIXTURE_CLASS_COLUMNS)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with ties for the threshold and evaluation operators."""
    ev = table(spark, sf_dir, "events")
    loss = F.col("value") / 500
    return ev.select((F.col("event_id") + 1).alias("original_index"), loss.alias("loss"), F.exp(loss).alias("perplexity"))


def doc_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, messy texts as requests (tokenising, packing, text filters)."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("original_index"),
        F.coalesce(F.col("toxic"), F.lit(0)).alias("anomalous"),
        F.col("source").alias("ano_class"),
        F.col("text").alias("request"))


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-way logits with a target id, ten tokens per sample."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") - F.col("vec_id") % 10).alias("original_index"),
                    (F.col("vec_id") % 10).alias("pos"),
                    F.col("embedding").alias("logits"), "label")


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric log: a run is a user, its mtime the user's last event."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max("ts").alias("mtime"))  # combined map-side, however long a run is
    return e.join(last, "user_id").select(
                    F.col("user_id").alias("run"), "mtime",
                    F.col("event_type").alias("tag"), F.col("event_id").alias("step"), "value")


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several timing rows per sample."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("original_index"),
                     (F.col("l_quantity") / 1000).alias("time_taken"),
                     F.col("l_linenumber").alias("tokens_count"))


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The request table as stored after preprocessing (K1): built by the
    P1-P4 operators once per session and read back by later stages."""
    from reqlens.sources.stage import stage_table
    return stage_table(spark, ("requests", sf_dir), lambda: requests(spark, sf_dir))
