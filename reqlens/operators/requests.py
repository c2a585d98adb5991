"""Request-table operators: rebuild text from a wide log, flags, index, filters.

All of them are single projections or filters: they run inside one
whole-stage-codegen span, need no shuffle, and scale with the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reqlens.schemas import (ANOMALY_CLASSES, BODY_COLUMN, ESSENTIAL_COLUMNS,
                             HEADER_COLUMNS, LINE_SEPARATOR, NORMAL_CLASS, NORMAL_FLAG)


def _col_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def essential_filter(df: DataFrame) -> DataFrame:
    """Drop rows lacking method, uri or protocol."""
    cond = F.lit(True)
    for c in ESSENTIAL_COLUMNS:
        cond = cond & _col_or_null(df, c).isNotNull()
    return df.filter(cond)


def request_text(df: DataFrame) -> Column:
    """``method uri protocol``, ``Name: value`` per non-null header in fixed
    order, an empty segment, then the body if it is not empty; joined by the
    literal ``[r][n]``. NULL when an essential part is missing.

    ``concat_ws`` skips NULL pieces but keeps ``''``, which gives exactly the
    trailing separator of a request without body.
    """
    method, uri, proto = (_col_or_null(df, c) for c in ESSENTIAL_COLUMNS)
    line = F.when(method.isNotNull() & uri.isNotNull() & proto.isNotNull(),
                  F.concat_ws(" ", method, uri, proto))
    headers = [F.concat(F.lit(f"{name}: "), F.nullif(_col_or_null(df, c), F.lit("")))
               for c, name in HEADER_COLUMNS]
    body = F.nullif(_col_or_null(df, BODY_COLUMN), F.lit(""))
    text = F.concat_ws(LINE_SEPARATOR, line, *headers, F.lit(""), body)
    return F.when(line.isNotNull(), text)


def class_first_match(df: DataFrame, normal_col: str = NORMAL_FLAG,
                      class_cols: list[tuple[str, str]] | None = None) -> Column:
    """If the normal flag is 0, the first class (list order) whose flag is 1;
    otherwise, or when no flag is set, ``normal``.

    ``class_cols`` maps class name -> column name; absent columns count as 0.
    """
    class_cols = class_cols or [(c, c) for c in ANOMALY_CLASSES]
    picks = [F.when(F.col(f"`{col}`") == 1, F.lit(name))
             for name, col in class_cols if col in df.columns]
    first = F.coalesce(*picks, F.lit(NORMAL_CLASS)) if picks else F.lit(NORMAL_CLASS)
    return F.when(F.col(f"`{normal_col}`") == 0, first).otherwise(F.lit(NORMAL_CLASS))


def anomalous_flag(df: DataFrame, normal_col: str = NORMAL_FLAG) -> Column:
    """Invert the normal flag; NULL counts as not anomalous."""
    return F.when(F.col(f"`{normal_col}`") == 0, F.lit(1)).otherwise(F.lit(0))


def assign_index(df: DataFrame, name: str = "original_index", start: int = 1) -> DataFrame:
    """P5: dense 1-based position in scan order, without a single-task window.

    Scan order is the order of the files' paths and of the places in a file
    (Spark deals splits to partitions by size, so partition order is another
    one); a frame that isn't a file scan is numbered in partition order. The row
    count of every split is aggregated (one row per split, a table bounded by
    the number of splits), its prefix sum is the split's offset, and the
    position inside a split comes from ``monotonically_increasing_id``. A file
    scan splits the same way on recomputation, so positions are stable when an
    executor is lost. Apply it to the scan itself, not after a shuffle.
    """
    scan = bool(df.inputFiles())
    path = F.col("_metadata.file_path") if scan else F.lit("")
    block = F.col("_metadata.file_block_start") if scan else F.lit(0)
    try:
        tagged = df.select("*", path.alias("__path"), block.alias("__block"))
        tagged.schema  # noqa: B018  a derived frame has no such column
    except AnalysisException:
        tagged = df.select("*", F.lit("").alias("__path"), F.lit(0).alias("__block"))
    tagged = tagged.withColumn("__pid", F.spark_partition_id()).withColumn("__mid", F.monotonically_increasing_id())
    split = ["__path", "__block", "__pid"]
    counts = tagged.groupBy(*split).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*split, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.join(F.broadcast(offsets), split)
    return out.withColumn(name, F.col("__off") + F.col("__mid") - F.col("__first") + F.lit(start)) \
        .drop(*split, "__mid", "__first", "__off")


def preprocess(df: DataFrame, normal_col: str = NORMAL_FLAG,
               class_cols: list[tuple[str, str]] | None = None,
               index_col: str = "original_index") -> DataFrame:
    """S1 -> request table (P1-P5): ``original_index, anomalous, ano_class, request``.

    ``index_col`` must already hold the 1-based position over all source rows
    (use :func:`assign_index` on the raw scan) so dropped rows leave gaps.
    """
    return essential_filter(df).select(
        F.col(index_col).cast("long").alias("original_index"),
        anomalous_flag(df, normal_col).alias("anomalous"),
        class_first_match(df, normal_col, class_cols).alias("ano_class"),
        request_text(df).alias("request"),
    )


def valid_text_filter(df: DataFrame, col: str = "request") -> DataFrame:
    """Keep rows whose text is a string with a non-whitespace character."""
    return df.filter(F.col(col).isNotNull() & F.col(col).rlike(r"\S"))


def label_filter(df: DataFrame, mode: str) -> DataFrame:
    """``hide_anomalous`` / ``hide_normal`` / ``anomalous_only`` /
    ``drop_normal_class`` (class not ``normal`` and not NULL)."""
    if mode == "hide_anomalous":
        return df.filter(~(F.col("anomalous") == 1) | F.col("anomalous").isNull())
    if mode == "hide_normal":
        return df.filter(~(F.col("anomalous") == 0) | F.col("anomalous").isNull())
    if mode == "anomalous_only":
        return df.filter(F.col("anomalous") == 1)
    if mode == "drop_normal_class":
        return df.filter(F.col("ano_class").isNotNull() & (F.col("ano_class") != NORMAL_CLASS))
    raise ValueError(f"unknown label filter {mode!r}")


def positional_slice(df: DataFrame, order_col: str, offset: int, window: int) -> DataFrame:
    """Rows ``[offset, offset+window)`` in ``order_col`` order; ``window=0`` = all.
    Only the ranges that the slice touches are ranked (:func:`ranking.slice_of`)."""
    if window == 0:
        return df
    from reqlens.operators.ranking import slice_of
    return slice_of(df, order_col, offset, window)


def sample_category(has_truth: bool = True) -> Column:
    """``red`` for anomalous rows, else ``gray``; all gray without truth."""
    if not has_truth:
        return F.lit("gray")
    return F.when(F.col("anomalous") == 1, F.lit("red")).otherwise(F.lit("gray"))
