"""Writers of the data model (K1-K8). All writes are distributed: every task
writes its own part file; nothing is collected to the driver."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_requests(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> bool:
    """K1: write the request table; nothing is written (and a warning is
    issued) when it has no rows. Returns whether anything was written."""
    if df.isEmpty():
        warnings.warn("no valid HTTP requests could be reconstructed", stacklevel=2)
        return False
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        w.parquet(path)
    return True


def write_relabelled(relabelled: DataFrame, fixed_path: str, mislabeled_path: str,
                     mode: str = "overwrite") -> None:
    """K2: relabelled table and the index list of changed rows, from one
    persisted frame so the rules run once."""
    from pyspark import StorageLevel

    cached = relabelled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cached.drop("relabelled").write.mode(mode).parquet(fixed_path)
        cached.filter("relabelled").select("original_index").write.mode(mode).parquet(mislabeled_path)
    finally:
        cached.unpersist()


def write_splits(split_df: DataFrame, path: str, mode: str = "overwrite",
                 dry_run: bool = False) -> DataFrame:
    """K3: one table partitioned by ``split``; ``dry_run`` writes nothing. Returns
    the split's statistics (A16), of the stored table unless it is a dry run."""
    from reqlens.operators.split import split_stats
    if dry_run:
        return split_stats(split_df)
    split_df.write.mode(mode).partitionBy("split").parquet(path)
    return split_stats(split_df.sparkSession.read.schema(split_df.schema).parquet(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """K4/K5/K7/K8: predictions, timings, k sweep, model count tables."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_evaluations(df: DataFrame, path: str, log_all: bool = True, fmt: str = "parquet",
                      mode: str = "overwrite") -> None:
    """K6: evaluation table; ``log_all=False`` drops the index lists and two
    flags. CSV keeps the arrays as JSON text."""
    if not log_all:
        df = df.drop("fp_indexes", "fn_indexes", "average_anomalies", "use_std_as_offset")
    if fmt == "csv":
        for c in ("fp_indexes", "fn_indexes"):
            if c in df.columns:
                df = df.withColumn(c, F.to_json(c))
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)


def write_error_sets(intervals: DataFrame, ranked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K6: the error index sets of a whole grid as intervals (at most one row for
    each scored row) and the parameters in order; nothing is lost."""
    intervals.write.mode(mode).parquet(f"{path}/intervals")
    ranked.coalesce(1).write.mode(mode).parquet(f"{path}/parameters")


def read_error_sets(spark, path: str, param_ids: list[int] | None = None) -> DataFrame:
    """``(param_id, kind, original_index)`` from stored intervals, for some
    parameter rows or all."""
    from reqlens.operators.evaluate import errors_of
    return errors_of(spark.read.parquet(f"{path}/intervals"), spark.read.parquet(f"{path}/parameters"), param_ids)
