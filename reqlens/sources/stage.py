"""Stage tables: the output of a pipeline stage written once as Parquet in the
shared checkpoint folder and read back by the stages after it.

This is the boundary the source workflow has between its steps (request
table, split tables, model folder, prediction and evaluation files): later
stages read a stored table instead of recomputing the whole lineage, and a
lost executor recomputes only from the stored table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.RLock()
_PATHS: dict[tuple, str] = {}


def stage_table(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Return the stored stage ``key`` (built and written on first use)."""
    from reqlens.plans.q_requests import scratch_path

    k = (spark.sparkContext.applicationId, *key)
    with _LOCK:
        path = _PATHS.get(k)
        if path is None:
            path = scratch_path(spark, "stage-" + "-".join(str(x).strip("/").replace("/", "_") for x in key))
            build().write.mode("overwrite").parquet(path)
            _PATHS[k] = path
    return spark.read.parquet(path)
