"""Storage and naming helpers of the subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.session import ensure_checkpoint_dir


def work_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    lineage, and a lost executor only reads the files again."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def clash_free(added: Callable[[dict], list[str]], own: tuple[str, ...] = ("text",)):
    """For operators on documents that pass other columns through: they see every
    column under a plain name, so neither dots, nor case, nor repeated names
    matter. Columns named like a result (``added``, whatever the case) are left out, but for
    the arguments ``own`` that name the operator's own columns."""
    def deco(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature(operator).bind(docs, *args, **kwargs)
            bound.apply_defaults()
            given = bound.arguments
            results = {c.lower() for c in added(given)}
            names = {f"column_{i}": c for i, c in enumerate(docs.columns)}
            used = {}
            for a in own:
                exact = [k for k, c in names.items() if c == given[a]] or [k for k, c in names.items() if c.lower() == given[a].lower()]
                if not exact:
                    raise ValueError(f"no column {given[a]!r}")
                used[a] = exact[0]
            kept = [k for k, c in names.items() if c.lower() not in results or k in used.values()]
            given.update(used)
            given[next(iter(given))] = docs.toDF(*names).select(*kept)
            out = operator(*bound.args, **bound.kwargs)
            return out.toDF(*(names.get(c, c) for c in out.columns))
        return run
    return deco


def remainder(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null ids count as remainder -1, so
    they are in no training fold)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(-1))


def give_back() -> None:
    """Return what this worker's earlier tasks freed to the system: workers are
    reused, and an executor's memory holds them all."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, returning its memory before and after each task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()
    return task
