"""Global-order operators without a single-task window.

A window with ``orderBy`` but no ``partitionBy`` moves every row to one task.
The operators here deal the order into ranges instead:

1. the rows are stored once (a reliable checkpoint) and counted, and range
   partitioned by the order column into as many parts as that count asks for
   (``PART_ROWS`` rows each); the parts are stored with their number, since everything after must see the
   same borders;
2. per-part totals (one row a part) and their prefix sums are a small table,
   broadcast back;
3. a window partitioned by part gives the sums inside it.

Skew: callers pre-aggregate by distinct value first, so a value held by a
third of all rows is one row here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a part, about
PART_ROWS = 1_000_000
#: sum of the weights of a part's rows, about
PART_WEIGHT = 8_000_000
PART = "__part"


@dataclass
class Ranges:
    """Rows dealt into ranges of an order column, and the totals of the ranges."""
    rows: DataFrame     # with PART
    order_col: str
    totals: DataFrame   # PART, rows, and a total for each summed column, one row a part

    def total(self, col: str = "__rows") -> Column:
        """Sum over all rows (scalar subquery over the totals)."""
        return self.totals.select(F.sum(f"{col}_total")).scalar()

    def before(self, cols: list[str]) -> DataFrame:
        """Per part the sums of all parts before it."""
        w = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # one row a part
        return self.totals.select(PART, *[F.coalesce(F.sum(f"{c}_total").over(w), F.lit(0)).alias(f"{c}_offset") for c in cols])


def ranges(df: DataFrame, order_col: str, sum_cols: list[str], part_rows: int | None = None, weight: Column | None = None) -> Ranges:
    """``weight`` is a row's size, for wide rows: a part holds about ``PART_WEIGHT`` of it at most."""
    stored = df.checkpoint(eager=True)
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.lit(0) if weight is None else weight).alias("w")).first()
    parts = max(1, -(-size.n // (part_rows or PART_ROWS)), -(-(size.w or 0) // PART_WEIGHT))
    rows = stored.repartitionByRange(parts, order_col).withColumn(PART, F.spark_partition_id()).checkpoint(eager=True)
    totals = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("__rows_total"), *[F.sum(c).alias(f"{c}_total") for c in sum_cols])
    return Ranges(rows, order_col, totals.checkpoint(eager=True))


def running(r: Ranges, sum_cols: list[str]) -> DataFrame:
    """The rows with ``<c>_before`` = sum of ``c`` over all rows whose order
    column is strictly smaller."""
    w = Window.partitionBy(PART).orderBy(r.order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = r.rows.join(F.broadcast(r.before(sum_cols)), PART)
    for c in sum_cols:
        out = out.withColumn(f"{c}_before", F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(w), F.lit(0)))
    return out.drop(PART, *[f"{c}_offset" for c in sum_cols])


def prefix_sums(df: DataFrame, order_col: str, sum_cols: list[str], part_rows: int | None = None) -> DataFrame:
    """Add ``<c>_before`` = sum of ``c`` over all rows whose ``order_col`` is
    strictly smaller. ``order_col`` must be unique (pre-aggregate first)."""
    return running(ranges(df, order_col, sum_cols, part_rows), sum_cols)


def global_position(df: DataFrame, order_col: str, name: str = "pos", part_rows: int | None = None, weight: Column | None = None) -> DataFrame:
    """Dense 1-based position by ``order_col`` (ties in any order), part by part."""
    r = ranges(df, order_col, [], part_rows, weight)
    w = Window.partitionBy(PART).orderBy(order_col)
    return r.rows.join(F.broadcast(r.before(["__rows"])), PART) \
        .withColumn(name, (F.col("__rows_offset") + F.row_number().over(w)).cast("long")).drop(PART, "__rows_offset")


def slice_of(df: DataFrame, order_col: str, offset: int, window: int, part_rows: int | None = None) -> DataFrame:
    """Rows ``[offset, offset + window)`` in order: only the parts that the slice
    touches are read and ranked, however far the offset."""
    r = ranges(df, order_col, [], part_rows)
    touched = r.totals.join(r.before(["__rows"]), PART).filter(
        (F.col("__rows_offset") < offset + window) & (F.col("__rows_offset") + F.col("__rows_total") > offset)).select(PART, "__rows_offset")
    w = Window.partitionBy(PART).orderBy(order_col)
    return r.rows.join(F.broadcast(touched), PART).withColumn("__pos", F.col("__rows_offset") + F.row_number().over(w) - 1) \
        .filter((F.col("__pos") >= offset) & (F.col("__pos") < offset + window)).drop(PART, "__rows_offset", "__pos")


def rolling_stddev(df: DataFrame, order_col: str, value_col: str, window: int,
                   chunk_rows: int | None = None, name: str = "rolling_std",
                   part_rows: int | None = None) -> DataFrame:
    """Sample std over the trailing ``window`` rows (by ``order_col``); NULL
    when fewer than ``window`` values are in the frame (as a pandas rolling
    std with default ``min_periods``).

    Scales by chunking the dense position into chunks of ``chunk_rows`` and
    copying the last ``window - 1`` rows of each chunk into the next as a
    halo, so each chunk's window runs in its own task. Overhead is
    ``(window - 1) / chunk_rows``.
    """
    chunk = chunk_rows or max(4 * window, 50000)
    if chunk < window:
        raise ValueError("chunk_rows must be at least the window size")
    pos = global_position(df, order_col, "__pos", part_rows)
    pos = pos.withColumn("__chunk", F.floor((F.col("__pos") - 1) / chunk).cast("long"))
    halo = (pos.filter(((F.col("__pos") - 1) % chunk) >= chunk - (window - 1))
               .withColumn("__chunk", F.col("__chunk") + 1)
               .withColumn("__halo", F.lit(True)))
    both = pos.withColumn("__halo", F.lit(False)).unionByName(halo)
    w = Window.partitionBy("__chunk").orderBy("__pos").rowsBetween(-(window - 1), 0)
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    out = both.withColumn(name, F.when(F.count(v).over(w) == window, F.stddev_samp(v).over(w)))
    return out.filter(~F.col("__halo")).drop("__pos", "__chunk", "__halo")
