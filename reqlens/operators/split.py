"""Seeded stratified train/eval/test split.

Each row gets ``shuffle_key = md5(seed|original_index)``. Within a class
(anomalous 0/1) rows are ranked by that key; train takes ranks
``1..n1``, eval the next ``n2``, test the next ``n3``, the rest is
``unused`` (sizes ``floor(frac * class_count)``). Splits are disjoint: the
source drew eval and test from the same remainder, so they could overlap;
``allow_overlap`` is not reproduced.

Scale: ranking a class with ``row_number`` puts a whole class in one task.
Here the first hex digits of the key form buckets (uniform, so a class
holding a third of the rows still spreads over all buckets). Counts per
(class, bucket) are a bounded table; their prefix sums give each bucket's
rank range. A bucket lying inside one split's range is assigned without any
sort; only buckets straddling a boundary (at most three per class) are
ranked, by a window partitioned by (class, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("train", "eval", "test")

# Default fractions of the source: 70/10/20 % of normals, all anomalies in test.
DEFAULT_FRACTIONS = {
    "train_frac_normals": 0.7, "train_frac_anomalous": 0.0,
    "eval_frac_normals": 0.1, "eval_frac_anomalous": 0.0,
    "test_frac_normals": 0.2, "test_frac_anomalous": 1.0,
}


def shuffle_key(seed: int = 42, col: str = "original_index") -> Column:
    """Deterministic shuffle key ``md5('<seed>|<index>')``."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(col).cast("string")))


def _fracs(fr: dict, cls: int) -> list[float]:
    name = "normals" if cls == 0 else "anomalous"
    out = [float(fr[f"{s}_frac_{name}"]) for s in SPLITS]
    if sum(out) > 1:
        raise ValueError(f"{name} fractions sum above 1: {out}")
    return out


def split_sizes(df: DataFrame, fractions: dict | None = None, count_col: str | None = None) -> DataFrame:
    """per class its count and ``floor(frac * count)`` for each split
    (double arithmetic, as ``int()`` of a float; never a cast, which rounds
    on some engines). ``count_col`` sums pre-aggregated counts instead."""
    fr = fractions or DEFAULT_FRACTIONS
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    counts = df.groupBy(F.col("anomalous").alias("cls")).agg(n.cast("long").alias("n"))
    cols = []
    for i, s in enumerate(SPLITS):
        f0, f1 = _fracs(fr, 0)[i], _fracs(fr, 1)[i]
        frac = F.when(F.col("cls") == 0, F.lit(f0)).otherwise(F.lit(f1))
        cols.append(F.floor(frac * F.col("n")).cast("long").alias(f"n_{s}"))
    return counts.select("cls", "n", *cols)


def stratified_split(df: DataFrame, fractions: dict | None = None, seed: int = 42,
                     key_digits: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """W6 + U1: add ``shuffle_key``, ``rank`` (only where needed: NULL for
    rows assigned from bucket ranges) and ``split``.

    Rows whose ``anomalous`` is neither 0 nor 1 are ``unused``. ``sizes`` gives the
    sizes (F12) instead of fractions of the rows at hand."""
    fr = fractions or DEFAULT_FRACTIONS
    keyed = df.withColumn("shuffle_key", shuffle_key(seed)) \
        .withColumn("__b", F.substring("shuffle_key", 1, key_digits)) \
        .withColumn("cls", F.col("anomalous"))
    bucket_counts = keyed.groupBy("cls", "__b").agg(F.count(F.lit(1)).alias("__bn"))
    # Class sizes from the bucket table (no second pass over the rows).
    if sizes is None:
        sizes = split_sizes(bucket_counts.groupBy(F.col("cls").alias("anomalous"))
                            .agg(F.sum("__bn").alias("__n")), fr, count_col="__n")
    # Bounded: at most 2 classes x 16^key_digits buckets.
    w = Window.partitionBy("cls").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = bucket_counts.withColumn("__lo", F.coalesce(F.sum("__bn").over(w), F.lit(0))) \
        .withColumn("__hi", F.col("__lo") + F.col("__bn")) \
        .join(F.broadcast(sizes), "cls") \
        .withColumn("__c1", F.col("n_train")) \
        .withColumn("__c2", F.col("n_train") + F.col("n_eval")) \
        .withColumn("__c3", F.col("n_train") + F.col("n_eval") + F.col("n_test"))

    def split_of(rank: Column) -> Column:
        return (F.when(rank <= F.col("__c1"), "train").when(rank <= F.col("__c2"), "eval")
                .when(rank <= F.col("__c3"), "test").otherwise("unused"))

    ranges = ranges.withColumn("__first", split_of(F.col("__lo") + 1)) \
        .withColumn("__last", split_of(F.col("__hi"))) \
        .select("cls", "__b", "__lo", "__c1", "__c2", "__c3", "__first", "__last")
    j = keyed.join(F.broadcast(ranges), ["cls", "__b"], "left")
    whole = j.filter(F.col("__first") == F.col("__last")) \
        .withColumn("rank", F.lit(None).cast("long")).withColumn("split", F.col("__first"))
    edge = j.filter(F.col("__first") != F.col("__last"))
    wr = Window.partitionBy("cls", "__b").orderBy("shuffle_key", "original_index")
    edge = edge.withColumn("rank", (F.col("__lo") + F.row_number().over(wr)).cast("long")) \
        .withColumn("split", split_of(F.col("rank")))
    unknown = j.filter(F.col("__first").isNull()) \
        .withColumn("rank", F.lit(None).cast("long")).withColumn("split", F.lit("unused"))
    out = whole.unionByName(edge).unionByName(unknown)
    return out.drop("__b", "cls", "__lo", "__c1", "__c2", "__c3", "__first", "__last")


def overlapping_split(df: DataFrame, fractions: dict | None = None, seed: int = 42) -> DataFrame:
    """D7 as the source does it (``allow_overlap``): the eval and the test rows are
    both drawn from all rows outside the train split, so a row can be in both and then
    comes twice. The test draw has its own shuffle (``seed + 1``); unused rows are left out."""
    first = stratified_split(df, fractions, seed)
    train = first.filter("split = 'train'").select("original_index")
    none = F.lit(0).cast("long")
    sizes = split_sizes(df, fractions).withColumn("n_train", none).withColumn("n_eval", none)
    test = stratified_split(split_anti_join(df, train), fractions, seed + 1, sizes=sizes).filter("split = 'test'")
    return first.filter("split in ('train', 'eval')").unionByName(test)


def split_anti_join(df: DataFrame, used: DataFrame) -> DataFrame:
    """Rows of ``df`` whose index is not in ``used`` (left anti join)."""
    return df.join(used.select("original_index"), "original_index", "left_anti")


def split_stats(split_df: DataFrame) -> DataFrame:
    """Per split its rows, normal and anomalous counts, its share of all
    rows and the normal / anomalous share inside it (dry runs stop here)."""
    total = split_df.select(F.count(F.lit(1))).scalar()
    per = split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("anomalous") == 0).alias("normal"),
        F.count_if(F.col("anomalous") == 1).alias("anomalous"))
    return per.select("split", "rows", "normal", "anomalous",
                      (F.col("rows") / total).alias("split_share"),
                      (F.col("normal") / F.col("rows")).alias("normal_share"),
                      (F.col("anomalous") / F.col("rows")).alias("anomalous_share"))
