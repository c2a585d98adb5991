"""Padding is no work of the stride masks."""

from pyspark.sql import functions as F

from reqlens.operators import tokens as tk


def test_padding_is_added_after_the_masks(spark):
    df = spark.createDataFrame([(["a", "[MASK]", "b", "c"],), ([],)], "tokens array<string>").withColumn("s", F.explode(F.array(*map(F.lit, range(5)))))
    before, flags = tk.stride_mask(tk.padded(max_tokens=9), 5, F.col("s"))
    after, _ = tk.stride_mask(tk.between_sentinels(), 5, F.col("s"))
    rows = df.select(before.alias("before"), F.aggregate(flags, F.lit(0), lambda a, x: a + x).alias("n"),
                     tk.pad(after, 9).alias("after"), tk.masked_count(tk.between_sentinels(), after).alias("m")).collect()
    assert all(r.before == r.after and r.n == r.m and len(r.after) == 9 for r in rows)
