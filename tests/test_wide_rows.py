"""Ranges of wide rows."""

from pyspark.sql import functions as F

from reqlens.operators import packing, ranking


def test_wide_rows_make_more_parts(spark, monkeypatch):
    """Positions and blocks are those of one part."""
    df = spark.createDataFrame([(i, list(range(5, 5 + i % 40))) for i in range(300)], "original_index long, ids array<int>")
    whole = sorted(map(tuple, packing.pack(df, block_size=64, batch_rows=50, sep_id=3).collect()))
    monkeypatch.setattr(ranking, "PART_WEIGHT", 500)
    assert ranking.ranges(df, "original_index", [], weight=F.size("ids")).totals.count() > 5
    assert sorted(map(tuple, packing.pack(df, block_size=64, batch_rows=50, sep_id=3).collect())) == whole
