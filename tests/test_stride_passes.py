"""The stride masks find once a request which pass masks a position, and read their tokens fast."""

import re

from pyspark.sql import functions as F

from reqlens.operators import tokens as tk
from reqlens.plans.q_model import q_stride_mask


def test_stored_passes_give_the_same_masks(spark):
    rows = [(["a", "[MASK]", "b", "c", "[PAD]", "d"],), ([],), (None,), ([f"t{i}" for i in range(23)],), (["a", None, "c"],)]
    df = spark.createDataFrame(rows, "tokens array<string>").withColumn("seq", tk.between_sentinels())
    seq, passes, s = F.col("seq"), F.col("passes"), F.col("shift_index")
    df = tk.stride_expand(df.withColumn("passes", tk.mask_passes(seq, 5)), 5)
    before, after = tk.stride_mask(seq, 5, s)[0], tk.stride_mask(seq, 5, s, passes)[0]
    got = df.select(tk.pad(before, 9).alias("before"), tk.pad(after, 9, like=seq).alias("after"),
                    tk.masked_count(seq, before).alias("n"), tk.masked_count(seq, after, passes, s).alias("m")).collect()
    assert len(got) == 25 and all(r.before == r.after and r.n == r.m for r in got)


def test_query_masks_whole_requests_without_tests_per_pass(spark, tmp_path):
    events = [(i, i % 3, ("view", "purchase", "error", None)[i % 4], float(i), '{"k": ' + "x y," * (300 * (i == 5)) + "}") for i in range(12)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(i, f"https://h{i}.example/a/é?q=[MASK]") for i in range(5)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    from reqlens.sources import fixtures as fx
    out = q_stride_mask(spark, str(tmp_path))
    texts = {r.original_index: re.findall(tk.TOKEN_PATTERN, r.request) for r in fx.request_table(spark, str(tmp_path)).collect()}
    rows = out.collect()
    assert len(rows) == 5 * len(texts) and max(map(len, texts.values())) > tk.MAX_TOKENS
    for r in rows:
        seq = [tk.CLS, *texts[r.original_index], tk.SEP]
        hits = [i % 5 == r.shift_index and 0 < i < len(seq) - 1 for i in range(len(seq))]
        masked = [tk.MASK if h else x for h, x in zip(hits, seq, strict=True)]
        assert r.masked == masked + [tk.PAD] * (tk.MAX_TOKENS - len(seq)) and r.n_masked == sum(hits)
    per_pass = out._jdf.queryExecution().optimizedPlan().toString().partition("Generate explode")[0]
    assert "zip_with" in per_pass and " IN (" not in per_pass and " % " not in per_pass


def test_spelled_pattern_finds_the_same_tokens(spark):
    chars = [chr(c) for c in [*range(1, 0x3100), 0xFEFF, 0xFFFD, 0x1F600, 0x1D7D8]]
    df = spark.createDataFrame([("".join(f"{c}a{c}{c}9Z" for c in chars),), ("",), (None,)], "request string")
    r = df.select(tk.all_tokens().alias("spelled"), F.regexp_extract_all("request", F.lit(tk.TOKEN_PATTERN), 0).alias("plain")).collect()
    assert len(r[0].plain) > len(chars) and all(x.spelled == x.plain for x in r)
    assert not re.search(r"\w-\w", tk.SPELLED_PATTERN)
