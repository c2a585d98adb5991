"""Split properties, token helpers and explain colours."""

from pyspark.sql import functions as F

from reqlens.operators import explain as xp
from reqlens.operators import split as sp
from reqlens.operators import tokens as tk


def test_split_disjoint_exact_sizes(spark):
    rows = [(i, 1 if i % 5 == 0 else 0) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "original_index long, anomalous int")
    out = sp.stratified_split(df, key_digits=1).collect()
    assert len(out) == 3000 and len({r.original_index for r in out}) == 3000
    normals = sum(1 for _, a in rows if a == 0)
    anoms = 3000 - normals
    cnt = {}
    for r in out:
        cnt[(r.split, r.anomalous)] = cnt.get((r.split, r.anomalous), 0) + 1
    assert cnt[("train", 0)] == int(0.7 * normals)
    assert cnt[("eval", 0)] == int(0.1 * normals)
    assert cnt[("test", 0)] == int(0.2 * normals)
    assert cnt[("test", 1)] == anoms
    # the bucketed ranks equal a plain row number within each class
    pdf = spark.createDataFrame(rows, "original_index long, anomalous int") \
        .withColumn("k", sp.shuffle_key()).toPandas()
    pdf["rn"] = pdf.sort_values(["k", "original_index"]).groupby("anomalous").cumcount() + 1
    n1 = int(0.7 * normals)
    train = {r.original_index for r in out if r.split == "train"}
    assert train == set(pdf[(pdf.anomalous == 0) & (pdf.rn <= n1)].original_index)


def test_neighbours_and_padding(spark):
    df = spark.createDataFrame([(1, "GET /a?b=1"), (2, ""), (3, "x")], "original_index long, request string")
    t = tk.tokenize(df)
    rows = {(r.original_index, r.pos): (r.prev, r.tok, r.nxt) for r in
            tk.token_rows(t).filter(F.col("tok").isNotNull()).collect()}
    assert rows[(1, 1)] == ("[CLS]", "GET", "/")
    assert rows[(1, 6)] == ("b", "=", "1")
    assert rows[(1, 7)] == ("=", "1", "[SEP]")
    assert rows[(3, 1)] == ("[CLS]", "x", "[SEP]")
    assert not any(k[0] == 2 for k in rows)
    seq = t.withColumn("seq", tk.padded(max_tokens=12)).orderBy("original_index").collect()
    assert len(seq[0].seq) == 12 and seq[0].seq[0] == "[CLS]" and seq[0].seq[8] == "[SEP]"


def test_gradient_hex_is_half_even(spark):
    # 0.5 * 255 = 127.5 -> 128 (half-even keeps 128); 0.0039215686 * 255 = 1.0
    df = spark.createDataFrame([(0.5,), (1.0,), (0.0,), (2.5 / 255,)], "p double")
    got = [r.h for r in df.select(xp.hex2(F.col("p")).alias("h")).collect()]
    assert got == ["80", "ff", "00", format(round(2.5), "02x")]


def test_overlapping_split(spark):
    """Train stays apart, eval and test are drawn from the same rest."""
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 401)], "original_index long, anomalous int")
    fractions = {"train_frac_normals": 0.5, "train_frac_anomalous": 0.0, "eval_frac_normals": 0.4,
                 "eval_frac_anomalous": 0.5, "test_frac_normals": 0.1, "test_frac_anomalous": 0.5}
    out = sp.overlapping_split(df, fractions).collect()
    rows = {s: [r.original_index for r in out if r.split == s] for s in ("train", "eval", "test")}
    assert [len(rows[s]) for s in ("train", "eval", "test")] == [150, 120 + 50, 30 + 50]
    assert all(len(set(v)) == len(v) for v in rows.values())
    assert not set(rows["train"]) & (set(rows["eval"]) | set(rows["test"]))
    assert set(rows["eval"]) & set(rows["test"])
    assert out == sp.overlapping_split(df, fractions).collect() or sorted(map(tuple, out)) == sorted(map(tuple, sp.overlapping_split(df, fractions).collect()))
