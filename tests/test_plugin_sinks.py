"""Token-level plug-ins, error intervals, sinks and readers round trip."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.operators import evaluate as ev
from reqlens.operators import lm, plugin, rules
from reqlens.operators import split as sp
from reqlens.sources import readers, sinks
from reqlens.sources.layout import Layout


def ids_of(df, ids):
    """Requests as ids by a small vocabulary, specials 0 to 4."""
    table = F.create_map(*[x for t, i in ids.items() for x in (F.lit(t), F.lit(i))])
    return df.select("original_index", F.transform(F.regexp_extract_all("request", F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"), 0),
                                                   lambda t: F.coalesce(table[t], F.lit(1))).alias("ids"))


TEXTS = ["GET / a b c", "GET / a a b", "POST x y z / c", "a", "", "GET zz / b " + "a b c " * 40]


def test_masked_plugin_equals_the_count_model(spark):
    """A plug-in that knows the count tables gives the count model's strided scores,
    as losses and as logits."""
    df = spark.createDataFrame(list(enumerate(TEXTS)), "original_index long, request string")
    model = lm.fit(df.filter("original_index < 3"))
    words = sorted({r.tok for r in lm.long_tokens(df).collect()})
    ids = {w: i + 5 for i, w in enumerate(words)}
    uni = {r.tok: r.c for r in model.unigram.collect()}
    bi = {(r.prev, r.tok): r.c for r in model.bigram.collect()}
    ctx = {(r.prev, r.tok, r.nxt): r.c for r in model.context.collect()}
    n, v = sum(uni.values()), len(uni)
    left, around = {}, {}
    for (a, _), c in bi.items():
        left[a] = left.get(a, 0) + c
    for (a, _, b), c in ctx.items():
        around[a, b] = around.get((a, b), 0) + c

    def probability(a, t, b):
        p = (uni.get(t, 0) + 1) / (n + v + 1)
        if left.get(a):
            p = 0.7 * bi.get((a, t), 0) / left[a] + 0.3 * p
        if around.get((a, b)):
            p = 0.7 * ctx.get((a, t, b), 0) / around[a, b] + 0.3 * p
        return p

    names = {i: w for w, i in ids.items()}

    def make_losses():
        def score(block, mask, labels):
            out = np.zeros(block.shape)
            for r in range(len(block)):
                m = int(mask[r].sum())
                for k in range(m):
                    if labels[r, k] >= 0:
                        assert block[r, k] == 4  # the mask token
                        a = "[CLS]" if k == 0 else names[int(block[r, k - 1])]
                        b = "[SEP]" if k == m - 1 else names[int(block[r, k + 1])]
                        out[r, k] = -math.log(probability(a, names[int(labels[r, k])], b))
            return out
        return score

    def make_logits():
        def score(block, mask, labels):
            out = np.zeros((*block.shape, len(ids) + 5), np.float32)
            for r in range(len(block)):
                m = int(mask[r].sum())
                for k in range(m):
                    if block[r, k] == 4:
                        a = "[CLS]" if k == 0 else names[int(block[r, k - 1])]
                        b = "[SEP]" if k == m - 1 else names[int(block[r, k + 1])]
                        p = np.array([probability(a, names[i], b) for i in range(5, len(ids) + 5)])
                        out[r, k, :5] = np.log(max(1 - p.sum(), 1e-9) / 5)
                        out[r, k, 5:] = np.log(p)
            return out
        return score

    expected = {r.original_index: (r.loss, r.perplexity) for r in lm.score_masked_strided(model, df, 5).collect()}
    coded = ids_of(df, ids).repartition(2)
    for make, output, tolerance in ((make_losses, "loss", 1e-9), (make_logits, "logits", 1e-4)):
        for batch_tokens in (1, 64, 100_000):
            got = {r.original_index: (r.loss, r.perplexity) for r in plugin.score_masked_with(coded, make, 5, output, batch_tokens).collect()}
            assert set(got) == set(expected)
            for i, e in expected.items():
                assert got[i] == pytest.approx(e, abs=tolerance * 10, rel=tolerance)


def test_causal_plugin_and_timings(spark):
    df = spark.createDataFrame([(1, [5, 6, 7]), (2, [5]), (3, []), (4, None)], "original_index long, ids array<int>")
    out = {r.original_index: r for r in plugin.score_causal_with(df, lambda: lambda b, m, t: b * 1.0).collect()}
    assert out[1].loss == pytest.approx(13 / (2 + 1e-9)) and out[1].perplexity == pytest.approx(math.exp(out[1].loss))
    assert out[2].loss == 0.0 and out[3].loss == 0.0
    assert [out[i].tokens_count for i in (1, 2, 3, 4)] == [3, 1, 0, 0] and out[1].time_taken > 0


def test_batches_group_similar_lengths():
    lengths = [5, 100, 6, 90, 5, 7, 400]
    plan = plugin.batch_plan(lengths, 200)
    assert sorted(i for b in plan for i in b) == list(range(7))
    assert all(len(b) == 1 or len(b) * max(lengths[i] for i in b) <= 200 for b in plan)
    assert [6] in plan and len(plan) <= 4


def joined(spark):
    rows = [(i, (i * 37 % 101) / 100 if i % 10 else float("nan"), int(i % 3 == 0)) for i in range(1, 200)] + [(500, None, 1), (501, 0.5, 0), (502, 0.5, 1)]
    return spark.createDataFrame(rows, "original_index long, loss double, anomalous int")


def params(spark):
    rows = [(0, 0.1), (1, 0.5), (2, 0.5), (3, 0.9), (4, 0.25)]
    return spark.createDataFrame(rows, "param_id long, threshold_offset double").withColumn("use_std_as_offset", F.lit(False))


def test_intervals_hold_every_error_set(spark, tmp_path):
    j, p = joined(spark), params(spark)
    intervals = ev.error_intervals(j, p)
    assert intervals.count() <= j.count()
    expected = set()
    for r in j.collect():
        for q in p.collect():
            hit = r.loss is not None and not math.isnan(r.loss) and r.loss > q.threshold_offset
            if hit == (r.anomalous == 0):
                expected.add((q.param_id, "fp" if hit else "fn", r.original_index))
    assert {tuple(x) for x in ev.error_indexes(j, p).collect()} == expected
    sinks.write_error_sets(intervals, ev.ranked_params(p), str(tmp_path / "e"))
    assert {tuple(x) for x in sinks.read_error_sets(spark, str(tmp_path / "e")).collect()} == expected
    some = {tuple(x) for x in sinks.read_error_sets(spark, str(tmp_path / "e"), [1, 4]).collect()}
    assert some == {x for x in expected if x[0] in (1, 4)}


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_evaluations_round_trip(spark, tmp_path, fmt):
    """K6/F2: index arrays survive both formats; ``log_all=False`` drops four columns."""
    from reqlens.functions.lists import parse_index_list
    j, p = joined(spark), ev.param_grid(spark).filter("param_id in (9, 49)")
    evals = ev.with_index_lists(ev.threshold_sweep(j, p), ev.error_indexes(j, p))
    path = str(tmp_path / "full")
    sinks.write_evaluations(evals, path, fmt=fmt)
    back = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).option("escape", '"').csv(path) \
        .withColumn("fp_indexes", parse_index_list(F.col("fp_indexes"))).withColumn("fn_indexes", parse_index_list(F.col("fn_indexes")))
    lists = {int(r.param_id): (r.fp_indexes, r.fn_indexes) for r in back.collect()}
    assert lists == {r.param_id: (r.fp_indexes, r.fn_indexes) for r in evals.collect()} and all(len(x) > 0 for y in lists.values() for x in y)
    sinks.write_evaluations(evals, str(tmp_path / "short"), log_all=False)
    assert set(evals.columns) - set(spark.read.parquet(str(tmp_path / "short")).columns) \
        == {"fp_indexes", "fn_indexes", "average_anomalies", "use_std_as_offset"}


def test_tables_round_trip(spark, tmp_path):
    """K2, K3, K4, K5, K7, K8 and S4."""
    df = spark.createDataFrame([(1, 0, "normal", "GET /../x"), (2, 0, "normal", "GET /a"), (3, 1, "126 - Path Traversal", "GET /b")],
                               "original_index long, anomalous int, ano_class string, request string")
    sinks.write_relabelled(rules.relabel(df), str(tmp_path / "fixed"), str(tmp_path / "wrong"))
    assert {r.original_index for r in spark.read.parquet(str(tmp_path / "wrong")).collect()} == {1}
    assert {(r.original_index, r.anomalous) for r in readers.read_requests(spark, str(tmp_path / "fixed")).collect()} == {(1, 1), (2, 0), (3, 1)}

    many = spark.range(1, 101).select(F.col("id").alias("original_index"), (F.col("id") % 4 == 0).cast("int").alias("anomalous"))
    split = sp.stratified_split(many)
    dry = sinks.write_splits(split, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    wet = sinks.write_splits(split, str(tmp_path / "wet"))
    assert sorted(map(tuple, dry.collect())) == sorted(map(tuple, wet.collect())) and sum(r.rows for r in wet.collect()) == 100

    scores = spark.createDataFrame([(1, 0.5, 1.6), (2, None, None)], "original_index long, loss double, perplexity double")
    sinks.write_table(scores, str(tmp_path / "pred"))
    assert sorted(map(tuple, readers.read_predictions(spark, str(tmp_path / "pred")).collect()), key=str) == sorted(map(tuple, scores.collect()), key=str)
    times = plugin.timing_sum(spark.createDataFrame([(1, 0.5, 3), (1, 0.25, 4)], "original_index long, time_taken double, tokens_count long"))
    sinks.write_table(times, str(tmp_path / "times"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "times")).first().asDict() == {"original_index": "1", "time_taken": "0.75", "tokens_count": "7"}

    model = lm.fit(df)
    model.write(str(tmp_path / "model"))
    again = lm.CountModel.read(spark, str(tmp_path / "model"))
    for a, b in zip((model.unigram, model.bigram, model.context), (again.unigram, again.bigram, again.context)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_csv_without_breaks_is_split(spark, tmp_path):
    head = "request_http_method,request_http_request,request_http_protocol,request_host\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text(head + "".join(f'GET,/{i},HTTP/1.1,"a ""q"", {i}"\n' for i in range(4000)))
    (tmp_path / "mixed").mkdir()
    (tmp_path / "mixed" / "a.csv").write_text(head + "GET,/x,HTTP/1.1,h\n")
    (tmp_path / "mixed" / "b.csv").write_text(head + 'GET,/y,HTTP/1.1,"two\nlines"\n')
    plain, broken = readers.files_with_breaks(spark, str(tmp_path / "mixed"))
    assert [f.rsplit("/", 1)[1] for f in plain] == ["a.csv"] and [f.rsplit("/", 1)[1] for f in broken] == ["b.csv"]
    rows = {(r.request_http_request, r.request_host) for r in readers.read_raw_requests(spark, str(tmp_path / "mixed")).collect()}
    assert rows == {("/x", "h"), ("/y", "two\nlines")}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        df = readers.read_raw_requests(spark, str(tmp_path / "plain"))
        assert df.rdd.getNumPartitions() > 1
        assert df.count() == 4000 and df.filter(F.col("request_host") == 'a "q", 17').count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_layout():
    x = Layout("/data/requests.csv", "run1", "/models")
    assert x.splits == "/data/run1-requests" and x.split("eval") == "/data/run1-requests/split=eval"
    assert x.predictions("m") == "/models/m/predictions/run1-test-requests"
    assert x.evaluations("m", "eval") == "/models/m/evaluations/run1-eval-requests"
    with pytest.raises(ValueError):
        x.split("dev")


def test_sums_of_labelled_losses(spark):
    """The sums that leave the task are those of the listed losses; samples without ids have none."""
    rows = [(1, [5, 6, 7], [-100, 6, 7]), (2, [], []), (3, None, None), (4, [9], [-100]), (5, [8] * 50, [8] * 50)]
    df = spark.createDataFrame(rows, "original_index long, input_ids array<int>, labels array<int>")
    make = lambda: lambda b, m, t: b * 0.1 * m
    keys = ["original_index"]
    listed = {r.original_index: [v for v, x in zip(r["values"], r.labels or []) if x != -100] for r in plugin.token_losses(df, make, keys, batch_tokens=40).collect()}
    for r in plugin.token_losses(df, make, keys, batch_tokens=40, sums=True).collect():
        assert r.n_labels == len(listed[r.original_index]) and abs(r.loss_sum - sum(listed[r.original_index])) < 1e-9
