"""The pipeline's stages: switches, restart from the manifest, threshold methods."""

import pytest
from pyspark.sql import functions as F

from reqlens.operators import lm
from reqlens.plans import pipeline as pl


def requests(spark, n=240):
    rows = []
    for i in range(1, n + 1):
        bad = i % 4 == 0
        text = f"GET /page/{i % 7}?id={i % 5} HTTP/1.1" if not bad else f"GET /page/../../etc/{i % 3}/passwd?x=1+OR+1 HTTP/1.1"
        rows.append((i, int(bad), "126 - Path Traversal" if bad else "normal", text))
    return spark.createDataFrame(rows, "original_index long, anomalous int, ano_class string, request string")


FRACTIONS = {"train_frac_normals": 0.6, "eval_frac_normals": 0.2, "test_frac_normals": 0.2,
             "train_frac_anomalous": 0.0, "eval_frac_anomalous": 0.0, "test_frac_anomalous": 1.0}


def config(**more):
    return pl.PipelineConfig(fractions=dict(FRACTIONS), **more)


def test_stages_that_are_off_are_not_run(spark):
    out = pl.run_stages(spark, requests(spark), config(stages=("split",)))
    assert set(out) == {"splits", "split_stats"}
    assert {r.split: r.rows for r in out["split_stats"].collect()} == {"train": 108, "eval": 36, "test": 96}
    assert pl.run_stages(spark, requests(spark), config(stages=())) == {}
    out = pl.run_stages(spark, requests(spark), config(stages=("relabel",)))
    assert set(out) == {"relabelled"}
    out = pl.run_stages(spark, requests(spark), config(stages=("split", "fit")))
    assert "predictions" not in out and out["context"].count() > 0
    with pytest.raises(ValueError):
        pl.run_stages(spark, requests(spark), config(stages=("splitt",)))


def test_input_that_is_split_already_and_a_given_model(spark):
    df = requests(spark).withColumn("split", F.when(F.col("original_index") % 3 == 0, "train").when(F.col("original_index") % 3 == 1, "eval").otherwise("test"))
    model = lm.fit(df.filter("split = 'train' and anomalous = 0"))
    fitted = pl.run_stages(spark, df, config(stages=("fit", "score", "threshold", "evaluate")))
    given = pl.run_stages(spark, df, config(stages=("score", "threshold", "evaluate")), model=model)
    assert sorted(map(tuple, fitted["report"].collect())) == sorted(map(tuple, given["report"].collect()))
    assert pl.run_stages(spark, df, config(stages=("score",))) == {}


def test_restart_from_the_manifest(spark, tmp_path):
    folder = str(tmp_path / "run")
    made = []

    class Watched(pl.Stages):
        def __init__(self, *a):
            super().__init__(*a)
            made.append(self.made)

    original, pl.Stages = pl.Stages, Watched
    try:
        pl.run_stages(spark, requests(spark), config(stages=("split", "fit"), folder=folder), identity="v1")
        first = pl.run_stages(spark, requests(spark), config(stages=("split", "fit", "score", "threshold", "evaluate"), folder=folder), identity="v1")
        again = pl.run_stages(spark, requests(spark), config(stages=("split", "fit", "score", "threshold", "evaluate"), folder=folder, method="percentile"),
                              identity="v1")
        pl.run_stages(spark, requests(spark), config(stages=("split",), folder=folder), identity="v2")
    finally:
        pl.Stages = original
    assert made[0] == ["splits", "context"]
    assert made[1] == ["unigram", "bigram", "predictions", "thresholds", "evaluations"]
    assert made[2] == ["thresholds", "evaluations"]
    assert made[3] == ["splits"]
    assert first["predictions"].count() == again["predictions"].count() == 2 * (36 + 96)
    assert first["report"].columns == again["report"].columns


def test_finetune_grid_best_and_classes(spark):
    stages = ("split", "fit", "finetune", "score", "threshold", "evaluate", "classes")
    out = pl.run_stages(spark, requests(spark), config(stages=stages, grid=True, best_by="f1", models=("causal",), base_weight=2.0))
    splits = out["splits"]
    plain = lm.finetune(lm.fit(splits.filter("split = 'train' and anomalous = 0")), splits.filter("split = 'eval' and anomalous = 0"), 2.0)
    assert {(r.prev, r.tok, r.nxt, r.c) for r in out["context"].collect()} == {(r.prev, r.tok, r.nxt, r.c) for r in plain.context.collect()}
    assert out["evaluations"].count() == 100
    best, report = out["best"].first(), out["report"].first()
    assert best.model == "causal" and report.true_positives + report.false_negatives == 60
    assert {c.ano_class for c in out["classes"].collect()} <= {"126 - Path Traversal"}


def test_thresholds_by_method(spark):
    rows = [("causal", float(x)) for x in range(101)] + [("masked", float("nan")), ("masked", 4.0)]
    df = spark.createDataFrame(rows, "model string, loss double")
    got = {r.model: r.threshold for r in pl.estimate(df, config(method="percentile", percentile=90)).collect()}
    assert got["causal"] == pytest.approx(90.0) and got["masked"] == 4.0
    got = {r.model: r.threshold for r in pl.estimate(df, config(k=2.0)).collect()}
    assert got["causal"] == pytest.approx(50 + 2 * 29.154759, abs=1e-5) and got["masked"] == 4.0


def test_preprocess_from_csv(spark, tmp_path):
    lines = ["request_http_method,request_http_request,request_http_protocol,request_host,000 - Normal,126 - Path Traversal",
             'GET,/a,HTTP/1.1,"h,1",1,0', "GET,/../x,HTTP/1.1,h,0,1", ",/gone,HTTP/1.1,h,1,0"]
    (tmp_path / "raw.csv").write_text("\n".join(lines) + "\n")
    out = pl.run_stages(spark, cfg=config(stages=("preprocess",)), raw_csv=str(tmp_path / "raw.csv"))
    rows = sorted(map(tuple, out["requests"].select("original_index", "anomalous", "ano_class").collect()))
    assert rows == [(1, 0, "normal"), (2, 1, "126 - Path Traversal")]


def test_token_rows_meet_the_types_once(spark):
    """One join brings the losses to the token rows; the count tables meet the types."""
    df = requests(spark)
    model = lm.fit(df.filter("anomalous = 0"))
    for kinds in (("causal",), ("masked",), ("causal", "masked")):
        plan = lm.score_all(model, df, kinds)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
        # a broadcast of the frequent types, the join with the others, and the one that keeps requests without tokens
        assert plan.count("Join ") <= 3


def test_hot_types_have_the_same_losses(spark, monkeypatch):
    df = requests(spark)
    model = lm.fit(df.filter("anomalous = 0"))

    def scores():
        return sorted(map(tuple, lm.score_all(model, df).collect()))
    apart = scores()
    monkeypatch.setattr(lm, "HOT_SHARE", 1)
    assert scores() == apart
