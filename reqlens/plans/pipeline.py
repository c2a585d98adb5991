"""The end-to-end experiment as a graph of stored stages with switches.

preprocess (S1, P1-P5) -> relabel (P10-P12) -> split (W6) -> fit (M1) -> finetune
(M7) -> score (M2, M3) -> threshold (A7, A8) -> evaluate (A1, A2, R1, A12) ->
classes (R7).

Every stage that is on writes its tables once as Parquet and the stages after it
read those, so a lost executor repeats only its own stage's tasks. A manifest
beside the tables names each with its identity, a digest of what it was made from
(parameters and the identities of its inputs), its schema and path: a run over the same
folder starts again after the stages that are there and whose identity is the same.

A stage that is off is not run: its output is taken from the input (a ``split``
column, already relabelled requests) or a given model, and stages that lack theirs
are not run either.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.functions import metrics as M
from reqlens.operators import evaluate as ev
from reqlens.operators import lm
from reqlens.operators import report as rp
from reqlens.operators import rules
from reqlens.operators import split as sp
from reqlens.operators import threshold as th
from reqlens.session import ensure_checkpoint_dir

STAGES = ("preprocess", "relabel", "split", "fit", "finetune", "score", "threshold", "evaluate", "classes")
DEFAULT = ("relabel", "split", "fit", "score", "threshold", "evaluate")
MANIFEST_SCHEMA = "name string, identity string, path string, schema string"


@dataclass
class PipelineConfig:
    stages: tuple[str, ...] = DEFAULT
    models: tuple[str, ...] = ("causal", "masked")
    stride: int = 5
    #: threshold: ``gaussian`` (mean + k deviations) or ``percentile``, of the eval split's scores
    method: str = "gaussian"
    k: float = 0.5
    percentile: float = 99
    #: the estimated threshold alone, or with the grid 0.01 .. 0.99
    grid: bool = False
    #: criterion of the best entry
    best_by: str = "f1"
    #: split whose normal requests a fine-tuned model adds, and the weight of the base counts
    finetune_split: str = "eval"
    base_weight: float = 1.0
    seed: int = 42
    max_tokens: int | None = None
    fractions: dict = field(default_factory=lambda: dict(sp.DEFAULT_FRACTIONS))
    #: where the stage tables go; a new folder below the checkpoint folder if not given
    folder: str | None = None


class Stages:
    """The stored tables of a folder and their manifest."""

    def __init__(self, spark: SparkSession, folder: str | None) -> None:
        self.spark = spark
        self.folder = folder or f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
        self.known: dict[tuple[str, str], tuple[str, str]] = {}
        self.identity: dict[str, str] = {}
        #: names of the tables that this run made, in order
        self.made: list[str] = []
        spark.createDataFrame([], MANIFEST_SCHEMA).write.mode("append").json(f"{self.folder}/manifest")
        for r in spark.read.schema(MANIFEST_SCHEMA).json(f"{self.folder}/manifest").collect():  # one row a table
            self.known[r["name"], r["identity"]] = r["path"], r["schema"]

    def source(self, name: str, identity: str) -> None:
        self.identity[name] = identity

    def table(self, name: str, inputs: list[str], parameters: object, build: Callable[[], DataFrame],
              partition: str | None = None) -> DataFrame:
        """The table ``name``: read if it is there with this identity, else made."""
        text = json.dumps([name, [self.identity[i] for i in inputs], parameters], sort_keys=True, default=str)
        self.identity[name] = own = hashlib.sha256(text.encode()).hexdigest()
        if (name, own) not in self.known:
            df, path = build(), f"{self.folder}/{name}-{own[:16]}"
            writer = df.write.mode("overwrite")  # what a run that broke off left there
            (writer.partitionBy(partition) if partition else writer).parquet(path)
            schema = df.schema.json()
            # only a table that is whole enters the manifest
            self.spark.createDataFrame([(name, own, path, schema)], MANIFEST_SCHEMA).coalesce(1) \
                .write.mode("append").json(f"{self.folder}/manifest")
            self.known[name, own] = path, schema
            self.made.append(name)
        path, schema = self.known[name, own]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)


def file_identity(spark: SparkSession, path: str) -> str:
    """Digest of the files' paths, lengths and times (their contents aren't read)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("long").alias("t"))
    total = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "t").cast("decimal(38,0)"))).first()
    return f"{path}:{tuple(map(str, total))}"


def run_stages(spark: SparkSession, requests: DataFrame | None = None, cfg: PipelineConfig | None = None, raw_csv: str | None = None,
               identity: str | None = None, model: lm.CountModel | None = None) -> dict[str, DataFrame]:
    """Run the stages that are on; returns their tables by name. ``identity`` names
    the content of ``requests``; without one they count as new every time."""
    cfg = cfg or PipelineConfig()
    unknown = set(cfg.stages) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages {sorted(unknown)}")
    on = set(cfg.stages)
    s = Stages(spark, cfg.folder)
    out: dict[str, DataFrame] = {}
    at = "requests"
    if "preprocess" in on:
        if raw_csv is None:
            raise ValueError("the stage preprocess needs raw_csv")
        from reqlens.operators.requests import preprocess
        from reqlens.sources.readers import read_raw_requests
        s.source("raw", file_identity(spark, raw_csv))
        requests = s.table("requests", ["raw"], None, lambda: preprocess(_indexed(read_raw_requests(spark, raw_csv))))
        out["requests"] = requests
    else:
        if requests is None:
            raise ValueError("no requests given")
        s.source("requests", identity or uuid.uuid4().hex)
    if "relabel" in on:
        before, at = requests, "relabelled"
        requests = out["relabelled"] = s.table("relabelled", ["requests"], None, lambda: rules.relabel(before).drop("relabelled"))
    if "split" in on:
        before = requests
        splits = s.table("splits", [at], [cfg.fractions, cfg.seed], lambda: sp.stratified_split(before, cfg.fractions, cfg.seed)
                         .select("original_index", "anomalous", "ano_class", "request", "split"), partition="split")
        out["splits"] = splits
        out["split_stats"] = sp.split_stats(splits)
        at = "splits"
    elif "split" in requests.columns:
        splits = requests
    else:
        return out
    train = splits.filter((F.col("split") == "train") & (F.col("anomalous") == 0))
    if "fit" in on:
        ctx = s.table("context", [at], [cfg.max_tokens], lambda: lm.fit(train, cfg.max_tokens).context)
        model, model_at = lm.CountModel.of_context(ctx), "context"
    elif model is not None:
        s.source("given model", uuid.uuid4().hex)
        model_at = "given model"
    if model is not None and "finetune" in on:
        base, new = model, splits.filter((F.col("split") == cfg.finetune_split) & (F.col("anomalous") == 0))
        ctx = s.table("finetuned", [model_at, at], [cfg.finetune_split, cfg.base_weight, cfg.max_tokens],
                      lambda: lm.finetune(base, new, cfg.base_weight, cfg.max_tokens).context)
        model, model_at = lm.CountModel.of_context(ctx), "finetuned"
    if model is not None:
        out["context"] = model.context
    if model is None or "score" not in on:
        return out
    fitted = lm.CountModel(s.table("unigram", [model_at], None, lambda: model.unigram),
                           s.table("bigram", [model_at], None, lambda: model.bigram), model.context)
    scored = splits.filter(F.col("split").isin("eval", "test"))
    predictions = s.table("predictions", [model_at, at], [cfg.models, cfg.stride, cfg.max_tokens], lambda: lm.score_all(
        fitted, scored, cfg.models, cfg.stride, cfg.max_tokens).join(scored.select("original_index", "anomalous", "ano_class", "split"), "original_index"),
        partition="split")
    out["predictions"] = predictions
    if "threshold" not in on:
        return out
    out["thresholds"] = thresholds = s.table("thresholds", ["predictions"], [cfg.method, cfg.k, cfg.percentile],
                                             lambda: estimate(predictions.filter("split = 'eval'"), cfg))
    test = predictions.filter("split = 'test'")
    if "evaluate" in on:
        out["evaluations"] = evaluations = s.table("evaluations", ["predictions", "thresholds"], [cfg.grid, cfg.models],
                                                   lambda: evaluate(spark, test, thresholds, cfg))
        out["best"] = _union([ev.best_result(evaluations.filter(F.col("model") == m).drop("model"), cfg.best_by)
                              .select(F.lit(m).alias("model"), "*") for m in cfg.models])
        out["report"] = report(test, evaluations, cfg)
    if "classes" in on:
        truth = splits.filter("split = 'test'")
        out["classes"] = rp.class_fn_rates_multi(truth, [
            (m, test.filter(F.col("model") == m), thresholds.filter(F.col("model") == m).select("threshold").scalar(), "loss") for m in cfg.models])
    return out


def _indexed(raw: DataFrame) -> DataFrame:
    from reqlens.operators.requests import assign_index
    return raw if "original_index" in raw.columns else assign_index(raw)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def estimate(scores: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """``(model, threshold)`` by the method of the configuration; NULL without scores."""
    if cfg.method == "gaussian":
        x = ev.clean_score("loss")
        found = scores.groupBy("model").agg((F.avg(x) + F.lit(float(cfg.k)) * F.stddev_pop(x)).alias("threshold"))
    elif cfg.method == "percentile":
        found = _union([th.percentile_threshold(scores.filter(F.col("model") == m), "loss", cfg.percentile)
                        .select(F.lit(m).alias("model"), "threshold") for m in cfg.models])
    else:
        raise ValueError(f"unknown threshold method {cfg.method!r}")
    return found


def evaluate(spark: SparkSession, test: DataFrame, thresholds: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """The evaluation rows of every model (A2): one sweep a model."""
    parts = []
    for m in cfg.models:
        params = ev.param_grid(spark, thresholds.filter(F.col("model") == m))
        params = params if cfg.grid else params.filter("estimated")
        parts.append(ev.threshold_sweep(test.filter(F.col("model") == m), params, "loss", None).select(F.lit(m).alias("model"), "*"))
    return _union(parts)


def report(test: DataFrame, evaluations: DataFrame, cfg: PipelineConfig) -> DataFrame:
    """One row a model: the estimated threshold, its counts, F1, and the ROC AUC."""
    rows = M.with_metrics(evaluations.filter("estimated"), ["f1"], digits=None)
    return _union([rows.filter(F.col("model") == m).select(
        "model", F.round("calculated_thresholds_avg", 6).alias("threshold"), "true_positives", "false_positives", "false_negatives",
        "true_negatives", F.round("f1", 6).alias("f1"),
        F.round(ev.auc_scores(test.filter(F.col("model") == m), "loss").select("auc_roc").scalar(), 6).alias("auc_roc")) for m in cfg.models])


def run(spark: SparkSession, requests: DataFrame, cfg: PipelineConfig | None = None) -> DataFrame:
    """One report row per model: threshold, confusion counts, F1, AUC."""
    return run_stages(spark, requests, cfg)["report"]
