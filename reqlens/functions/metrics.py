"""Metric formulas over confusion-count columns (F1), as Column expressions.

Zero guards follow the source: TPR, FPR, recall, FNR and TNR are 0 when their
denominator is 0. Precision, F1 and accuracy are NULL when theirs is 0 (the
source tests the wrong denominator for precision and divides by zero for F1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FP, FN, TN, TP = "false_positives", "false_negatives", "true_negatives", "true_positives"


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio_or_zero(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _ratio_or_null(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def accuracy() -> Column:
    return _ratio_or_null(_c(TP) + _c(TN), _c(TP) + _c(TN) + _c(FP) + _c(FN))


def tpr() -> Column:
    return _ratio_or_zero(_c(TP), _c(TP) + _c(FN))


def fpr() -> Column:
    return _ratio_or_zero(_c(FP), _c(FP) + _c(TN))


def precision() -> Column:
    return _ratio_or_null(_c(TP), _c(TP) + _c(FP))


def recall() -> Column:
    return tpr()


def f1() -> Column:
    return _ratio_or_null(2 * _c(TP), 2 * _c(TP) + _c(FP) + _c(FN))


def fnr() -> Column:
    return _ratio_or_zero(_c(FN), _c(FN) + _c(TP))


def tnr() -> Column:
    return _ratio_or_zero(_c(TN), _c(TN) + _c(FP))


METRICS = {"accuracy": accuracy, "tpr": tpr, "fpr": fpr, "precision": precision,
           "recall": recall, "f1": f1, "fnr": fnr, "tnr": tnr}


def with_metrics(df, names: list[str] | None = None, digits: int | None = 6):
    """Add the metric columns (rounded to ``digits`` unless None)."""
    for n in names or list(METRICS):
        col = METRICS[n]()
        df = df.withColumn(n, F.round(col, digits) if digits is not None else col)
    return df
