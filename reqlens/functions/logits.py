"""Cross entropy from logits (F4) as a JVM-side array expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE_LABEL = -100


def token_nll(logits: Column, label: Column) -> Column:
    """``logsumexp(logits) - logits[label]`` with the max shift; NULL for the
    ignored label -100."""
    x = F.transform(logits, lambda v: v.cast("double"))
    m = F.array_max(x)
    s = F.aggregate(F.transform(x, lambda v: F.exp(v - m)), F.lit(0.0), lambda a, v: a + v)
    nll = m + F.log(s) - F.element_at(x, label + 1)
    return F.when(label != IGNORE_LABEL, nll)
