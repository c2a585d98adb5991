"""Threshold estimation and score statistics.

Every statistic is an aggregate with map-side partials; exact percentiles use
range-partitioned prefix sums over the distinct values instead of one task holding
every value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.operators.evaluate import clean_score
from reqlens.operators.ranking import prefix_sums, ranges, running


def gaussian_threshold(df: DataFrame, col: str = "loss", k: float = 0.5) -> DataFrame:
    """``mu + k * sigma`` with the MLE sigma (population std); NaN scores
    count as missing (D16)."""
    x = clean_score(col)
    return df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma")) \
        .withColumn("threshold", F.col("mu") + F.lit(float(k)) * F.col("sigma"))


def gaussian_threshold_value(df: DataFrame, col: str = "loss", k: float = 0.5) -> Column:
    """A7 as a scalar subquery, for use inside other plans."""
    return gaussian_threshold(df, col, k).select("threshold").scalar()


def exact_percentiles(df: DataFrame, col: str, qs: list[float],
                      part_rows: int | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation (as numpy's default).

    Distinct values are counted (a hot value is one row), their running counts
    come from range-partitioned prefix sums, and each needed order statistic is found
    by the row whose count interval covers its rank. Returns ``(q, value)``.
    """
    x = clean_score(col)
    counts = df.filter(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    r = ranges(counts, "v", ["c"], part_rows)
    n, g = r.total("c"), running(r, ["c"])
    h = [(n - 1) * F.lit(float(q)) for q in qs]
    ranks = F.array(*[F.floor(e) for e in h], *[F.ceil(e) for e in h])
    hits = g.withColumn("__ranks", ranks).select(
        "v", F.explode(F.filter("__ranks", lambda r: (r >= F.col("c_before"))
                                & (r < F.col("c_before") + F.col("c")))).alias("r"))
    hits = hits.dropDuplicates(["r"])
    rows = []
    for q, e in zip(qs, h):
        lo = F.max(F.when(F.col("r") == F.floor(e), F.col("v")))
        hi = F.max(F.when(F.col("r") == F.ceil(e), F.col("v")))
        t = e - F.floor(e)
        rows.append(F.struct(F.lit(float(q)).alias("q"), (lo + (hi - lo) * t).alias("value")))
    return hits.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def percentile_threshold(df: DataFrame, col: str = "loss", percentile: float = 99) -> DataFrame:
    """The ``percentile``-th percentile as the threshold."""
    return exact_percentiles(df, col, [percentile / 100.0]).select(F.col("value").alias("threshold"))


def percentile_profile(df: DataFrame, col: str = "loss",
                       percentiles: tuple[int, ...] = (25, 50, 75, 95, 99)) -> DataFrame:
    """Percentile profile as ``(percentile, value)`` rows."""
    out = exact_percentiles(df, col, [p / 100.0 for p in percentiles])
    return out.select(F.round(F.col("q") * 100).cast("int").alias("percentile"), "value")


def upside_deviation(df: DataFrame, col: str = "loss", target: float | None = None) -> DataFrame:
    """``sqrt(sum(max(0, x - t)^2) / (n - 1))``, t = mean by default,
    0 when fewer than two values."""
    x = clean_score(col)
    t = F.lit(float(target)) if target is not None else df.select(F.avg(x)).scalar()
    return df.agg(F.count(x).alias("n"), F.sum(F.pow(F.greatest(x - t, F.lit(0.0)), 2)).alias("s")) \
        .select(F.when(F.col("n") < 2, F.lit(0.0))
                .otherwise(F.sqrt(F.col("s") / (F.col("n") - 1))).alias("upside_deviation"))


def histogram(df: DataFrame, col: str = "loss", bins: int = 100, density: bool = False) -> DataFrame:
    """Equal-width histogram over ``[min, max]`` with ``bins`` bins, the
    last bin closed on the right; every bin is returned, empty ones with 0.
    ``density`` divides counts by ``n * width``."""
    x = clean_score(col)
    stats = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n"))
    mn0, mx0, n = (stats.select(c).scalar() for c in ("mn", "mx", "n"))
    mn = F.when(mn0 == mx0, mn0 - 0.5).otherwise(mn0)
    mx = F.when(mn0 == mx0, mx0 + 0.5).otherwise(mx0)
    width = (mx - mn) / F.lit(float(bins))
    b = F.least(F.floor((x - mn) * F.lit(float(bins)) / (mx - mn)), F.lit(bins - 1)).cast("int")
    counts = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # The bin table is bounded by the parameter ``bins``.
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(F.broadcast(counts), "bin", "left").select(
        "bin", (mn + F.col("bin") * width).alias("lo"), (mn + (F.col("bin") + 1) * width).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    if density:
        out = out.withColumn("density", F.col("count") / (n * width))
    return out


def gaussian_curve(df: DataFrame, col: str = "loss", points: int = 1000, margin: float = 0.05) -> DataFrame:
    """normal density with the fitted (mu, sigma) at ``points`` evenly
    spaced x between the plot limits (data range widened by ``margin``). Scores
    that are all equal have no density: the column is NULL."""
    x = clean_score(col)
    st = df.agg(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sd"), F.min(x).alias("mn"), F.max(x).alias("mx"))
    mu, sd, mn, mx = (st.select(c).scalar() for c in ("mu", "sd", "mn", "mx"))
    lo = mn - (mx - mn) * margin
    hi = mx + (mx - mn) * margin
    step = (hi - lo) / F.lit(float(points - 1))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    xs = lo + F.col("i") * step
    sd = F.nullif(sd, F.lit(0.0))
    z = (xs - mu) / sd
    pdf = F.exp(F.lit(-0.5) * z * z) / (sd * F.lit(math.sqrt(2 * math.pi)))
    return grid.select("i", xs.alias("x"), pdf.alias("density"))


def kde_curve(df: DataFrame, col: str = "loss", bins: int | None = 1500, points: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth ``n^(-1/5) * std``) over
    ``points`` x from min to max, evaluated on pre-binned data (bounded:
    bins x points kernel terms, whatever the row count; each bin's kernel sits
    at the mean of its values, so the error is second order in the bin width;
    ``bins`` is the accuracy parameter, and ``bins=None`` takes every distinct
    value as its own kernel, exactly). Scores that are all equal have no
    bandwidth: the density is NULL."""
    x = clean_score(col)
    st = df.agg(F.min(x).alias("mn"), F.max(x).alias("mx"), F.count(x).alias("n"),
                F.stddev_samp(x).alias("sd"))
    mn, mx, n, sd = (st.select(c).scalar() for c in ("mn", "mx", "n", "sd"))
    h = F.nullif(sd * F.pow(n.cast("double"), F.lit(-0.2)), F.lit(0.0))
    # Pre-bin: each non-empty bin becomes one kernel at the mean of its
    # values (first moment), weighted by its count.
    b = x if bins is None else F.coalesce(
        F.least(F.floor((x - mn) * F.lit(float(bins)) / F.nullif(mx - mn, F.lit(0.0))), F.lit(bins - 1)), F.lit(0))
    hist = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(
        F.avg(x).alias("c"), F.count(F.lit(1)).alias("count"))
    step = (mx - mn) / F.lit(float(points - 1))
    idx = F.sequence(F.lit(0), F.lit(points - 1))
    # Scalar subqueries cannot sit inside a lambda: project them first.
    hist = hist.withColumn("__mn", mn).withColumn("__step", step).withColumn("__h", h)
    contrib = hist.select(F.posexplode(F.transform(
        idx, lambda i: F.col("count") * F.exp(F.lit(-0.5) * F.pow(
            (F.col("__mn") + i * F.col("__step") - F.col("c")) / F.col("__h"), 2))
    )).alias("i", "w"))
    return contrib.groupBy("i").agg(F.sum("w").alias("w")).select(
        "i", (mn + F.col("i") * step).alias("x"),
        (F.col("w") / (n * h * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def rolling_std(df: DataFrame, order_col: str, value_col: str, window: int,
                name: str = "rolling_std", part_rows: int | None = None) -> DataFrame:
    """Sample std over the trailing ``window`` rows by ``order_col``;
    incomplete windows get the global sample std (A10).

    O(n) at any window size: values are centred on the global mean, running
    sums of x and x^2 come from range-partitioned prefix sums, and the frame sum is the
    difference with the row ``window`` positions earlier (an equi-join on the
    position, no single-task window and no per-row frame scan). A NULL or NaN
    makes the frames that hold it incomplete.
    """
    v = clean_score(value_col)
    mean = df.select(F.avg(v)).scalar()
    gstd = df.select(F.stddev_samp(v)).scalar()
    c = df.withColumn("__x", F.coalesce(v - mean, F.lit(0.0))).withColumn("__x2", F.col("__x") * F.col("__x")) \
        .withColumn("__one", F.lit(1).cast("long")).withColumn("__has", v.isNotNull().cast("long"))
    p = prefix_sums(c, order_col, ["__one", "__has", "__x", "__x2"], part_rows) \
        .withColumn("__pos", F.col("__one_before") + 1)
    p = p.withColumn("__s0", F.col("__has_before") + F.col("__has")) \
         .withColumn("__s1", F.col("__x_before") + F.col("__x")) \
         .withColumn("__s2", F.col("__x2_before") + F.col("__x2"))
    prev = p.select((F.col("__pos") + window).alias("__pos"), F.col("__s0").alias("__p0"),
                    F.col("__s1").alias("__p1"), F.col("__s2").alias("__p2"))
    j = p.join(prev, "__pos", "left")
    s1 = F.col("__s1") - F.coalesce(F.col("__p1"), F.lit(0.0))
    s2 = F.col("__s2") - F.coalesce(F.col("__p2"), F.lit(0.0))
    var = (s2 - s1 * s1 / window) / (window - 1)
    filled = F.col("__s0") - F.coalesce(F.col("__p0"), F.lit(0)) == window
    std = F.when(filled, F.sqrt(F.greatest(var, F.lit(0.0))))
    return j.withColumn(name, F.coalesce(std, gstd)).drop(
        "__x", "__x2", "__one", "__has", "__has_before", "__s0", "__p0", "__one_before", "__x_before", "__x2_before", "__s1", "__s2", "__p1",
        "__p2", "__pos")
