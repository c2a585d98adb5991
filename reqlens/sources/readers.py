"""Scans of the data model (S1-S6). Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqlens.schemas import (DEFAULT_NA_TOKENS, EVALUATION_SCHEMA, PREDICTION_SCHEMA,
                             RAW_REQUEST_SCHEMA, REQUEST_SCHEMA)


def _csv(spark: SparkSession, schema: T.StructType):
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE"))


def na_cleanup(df: DataFrame, na_tokens: list[str] | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """The NA strings a pandas CSV reader turns into NaN become NULL."""
    tokens = DEFAULT_NA_TOKENS if na_tokens is None else na_tokens
    arr = F.array(*[F.lit(t) for t in tokens])
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.select(*[
        (F.when(F.array_contains(arr, F.col(f"`{c}`")), F.lit(None).cast("string"))
          .otherwise(F.col(f"`{c}`")).alias(c)) if c in cols else F.col(f"`{c}`")
        for c in df.columns])


def files_with_breaks(spark: SparkSession, path: str | list[str]) -> tuple[list[str], list[str]]:
    """(files whose fields hold no line break, files that may have one), by one
    splittable pass over the lines: a field with a break leaves a line with an odd
    number of quotes. A quote inside an unquoted field counts as a possible break."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    found = lines.groupBy("file").agg(F.max(odd).alias("odd")).collect()  # one row a file, as the reader needs their names
    return sorted(r.file for r in found if not r.odd), sorted(r.file for r in found if r.odd)


def read_raw_requests(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      na_tokens: list[str] | None = None) -> DataFrame:
    """Wide request-log CSV, NA cleanup, then the declared schema.

    Columns are matched by header name (a CSV schema alone is applied by
    position), every field is read as text (no inference pass) and cast to
    its declared type after the NA cleanup; absent columns are NULL. Only files
    that may hold a line break inside a field are read in one piece each; the
    others are split between tasks.
    """
    schema = schema or RAW_REQUEST_SCHEMA

    def read(files: list[str], whole: bool) -> DataFrame:
        return (spark.read.option("header", True).option("multiLine", whole).option("quote", '"')
                .option("escape", '"').option("inferSchema", False).csv(files))

    plain, broken = files_with_breaks(spark, path)
    parts = [read(files, whole) for files, whole in ((plain, False), (broken, True)) if files]
    raw = parts[0] if parts else read([path], True)
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    raw = na_cleanup(raw, na_tokens)
    have = set(raw.columns)
    return raw.select(*[
        (F.col(f"`{f.name}`").cast(f.dataType) if f.name in have
         else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields])


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Request table (parquet, or CSV with the declared schema)."""
    if fmt == "csv":
        return _csv(spark, REQUEST_SCHEMA).csv(path)
    return spark.read.schema(REQUEST_SCHEMA).parquet(path)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """S3: table written with ``partitionBy('split')``; a filter on ``split``
    prunes directories at planning time."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction table."""
    return spark.read.schema(PREDICTION_SCHEMA).parquet(path)


def read_evaluations(spark: SparkSession, paths: list[str] | str,
                     labels: list[str] | None = None) -> DataFrame:
    """Several evaluation tables, each tagged with a model label; paths
    that do not exist are skipped with a warning."""
    import warnings

    paths = [paths] if isinstance(paths, str) else list(paths)
    labels = labels or paths
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001
    hconf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    frames = []
    for p, label in zip(paths, labels):
        jp = jvm_path(p)
        if not jp.getFileSystem(hconf).exists(jp):
            warnings.warn(f"evaluation table {p} not found, skipping", stacklevel=2)
            continue
        frames.append(spark.read.parquet(p).withColumn("model", F.lit(label)))
    if not frames:
        raise FileNotFoundError("no evaluation table found")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def latest_run_log(log: DataFrame, tags: list[str] | None = None) -> DataFrame:
    """Rows of the newest run (largest mtime; ties by run) for the scalar
    tags. The newest run is a one-row aggregate joined back (a semi join)."""
    newest = log.agg(F.max_by("run", F.struct("mtime", "run")).alias("run"))
    out = log.join(newest, "run", "left_semi")
    return out.filter(F.col("tag").isin(tags)) if tags else out
