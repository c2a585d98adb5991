"""Declared schemas and fixed names of the request-log data model.

Schemas are declared, never inferred: a wide CSV with whole-column inference
turns a nullable 0/1 header into ``1.0`` text; here every header is a string.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the source data model) -------------------------
# Essential request-line columns, in request-line order.
ESSENTIAL_COLUMNS = ["request_http_method", "request_http_request", "request_http_protocol"]

# Header columns and the header name written for each, in output order.
HEADER_COLUMNS = [
    ("request_host", "Host"),
    ("request_user_agent", "User-Agent"),
    ("request_accept", "Accept"),
    ("request_accept_language", "Accept-Language"),
    ("request_accept_encoding", "Accept-Encoding"),
    ("request_referer", "Referer"),
    ("request_origin", "Origin"),
    ("request_cookie", "Cookie"),
    ("request_content_type", "Content-Type"),
    ("request_do_not_track", "DNT"),
    ("request_connection", "Connection"),
]
BODY_COLUMN = "request_body"
NORMAL_FLAG = "000 - Normal"

# Attack classes in first-match order.
ANOMALY_CLASSES = [
    "272 - Protocol Manipulation",
    "242 - Code Injection",
    "88 - OS Command Injection",
    "126 - Path Traversal",
    "66 - SQL Injection",
    "16 - Dictionary-based Password Attack",
    "310 - Scanning for Vulnerable Software",
    "153 - Input Data Manipulation",
    "248 - Command Injection",
    "274 - HTTP Verb Tampering",
    "194 - Fake the Source of Data",
    "34 - HTTP Response Splitting",
    "33 - HTTP Request Smuggling",
]
NORMAL_CLASS = "normal"
LINE_SEPARATOR = "[r][n]"

# Strings a pandas CSV reader turns into NaN by default.
DEFAULT_NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                     "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
                     "n/a", "nan", "null"]
# -----------------------------------------------------------------------------

RAW_REQUEST_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in ESSENTIAL_COLUMNS]
    + [T.StructField(c, T.StringType(), True) for c, _ in HEADER_COLUMNS]
    + [T.StructField(BODY_COLUMN, T.StringType(), True),
       T.StructField(NORMAL_FLAG, T.IntegerType(), True)]
    + [T.StructField(c, T.IntegerType(), True) for c in ANOMALY_CLASSES]
)

REQUEST_SCHEMA = T.StructType([
    T.StructField("original_index", T.LongType(), False),
    T.StructField("anomalous", T.IntegerType(), False),
    T.StructField("ano_class", T.StringType(), True),
    T.StructField("request", T.StringType(), True),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField("original_index", T.LongType(), False),
    T.StructField("loss", T.DoubleType(), True),
    T.StructField("perplexity", T.DoubleType(), True),
])

TIMING_SCHEMA = T.StructType([
    T.StructField("original_index", T.LongType(), False),
    T.StructField("time_taken", T.DoubleType(), True),
    T.StructField("tokens_count", T.LongType(), True),
])

EVALUATION_SCHEMA = T.StructType([
    T.StructField("window_size", T.IntegerType(), True),
    T.StructField("threshold_offset", T.DoubleType(), True),
    T.StructField("metric", T.StringType(), True),
    T.StructField("average_anomalies", T.BooleanType(), True),
    T.StructField("use_std_as_offset", T.BooleanType(), True),
    T.StructField("std_multiplier", T.DoubleType(), True),
    T.StructField("calculated_thresholds_avg", T.DoubleType(), True),
    T.StructField("false_positives", T.LongType(), True),
    T.StructField("false_negatives", T.LongType(), True),
    T.StructField("true_negatives", T.LongType(), True),
    T.StructField("true_positives", T.LongType(), True),
    T.StructField("correct", T.LongType(), True),
    T.StructField("fp_indexes", T.ArrayType(T.LongType()), True),
    T.StructField("fn_indexes", T.ArrayType(T.LongType()), True),
    T.StructField("estimated", T.BooleanType(), True),
])

TRAIN_LOG_SCHEMA = T.StructType([
    T.StructField("run", T.StringType(), True),
    T.StructField("mtime", T.TimestampType(), True),
    T.StructField("tag", T.StringType(), True),
    T.StructField("step", T.LongType(), True),
    T.StructField("value", T.DoubleType(), True),
])
