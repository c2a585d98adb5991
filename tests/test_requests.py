"""P1-P5 and the relabel rules on hand-made rows."""

from pyspark.sql import functions as F

from reqlens.operators import requests as rq
from reqlens.operators import rules
from reqlens.schemas import RAW_REQUEST_SCHEMA


def _raw(spark, rows):
    cols = [f.name for f in RAW_REQUEST_SCHEMA.fields]
    full = [{c: r.get(c) for c in cols} for r in rows]
    return spark.createDataFrame(full, RAW_REQUEST_SCHEMA)


def test_reconstruct_with_and_without_body(spark):
    df = _raw(spark, [
        {"request_http_method": "GET", "request_http_request": "/a", "request_http_protocol": "HTTP/1.1",
         "request_host": "h", "request_cookie": "c=1", "000 - Normal": 1},
        {"request_http_method": "POST", "request_http_request": "/b", "request_http_protocol": "HTTP/1.1",
         "request_body": "x=1", "000 - Normal": 0, "126 - Path Traversal": 1, "66 - SQL Injection": 1},
        {"request_http_method": None, "request_http_request": "/c", "request_http_protocol": "HTTP/1.1",
         "000 - Normal": 1},
    ]).withColumn("original_index", F.monotonically_increasing_id() + 1)
    out = {r.request: r for r in rq.preprocess(df).collect()}
    assert "GET /a HTTP/1.1[r][n]Host: h[r][n]Cookie: c=1[r][n]" in out
    assert "POST /b HTTP/1.1[r][n][r][n]x=1" in out
    assert len(out) == 2  # the row without a method is dropped
    assert out["POST /b HTTP/1.1[r][n][r][n]x=1"].ano_class == "126 - Path Traversal"
    assert out["POST /b HTTP/1.1[r][n][r][n]x=1"].anomalous == 1


def test_anomalous_without_class_stays_normal(spark):
    df = _raw(spark, [{"request_http_method": "GET", "request_http_request": "/", "request_http_protocol": "H",
                       "000 - Normal": 0}]).withColumn("original_index", F.lit(1))
    r = rq.preprocess(df).collect()[0]
    assert (r.anomalous, r.ano_class) == (1, "normal")


def test_assign_index_is_dense_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7)
    got = rq.assign_index(df).orderBy("id").collect()
    assert [r.original_index for r in got] == list(range(1, 1001))


def test_rule_literals_and_relabel(spark):
    assert len(rules.RELABEL_LITERALS) == 115
    assert len(rules.distinct_literals()) == 111
    df = spark.createDataFrame(
        [(1, 0, "normal", "GET /x/../y HTTP/1.1"), (2, 0, "normal", "GET /ok HTTP/1.1"),
         (3, 1, "66 - SQL Injection", "GET /ORDER+BY HTTP/1.1"), (4, 0, "normal", "GET /a.bak HTTP/1.1")],
        "original_index long, anomalous int, ano_class string, request string")
    got = {r.original_index: (r.anomalous, r.relabelled, r.ano_class) for r in rules.relabel(df).collect()}
    assert got[1] == (1, True, "normal")
    assert got[2] == (0, False, "normal")
    assert got[3] == (1, False, "66 - SQL Injection")
    assert got[4] == (1, True, "normal")  # backup-file regex


def test_minimal_literals_same_hits():
    lits = rules.distinct_literals()
    mini = rules.minimal_literals()
    assert len(mini) < len(lits)
    for text in ["GET /blog/index.php/2020%22 x", "a--b", "nothing here", "passwd", "/blog%25"]:
        assert any(p in text for p in lits) == any(p in text for p in mini)
