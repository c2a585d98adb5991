"""A few query keys against their DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

SF = "/root/testdata/sf0.001"
KEYS = ["http_reconstruct", "relabel_summary", "threshold_sweep", "stratified_split", "score_causal",
        "auc_roc", "best_result"]


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from oracle_check import TABLES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, duck, key):
    import __spark_entry__ as entry
    from oracle_check import rows_of
    got = entry.queries()[key](spark, SF).toPandas()
    exp = duck.sql(entry.oracle_sql()[key]).df()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(exp)
    assert c1 == c2
    assert r1 == r2
