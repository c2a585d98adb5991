"""Losses are looked up where the tokens are."""

from pyspark.sql import functions as F

from reqlens.operators import explain as xp
from reqlens.operators import lm

TEXTS = [(1, "a b c a b"), (2, "a b zz"), (2, "a b q"), (3, ""), (4, None), (5, "x"), (None, "a rare w1")]


def requests(spark):
    return spark.createDataFrame(TEXTS, "original_index long, request string")


def plain_losses(model, kind, df):
    """Losses of all tokens by a join of the token rows with their types."""
    keys, loss = lm.LOSSES[kind]
    rows = lm.long_tokens(df)
    types = loss(rows.select(*keys).distinct(), model).select(*keys, (F.rint(F.col("nll") * lm.GRAIN) / lm.GRAIN).alias("nll"))
    found = rows.join(types, keys).select("original_index", "pos", "tok", "nll").collect()
    return sorted(map(tuple, found), key=str)


def test_looked_up_losses_equal_joined_ones(spark, monkeypatch):
    """Frequent types alone, rare ones alone, and both; repeated and null indexes."""
    df = requests(spark)
    model = lm.fit(df.filter("original_index = 1"))
    for share in (lm.HOT_SHARE, 5, 1):
        monkeypatch.setattr(lm, "HOT_SHARE", share)
        for kind in lm.LOSSES:
            got = lm.with_losses(df, model, {"nll": kind}).select("original_index", "pos", "tok", "nll")
            assert sorted(map(tuple, got.collect()), key=str) == plain_losses(model, kind, df)


def test_token_rows_are_not_shuffled(spark):
    """Only the types are: the frequent ones go to the tasks."""
    df = requests(spark)
    model = lm.fit(df.filter("original_index = 1"))
    rows = xp.token_probabilities(xp.causal_token_rows(model, df))
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_explained_arrays_equal_explained_rows(spark, monkeypatch):
    df = requests(spark)
    model = lm.fit(df.filter("original_index = 1"))
    rows = xp.causal_token_rows(model, df)
    arrays = xp.request_tokens(model, df)
    for gradient in (True, False):
        by_rows = {(r.original_index, r.explained) for r in xp.explain(rows, "html", gradient=gradient).collect()}
        by_arrays = {(r.original_index, r.explained) for r in xp.explain_tokens(arrays, ("html",), gradient=gradient).collect()}
        assert by_rows == by_arrays and len(by_rows) == 4
    assert xp.explain_tokens(arrays, ("terminal", "html", "latex")).count() == 12


def test_explained_requests_equal_explained_arrays(spark, monkeypatch):
    """Markup by type, looked up: the strings and means that the arrays give, also for
    texts that share an index, a byte-level space, escapes and contrast."""
    df = spark.createDataFrame([*TEXTS, (6, "a <b> & _c_ $ 5% Ġx a b"), (2, "Ġ < a")], "original_index long, request string")
    model = lm.fit(df.filter("original_index in (1, 6)"))
    fmts = ("terminal", "html", "latex")
    for share in (lm.HOT_SHARE, 8):
        monkeypatch.setattr(lm, "HOT_SHARE", share)
        for kind, contrast, gradient in (("causal", 1.0, True), ("masked", 3.0, True), ("causal", 1.0, False), ("masked", 0.5, False)):
            by_arrays = xp.explain_tokens(xp.request_tokens(model, df, kind), fmts, contrast, gradient)
            got = xp.explain_requests(model, df, fmts, contrast, gradient, kind)
            columns = ["original_index", "fmt", "mean_prob", "explained"]
            assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, by_arrays.select(columns).collect()), key=str)


def test_explained_requests_gather_texts_once(spark):
    """One shuffle of the texts; the tokens' markup isn't made by functions on arrays of rows."""
    df = requests(spark)
    model = lm.fit(df.filter("original_index = 1"))
    plan = xp.explain_requests(model, df, ("html",), gradient=False)._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert plan.count("collect_list") <= 2 and "lambdafunction(exp" not in plan.lower()
