"""F5/F8/F9 markup formats on hand-made token rows."""

from reqlens.operators import explain as xp


def _rows(spark):
    return spark.createDataFrame(
        [(1, 1, "a<b", 0.0), (1, 2, "x_$%&", 0.6931471805599453), (1, 3, "[CLS]", 0.0)],
        "original_index long, pos int, tok string, nll double")


def test_terminal(spark):
    r = xp.explain(_rows(spark), "terminal").collect()[0]
    assert r.explained == ("\x1b[38;2;255;255;255ma<b\x1b[0m" "\x1b[38;2;255;128;255mx_$%&\x1b[0m" "\x1b[0m")
    assert abs(r.mean_prob - 0.75) < 1e-12  # [CLS] dropped before the mean


def test_html_escapes(spark):
    r = xp.explain(_rows(spark), "html").collect()[0]
    assert r.explained.startswith(xp.HTML_PREFIX) and r.explained.endswith(xp.HTML_SUFFIX)
    assert '<span style="color: #0000ff;">a&lt;b</span>' in r.explained
    assert '<span style="color: #800080;">x_$%&amp;</span>' in r.explained


def test_latex_escapes(spark):
    r = xp.explain(_rows(spark), "latex").collect()[0]
    assert r.explained == "|\\hlhex{ffffff}{a<b}||\\hlhex{ff80ff}{x\\_\\$\\%\\&}|"


def _numbered(spark, n=50):
    import math
    return spark.createDataFrame([(1, i + 1, f"t{i}", -math.log((i + 1) / n)) for i in range(n)] + [(2, 1, "only", 0.5), (3, 1, "[CLS]", 0.0)],
                                 "original_index long, pos int, tok string, nll double")


def _levels(probs):
    import numpy as np
    limits = np.percentile(probs, [2, 6, 14])
    return [next((k for k in range(3) if p < limits[k]), 3) for p in probs]


def test_percentile_formats(spark):
    levels = _levels([(i + 1) / 50 for i in range(50)])
    rgb, hexes, html = ["255;0;0", "255;165;0", "255;255;0"], ["FF0000", "FFA500", "FFFF00"], xp.HTML_PERCENTILE_COLOURS
    assert set(levels) == {0, 1, 2, 3}
    got = {r.original_index: r.explained for r in xp.explain(_numbered(spark), "terminal", gradient=False).collect()}
    assert got[1] == "".join(f"\x1b[38;2;{rgb[k]}mt{i}\x1b[0m" if k < 3 else f"t{i}" for i, k in enumerate(levels)) + "\x1b[0m"
    assert got[2] == "only\x1b[0m" and got[3] == "\x1b[0m"
    got = {r.original_index: r.explained for r in xp.explain(_numbered(spark), "latex", gradient=False).collect()}
    assert got[1] == "".join(f"|\\hlhex{{{hexes[k]}}}{{t{i}}}|" if k < 3 else f"t{i}" for i, k in enumerate(levels))
    got = {r.original_index: r.explained for r in xp.explain(_numbered(spark), "html", gradient=False).collect()}
    assert got[1] == xp.HTML_PREFIX + "".join(f'<span style="color: {html[k]};">t{i}</span>' for i, k in enumerate(levels)) + xp.HTML_SUFFIX


def test_contrast_moves_tokens_below_the_limits(spark):
    """Limits come from the plain probabilities, colours from the contrasted ones."""
    import numpy as np
    probs = [(i + 1) / 50 for i in range(50)]
    limits = np.percentile(probs, [2, 6, 14])
    got = xp.explain(_numbered(spark), "terminal", contrast=2.0, gradient=False).filter("original_index = 1").first().explained
    assert got.count("\x1b[38;2;") == sum(p * p < limits[2] for p in probs)


def test_requests_without_tokens_stay(spark):
    asked = spark.createDataFrame([(1,), (9,)], "original_index long")
    got = {r.original_index: r for r in xp.explain(_rows(spark), "html", requests=asked).collect()}
    assert got[9].mean_prob is None and got[9].explained == xp.HTML_PREFIX + xp.HTML_SUFFIX
    assert set(got) == {1, 9}


def test_dataset_explanation_flags(spark):
    from reqlens.operators import lm
    rows = [(1, "a b c"), (2, "a x"), (3, "zz zz"), (4, "")]
    df = spark.createDataFrame(rows, "original_index long, request string")
    model = lm.fit(df.filter("original_index = 1"))
    scored = spark.createDataFrame([(1, "causal", 0.1, 1), (2, "causal", 0.9, 0), (3, "causal", 0.9, 1), (3, "masked", 0.1, 1)],
                                   "original_index long, model string, loss double, anomalous int")
    entries = spark.createDataFrame([("causal", 0.5), ("masked", 0.5)], "model string, threshold_offset double")
    got = {(r.original_index, r.model): (r.is_fn, r.is_fp) for r in xp.explain_dataset(model, df, scored, entries).collect()}
    assert len(got) == 8
    assert got[1, "causal"] == (True, False) and got[2, "causal"] == (False, True) and got[3, "masked"] == (True, False)
    assert not any(any(v) for k, v in got.items() if k not in {(1, "causal"), (2, "causal"), (3, "masked")})
