"""Token-level explanation of scores.

Per-token losses come from the model joins in long form; each token gets a
probability ``exp(-loss)`` (F3), a colour (gradient F5 or per-request
percentile F6, contrast F7) and a marked-up piece (F8); the pieces of a
request are re-assembled in position order (one group per request, its tokens)
into one string per output format (F9). The limits of the percentile colours are
order statistics of that group's sorted probabilities, so the token rows are
gathered once and never joined to their own aggregate.

Fixed from the source: probabilities are aligned with their tokens, the
masked variant masks the explained position (every other token is context),
the causal mean covers real tokens only, uncoloured tokens are kept, and HTML
text is escaped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.operators import lm

# --- fixed values ------------------------------------------------------------
SKIP_TOKENS = ["<|endoftext|>", "[EOS]", "</s>", "<EOS>", "[PAD]", "<PAD>", "[CLS]"]
RESET = "\x1b[0m"
HTML_PREFIX = ('<div style="background-color: #cccccc; color: white; padding: 20px; '
               'font-family: monospace; line-height: 1.5;">')
HTML_SUFFIX = "</div>"
PERCENTILES = [0.02, 0.06, 0.14]
PERCENTILE_COLOURS = ["FF0000", "FFA500", "FFFF00"]             # below p2, p6, p14
HTML_PERCENTILE_COLOURS = ["#ff6b6b", "#ff8000", "#ffff00", "#000000"]
LATEX_ESCAPES = ["_", "$", "%", "&"]
BYTE_SPACE = "Ġ"                                            # byte-level BPE space
# -----------------------------------------------------------------------------


def hex2(x: Column) -> Column:
    """Two-digit lower-case hex of ``round_half_even(x * 255)``."""
    return F.lpad(F.lower(F.hex(F.bround(x * 255, 0).cast("int"))), 2, "0")


def token_probabilities(token_nll: DataFrame, contrast: float = 1.0) -> DataFrame:
    """F3 + F7: ``prob = exp(-nll) ** contrast``."""
    p = F.exp(-F.col("nll"))
    if contrast != 1.0:
        p = F.pow(p, F.lit(float(contrast)))
    return token_nll.withColumn("prob", p)


def _first_without_context(pos: Column, nll: Column) -> Column:
    """The first token has no context: loss 0 (prob 1)."""
    return F.when(pos == 1, F.lit(0.0)).otherwise(nll)


def causal_token_rows(model: lm.CountModel, df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """M5 + W5: every real token; the first has no context, loss 0 (prob 1)."""
    rows = lm.with_losses(df, model, {"nll": "causal"}, max_tokens)
    return rows.withColumn("nll", _first_without_context(F.col("pos"), F.col("nll")))


def masked_token_rows(model: lm.CountModel, df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """M4 + T7/T8: one masked position at a time, every other token visible;
    the loss is read at the masked position."""
    return lm.masked_token_nll(model, df, stride=2, max_tokens=max_tokens)


def request_tokens(model: lm.CountModel, df: DataFrame, kind: str = "causal", max_tokens: int | None = None) -> DataFrame:
    """The same tokens as one row ``(original_index, tokens)`` for each index that has any,
    ``tokens`` an array of ``(pos, tok, nll)``: only texts are gathered by index, no token rows."""
    found = lm.request_losses(lm.marked_texts(df, max_tokens, by_index=True), df, model, {"nll": kind}, max_tokens).filter(F.size("tokens") > 0)
    if kind != "causal":
        return found
    return found.withColumn("tokens", F.transform("tokens", lambda t: t.withField("nll", _first_without_context(t["pos"], t["nll"]))))


def gradient_piece(fmt: str, tok: Column, p: Column) -> Column:
    """The marked-up text of one token with its probability."""
    text = _escaped(fmt, tok)
    n = hex2(p)
    if fmt == "terminal":
        g = F.bround(p * 255, 0).cast("int").cast("string")
        return F.concat(F.lit("\x1b[38;2;255;"), g, F.lit(";255m"), text, F.lit(RESET))
    if fmt == "html":
        return F.concat(F.lit('<span style="color: #'), hex2(1 - p), F.lit("00"), n, F.lit(';">'), text, F.lit("</span>"))
    return F.concat(F.lit("|\\hlhex{ff"), n, F.lit("ff}{"), text, F.lit("}|"))


def _escaped(fmt: str, tok: Column) -> Column:
    """F8: the token's text in the format."""
    if fmt == "html":
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;")):
            tok = F.replace(tok, F.lit(a), F.lit(b))
    elif fmt == "latex":
        for c in LATEX_ESCAPES:
            tok = F.replace(tok, F.lit(c), F.lit("\\" + c))
    elif fmt != "terminal":
        raise ValueError(fmt)
    return tok


def percentile_marks(fmt: str) -> list[tuple[str, str]]:
    """What stands before and after a token below the first, second, third limit
    (levels 0 to 2) or none (3). Tokens without a colour stay as they are; HTML has a colour for them."""
    if fmt == "html":
        return [(f'<span style="color: {c};">', "</span>") for c in HTML_PERCENTILE_COLOURS]
    if fmt == "latex":
        return [*((f"|\\hlhex{{{c}}}{{", "}|") for c in PERCENTILE_COLOURS), ("", "")]
    rgb = [";".join(str(int(c[i:i + 2], 16)) for i in (0, 2, 4)) for c in PERCENTILE_COLOURS]
    return [*((f"\x1b[38;2;{c}m", RESET) for c in rgb), ("", "")]


def percentile_piece(fmt: str, tok: Column, level: Column) -> Column:
    """The marked-up text of a token of this level."""
    text, marks = _escaped(fmt, tok), percentile_marks(fmt)
    out = F.concat(F.lit(marks[3][0]), text, F.lit(marks[3][1]))
    for i in (2, 1, 0):
        out = F.when(level == i, F.concat(F.lit(marks[i][0]), text, F.lit(marks[i][1]))).otherwise(out)
    return out


def _order_statistic(ordered: Column, q: float) -> Column:
    """The q-quantile of a sorted array, between neighbours as numpy's default."""
    at = (F.size(ordered) - 1) * F.lit(q)
    low = F.get(ordered, F.floor(at).cast("int"))
    return low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at))


def _frame(fmt: str) -> tuple[str, str]:
    """What stands before and after the pieces of a text."""
    return {"terminal": ("", RESET), "html": (HTML_PREFIX, HTML_SUFFIX)}.get(fmt, ("", ""))


def _wrap(fmt: str, body: Column) -> Column:
    before, after = _frame(fmt)
    return F.replace(F.concat(F.lit(before), body, F.lit(after)), F.lit(BYTE_SPACE), F.lit(" "))


def explain(token_rows: DataFrame, fmt: str = "terminal", contrast: float = 1.0, gradient: bool = True,
            keys: tuple[str, ...] = ("original_index",), requests: DataFrame | None = None,
            include_padding: int | None = None) -> DataFrame:
    """per request (``keys``) ``mean_prob`` of its real tokens and the marked-up
    string, with gradient (F5) or percentile colours (F6). Given ``requests``,
    those without tokens have a row, too, with no mean and nothing marked up.
    ``include_padding`` takes the mean over a window of that many positions, padding
    having probability 1 (D14: what the source does)."""
    g = token_rows.groupBy(*keys).agg(F.collect_list(F.struct("pos", "tok", "nll")).alias("tokens"))
    g = explain_tokens(g, (fmt,), contrast, gradient, keys, include_padding).drop("fmt")
    if requests is None:
        return g
    return requests.select(*keys).join(g, list(keys), "left").withColumn("explained", F.coalesce("explained", _wrap(fmt, F.lit(""))))


def explain_tokens(g: DataFrame, fmts: tuple[str, ...] = ("terminal",), contrast: float = 1.0, gradient: bool = True,
                   keys: tuple[str, ...] = ("original_index",), include_padding: int | None = None) -> DataFrame:
    """F9 on gathered tokens (``tokens``: an array of ``(pos, tok, nll)``): ``(keys, fmt,
    mean_prob, explained)``, a row for each format. Everything is computed inside the row."""
    plain = lambda t: F.exp(-t["nll"])
    contrasted = plain if contrast == 1.0 else lambda t: F.pow(plain(t), F.lit(float(contrast)))
    is_shown = lambda t: ~t["tok"].isin(SKIP_TOKENS)
    g = g.withColumn("shown", F.filter("tokens", is_shown))
    n, total = F.size("shown"), F.aggregate(F.transform("shown", plain), F.lit(0.0), lambda a, x: a + x)
    if include_padding is not None:
        rest = F.greatest(F.lit(include_padding) - n, F.lit(0))
        mean = (total + rest) / (n + rest)
    else:
        mean = F.when(n > 0, total / n)
    if gradient:
        def pieces(fmt: str) -> Column:
            return F.sort_array(F.transform("shown", lambda t: F.struct(t["pos"].alias("pos"), gradient_piece(fmt, t["tok"], contrasted(t)).alias("piece"))))["piece"]
    else:
        # limits are taken over the plain probabilities of all tokens, colours by the contrasted ones
        g = g.withColumn("ordered", F.sort_array(F.transform("tokens", plain))) \
            .withColumn("limits", F.array(*[_order_statistic(F.col("ordered"), q) for q in PERCENTILES]))
        level = lambda p: F.when(p < F.col("limits")[0], 0).when(p < F.col("limits")[1], 1).when(p < F.col("limits")[2], 2).otherwise(3)
        g = g.withColumn("levels", F.sort_array(F.transform("shown", lambda t: F.struct(
            t["pos"].alias("pos"), t["tok"].alias("tok"), contrasted(t).alias("prob"), level(contrasted(t)).alias("level")))))

        def pieces(fmt: str) -> Column:
            return F.transform("levels", lambda t: percentile_piece(fmt, t["tok"], t["level"]))
    marked = [F.struct(F.lit(f).alias("fmt"), _wrap(f, F.array_join(pieces(f), "")).alias("explained")) for f in fmts]
    if len(marked) == 1:
        return g.select(*keys, mean.alias("mean_prob"), marked[0]["fmt"].alias("fmt"), marked[0]["explained"].alias("explained"))
    return g.withColumn("mean_prob", mean).select(*keys, "mean_prob", F.inline(F.array(*marked)))


def explain_requests(model: lm.CountModel, df: DataFrame, fmts: tuple[str, ...] = ("terminal",), contrast: float = 1.0, gradient: bool = True,
                     kind: str = "causal", max_tokens: int | None = None) -> DataFrame:
    """F9 on requests: what :func:`explain_tokens` makes of :func:`request_tokens`, ``(original_index, fmt,
    mean_prob, explained)``. Probabilities, gradient pieces and escaped texts are computed once per
    distinct token type and looked up; order statistics and joined pieces are array operations
    on a batch of texts. Only texts are gathered by index."""
    nll = F.when(F.col("prev") == lm.CLS, F.lit(0.0)).otherwise(F.col("nll")) if kind == "causal" else F.col("nll")
    plain = F.exp(-nll)
    contrasted = plain if contrast == 1.0 else F.pow(plain, F.lit(float(contrast)))
    values = {"prob": plain}
    if not gradient and contrast != 1.0:
        values["contrasted"] = contrasted
    for fmt in fmts:
        values[fmt] = gradient_piece(fmt, F.col("tok"), contrasted) if gradient else _escaped(fmt, F.col("tok"))

    def finish(b, row, pos, tok, found: dict) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        size = np.bincount(row, minlength=len(b))
        own = np.flatnonzero(size)
        prob = found["prob"].to_numpy(zero_copy_only=False)
        level = None
        if not gradient:
            level = _levels(row, size, prob, found["contrasted"].to_numpy(zero_copy_only=False) if "contrasted" in found else prob)
        skipped = pc.is_in(tok, value_set=pa.array(SKIP_TOKENS, tok.type)).to_numpy(zero_copy_only=False)
        if skipped.any():
            shown = np.flatnonzero(~skipped)
            row, pos, prob, tok = row[shown], pos[shown], prob[shown], tok.take(pa.array(shown))
            level, found = level if gradient else level[shown], {c: v.take(pa.array(shown)) for c, v in found.items()}
        n, total = np.bincount(row, minlength=len(b))[own], np.bincount(row, prob, minlength=len(b))[own]
        mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
        ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
        several = bool(np.any((row[1:] == row[:-1]) & (pos[1:] <= pos[:-1])))  # texts that share an index
        for fmt in fmts:
            pieces = found[fmt]
            if not gradient:
                before, after = (pa.array(x).take(pa.array(level)) for x in zip(*percentile_marks(fmt)))
                pieces = pc.binary_join_element_wise(before, pieces, after, "")
            if several:  # their tokens stand by position
                ties = {"piece": pieces} if gradient else {"tok": tok, "prob": found.get("contrasted", found["prob"])}
                order = pc.sort_indices(pa.table({"row": row, "pos": pos, **ties}), sort_keys=[(k, "ascending") for k in ("row", "pos", *ties)])
                pieces = pieces.take(order)
            body = pc.binary_join(pa.ListArray.from_arrays(ends, pieces), "")
            before, after = _frame(fmt)
            text = pc.replace_substring(pc.binary_join_element_wise(before, body, after, ""), BYTE_SPACE, " ")
            yield pa.RecordBatch.from_arrays([b.column("original_index").take(pa.array(own)), pa.array([fmt] * len(own), pa.string()), mean, text],
                                             names=["original_index", "fmt", "mean_prob", "explained"])

    return lm.looked_up(lm.marked_texts(df, max_tokens, by_index=True), df, model, {"nll": kind}, finish,
                        "fmt string, mean_prob double, explained string", values, max_tokens)


def _levels(row, size, prob, contrasted):
    """Of each token the first of its row's limits (``PERCENTILES`` of ``prob``) that is above
    ``contrasted``, 3 if none is; limits as by :func:`_order_statistic`."""
    import numpy as np

    ordered = prob[np.lexsort((prob, row))]
    first = np.cumsum(size) - size
    some = np.flatnonzero(size)
    level = np.full(len(row), 3, np.int8)
    for i in range(len(PERCENTILES) - 1, -1, -1):
        at = (size[some] - 1) * PERCENTILES[i]
        down = np.floor(at)
        low, high = ordered[first[some] + down.astype(np.int64)], ordered[first[some] + np.ceil(at).astype(np.int64)]
        limit = np.zeros(len(size))
        limit[some] = low + (high - low) * (at - down)
        level[contrasted < limit[row]] = i
    return level


def percentile_colours(token_rows: DataFrame) -> DataFrame:
    """per request the 2/6/14 % percentiles of the token probabilities;
    a token takes the colour of the first limit above its probability
    (terminal/latex: red, orange, yellow, none; html adds black)."""
    return percentile_colours_of(token_rows.groupBy("original_index").agg(F.collect_list(F.struct("pos", "tok", "nll")).alias("tokens")))


def percentile_colours_of(g: DataFrame) -> DataFrame:
    """F6 on gathered tokens (``tokens``: an array of ``(pos, tok, nll)``)."""
    prob = F.transform("tokens", lambda t: F.struct(t["pos"].alias("pos"), t["tok"].alias("tok"), F.exp(-t["nll"]).alias("prob")))
    g = g.select("original_index", prob.alias("tokens")).withColumn("ordered", F.sort_array(F.col("tokens.prob")))
    limits = F.array(*[_order_statistic(F.col("ordered"), q) for q in PERCENTILES])
    j = g.withColumn("lim", limits).select("original_index", "lim", F.inline("tokens"))
    p, l0, l1, l2 = F.col("prob"), F.col("lim")[0], F.col("lim")[1], F.col("lim")[2]
    colour = F.when(p < l0, PERCENTILE_COLOURS[0]).when(p < l1, PERCENTILE_COLOURS[1]) \
        .when(p < l2, PERCENTILE_COLOURS[2])
    return j.select("original_index", "pos", "tok", "prob", colour.alias("colour"))


def explain_dataset(model: lm.CountModel, requests: DataFrame, scored: DataFrame, entries: DataFrame, fmt: str = "terminal",
                    gradient: bool = True, max_tokens: int | None = None) -> DataFrame:
    """``(original_index, model, is_fn, is_fp, mean_prob, explained)`` of the requests
    by both models. The flags say whether a request is among the false negatives or
    positives of its model's evaluation entry: ``entries`` holds (model, threshold_offset), ``scored``
    the evaluated rows (original_index, model, loss, anomalous). Both models' losses come from one pass."""
    from reqlens.operators.evaluate import classify, clean_score, is_normal
    flagged = scored.join(F.broadcast(entries.select("model", "threshold_offset")), "model")  # one entry a model
    hit = classify(clean_score("loss"), F.col("threshold_offset"))
    wrong = flagged.filter(hit == is_normal()).select("original_index", "model", F.lit(True).alias("wrong"), hit.alias("hit"))
    found = lm.request_losses(lm.marked_texts(requests, max_tokens, by_index=True), requests, model, {"causal": "causal", "masked": "masked"}, max_tokens)
    causal = F.transform("tokens", lambda t: F.struct(t["pos"].alias("pos"), t["tok"].alias("tok"), _first_without_context(t["pos"], t["causal"]).alias("nll")))
    masked = F.transform("tokens", lambda t: F.struct(t["pos"].alias("pos"), t["tok"].alias("tok"), t["masked"].alias("nll")))
    keys = ("original_index", "model")
    both = found.select("original_index", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), t.alias("tokens")) for m, t in (("causal", causal), ("masked", masked))])))
    asked = requests.select("original_index", F.explode(F.array(F.lit("causal"), F.lit("masked"))).alias("model"))
    out = asked.join(explain_tokens(both, (fmt,), gradient=gradient, keys=keys).drop("fmt"), list(keys), "left") \
        .withColumn("explained", F.coalesce("explained", _wrap(fmt, F.lit(""))))
    return out.join(wrong, ["original_index", "model"], "left").select(
        "original_index", "model", F.coalesce(F.col("wrong") & ~F.col("hit"), F.lit(False)).alias("is_fn"),
        F.coalesce(F.col("wrong") & F.col("hit"), F.lit(False)).alias("is_fp"), "mean_prob", "explained")
