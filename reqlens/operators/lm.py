"""Count-based language models fitted and scored wholly in Spark (M1-M3, M7,
A3, A18, J7).

Model (smoothed n-gram counts; additive and Jelinek-Mercer smoothing):

* ``p1(t) = (c(t) + alpha) / (N + alpha * (V + 1))`` (the +1 is the unknown token)
* causal ``p(t|a) = lam * c(a,t)/c(a) + (1-lam) * p1(t)``, or ``p1(t)`` when ``c(a) = 0``
* masked ``p(t|a,b) = lam * c(a,t,b)/c(a,b) + (1-lam) * p(t|a)``, or ``p(t|a)``
  when ``c(a,b) = 0``; with stride 1 every neighbour is masked too: ``p1``.

Fitting is three ``groupBy`` counts over the long token table (map-side
partial counts, so a hot token costs one row per task before the shuffle).
Scoring joins the distinct token types (token and neighbours) of the scored
requests to the count tables; the losses of frequent types are looked up in place, those of
the others come by a join (:func:`request_losses`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.operators import lookup
from reqlens.operators.tokens import CLS, SEP, tokenize, token_rows, tokens

ALPHA = 1.0
LAMBDA = 0.7
CAUSAL_EPS = 1e-9
#: losses are multiples of 1 / GRAIN: sums below 2**53 / GRAIN are exact, whatever their order
GRAIN = float(1 << 38)
#: types held by more than one in so many token rows go to every task
HOT_SHARE = 400_000


@dataclass
class CountModel:
    """Count tables of a fitted model (each a DataFrame; K8 writes them)."""
    unigram: DataFrame     # tok, c
    bigram: DataFrame      # prev, tok, c
    context: DataFrame     # prev, tok, nxt, c

    def write(self, path: str, mode: str = "overwrite") -> None:
        for name in ("unigram", "bigram", "context"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @staticmethod
    def of_context(ctx: DataFrame) -> "CountModel":
        """The model of a context table: the other tables are its sums."""
        bi = ctx.groupBy("prev", "tok").agg(F.sum("c").alias("c"))
        return CountModel(ctx.groupBy("tok").agg(F.sum("c").alias("c")), bi, ctx)

    @staticmethod
    def read(spark, path: str) -> "CountModel":
        return CountModel(*(spark.read.parquet(f"{path}/{n}") for n in ("unigram", "bigram", "context")))


def long_tokens(df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """Tokenise (T3) and explode to one row per token with its neighbours."""
    t = tokenize(df.select("original_index", "request"), max_tokens=max_tokens)
    return token_rows(t).filter(F.col("tok").isNotNull())


def fit(train: DataFrame, max_tokens: int | None = None) -> CountModel:
    """M1: count tables from the training requests (normals in the pipeline)."""
    rows = long_tokens(train, max_tokens)
    # One pass over the long token table: every occurrence is counted once in
    # the context table, so the bigram and unigram tables are exact sums of
    # it (aggregates of a table far smaller than the token stream).
    return CountModel.of_context(rows.groupBy("prev", "tok", "nxt").agg(F.count(F.lit(1)).alias("c")))


def finetune(base: CountModel, new: DataFrame, base_weight: float = 1.0,
             max_tokens: int | None = None) -> CountModel:
    """M7: fine-tune = base counts (weighted) plus counts of the new data,
    summed per key (``unionByName`` + ``groupBy``)."""
    add = fit(new, max_tokens)

    def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        return a.withColumn("c", F.col("c") * F.lit(float(base_weight))) \
            .unionByName(b.withColumn("c", F.col("c").cast("double"))) \
            .groupBy(*keys).agg(F.sum("c").alias("c"))

    return CountModel(merge(base.unigram, add.unigram, ["tok"]),
                      merge(base.bigram, add.bigram, ["prev", "tok"]),
                      merge(base.context, add.context, ["prev", "tok", "nxt"]))


def _p1(model: CountModel, c_t: Column) -> Column:
    n = model.unigram.select(F.sum("c").cast("double")).scalar()
    v = model.unigram.select(F.count(F.lit(1)).cast("double")).scalar()
    return (F.coalesce(c_t, F.lit(0)).cast("double") + ALPHA) / (n + ALPHA * (v + 1))


def _with_bigram(types: DataFrame, model: CountModel) -> DataFrame:
    ctx_tot = model.bigram.groupBy("prev").agg(F.sum("c").alias("c_a"))
    types = types.join(model.unigram.withColumnRenamed("c", "c_t"), "tok", "left") \
        .join(model.bigram.withColumnRenamed("c", "c_at"), ["prev", "tok"], "left") \
        .join(ctx_tot, "prev", "left")
    p1 = _p1(model, F.col("c_t"))
    types = types.withColumn("p1", p1)
    return types.withColumn("p_bi", F.when(F.coalesce(F.col("c_a"), F.lit(0)) > 0,
                                           F.lit(LAMBDA) * F.coalesce(F.col("c_at"), F.lit(0)).cast("double") / F.col("c_a")
                                           + F.lit(1 - LAMBDA) * F.col("p1"))
                            .otherwise(F.col("p1")))


def _causal_loss(types: DataFrame, model: CountModel) -> DataFrame:
    return _with_bigram(types, model).withColumn("nll", -F.log("p_bi"))


def _masked_loss(types: DataFrame, model: CountModel) -> DataFrame:
    pair_tot = model.context.groupBy("prev", "nxt").agg(F.sum("c").alias("c_ab"))
    types = _with_bigram(types, model) \
        .join(model.context.withColumnRenamed("c", "c_atb"), ["prev", "tok", "nxt"], "left") \
        .join(pair_tot, ["prev", "nxt"], "left")
    p = F.when(F.coalesce(F.col("c_ab"), F.lit(0)) > 0,
               F.lit(LAMBDA) * F.coalesce(F.col("c_atb"), F.lit(0)).cast("double") / F.col("c_ab")
               + F.lit(1 - LAMBDA) * F.col("p_bi")).otherwise(F.col("p_bi"))
    return types.withColumn("nll", -F.log(p))


def _unmasked_loss(types: DataFrame, model: CountModel) -> DataFrame:
    return types.join(model.unigram.withColumnRenamed("c", "c_t"), "tok", "left") \
        .withColumn("nll", -F.log(_p1(model, F.col("c_t"))))


#: what a token's loss depends on, and how it is computed for distinct values of that
LOSSES = {"causal": (["prev", "tok"], _causal_loss), "masked": (["prev", "tok", "nxt"], _masked_loss), "alone": (["tok"], _unmasked_loss)}


def marked_texts(df: DataFrame, max_tokens: int | None = None, by_index: bool = False) -> DataFrame:
    """``(original_index, partner, words)``: the tokens of each text between the sentinels,
    joined by spaces (no token holds one). With ``by_index`` one row for each index,
    the texts that share it one after another."""
    rows = df.select("original_index", F.coalesce(F.col("original_index").cast("string"), F.lit("")).alias("partner"),
                     F.coalesce("request", F.lit("")).alias("request"))
    if not by_index:
        return rows.select("original_index", "partner", _words_of(F.col("request"), max_tokens).alias("words"))
    return rows.groupBy("partner").agg(F.first("original_index").alias("original_index"), F.collect_list("request").alias("texts")) \
        .select("original_index", "partner", F.array_join(F.transform("texts", lambda t: _words_of(t, max_tokens)), " ").alias("words"))


def _words_of(text: Column, max_tokens: int | None) -> Column:
    return F.array_join(F.concat(F.array(F.lit(CLS)), tokens(text, max_tokens), F.array(F.lit(SEP))), " ")


def _located(words, keys: list[str]) -> tuple:
    """Of marked texts the tokens' rows, positions, texts and types (``keys`` joined by spaces)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(words, " ")
    flat = lists.flatten()
    begins = pc.equal(flat, CLS).to_numpy(zero_copy_only=False)
    real = np.flatnonzero(~(begins | pc.equal(flat, SEP).to_numpy(zero_copy_only=False)))
    first = np.maximum.accumulate(np.where(begins, np.arange(len(flat)), 0)) if len(flat) else real
    row = np.repeat(np.arange(len(words)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[real]
    at = {"prev": real - 1, "tok": real, "nxt": real + 1}
    column = {k: flat.take(pa.array(at[k])) for k in {"tok", *keys}}
    kind = column["tok"] if keys == ["tok"] else pc.binary_join_element_wise(*[column[k] for k in keys], " ")
    return row, (real - first[real]).astype(np.int32), column["tok"], kind


def request_losses(texts: DataFrame, df: DataFrame, model: CountModel, losses: dict[str, str], max_tokens: int | None = None,
                   digits: int | None = None) -> DataFrame:
    """``(original_index, tokens)`` of marked texts of the requests ``df``; a token
    has ``pos``, ``tok`` and a loss (rounded to ``digits``, if given) for each (column, kind of ``LOSSES``)."""
    names = list(losses)

    def finish(b, row, pos, tok, found: dict) -> Iterator:
        import numpy as np
        import pyarrow as pa
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(b)))]).astype(np.int32)
        token = pa.StructArray.from_arrays([pa.array(pos), tok.cast(pa.string()), *(found[c] for c in names)], names=["pos", "tok", *names])
        yield pa.RecordBatch.from_arrays([b.column("original_index"), pa.ListArray.from_arrays(pa.array(ends), token)],
                                         names=["original_index", "tokens"])

    return looked_up(texts, df, model, losses, finish, f"tokens array<struct<pos:int,tok:string,{','.join(f'{c}:double' for c in names)}>>",
                     max_tokens=max_tokens, digits=digits)


def looked_up(texts: DataFrame, df: DataFrame, model: CountModel, losses: dict[str, str], finish: Callable, schema: str,
              values: dict[str, Column] | None = None, max_tokens: int | None = None, digits: int | None = None) -> DataFrame:
    """What ``finish`` makes of the tokens of marked texts of the requests ``df``: ``original_index``
    and ``schema``. It gets a batch of texts, and of their tokens the rows, positions, texts and a dict of
    Arrow arrays: the losses, or the ``values`` computed from ``tok``, its neighbours and the losses.

    All these depend on a token and its neighbours alone, so they are computed once per
    distinct type: the count tables meet the types, which are stored (a reliable checkpoint).
    The types that make up more than one in ``HOT_SHARE`` token rows (there are fewer than
    ``HOT_SHARE`` of those) go to every task, which looks its tokens up. Only the other
    tokens are shuffled: their types come by a join, and meet the texts by their ``partner``, the index as text."""
    keys = max((LOSSES[k][0] for k in losses.values()), key=len)
    types = long_tokens(df, max_tokens).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    scored = types
    for name, kind in losses.items():
        scored = LOSSES[kind][1](scored.select(*keys, "n", *[c for c in losses if c in scored.columns]), model).withColumnRenamed("nll", name)
    exact = {c: F.rint(F.col(c) * GRAIN) / GRAIN for c in losses}
    scored = scored.withColumns({c: x if digits is None else F.round(x, digits) for c, x in exact.items()})
    values = values or {c: F.col(c) for c in losses}
    names = list(values)
    scored = scored.select(F.concat_ws(" ", *keys).alias("type"), "n", *[x.alias(c) for c, x in values.items()]).checkpoint(eager=True)
    total = scored.select(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    frequent = scored.filter(hot).select("type", *names).toArrow().combine_chunks()  # fewer than HOT_SHARE rows
    seldom = scored.filter(~hot).select("type", *names)

    def missing(batches: Iterator) -> Iterator:
        known = lookup.whole(frequent.column("type"))
        for batch in batches:
            for b in lookup.parts(batch):
                row, _, _, kind = _located(b.column("words"), keys)
                yield from lookup.missing(b.column("partner"), row, kind, known, "type")

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa
        known = lookup.whole(frequent.column("type"))
        hot_values = [lookup.whole(frequent.column(c)) for c in names]
        for batch in batches:
            for b in lookup.parts(batch):
                row, pos, tok, kind = _located(b.column("words"), keys)
                at, own = lookup.places(row, kind, known, b.column("rare") if "rare" in b.schema.names else None, "type")
                at = pa.array(at)
                found = {c: (v if own is None else pa.concat_arrays([v, own.field(c).cast(v.type)])).take(at) for c, v in zip(names, hot_values)}
                yield from finish(b, row, pos, tok, found)

    if not seldom.isEmpty():
        # by text, not by index: the texts aren't gathered for that
        needed = marked_texts(df, max_tokens).select("partner", "words").mapInArrow(missing, "partner string, type string")
        rare = needed.join(seldom, "type").groupBy("partner").agg(F.collect_set(F.struct("type", *names)).alias("rare"))
        texts = texts.join(rare, "partner", "left")
    index = texts.schema["original_index"].dataType.simpleString()
    return texts.mapInArrow(fill, f"original_index {index}, {schema}")


def with_losses(df: DataFrame, model: CountModel, losses: dict[str, str], max_tokens: int | None = None) -> DataFrame:
    """``(original_index, pos, tok)`` of every token and the losses (:func:`request_losses`)."""
    return request_losses(marked_texts(df, max_tokens), df, model, losses, max_tokens).select("original_index", F.inline("tokens"))


def causal_token_nll(model: CountModel, df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """J7 + F4 for the causal model: ``(original_index, pos, tok, nll)`` for
    real tokens 2..n (the first token has no left context; D12)."""
    return with_losses(df, model, {"nll": "causal"}, max_tokens).filter(F.col("pos") >= 2)


def masked_token_nll(model: CountModel, df: DataFrame, stride: int = 5, max_tokens: int | None = None) -> DataFrame:
    """J7 + F4 for the masked model: ``(original_index, pos, tok, nll)`` for
    every real token, the sentinels serving as context; with stride 1 the context is masked, too."""
    return with_losses(df, model, {"nll": "alone" if stride == 1 else "masked"}, max_tokens)


def sample_loss_causal(df: DataFrame, token_nll: DataFrame) -> DataFrame:
    """A18 causal: ``loss = sum(nll) / (count + 1e-9)``, ``perplexity = exp(loss)``;
    every request of ``df`` gets a row (no scored token: loss 0)."""
    agg = token_nll.groupBy("original_index").agg(F.sum("nll").alias("s"), F.count("nll").alias("n"))
    return df.select("original_index").join(agg, "original_index", "left").select(
        "original_index",
        (F.coalesce(F.col("s"), F.lit(0.0)) / (F.coalesce(F.col("n"), F.lit(0)) + F.lit(CAUSAL_EPS))).alias("loss"),
    ).withColumn("perplexity", F.exp("loss"))


def pass_losses(df: DataFrame, token_nll: DataFrame, stride: int = 5) -> DataFrame:
    """J6 + A18 masked: one row per (request, shift); the pass masks the
    tokens at positions ``pos % stride == shift``; its loss is their mean nll,
    0 when it masks nothing (D11)."""
    per = token_nll.groupBy("original_index", (F.col("pos") % stride).alias("shift_index")) \
        .agg(F.sum("nll").alias("s"), F.count("nll").alias("n"))
    passes = df.select("original_index").withColumn(
        "shift_index", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))))
    j = passes.join(per, ["original_index", "shift_index"], "left")
    loss = F.when(F.coalesce(F.col("n"), F.lit(0)) > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    return j.select("original_index", "shift_index", loss.alias("loss"), F.exp(loss).alias("perplexity"))


def stride_mean(passes: DataFrame) -> DataFrame:
    """A3: mean loss and mean perplexity over the passes of each request."""
    return passes.groupBy("original_index").agg(F.avg("loss").alias("loss"),
                                                 F.avg("perplexity").alias("perplexity"))


def score_all(model: CountModel, df: DataFrame, kinds: tuple[str, ...] = ("causal", "masked"), stride: int = 5,
              max_tokens: int | None = None) -> DataFrame:
    """M2 and M3 in one pass: ``(original_index, model, loss, perplexity)``. The
    requests are tokenised once and their tokens meet the types' losses of all models in one join."""
    losses = {k: "alone" if k == "masked" and stride == 1 else k for k in kinds}
    rows = with_losses(df, model, losses, max_tokens)
    per = rows.groupBy("original_index").agg(
        *([F.sum(F.when(F.col("pos") >= 2, F.col("causal"))).alias("s"), F.count_if(F.col("pos") >= 2).alias("n")] if "causal" in kinds else []),
        *[x for i in range(stride if "masked" in kinds else 0)
          for x in (F.sum(F.when(F.col("pos") % stride == i, F.col("masked"))).alias(f"s{i}"), F.count_if(F.col("pos") % stride == i).alias(f"n{i}"))])
    j = df.select("original_index").join(per, "original_index", "left")
    scores = []
    if "causal" in kinds:
        loss = F.coalesce("s", F.lit(0.0)) / (F.coalesce("n", F.lit(0)) + F.lit(CAUSAL_EPS))
        scores.append(F.struct(F.lit("causal").alias("model"), loss.alias("loss"), F.exp(loss).alias("perplexity")))
    if "masked" in kinds:  # a pass without a masked token counts as loss 0 (D11)
        passes = [F.when(F.coalesce(f"n{i}", F.lit(0)) > 0, F.col(f"s{i}") / F.col(f"n{i}")).otherwise(F.lit(0.0)) for i in range(stride)]
        scores.append(F.struct(F.lit("masked").alias("model"), (sum(passes[1:], passes[0]) / stride).alias("loss"),
                               (sum([F.exp(p) for p in passes[1:]], F.exp(passes[0])) / stride).alias("perplexity")))
    return j.select("original_index", F.explode(F.array(*scores)).alias("x")).select("original_index", "x.*")


def score_causal(model: CountModel, df: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """M3: ``(original_index, loss, perplexity)`` for every request."""
    return score_all(model, df, ("causal",), max_tokens=max_tokens).drop("model")


def score_masked_strided(model: CountModel, df: DataFrame, stride: int = 5, max_tokens: int | None = None) -> DataFrame:
    """M2: strided pseudo-log-likelihood: per-pass mean nll, then the mean
    over passes of loss and of perplexity."""
    return score_all(model, df, ("masked",), stride, max_tokens).drop("model")


__all__ = ["CountModel", "fit", "finetune", "score_causal", "score_masked_strided", "causal_token_nll",
           "masked_token_nll", "sample_loss_causal", "pass_losses", "stride_mean", "long_tokens", "score_all", "with_losses", "CLS"]
