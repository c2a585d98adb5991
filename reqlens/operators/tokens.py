"""Token-level dataflow.

Requests are split by a regex into word and symbol tokens, truncated only where
a model window is asked for (``max_tokens`` including the two sentinels), and handled either
as arrays (one row per request; higher-order functions, no shuffle) or in long
form (one row per token, with its left and right neighbour zipped in from
shifted array slices, so no window or self-join is needed).
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
TOKEN_PATTERN = r"[A-Za-z0-9]+|[^A-Za-z0-9\s]"
PAD, UNK, CLS, SEP, MASK = "[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"
SPECIAL_TOKENS = [PAD, UNK, CLS, SEP, MASK]          # ids 0..4
MAX_TOKENS = 512
IGNORE_LABEL = -100
_ALNUM = string.ascii_letters + string.digits
# TOKEN_PATTERN for Java, which looks single characters up in a table but tries ranges one by one.
SPELLED_PATTERN = rf"[{_ALNUM}]+|[^{_ALNUM} \t\n\x0B\f\r]"
# -----------------------------------------------------------------------------


def all_tokens(col: str | Column = "request") -> Column:
    """Every token of the whole text."""
    return F.regexp_extract_all(F.col(col) if isinstance(col, str) else col, F.lit(SPELLED_PATTERN), 0)


def tokens(col: str | Column = "request", max_tokens: int | None = None) -> Column:
    """Tokens of the whole text; with ``max_tokens``, truncated to a model
    window that has room for the two sentinels."""
    return all_tokens(col) if max_tokens is None else F.slice(all_tokens(col), 1, max_tokens - 2)


def tokenize(df: DataFrame, col: str = "request", max_tokens: int | None = None) -> DataFrame:
    """``tokens`` (truncated only if ``max_tokens`` is given) and ``n_total``
    (count over the whole text)."""
    return df.withColumn("n_total", F.size(all_tokens(col))).withColumn("tokens", tokens(col, max_tokens))


def between_sentinels(tok_col: str = "tokens") -> Column:
    """``[CLS] tokens [SEP]``."""
    return F.concat(F.array(F.lit(CLS)), F.col(tok_col), F.array(F.lit(SEP)))


def pad(seq: Column, max_tokens: int = MAX_TOKENS, like: Column | None = None) -> Column:
    """The sequence, padded with ``[PAD]`` to at least ``max_tokens``. A stored array of its
    length, ``like``, saves working the sequence out for its length, too."""
    return F.concat(seq, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_tokens) - F.size(seq if like is None else like), F.lit(0))))


def padded(tok_col: str = "tokens", max_tokens: int = MAX_TOKENS) -> Column:
    """``[CLS] tokens [SEP]``, padded with ``[PAD]`` to at least ``max_tokens``."""
    return pad(between_sentinels(tok_col), max_tokens)


def special_mask(seq: Column) -> Column:
    """T4: 1 where the token is a special token."""
    specials = F.array(*[F.lit(s) for s in SPECIAL_TOKENS])
    return F.transform(seq, lambda x: F.array_contains(specials, x).cast("int"))


def attention_mask(seq: Column) -> Column:
    """T4: 1 for every position that is not padding."""
    return F.transform(seq, lambda x: (x != F.lit(PAD)).cast("int"))


def token_count(mask: Column) -> Column:
    """T5: attended positions."""
    return F.size(F.filter(mask, lambda x: x == 1))


def stride_expand(df: DataFrame, stride: int = 5) -> DataFrame:
    """One row per (request, shift) for ``shift`` in ``0..stride-1``."""
    return df.withColumn("shift_index", F.explode(F.sequence(F.lit(0), F.lit(stride - 1))))


def mask_passes(seq: Column, stride: int) -> Column:
    """The pass that masks each position, ``i % stride``; -1 where none does (special tokens).
    Stored once a request, it saves every pass the tests of :func:`stride_mask`."""
    return F.transform(seq, lambda x, i: F.when(~x.isin(SPECIAL_TOKENS), i % stride).otherwise(F.lit(-1)))


def stride_mask(seq: Column, stride: int, shift: Column, passes: Column | None = None) -> tuple[Column, Column]:
    """Pass ``shift`` masks the non-special positions ``i`` with
    ``i % stride == shift``. Returns (masked tokens, 0/1 flags of the masked
    positions); :func:`stride_ids` gives ids and labels. ``passes``: the stored
    :func:`mask_passes` of the sequence."""
    hit = lambda x, i: ((i % stride) == shift) & ~x.isin(SPECIAL_TOKENS)
    if passes is None:
        masked = F.transform(seq, lambda x, i: F.when(hit(x, i), F.lit(MASK)).otherwise(x))
    else:
        masked = F.zip_with(seq, passes, lambda x, p: F.call_function("if", p == shift, F.lit(MASK), x))
    flags = F.transform(seq, lambda x, i: hit(x, i).cast("int"))
    return masked, flags


def masked_count(seq: Column, masked: Column, passes: Column | None = None, shift: Column | None = None) -> Column:
    """How many positions of the sequence a pass has masked; from the stored
    :func:`mask_passes`, if given with the pass."""
    if passes is not None:
        return F.size(passes) - F.size(F.array_remove(passes, shift))
    return F.size(F.array_remove(seq, MASK)) - F.size(F.array_remove(masked, MASK))


def stride_ids(ids: Column, stride: int, shift: Column, mask_id: int = SPECIAL_TOKENS.index(MASK),
               n_special: int = len(SPECIAL_TOKENS), first: int = 1) -> tuple[Column, Column]:
    """T6 on ids, whose special tokens are 0 to ``n_special - 1``: (masked ids,
    labels). Labels keep the id at masked positions and are -100 elsewhere; the
    array's first element is at position ``first``."""
    def hit(x: Column, i: Column) -> Column:
        return ((i + first) % stride == shift) & (x >= n_special)
    return (F.transform(ids, lambda x, i: F.when(hit(x, i), F.lit(mask_id)).otherwise(x)),
            F.transform(ids, lambda x, i: F.when(hit(x, i), x).otherwise(F.lit(IGNORE_LABEL))))


def causal_labels(ids: Column, pad_id: int = 0) -> Column:
    """Labels are the ids, with padding replaced by -100."""
    return F.transform(ids, lambda x: F.when(x == pad_id, F.lit(IGNORE_LABEL)).otherwise(x))


def uniform01(seed: int, key: Column, pos: Column) -> Column:
    """Deterministic uniform in [0, 1) from md5(seed|key|pos) (first 8 hex)."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), pos.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def random_mask(seq: Column, key: Column, probability: float = 0.30, seed: int = 42) -> Column:
    """MLM training mask: each non-special token is replaced by the mask
    token with ``probability`` (always the mask token, never a random one),
    decided by a seeded hash of (request, position) so reruns agree."""
    specials = F.array(*[F.lit(s) for s in SPECIAL_TOKENS])
    return F.transform(seq, lambda x, i: F.when(
        ~F.array_contains(specials, x) & (uniform01(seed, key, i) < F.lit(probability)), F.lit(MASK)
    ).otherwise(x))


def neighbours(tok_col: str = "tokens") -> Column:
    """W4 without a shuffle: zip each token with its left and right neighbour
    (sentinels at the ends) from shifted slices of the same array."""
    t = F.col(tok_col)
    n = F.size(t)
    left = F.concat(F.array(F.lit(CLS)), F.slice(t, 1, F.greatest(n - 1, F.lit(0))))
    right = F.concat(F.when(n > 1, F.slice(t, 2, F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<string>")),
                     F.array(F.lit(SEP)))
    return F.arrays_zip(t.alias("tok"), left.alias("prev"), right.alias("nxt"))


def token_rows(df: DataFrame, tok_col: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """Long form: ``(original_index, pos, tok, prev, nxt)``; ``pos`` counts
    from 1 (the ``[CLS]`` sentinel is position 0)."""
    keep = keep or ["original_index"]
    z = df.select(*keep, F.posexplode(neighbours(tok_col)).alias("p", "z"))
    return z.select(*keep, (F.col("p") + 1).alias("pos"), F.col("z.tok").alias("tok"),
                    F.col("z.prev").alias("prev"), F.col("z.nxt").alias("nxt"))


def causal_align(losses: Column) -> Column:
    """Left-pad per-token losses so the first token has loss 0."""
    return F.concat(F.array(F.lit(0.0)), losses)
