"""Subword vocabulary learning (T1), fixed tokens (T2) and encoding with the
learned merges (T3), byte-pair style.

Learning. The corpus is reduced to its distinct words with counts. A word's
symbols are kept as one text in which every symbol stands between two marks, so
merging a pair is one linear ``replace``, from the left and without overlap. Each round:

1. the pairs of every word are summed, weighted by the word's count (map-side
   partial sums, one shuffle);
2. the best pair (count desc, pair asc) is taken, and those after it that one
   merge at a time would pick next (:func:`_next_merges`); the merge list is the
   model, not data;
3. the words are rewritten (the pairs of a round share no symbol, so their order
   does not matter).

The word table is stored once after the corpus pass and checkpointed every
``checkpoint_every`` rounds to cut the lineage. Deterministic for a given corpus.

Encoding. A merge can touch a word only if its token is a substring of it, so
distinct words meet the merge table on their substrings (no longer than the
longest token), and a word contracts its few merges in rank order: a pair can
only appear after the merges that make its symbols, so that is the same as
always merging the best pair. Ids come from a join of the distinct pieces with the
vocabulary; frequent words are looked up in place, the others come to their texts by a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.operators import lookup
from reqlens.operators.tokens import SPECIAL_TOKENS, TOKEN_PATTERN, UNK

#: around each symbol; neither can be part of a word
OPEN, CLOSE = "\u0001", "\u0002"
#: words held by more than one in so many token rows go to every task
HOT_SHARE = 400_000


def fixed_pattern(fixed_tokens: list[str]) -> str:
    """The splitter that keeps fixed tokens whole, longest first."""
    whole = sorted({t for t in fixed_tokens if t}, key=lambda t: (-len(t), t))
    return "|".join([*(re.sub(r"([^A-Za-z0-9])", r"\\\1", t) for t in whole), TOKEN_PATTERN])


def wrapped(word: Column) -> Column:
    """The word's characters, each between the marks."""
    return F.regexp_replace(word, "(?s)(.)", f"{OPEN}$1{CLOSE}")


def merged(symbols: Column, left: Column, right: Column) -> Column:
    """The symbols with all occurrences of the pair joined."""
    pair = F.concat(F.lit(OPEN), left, F.lit(CLOSE + OPEN), right, F.lit(CLOSE))
    return F.replace(symbols, pair, F.concat(F.lit(OPEN), left, right, F.lit(CLOSE)))


def pieces(symbols: Column) -> Column:
    """The symbols as an array."""
    inner = F.substring(symbols, F.lit(2), F.length(symbols) - 2)
    return F.when(F.length(symbols) > 0, F.split(inner, CLOSE + OPEN, -1)).otherwise(F.array().cast("array<string>"))


def word_counts(df: DataFrame, col: str = "request") -> DataFrame:
    """Distinct words of the whole texts with their counts and symbols."""
    words = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(TOKEN_PATTERN), 0)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).withColumn("symbols", wrapped(F.col("word")))


def pair_counts(words: DataFrame) -> DataFrame:
    """The pair table ``(left, right, freq)`` of the words' symbols."""
    s = words.select("freq", pieces(F.col("symbols")).alias("s")).filter(F.size("s") > 1)
    pairs = F.arrays_zip(F.slice("s", 1, F.size("s") - 1).alias("l"), F.slice("s", 2, F.size("s") - 1).alias("r"))
    return s.select("freq", F.explode(pairs).alias("p")) \
        .groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("freq").alias("freq"))


def _next_merges(pairs: DataFrame, k: int) -> list[tuple[str, str, int]]:
    """The longest prefix, of at most ``k``, of the ranked pairs that one merge at
    a time would pick one after another.

    A pair follows the ones before it if it shares no symbol with them (its
    count then stays) and no pair that those merges make can rank above it:
    merging (a, b) makes pairs only where a pair ends with a or begins with b, and they are at most as
    frequent as that one, which must be strictly rarer."""
    top = pairs.orderBy(F.desc("freq"), "left", "right").limit(4 * k + 1).collect()
    unseen = top[-1].freq if len(top) > 4 * k else 0
    used: set[str] = set()
    out: list[tuple[str, str, int]] = []
    made = 0  # no new pair is more frequent
    for r in top:
        if r.left in used or r.right in used or len(out) == k or (out and made >= r.freq):
            break
        out.append((r.left, r.right, int(r.freq)))
        used |= {r.left, r.right}
        made = max([made, unseen, *(x.freq for x in top if x.right == r.left or x.left == r.right)])
    return out


def apply_merges(words: DataFrame, merges: list[tuple[str, str, int]]) -> DataFrame:
    """The words with pairs that share no symbol merged."""
    s = F.col("symbols")
    for a, b, _ in merges:
        s = merged(s, F.lit(a), F.lit(b))
    return words.withColumn("symbols", s)


def learn(df: DataFrame, num_merges: int = 200, merges_per_round: int = 64, min_freq: int = 1,
          checkpoint_every: int = 8, col: str = "request") -> tuple[DataFrame, DataFrame]:
    """Returns (merges ``(rank, left, right, token, freq)``, vocabulary
    ``(token, kind)``: base characters then merged tokens). The merges are those
    of one merge at a time; ``merges_per_round`` bounds a round's batch only."""
    spark = df.sparkSession
    # The corpus pass happens once: the (small) word table is stored, and
    # each round reads and rewrites only it.
    words = word_counts(df, col).checkpoint(eager=True)
    base = words.select(F.explode(pieces(F.col("symbols"))).alias("token")).distinct()
    merges: list[tuple[str, str, int]] = []
    rnd = 0
    while len(merges) < num_merges:
        picked = [m for m in _next_merges(pair_counts(words), min(merges_per_round, num_merges - len(merges))) if m[2] >= min_freq]
        if not picked:
            break
        merges.extend(picked)
        words = apply_merges(words, picked)
        rnd += 1
        if rnd % checkpoint_every == 0:
            words = words.checkpoint(eager=True)
    mdf = spark.createDataFrame([(i + 1, a, b, a + b, f) for i, (a, b, f) in enumerate(merges)],
                                "rank int, left string, right string, token string, freq long")
    vocab = base.select("token", F.lit("base").alias("kind")).unionByName(
        mdf.select("token", F.lit("merge").alias("kind"))).dropDuplicates(["token"])
    return mdf, vocab


def vocab_with_fixed_tokens(vocab: DataFrame, fixed_tokens: list[str]) -> DataFrame:
    """The learned vocabulary plus fixed tokens, without duplicates."""
    fixed = vocab.sparkSession.createDataFrame([(t, "fixed") for t in dict.fromkeys(fixed_tokens)], "token string, kind string")
    return fixed.unionByName(vocab.join(fixed.select("token"), "token", "left_anti").select("token", "kind"))


def token_ids(merges: DataFrame, vocab: DataFrame, fixed_tokens: list[str]) -> DataFrame:
    """The vocabulary with ids (T2, T3): special tokens, other fixed tokens as
    given, base characters by code point, merged tokens by rank. The vocabulary is the model: its
    size is set by the number of merges and the alphabet."""
    spark = vocab.sparkSession
    fixed = list(dict.fromkeys([*SPECIAL_TOKENS, *fixed_tokens]))
    base = vocab.filter("kind = 'base'").join(spark.createDataFrame([(t,) for t in fixed], "token string"), "token", "left_anti") \
        .agg(F.array_sort(F.collect_set("token")).alias("t")).select(F.posexplode("t").alias("id", "token"))
    n_base = vocab.filter("kind = 'base'").count()
    ranked = merges.groupBy("token").agg(F.min("rank").alias("rank"))
    return spark.createDataFrame([(i, t, "fixed") for i, t in enumerate(fixed)], "id int, token string, kind string") \
        .unionByName(base.select((F.col("id") + len(fixed)).alias("id"), "token", F.lit("base").alias("kind"))) \
        .unionByName(ranked.select((F.col("rank") - 1 + len(fixed) + n_base).cast("int").alias("id"), "token", F.lit("merge").alias("kind")))


def contracted(words: DataFrame, merges: DataFrame) -> DataFrame:
    """``(word, pieces)`` of distinct words: each with the merges whose token it
    holds, applied in rank order."""
    longest = merges.select(F.max(F.length("token"))).scalar()
    at = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    last = F.least("longest", F.length("word") - F.col("i") + 1)
    parts = at.withColumn("longest", longest).withColumn("n", F.explode(F.when(last >= 2, F.sequence(F.lit(2), last)))) \
        .select("word", F.substring("word", F.col("i"), F.col("n")).alias("token"))
    found = parts.join(merges.select("rank", "left", "right", "token"), "token").groupBy("word") \
        .agg(F.array_sort(F.collect_set(F.struct("rank", "left", "right"))).alias("merges"))
    joined = words.select("word").join(found, "word", "left")
    symbols = F.aggregate(F.coalesce("merges", F.array().cast("array<struct<rank:int,left:string,right:string>>")),
                          wrapped(F.col("word")), lambda s, m: merged(s, m["left"], m["right"]))
    return joined.select("word", pieces(symbols).alias("pieces"))


def encode(df: DataFrame, merges: DataFrame, vocabulary: DataFrame, fixed_tokens: list[str], col: str = "request",
           key: str = "original_index") -> DataFrame:
    """``(key, ids)`` of every text, whole: fixed tokens stay whole, the other
    words are contracted once each, unknown characters become ``[UNK]``.

    The distinct words get their ids. Those that make up more than one in ``HOT_SHARE``
    words of the texts (there are fewer than ``HOT_SHARE`` of those) go to every task, which
    looks the words of its texts up; only the other words are shuffled, and meet the texts that hold them.
    Texts that share a key have the ids of all of them, by position; a null key has none."""
    pattern = F.lit(fixed_pattern(fixed_tokens))
    counts = df.select(F.explode(F.regexp_extract_all(F.col(col), pattern, 0)).alias("word")) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    whole = vocabulary.filter("kind = 'fixed'").select(F.col("token").alias("word"), F.array("id").alias("ids"))
    cut = contracted(counts.join(whole.select("word"), "word", "left_anti"), merges)
    unknown = vocabulary.filter(F.col("token") == UNK).select("id").scalar()
    ids = cut.select("word", F.posexplode("pieces").alias("i", "token")).join(vocabulary.select("token", "id"), "token", "left") \
        .withColumn("id", F.coalesce("id", unknown)) \
        .groupBy("word").agg(F.array_sort(F.collect_list(F.struct("i", "id"))).alias("p")) \
        .select("word", F.col("p.id").alias("ids"))
    coded = counts.join(ids.unionByName(whole), "word").checkpoint(eager=True)
    total = counts.select(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE > total
    frequent = coded.filter(hot).select("word", F.col("ids").cast("array<int>").alias("ids")).toArrow()  # fewer than HOT_SHARE rows
    seldom = coded.filter(~hot).select("word", F.col("ids").cast("array<int>").alias("ids"))
    texts = df.select(key, F.coalesce(F.col(key).cast("string"), F.lit("")).alias("partner"), F.coalesce(F.col(col), F.lit("")).alias("t")) \
        .groupBy("partner").agg(F.first(key).alias(key), F.collect_list("t").alias("t")) \
        .select(key, "partner", F.size("t").alias("n"), F.transform("t", lambda t: F.regexp_extract_all(t, pattern, 0)).alias("words"))

    def located(words) -> tuple:
        """Rows, positions and texts of the words."""
        import numpy as np
        import pyarrow.compute as pc
        inner = words.flatten()
        sizes = pc.list_value_length(inner).to_numpy()
        row = np.repeat(np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy()), sizes)
        return row, (np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32), inner.flatten()

    def missing(batches: Iterator) -> Iterator:
        known = frequent.column("word").combine_chunks()
        for batch in batches:
            for b in lookup.parts(batch):
                row, _, word = located(b.column("words"))
                yield from lookup.missing(b.column("partner"), row, word, known, "word")

    def fill(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        known, values = frequent.column("word").combine_chunks(), frequent.column("ids").combine_chunks()
        kind = pa.list_(pa.int32())
        for batch in batches:
            for b in lookup.parts(batch):
                row, pos, word = located(b.column("words"))
                at, own = lookup.places(row, word, known, b.column("rare") if "rare" in b.schema.names else None, "word")
                every = values.cast(kind) if own is None else pa.concat_arrays([values.cast(kind), own.field("ids").cast(kind)])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(b)))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(key), b.column("n"), pa.ListArray.from_arrays(ends, pa.array(pos)), pa.ListArray.from_arrays(ends, every.take(pa.array(at)))],
                    names=[key, "n", "pos", "ids"])

    if not seldom.isEmpty():
        needed = texts.select("partner", "words").mapInArrow(missing, "partner string, word string")
        texts = texts.join(needed.join(seldom, "word").groupBy("partner").agg(F.collect_set(F.struct("word", "ids")).alias("rare")), "partner", "left")
    out = texts.mapInArrow(fill, f"{key} {df.schema[key].dataType.simpleString()}, n int, pos array<int>, ids array<array<int>>")
    by_position = F.when(F.col("n") == 1, F.col("ids")).otherwise(F.sort_array(F.arrays_zip("pos", "ids"))["ids"])
    empty = F.array().cast("array<int>")
    return out.select(key, F.when(F.col(key).isNull(), empty).otherwise(F.flatten(by_position)).alias("ids"), F.explode(F.array_repeat(F.lit(0), F.col("n")))) \
        .select(key, "ids")
