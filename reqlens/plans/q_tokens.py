"""Query keys for the subword vocabulary (T1, T2) and packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from reqlens.operators import bpe, packing
from reqlens.operators import tokens as tk
from reqlens.plans.catalog import register
from reqlens.plans.oracle import with_views
from reqlens.sources import fixtures as fx

PATTERN_SQL = r"'[A-Za-z0-9]+|[^A-Za-z0-9\s]'"
FIXED_TOKENS = ["[r][n]", *tk.SPECIAL_TOKENS]
N_MERGES = 64


def _corpus(spark, sf_dir):
    return fx.request_table(spark, sf_dir).filter(F.col("anomalous") == 0)


@register("bpe_pair_counts", with_views(f"""
select substr(word, i, 1) as "left", substr(word, i + 1, 1) as "right", cast(sum(freq) as bigint) as freq
from (select word, freq, unnest(range(1, length(word))) as i
      from (select word, count(*) as freq
            from (select unnest(regexp_extract_all(request, {PATTERN_SQL})) as word from requests where anomalous = 0) t
            group by word) w) p
group by 1, 2""", "requests"))
def q_bpe_pair_counts(spark, sf_dir):
    """T1, first round: adjacent symbol pairs of the corpus words, weighted."""
    return bpe.pair_counts(bpe.word_counts(_corpus(spark, sf_dir)))


WORDS_SQL = f"""select word, sum(own) as freq from (
  select unnest(regexp_extract_all(request, {PATTERN_SQL})) as word, cast(anomalous = 0 as integer) as own from requests) t group by word"""


def merge_views(n_merges: int) -> list[tuple[str, str]]:
    """One merge a step, on all words; those outside the corpus have no weight."""
    return [
        ("words", WORDS_SQL),
        ("steps", f"""select * from (with recursive st(step, word, freq, sym, l, r, n) as (
  select 0, word, freq, regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'gs'), '', '', cast(0 as bigint) from words
  union all
  select st.step + 1, st.word, st.freq, replace(st.sym, chr(1) || b.l || chr(2) || chr(1) || b.r || chr(2), chr(1) || b.l || b.r || chr(2)), b.l, b.r, b.n
  from st, (select z[1] as l, z[2] as r, cast(sum(freq) as bigint) as n
            from (select freq, unnest(list_zip(s[1:len(s) - 1], s[2:])) as z
                  from (select freq, string_split(sym[2:length(sym) - 1], chr(2) || chr(1)) as s from st where freq > 0) where len(s) > 1)
            group by 1, 2 order by n desc, l, r limit 1) b
  where st.step < {n_merges})
select * from st)"""),
        ("merges", "select distinct step as rank, l, r, l || r as token, n from steps where step > 0"),
        ("vocab", """select distinct unnest(string_split(word, '')) as token, 'base' as kind from words where freq > 0
  union select token, 'merge' from merges"""),
    ]


FIXED_SQL = "['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '[r][n]']"
N_FIXED = 6


def encode_views(n_merges: int = N_MERGES) -> list[tuple[str, str]]:
    """The ids of every request with the learned merges and the fixed tokens."""
    split = r"'\[r\]\[n\]|\[MASK\]|\[CLS\]|\[PAD\]|\[SEP\]|\[UNK\]|[A-Za-z0-9]+|[^A-Za-z0-9\s]'"
    return [
        *merge_views(n_merges),
        ("base", f"""select token, row_number() over (order by token) - 1 + {N_FIXED} as id
  from (select distinct token from vocab where kind = 'base' and not list_contains({FIXED_SQL}, token)) b"""),
        ("ids", f"""select {FIXED_SQL}[i] as token, i - 1 as id from range(1, {N_FIXED} + 1) t(i)
  union all select token, id from base
  union all select token, min(rank) - 1 + {N_FIXED} + (select count(*) from vocab where kind = 'base') from merges group by token"""),
        ("contracted", "select word, string_split(sym[2:length(sym) - 1], chr(2) || chr(1)) as s from steps where step = (select max(step) from steps)"),
        ("split_word", f"select original_index, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from (select original_index, regexp_extract_all(request, {split}) as w from requests)"),
        ("part", f"""select original_index, p, unnest(s) as token, unnest(range(1, len(s) + 1)) as i
  from (select original_index, p, case when list_contains({FIXED_SQL}, a.word) then [a.word] else c.s end as s
        from split_word a left join contracted c on c.word = a.word)"""),
        ("encoded", """select r.original_index, coalesce(e.ids, []) as ids from requests r left join (
    select original_index, list(cast(coalesce(ids.id, 1) as integer) order by p, i) as ids
    from part left join ids on ids.token = part.token group by original_index) e on e.original_index = r.original_index"""),
    ]


def learned(spark, sf_dir):
    """The stored merges and vocabulary (K8) of the normal corpus."""
    from reqlens.sources.stage import stage_table
    made = {}

    def build(i):
        if "m" not in made:
            made["m"] = bpe.learn(_corpus(spark, sf_dir), num_merges=N_MERGES)
        return made["m"][i]
    merges = stage_table(spark, ("bpe-merges", sf_dir, N_MERGES), lambda: build(0))
    vocab = stage_table(spark, ("bpe-vocab", sf_dir, N_MERGES), lambda: build(1))
    return merges, bpe.token_ids(merges, vocab, FIXED_TOKENS)


def encoded(spark, sf_dir):
    merges, vocabulary = learned(spark, sf_dir)
    return bpe.encode(fx.request_table(spark, sf_dir), merges, vocabulary, FIXED_TOKENS)


def osql(body: str, *extra: tuple[str, str], n_merges: int = N_MERGES) -> str:
    return with_views(body, "requests", extra=[*encode_views(n_merges), *extra])


@register("bpe_vocab", with_views('select rank, l as "left", r as "right", token, n as freq from merges', "requests", extra=merge_views(200)))
def q_bpe_vocab(spark, sf_dir):
    """Merges learned over the whole normal corpus."""
    merges, _ = bpe.learn(_corpus(spark, sf_dir), num_merges=200, merges_per_round=64)
    return merges


@register("vocab_with_fixed_tokens", osql("""select token, case when list_contains(['[r][n]', '[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]'], token)
  then 'fixed' else kind end as kind
from (select token, min(kind) as kind from vocab group by token union select unnest(['[r][n]', '[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]']), 'fixed') v"""))
def q_vocab_with_fixed_tokens(spark, sf_dir):
    """Learned vocabulary plus the fixed tokens."""
    _, vocab = bpe.learn(_corpus(spark, sf_dir), num_merges=N_MERGES, merges_per_round=64)
    return bpe.vocab_with_fixed_tokens(vocab, FIXED_TOKENS)


@register("encode_learned", osql("select original_index, ids from encoded"))
def q_encode_learned(spark, sf_dir):
    """Every request as ids of the learned vocabulary; ``[r][n]`` is one token."""
    return encoded(spark, sf_dir)


@register("causal_labels_learned", osql("""
select original_index, list_concat(ids[1:16], list_transform(range(0, greatest(16 - len(ids), 0)), lambda x: 0)) as input_ids,
  list_concat(ids[1:16], list_transform(range(0, greatest(16 - len(ids), 0)), lambda x: -100)) as labels from encoded"""))
def q_causal_labels_learned(spark, sf_dir):
    """T10 on learned ids: a window of 16 ids, padded; padding has label -100."""
    e = encoded(spark, sf_dir)
    ids = F.concat(F.slice("ids", 1, 16), F.array_repeat(F.lit(0), F.greatest(F.lit(16) - F.size("ids"), F.lit(0))))
    return e.select("original_index", ids.alias("input_ids")).withColumn("labels", tk.causal_labels(F.col("input_ids")))


@register("stride_labels", osql("""
select original_index, shift_index,
  list_transform(range(1, len(ids) + 1), lambda i: case when i % 5 = shift_index and ids[i] > 4 then 4 else ids[i] end) as input_ids,
  list_transform(range(1, len(ids) + 1), lambda i: case when i % 5 = shift_index and ids[i] > 4 then ids[i] else -100 end) as labels
from encoded cross join (select cast(unnest(range(0, 5)) as integer) as shift_index) s"""))
def q_stride_labels(spark, sf_dir):
    """T6 on learned ids: the masked ids of each pass, and labels that keep the id at
    masked positions and are -100 elsewhere."""
    e = tk.stride_expand(encoded(spark, sf_dir), 5)
    masked, labels = tk.stride_ids(F.col("ids"), 5, F.col("shift_index"))
    return e.select("original_index", "shift_index", masked.alias("input_ids"), labels.alias("labels"))


def _packed_sql(source: str, block: int, batch_rows: int, sep: int) -> str:
    """Samples placed one after another, batch by batch."""
    return f"""
select * from (with recursive sample as (
  select (pos - 1) // {batch_rows} as batch, (pos - 1) % {batch_rows} as k, list_append(ids, {sep}) as s
  from (select row_number() over (order by original_index) as pos, ids from {source})),
place(batch, k, a, stop) as (
  select batch, k, cast(0 as bigint), len(s) from sample where k = 0
  union all
  select t.batch, t.k, case when p.stop % {block} = 0 or len(t.s) <= {block} - p.stop % {block} then p.stop else (p.stop // {block} + 1) * {block} end,
         len(t.s) + case when p.stop % {block} = 0 or len(t.s) <= {block} - p.stop % {block} then p.stop else (p.stop // {block} + 1) * {block} end
  from place p join sample t on t.batch = p.batch and t.k = p.k + 1),
token as (
  select t.batch, t.k, (p.a + i - 1) // {block} as block, p.a + i - 1 as address, t.s[i] as id
  from (select batch, k, s, unnest(range(1, len(s) + 1)) as i from sample) t join place p on p.batch = t.batch and p.k = t.k),
blocks as (select batch, cast(block as integer) as block, cast(count(distinct k) as integer) as n_samples, list(cast(id as integer) order by address) as ids from token group by batch, block)
select batch, block, n_samples, list_concat(ids, list_transform(range(len(ids), {block}), lambda x: 0)) as input_ids,
  list_concat(list_transform(ids, lambda x: 1), list_transform(range(len(ids), {block}), lambda x: 0)) as attention_mask,
  list_concat(ids, list_transform(range(len(ids), {block}), lambda x: -100)) as labels
from blocks)"""


@register("pack_learned", osql(_packed_sql("encoded", 512, 1000, 3)))
def q_pack_learned(spark, sf_dir):
    """Every request's learned ids packed into blocks of 512 with a separator."""
    return packing.pack(encoded(spark, sf_dir), "ids", block_size=512, batch_rows=1000, sep_id=3)


@register("pack_sequences", with_views(_packed_sql("doc_ids", 4096, 1000, 3), "doc_requests", extra=[
    ("doc_ids", f"""select original_index, list_transform(regexp_extract_all(coalesce(request, ''), {PATTERN_SQL}),
  lambda t: cast(5 + ('0x' || substr(md5(t), 1, 6))::integer % 50000 as integer)) as ids from doc_requests""")]))
def q_pack_sequences(spark, sf_dir):
    """Whole documents tokenised (no truncation), ids from a hashed
    vocabulary, packed into 4096-token blocks with a separator; longer
    documents go on in further blocks."""
    d = fx.doc_requests(spark, sf_dir)
    ids = F.transform(tk.all_tokens("request"), lambda t: (F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("int") % 50000 + 5))
    return packing.pack(d.select("original_index", ids.alias("ids")), "ids", block_size=4096, batch_rows=1000, sep_id=3)
