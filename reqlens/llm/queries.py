"""Query keys of the operators, with DuckDB statements where SQL can state
them. Every query reads whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqlens.llm import (byte_bpe, decontaminate, line_dedup, lm_score, near_dedup, neighbours, quality, secrets,
                         substring_dedup, surrogates, token_counts, vector_codes, whitening)
from reqlens.llm.util import remainder, work_dir
from reqlens.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; trained on the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), usable=lambda c: remainder(c, 5) > 0)
    return quality.score(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@register("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str, cache: str | None = None) -> DataFrame:
    """Token counts of every document; a new cache unless one is given."""
    import public_tokenizers
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                                       cache or f"{work_dir(spark)}/token-cache")
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@register("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of every document, as digests."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


@register("op2_decontaminate", f"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w, least(len(w), 13) as n from benchmark where item_id is not null),
item_window as (
  select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as k
  from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as s from b where n > 0)),
doc_window as (
  select doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') as k
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s
        from d cross join (select distinct n from item_window) where len(w) >= n)),
hit as (select doc_id, s, n, item_id from doc_window join item_window using (n, k)),
words_hit as (select doc_id, count(distinct p) as n_hit
              from (select doc_id, unnest(range(s, s + n)) as p from hit) group by doc_id),
items_hit as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
              from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join words_hit using (doc_id) left join items_hit using (doc_id)""")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
                        decontaminate.items_digest().alias("items_sha256"), "contaminated")


@register("op3_neighbours", """
with v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
near as (
  select q.vec_id as query_id, c.vec_id,
         sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score, vec_id) as rank from near) where rank <= 10""")
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@register("op8_near_dedup", r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingle as (
  select distinct doc_id, array_to_string(w[s:s + n - 1], ' ') as k
  from (select doc_id, w, least(len(w), 5) as n, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from w where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (
  select a, b from (
    select x.doc_id as a, y.doc_id as b, count(*) as both_have
    from shingle x join shingle y on x.k = y.k and x.doc_id <> y.doc_id group by all)
  join size p on p.doc_id = a join size q on q.doc_id = b
  where 100 * both_have >= 75 * (p.n + q.n - both_have)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select doc_id, b from reach join link on other = a)
select doc_id, cast(coalesce(any_value(n), 0) as bigint) as n_shingles, min(other) as component_id,
       doc_id = min(other) as kept
from reach left join size using (doc_id) group by doc_id""")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by their sets of five-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register("op9_substring_dedup", r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, s, array_to_string(w[s:s + 19], ' ') as k
            from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from d where len(w) >= 20)),
later as (select doc_id, s from (select *, row_number() over (partition by k order by doc_id, s) as n from windows) where n > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from later),
words as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, count(*) as n, string_agg(w[p], ' ' order by p) as t from words anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)""")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document left when repeated 20-word windows are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.strip(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; the fold of remainder 2 isn't learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = remainder("doc_id", 7)
    return lm_score.score(docs, (fold >= 0) & (fold != 2)).withColumn("held_out", fold == 2)


@register("op7_line_dedup")
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line up to two byte edits (one per eight bytes)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.strip_lines(docs, counts=True) \
        .select("doc_id", "n_lines", "n_removed", "n_near", F.sha2("text", 256).alias("kept_sha256"))


@register("op6_surrogates")
def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data and secrets replaced; the key is a
    setting of the session."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, spark.conf.get("reqlens.surrogates.key", "corpus-release-key"))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = "(?:" + "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) \
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''")


def _positions(kind: int, pattern: str) -> str:
    return f"""select rn, {kind} as kind, m[i] as m, cast(length(m[i]) as bigint) as size,
      cast(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as start
    from (select rn, m, p, unnest(range(1, len(m) + 1)) as i
          from (select rn, regexp_extract_all(t, '{pattern}') as m, string_split_regex(t, '{pattern}') as p from t))"""


def _upper_tail(z: str) -> str:
    """Bryc's approximation of the normal distribution's upper tail."""
    a = f"abs({z})"
    top = f"({a} * {a} + 5.575192695 * {a} + 12.77436324)"
    bottom = f"(2.5066282746310002 * {a} * {a} * {a} + 14.38718147 * {a} * {a} + 31.53531977 * {a} + 25.548726)"
    q = f"exp(-{a} * {a} / 2) * {top} / {bottom}"
    return f"(case when {z} < 0 then 1 - {q} else {q} end)"


_LOWER = "abcdefghijklmnopqrstuvwxyz"
_LATIN = _LOWER.upper() + _LOWER

_SECRETS_SQL = f"""
with t as (select row_number() over () as rn, doc_id, coalesce(text, '') as t from documents),
assign as ({_positions(0, _ASSIGN)}),
access as ({_positions(1, "AKIA[A-Z0-9]+")}),
hexa as ({_positions(2, "[0-9a-f]+")}),
run as ({_positions(3, "[A-Za-z0-9+/_-]{20,}={0,2}")}),
base as (
  select rn, kind, 'assign' as name, start, start + size as stop from assign where length(regexp_extract(m, '{_ASSIGN}', 1)) >= 6
  union all select rn, kind, 'access', start, start + size from access where size >= 20
  union all select rn, kind, 'hex', start, start + size from hexa where size >= 24),
classes as (
  select *, regexp_matches(b, '[0-9]') as d, regexp_matches(b, '[a-z]') as lo, regexp_matches(b, '[A-Z]') as up,
         regexp_matches(b, '[+/]') as plain, regexp_matches(b, '[_-]') as url
  from (select rn, start, size, rtrim(m, '=') as b from run)),
coded as (
  select rn, start, size, b, length(b) as n, case
    when d and not up and not plain and not url and regexp_matches(b, '[a-f]') and not regexp_matches(b, '[g-z]') then '0123456789abcdef'
    when d and not lo and not plain and not url and regexp_matches(b, '[A-F]') and not regexp_matches(b, '[G-Z]') then '0123456789ABCDEF'
    when not lo and not plain and not url and up and regexp_matches(b, '[2-7]') and not regexp_matches(b, '[0189]') then '{_LOWER.upper()}234567'
    when d and lo and not up and not plain and not url then '0123456789{_LOWER}'
    when d and up and not lo and not plain and not url then '0123456789{_LOWER.upper()}'
    when d and up and lo and not plain and not url then '0123456789{_LATIN}'
    when d and up and lo and not url then '{_LATIN}0123456789+/'
    when d and up and lo and not plain then '{_LATIN}0123456789-_' end as a
  from classes),
long_enough as (
  select *, length(a) as k from coded where a is not null
    and not (n >= 24 and a = '0123456789abcdef')
    and n >= (select coalesce(min(x), 20) from (select unnest(range(20, 200)) as x)
              where length(a) <= 16 or (length(a) * (1 + (x - 1) * 0.066) - x - (length(a) - 1)) / sqrt(2.0 * (length(a) - 1) * (x - 1) / x) >= 4)),
counted as (
  select *,
    list_sum(list_transform(string_split(a, ''), lambda c: (n - length(replace(b, c, ''))) * (n - length(replace(b, c, ''))))) as squares,
    list_transform(range(1, n + 1), lambda i: 2 * instr(a, b[i]) - 1 - k) as places
  from long_enough),
summed as (
  select *, cast(len(list_filter(places, lambda x: x > 0)) as double) as ones,
    cast(1 + len(list_filter(range(1, n), lambda i: (places[i] > 0) <> (places[i + 1] > 0))) as double) as runs,
    cast(list_sum(list_transform(range(1, n), lambda i: places[i] * places[i + 1])) as double) as products
  from counted),
spread as (
  select *, (power((cast(k * squares as double) / n - n) / (k - 1), 1.0 / 3) - (1 - 2.0 / (9 * (k - 1)))) / sqrt(2.0 / (9 * (k - 1))) as z_chi,
    2 * ones * (n - ones) / n + 1 as mean_runs, 2 * ones * (n - ones) * (2 * ones * (n - ones) - n) / (cast(n as double) * n * (n - 1)) as v,
    abs(products) / (sqrt(n - 1) * (cast(k as double) * k - 1) / 3) as z_serial
  from summed),
scored as (
  select *, case when v > 0 then abs(runs - mean_runs) / sqrt(v) else 1000 end as z_runs from spread),
tested as (
  select rn, start, size, a || ' ' || cast(cast(floor(log2(n)) as integer) as varchar) as family,
    cast(least(2400, floor(-log10(greatest(least(1, 3 * least({_upper_tail("z_chi")}, 2 * {_upper_tail("z_runs")}, 2 * {_upper_tail("z_serial")})), 1e-300)) * 8)) as integer) as class
  from scored),
ranked as (select family, class, count(*) over (partition by family) as m,
                  count(*) over (partition by family order by class desc range between unbounded preceding and current row) as extreme from tested),
limits as (select family, min(class) as lim from ranked where power(10.0, -class / 8.0) * m <= 0.01 * extreme group by family),
spans as (
  select * from base
  union all select rn, 3, 'random', start, start + size from tested left join limits using (family) where lim is null or class < lim),
texts as (
  select rn, string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (where kind < 3) as base,
    count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex
  from spans group by rn)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join texts using (rn)"""


@register("op11_secrets", _SECRETS_SQL)
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base spans, and runs that pass for random."""
    found = secrets.scan(table(spark, sf_dir, "documents"))

    def number(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")

    kinds = [number(k).alias(f"n_{name[0]}") for k, name in enumerate(secrets.KINDS)]
    return found.select("doc_id", *kinds, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
                        secrets.written(F.col("spans")).alias("spans"))


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assigning and averaging; ``d * 256 + j`` orders by distance, then index."""
    def assigned(book: str) -> str:
        return f"""select v.p, v.r, min(list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) * 256 + c.j) as best
  from piece v join {book} c on v.p = c.p group by v.p, v.r"""
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} as materialized ({assigned(f'book{k}')})")
        steps.append(f"""book{k + 1} as materialized (
  select b.p, b.j, coalesce(m.x, b.x) as x from book{k} b left join (
    select p, j, list((s - ((s % n) + n) % n) // n order by i) as x
    from (select v.p, a.best % 256 as j, i, cast(sum(v.x[i]) as bigint) as s, count(*) as n
          from a{k} a join piece v on a.p = v.p and a.r = v.r cross join (select unnest(range(1, 1 + (select max(len(x)) from piece))) as i)
          group by all) group by p, j) m on b.p = m.p and b.j = m.j)""")
    return f"""
with kept as materialized (
  select row_number() over (order by vec_id) - 1 as r, vec_id, label,
         list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
piece as materialized (select p, r, x[p * (len(x) // 4) + 1:(p + 1) * (len(x) // 4)] as x from kept cross join (select unnest(range(0, 4)) as p)),
book0 as materialized (select p, r as j, x from piece where r < 256),
{", ".join(steps)},
last as materialized ({assigned(f'book{rounds}')}),
coded as (
  select r, string_agg(lpad(lower(hex(best % 256)), 2, '0'), '' order by p) as code, cast(sum(best // 256) as bigint) as error
  from last group by r),
digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, j)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from kept join coded using (r) cross join digest"""


@register("op12_vector_codes", _codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of every usable vector, with errors."""
    return vector_codes.encode(table(spark, sf_dir, "embeddings")).drop("label")


@register("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every usable vector on 32 principal components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
