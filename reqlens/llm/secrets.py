"""Secret scans: patterns plus a battery of randomness tests.

Patterns find assignments, access keys and long hexadecimal strings (``KINDS``,
the base spans). Beside them every long run of key characters whose encoding can
be inferred (the smallest of ``ENCODINGS`` of whose character classes all occur)
is tested for being uniformly random in its alphabet:

* chi-squared of the character counts (Wilson-Hilferty, upper tail),
* runs of characters of the alphabet's lower and upper half, given their numbers
  (Wald-Wolfowitz, two-sided),
* serial correlation of neighbouring characters' places in the alphabet (two-sided).

The p-value is three times the smallest of the three, 1 at most. Ordinary
identifiers, paths and words fail at once; a key drawn at random fails as often as the level
says. Within each class of encoding and length (powers of two) the
Benjamini-Hochberg rule at ``level`` decides which runs are not random; so the
share of real keys among the discarded runs is bounded in each class, whatever the others
hold. Short runs would pass for lack of power: a run has to be long
enough for text (two characters alike with probability 0.066) to be 4 standard deviations
from uniform (``least_length``). The runs that are left are spans of kind ``random``.

Only DataFrame functions are used. Positions are prefix sums over the pieces
between matches, summed in blocks so that very many matches stay cheap. Texts
don't move; p-values are counted in classes of an eighth of a power of ten,
rounded up, and the rule's limits are a bounded table (encodings x powers of two).

Defined results: a null text counts as empty, without spans; null ids and
repeated rows each keep their row; an empty table gives no rows; other columns
are ignored. Positions are code points. Runs held by many documents count for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.util import stored, work_dir

# --- fixed values ------------------------------------------------------------
#: kind, pattern, group that counts, its least length
KINDS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
# -----------------------------------------------------------------------------
RANDOM = "random"
RUN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: alphabet and what a run in it looks like, in order of precedence
ENCODINGS = [
    (_DIGITS + "abcdef", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$"),
    (_DIGITS + "ABCDEF", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$"),
    (_UPPER + "234567", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$"),
    (_DIGITS + _LOWER, r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$"),
    (_DIGITS + _UPPER, r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$"),
    (_DIGITS + _UPPER + _LOWER, r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$"),
    (_UPPER + _LOWER + _DIGITS + "+/", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$"),
    (_UPPER + _LOWER + _DIGITS + "-_", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$"),
]
#: probability that two characters of a text are alike
TEXT_COINCIDENCE = 0.066
POWER = 4.0
BLOCK = 256
#: classes of p-values in a power of ten, and the last class
STEPS, LAST = 8, 2400


def least_length(k: int, shortest: int = 20) -> int:
    """Shortest run over k characters in which text fails the uniformity test."""
    n = shortest
    while (k * (1 + (n - 1) * TEXT_COINCIDENCE) - n - (k - 1)) / (2 * (k - 1) * (n - 1) / n) ** 0.5 < POWER and k > 16:
        n += 1
    return n


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of all matches, leftmost and not overlapping."""
    literal = F.lit(pattern)
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, literal, 0),
                       lambda piece, m: F.struct(F.length(piece).cast("bigint").alias("gap"), m.alias("text")))
    steps = F.filter(steps, lambda s: s["text"].isNotNull())
    span = "struct<start:bigint,end:bigint,text:string>"

    def walk(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.length(s["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), s["text"].alias("text")))).alias("out"))

    def add(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"),
                                                             s["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def none(kind: str) -> Column:
        return F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda b: F.aggregate(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)), none(span), walk))
    all_of = F.flatten(F.aggregate(blocks, none(f"array<{span}>"), add)["out"])
    return F.when(text.rlike(pattern), all_of).otherwise(F.array().cast(f"array<{span}>"))


def base_spans(text: Column, kind: int) -> Column:
    """Array of (start, kind, end) of one of ``KINDS``."""
    _, pattern, group, least = KINDS[kind]
    found = matches(text, pattern)
    good = F.filter(found, lambda s: F.length(F.regexp_extract(s["text"], pattern, group)) >= least)
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (Bryc's rational approximation)."""
    a = f"abs({z})"
    q = (f"exp(-{a} * {a} / 2) * ({a} * {a} + 5.575192695D * {a} + 12.77436324D) / "
         f"(2.5066282746310002D * {a} * {a} * {a} + 14.38718147D * {a} * {a} + 31.53531977D * {a} + 25.548726D)")
    return f"(case when {z} < 0 then 1 - {q} else {q} end)"


#: fields added to each run, step by step; earlier ones are read as ``c.name``
_INFERRED = [
    {"body": "regexp_replace(c.text, '=+$', '')"},
    {"alphabet": "case " + " ".join(f"when c.body rlike '{p}' then '{a}'" for a, p in ENCODINGS) + " end",
     "n": "cast(length(c.body) as bigint)"},
]
_BATTERY = [
    {"k": "cast(length(c.alphabet) as bigint)",
     "squares": "aggregate(transform(split(c.alphabet, ''), a -> cast(length(c.body) - length(replace(c.body, a, '')) as bigint)), "
                "0L, (s, m) -> s + m * m)",
     "halves": "translate(c.body, c.alphabet, concat(repeat('0', length(c.alphabet) div 2), repeat('1', length(c.alphabet) div 2)))",
     "places": "transform(split(c.body, ''), a -> cast(2 * instr(c.alphabet, a) - 1 - length(c.alphabet) as bigint))"},
    {"ones": "cast(length(replace(c.halves, '0', '')) as double)",
     "runs": "cast(1 + (2 * c.n - length(replace(c.halves, '01', '')) - length(replace(c.halves, '10', ''))) div 2 as double)",
     "products": "cast(aggregate(zip_with(c.places, slice(c.places, 2, cast(c.n as int)), (a, b) -> coalesce(a * b, 0L)), 0L, (s, m) -> s + m) as double)"},
    {"z_chi": "(power((cast(c.k * c.squares as double) / c.n - c.n) / (c.k - 1), 1D / 3) - (1 - 2D / (9 * (c.k - 1)))) / sqrt(2D / (9 * (c.k - 1)))",
     "mean_runs": "2 * c.ones * (c.n - c.ones) / c.n + 1",
     "spread": "2 * c.ones * (c.n - c.ones) * (2 * c.ones * (c.n - c.ones) - c.n) / (cast(c.n as double) * c.n * (c.n - 1))",
     "z_serial": "abs(c.products) / (sqrt(cast(c.n - 1 as double)) * (cast(c.k as double) * c.k - 1) / 3)"},
    {"z_runs": "case when c.spread > 0 then abs(c.runs - c.mean_runs) / sqrt(c.spread) else 1000D end"},
    {"p": f"least(1D, 3 * least({_tail('c.z_chi')}, 2 * {_tail('c.z_runs')}, 2 * {_tail('c.z_serial')}))"},
    {"family": "concat(c.alphabet, ' ', cast(floor(log2(cast(c.n as double))) as int))",
     "class": f"cast(least({LAST}, floor(-log10(greatest(c.p, 1e-300D)) * {STEPS})) as int)"},
]


def _add(df: DataFrame, steps: list[dict[str, str]], have: list[str], name: str = "runs") -> tuple[DataFrame, list[str]]:
    for step in steps:
        body = ", ".join([f"'{h}', c.{h}" for h in have] + [f"'{field}', {sql}" for field, sql in step.items()])
        df = df.withColumn(name, F.expr(f"transform({name}, c -> named_struct({body}))"))
        have = have + list(step)
    return df, have


def tested(df: DataFrame, text: str = "text", name: str = "runs") -> DataFrame:
    """Adds ``name``: (start, end, family, class, p) of every run whose encoding is
    known and whose length suffices."""
    df, have = _add(df.withColumn(name, matches(F.col(text), RUN)), _INFERRED, ["start", "end", "text"], name)
    long_enough = " or ".join(f"(length(c.alphabet) = {k} and c.n >= {least_length(k)})" for k in sorted({len(a) for a, _ in ENCODINGS}))
    # what the pattern ``hex`` finds already is no run of its own
    df = df.withColumn(name, F.expr(f"filter({name}, c -> ({long_enough}) and not (c.n >= 24 and length(c.alphabet) = 16 and c.body = lower(c.body)))"))
    df, have = _add(df, _BATTERY, have, name)
    return df.withColumn(name, F.transform(name, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "family", "class", "p")])))


def rejection_limits(runs: DataFrame, level: float) -> DataFrame:
    """(family, limit): runs of the family whose class is ``limit`` or more aren't
    random, by the Benjamini-Hochberg rule within the family."""
    counts = runs.groupBy("family", "class").agg(F.count("*").alias("n"))  # at most LAST rows a family
    extreme = Window.partitionBy("family").orderBy(F.desc("class"))
    ranked = counts.withColumn("extreme", F.sum("n").over(extreme)).withColumn("m", F.sum("n").over(Window.partitionBy("family")))
    return ranked.where(F.pow(F.lit(10.0), -F.col("class") / STEPS) * F.col("m") <= level * F.col("extreme")) \
        .groupBy("family").agg(F.min("class").alias("limit"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", level: float = 0.01) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, kind, end), kinds
    numbered as in ``KINDS``, then ``random``; ``spans`` holds the base ones as well."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = tested(rows).select("doc_id", F.array_sort(F.concat(*[base_spans(F.col("text"), k) for k in range(len(KINDS))])).alias("base"), "runs")
    found = stored(found, work_dir(docs.sparkSession), "runs")
    limits = rejection_limits(found.select(F.inline("runs")), level)
    # a bounded table: encodings x powers of two
    by_family = limits.agg(F.map_from_entries(F.collect_list(F.struct("family", "limit")))).scalar()
    out = found.withColumn("limits", by_family) \
        .withColumn("left", F.filter("runs", lambda r: r["class"] < F.coalesce(F.try_element_at("limits", r["family"]), F.lit(LAST + 1))))
    extra = F.transform("left", lambda r: F.struct(r["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), r["end"].alias("end")))
    return out.select("doc_id", "base", F.array_sort(F.concat("base", extra)).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(RANDOM))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
