"""PII: surrogate generation with DataFrame functions only.

Entities (``TYPES``, the first that matches) are found by one regular
expression. An entity's canonical form leaves out what doesn't tell it apart
(case of e-mail addresses, punctuation of numbers, titles of names); its
surrogate is drawn character by character from SHA-256 of the key, the type, the
canonical form and an attempt number: digits for digits, letters of the same
script for letters, octets of the same length for addresses, a Luhn check digit
where there was one, a vowel or a consonant at the end of a first name by the
title's gender. It is then poured into the form at hand, with its punctuation and
case. So one entity has one surrogate everywhere, in every form.

Collisions: over the distinct entities, a surrogate drawn by two of them, or one
that is a real entity, is drawn anew with the next attempt number (all but the
smallest entity), until none is left. When drawing gets nowhere, since a form (a
two-letter name, one-digit octets) has few free values or none, the entities left
are given its free values in order, and values of a longer form after them. Only the few entities beyond attempt 0 are
kept as a table and joined; every other surrogate is computed in its row, so a
very frequent entity is never shuffled with its occurrences.

Defined results: a null text stays null, an empty one empty, both without
entities; null ids, repeated rows and other columns pass through (columns named
like a result are replaced); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reqlens.llm.util import clash_free, stored, work_dir

_TITLES_F = r"Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Г-жа"
_TITLES_M = r"Mr|Herr|Señor|Monsieur|Г-н"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

#: (name, pattern) in order of precedence; groups don't capture
TYPES = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,127}[A-Za-z]{2,}+"),
    ("secret", r"(?i:(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.-]{6,}+)"),
    ("key", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
              r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
              r"|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])"),
    ("card", r"(?<![0-9-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])"),
    ("ipv4", rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![0-9A-Fa-f:])"),
    ("name", rf"(?<!\p{{L}})(?:{_TITLES_F}|{_TITLES_M})\.?[  ]\p{{Lu}}\p{{L}}++(?:[ -]\p{{Lu}}\p{{L}}++){{0,7}}"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in TYPES)

#: first and last code point and the range drawn from: letters of a script
_SCRIPTS = [("0", "9", "0", 10), ("a", "z", "a", 26), ("A", "Z", "A", 26), ("α", "ω", "α", 17), ("Α", "Ω", "Α", 17),
            ("а", "я", "а", 32), ("А", "Я", "А", 32), ("一", "鿿", "一", 20992), ("ぁ", "ゖ", "あ", 80),
            ("א", "ת", "א", 27), ("ß", "ß", "a", 26), ("à", "ÿ", "a", 26), ("À", "Þ", "A", 26)]


def _type(match: Column) -> Column:
    out = F.lit(TYPES[-1][0])
    for name, pattern in reversed(TYPES[:-1]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _prefix(kind: Column, match: Column) -> Column:
    """What stays as it is: a secret's name, a key's kind, a country code, a title."""
    return F.when(kind == "secret", F.regexp_extract(match, r"^[A-Za-z_-]+\s{0,3}[=:]\s{0,3}[\"']?", 0)) \
        .when(kind == "key", F.regexp_extract(match, r"^(?:AKIA|gh[pousr]_|sk-)", 0)) \
        .when(kind == "iban", F.substring(match, 1, 2)) \
        .when(kind == "phone", F.regexp_extract(match, r"^\+[0-9]{1,3}(?=[ .(-])|^\+", 0)) \
        .when(kind == "name", F.regexp_extract(match, rf"^(?:{_TITLES_F}|{_TITLES_M})\.?[  ]", 0)) \
        .otherwise(F.lit(""))


def _gender(kind: Column, prefix: Column) -> Column:
    return F.when(kind == "name", F.when(prefix.rlike(rf"^(?:{_TITLES_F})\b"), "f").otherwise("m")).otherwise("")


def _canonical(kind: Column, match: Column, prefix: Column) -> Column:
    """The entity itself: its country code (or gender) and what varies."""
    rest = match.substr(F.length(prefix) + 1, F.length(match))
    digits = F.regexp_replace(rest, "[^0-9A-Za-z]", "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), digits) \
        .when(kind.isin("email", "ipv6", "name"), F.lower(rest)).otherwise(rest)


def _prepared(df: DataFrame) -> DataFrame:
    """What the letters of a surrogate depend on, from kind, scope and canonical."""
    kind, canonical = F.col("kind"), F.col("canonical")
    n = F.length(canonical)
    return df.withColumn("chars", F.filter(F.split(canonical, ""), lambda c: c != "")) \
        .withColumn("hexadecimal", (kind.isin("secret", "key") & canonical.rlike("^[0-9a-f]+$") & canonical.rlike("[a-f]")) | (kind == "ipv6")) \
        .withColumn("open_end", F.when(kind == "email", n - F.length(F.substring_index(canonical, ".", -1))).otherwise(n)) \
        .withColumn("name_end", F.when(kind == "name", F.length(F.regexp_extract(canonical, r"^\p{L}+", 0)) - 1).otherwise(-1))


def _letters(c: Column, i: Column, r: Column) -> list:
    """(where it holds, number of letters, the letter of number r) for character
    c at place i, in order of precedence."""
    ending = (i == F.col("name_end")) & c.between("a", "z")
    out = [(i >= F.col("open_end"), 1, c), (ending & (F.col("scope") == "f"), 1, F.lit("a")),
           (ending, 9, F.lit("bdklmnrst").substr(1 + r % 9, F.lit(1))),
           (F.col("hexadecimal") & (c.between("0", "9") | c.between("a", "f")), 16, F.lower(F.hex((r % 16).cast("bigint"))))]
    for first, last, start, size in _SCRIPTS:
        # chr() knows the first 256 code points only: the others are cut from a text
        letter = F.chr((r % size + ord(start)).cast("bigint")) if ord(start) < 256 else \
            F.decode(F.unhex(F.lpad(F.hex((r % size + ord(start)).cast("bigint")), 4, "0")), "UTF-16BE")
        out.append((c.between(first, last), size, letter))
    return out


def _written(df: DataFrame) -> DataFrame:
    """``drawn`` from ``values``, a number for each character or octet. Each step
    is a column of its own, so it is computed once a row."""
    kind, canonical = F.col("kind"), F.col("canonical")

    def char(c: Column, i: Column) -> Column:
        out = F.when(F.lit(False), c)
        for holds, _, letter in _letters(c, i, F.get("values", i)):
            out = out.when(holds, letter)
        return out.otherwise(c)

    df = df.withColumn("plain", F.array_join(F.transform("chars", char), ""))
    octets = F.array_join(F.transform(F.split(canonical, r"\."), lambda o, i: F.when(F.length(o) == 1, F.get("values", i) % 9 + 1)
                                      .when(F.length(o) == 2, F.get("values", i) % 90 + 10)
                                      .otherwise(F.get("values", i) % 156 + 100).cast("string")), ".")
    df = df.withColumn("body", F.col("plain").substr(F.lit(1), F.length(canonical) - 1)) \
        .withColumn("digits", F.transform(F.reverse(F.filter(F.split("body", ""), lambda c: c.between("0", "9"))), lambda c: c.cast("int")))
    double = F.transform("digits", lambda d, i: F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    df = df.withColumn("total", F.aggregate(double, F.lit(0), lambda a, x: a + x))
    checked = F.concat("body", F.pmod(F.lit(10) - F.col("total") % 10, F.lit(10)).cast("string"))
    return df.withColumn("drawn", F.when(kind == "ipv4", octets).when(F.col("luhn"), checked).otherwise(F.col("plain"))) \
        .drop("values", "chars", "hexadecimal", "open_end", "name_end", "plain", "body", "digits", "total")


def _drawn(df: DataFrame, key: str) -> DataFrame:
    """``drawn``, the canonical surrogate, from kind, scope, canonical, luhn and
    attempt."""
    n = F.length("canonical")
    df = df.withColumn("seed", F.concat_ws("|", F.lit(key), "kind", "scope", "canonical", F.col("attempt").cast("string")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")),
                         lambda b: F.sha2(F.concat_ws("|", F.col("seed"), b.cast("string")), 256))
    # cut from the blocks, not from one text: linear in the length of a long secret
    df = df.withColumn("values", F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(
        b.substr(i * 4 + 1, F.lit(4)), 16, 10).cast("int")))))
    return _written(_prepared(df)).drop("seed")


def _spaces(df: DataFrame) -> DataFrame:
    """``sizes``, the number of letters at each place, ``space``, their product
    (up to 10^12), and ``shape``, the first value: forms of one kind, scope and
    shape have the same surrogates to choose from."""
    def size(c: Column, i: Column) -> Column:
        out = F.when(F.col("luhn") & (i == F.size("chars") - 1), 1)
        for holds, number, _ in _letters(c, i, F.lit(0)):
            out = out.when(holds, number)
        return out.otherwise(1).cast("bigint")

    octets = F.transform(F.split("canonical", r"\."), lambda o: F.when(F.length(o) == 1, 9).when(F.length(o) == 2, 90).otherwise(156).cast("bigint"))
    df = _prepared(df).withColumn("sizes", F.when(F.col("kind") == "ipv4", octets).otherwise(F.transform("chars", size))) \
        .withColumn("space", F.aggregate("sizes", F.lit(1).cast("bigint"), lambda a, s: F.least(a * s, F.lit(10**12)))) \
        .withColumn("values", F.transform("sizes", lambda s: F.lit(0)))
    hexadecimal = F.col("hexadecimal").cast("string")  # of digits, its first value is that of a number
    return _written(df.withColumn("base", hexadecimal)).withColumn("shape", F.concat_ws("|", "base", "drawn")).drop("base", "drawn")


def _longer() -> Column:
    """A form one place longer: an octet's first digit, or one more letter (digit) in front."""
    octets, first = F.split("canonical", r"\."), F.substring("canonical", 1, 1)
    short = F.array_position(F.transform(octets, lambda o: F.length(o) < 3), True)
    letter = F.when(first.rlike("^[0-9A-Za-zα-ωа-я]$"), first).otherwise("a")
    return F.when(F.col("kind") == "ipv4", F.array_join(F.transform(octets, lambda o, i: F.when(
        i + 1 == short, F.concat(F.lit("1"), o)).otherwise(o)), ".")).otherwise(F.concat(letter, "canonical"))


def _free(left: DataFrame, used: DataFrame, key: str, folder: str) -> DataFrame:
    """(kind, scope, entity, fixed) for every entity left: a value of its form that
    isn't among the used ones (kind, scope, drawn), each given once; when there is
    none any more, one of a longer form. The entities of a form are ranked by a keyed hash."""
    left = left.select("kind", "scope", F.col("canonical").alias("entity"), "canonical", "luhn")
    out, step = None, 0
    while True:
        at = f"{folder}/free-{step}"
        shaped = stored(_spaces(left), at, "left")
        lengths = used.groupBy("kind", "scope", F.length("drawn").alias("size")).agg(F.count("*").alias("taken"))
        forms = shaped.groupBy("kind", "scope", "shape").agg(F.count("*").alias("wanted"), F.first(F.struct("canonical", "luhn", "sizes", "space")).alias("f")) \
            .select("kind", "scope", "shape", "wanted", "f.*").withColumn("size", F.length("canonical"))
        # of wanted + taken values, taken ones at most are in use
        forms = forms.join(lengths, ["kind", "scope", "size"], "left") \
            .withColumn("n", F.least("space", F.col("wanted") + F.coalesce("taken", F.lit(0))))
        chunk = 10_000
        numbers = forms.withColumn("c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / chunk)))) \
            .repartition("kind", "scope", "shape", "c") \
            .withColumn("v", F.explode(F.sequence(F.col("c") * chunk, F.least(F.col("n"), (F.col("c") + 1) * chunk) - 1)))
        start = F.struct(F.col("v").alias("rest"), F.array().cast("array<int>").alias("values"))
        values = F.aggregate("sizes", start, lambda a, s: F.struct(
            F.floor(a["rest"] / s).alias("rest"), F.concat(a["values"], F.array((a["rest"] % s).cast("int"))).alias("values")), lambda a: a["values"])
        # two shapes may share a value: one of them has it
        values = _written(_prepared(numbers.withColumn("values", values))).groupBy("kind", "scope", "drawn").agg(F.min("shape").alias("shape")) \
            .join(used, ["kind", "scope", "drawn"], "left_anti")
        form = Window.partitionBy("kind", "scope", "shape")
        ranked = values.withColumn("rank", F.row_number().over(form.orderBy("drawn")))
        own = F.sha2(F.concat_ws("|", F.lit(key), "kind", "scope", "entity"), 256)
        placed = shaped.withColumn("rank", F.row_number().over(form.orderBy(own, "entity"))) \
            .join(ranked, ["kind", "scope", "shape", "rank"], "left").select("kind", "scope", "entity", "canonical", "luhn", "drawn")
        placed = stored(placed, at, "placed")
        new = placed.where("drawn is not null").select("kind", "scope", "entity", F.col("drawn").alias("fixed"))
        out = new if out is None else out.unionByName(new)
        left = placed.where("drawn is null").withColumn("longer", _longer())
        if left.isEmpty():
            return out
        if not left.where("longer = canonical").isEmpty():
            raise ValueError("more distinct IPv4 addresses than surrogates for them")
        # a longer number is no card number with a check digit
        left = left.select("kind", "scope", "entity", F.col("longer").alias("canonical"), F.lit(False).alias("luhn"))
        used = used.unionByName(new.select("kind", "scope", F.col("fixed").alias("drawn")))
        step += 1


def _poured(kind: Column, match: Column, prefix: Column, drawn: Column) -> Column:
    """The surrogate in the form of the match."""
    rest = match.substr(F.length(prefix) + 1, F.length(match))
    chars = F.filter(F.split(rest, ""), lambda c: c != "")
    compact = F.array_join(F.transform(chars, lambda c, i: F.when(
        c.rlike("^[0-9A-Za-z]$"),
        drawn.substr(F.length(F.regexp_replace(rest.substr(F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c)), "")
    placed = F.array_join(F.transform(chars, lambda c, i: F.when(
        c != F.lower(c), F.upper(drawn.substr(i + 1, F.lit(1)))).otherwise(drawn.substr(i + 1, F.lit(1)))), "")
    # a surrogate of a longer form goes on after the match
    more = drawn.substr(F.length(F.regexp_replace(rest, "[^0-9A-Za-z]", "")) + 1, F.length(drawn))
    tail, last = drawn.substr(F.length(rest) + 1, F.length(drawn)), F.right(rest, F.lit(1))
    return F.concat(prefix, F.when(kind.isin("phone", "card", "ssn", "iban"), F.concat(compact, more))
                    .when(kind.isin("email", "ipv6", "name"), F.concat(placed, F.when(last != F.lower(last), F.upper(tail)).otherwise(tail)))
                    .otherwise(drawn))


def _described(df: DataFrame, match: str = "match") -> DataFrame:
    m = F.col(match)
    return df.withColumn("kind", _type(m)).withColumn("prefix", _prefix(F.col("kind"), m)) \
        .withColumn("scope", F.when(F.col("kind") == "name", _gender(F.col("kind"), F.col("prefix"))).otherwise(
            F.when(F.col("kind").isin("phone", "iban"), F.col("prefix")).otherwise(""))) \
        .withColumn("canonical", _canonical(F.col("kind"), m, F.col("prefix"))) \
        .withColumn("luhn", (F.col("kind") == "card") & F.call_function("luhn_check", "canonical"))


def attempts(entities: DataFrame, key: str, folder: str, draws: int = 30) -> DataFrame:
    """(kind, scope, canonical, attempt, fixed) of the entities that need more than
    the first draw; ``fixed`` is the surrogate itself where drawing found none."""
    own = ["kind", "scope", "canonical", "luhn"]
    real = stored(entities.select(*own).distinct(), folder, "entities")
    names = real.select("kind", "scope", F.col("canonical").alias("drawn")).distinct()
    redrawn = stored(real.limit(0).withColumn("attempt", F.lit(1)), folder, "attempts-0")
    before = None
    for k in range(1, draws + 1):
        state = _drawn(real.join(redrawn, own, "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))), key)
        state = stored(state, folder, f"drawn-{k}")
        same = state.groupBy("kind", "scope", "drawn").agg(F.count("*").alias("n"), F.min("canonical").alias("first")).where("n > 1")
        clash = state.join(same, ["kind", "scope", "drawn"]).where("canonical <> first").select(*own)
        taken = state.join(names, ["kind", "scope", "drawn"], "left_semi").select(*own)
        again = stored(clash.unionByName(taken).distinct(), folder, f"again-{k}")
        n = again.count()
        done = redrawn.select("kind", "scope", "canonical", "attempt", F.lit(None).cast("string").alias("fixed"))
        if n == 0:
            return done
        # hardly fewer than before: their forms have few free values or none
        if k == draws or k >= 6 and 2 * n > before:
            used = state.join(again, own, "left_anti").select("kind", "scope", "drawn").unionByName(names)
            fixed = _free(again, used, key, folder).withColumnRenamed("entity", "canonical")
            return done.join(fixed, ["kind", "scope", "canonical"], "left_anti") \
                .unionByName(fixed.withColumn("attempt", F.lit(0)))
        before = n
        redrawn = stored(state.where("attempt > 0").select(*own, "attempt").join(again, own, "left_anti").unionByName(
            state.join(again, own, "left_semi").select(*own, (F.col("attempt") + 1).alias("attempt"))), folder, f"attempts-{k}")


@clash_free(lambda a: ["n_entities", "entity_types"])
def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with their entities replaced in the text, and with
    n_entities and entity_types (sorted)."""
    folder = work_dir(docs.sparkSession)
    docs = docs.select(*(c for c in docs.columns if c not in ("n_entities", "entity_types")))
    plain = {f"column_{i}": c for i, c in enumerate(docs.columns)}  # no name can clash below
    own = next(k for k, c in plain.items() if c == text)
    renamed = docs.toDF(*plain)
    # every entity holds one of these; a search for them is much cheaper
    may = F.col(own).rlike("[0-9@=:]") | F.col(own).contains("AKIA") | F.col(own).contains("sk-") | F.col(own).rlike("gh[pousr]_")
    for title in f"{_TITLES_F}|{_TITLES_M}".split("|"):
        may = may | F.col(own).contains(title)
    has = F.coalesce(may & F.col(own).rlike(PATTERN), F.lit(False))
    found = renamed.where(has).withColumn("row", F.monotonically_increasing_id()) \
        .withColumn("matches", F.regexp_extract_all(own, F.lit(PATTERN), F.lit(0))) \
        .withColumn("parts", F.split(own, PATTERN, -1))
    found = stored(found, folder, "found")
    each = _described(found.select("row", F.posexplode("matches").alias("pos", "match")))
    redrawn = attempts(each, key, folder)
    replaced = _drawn(each.join(redrawn, ["kind", "scope", "canonical"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0))), key) \
        .withColumn("drawn", F.coalesce("fixed", "drawn")) \
        .withColumn("new", _poured(F.col("kind"), F.col("match"), F.col("prefix"), F.col("drawn")))
    by_row = replaced.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"),
                                         F.array_sort(F.collect_set("kind")).alias("types"))
    text_now = F.array_join(F.flatten(F.zip_with("parts", F.concat("new", F.array(F.lit(""))), lambda p, n: F.array(p, n))), "")
    changed = found.join(by_row, "row").withColumn(own, text_now)
    untouched = renamed.where(~has).withColumns({"matches": F.array().cast("array<string>"), "types": F.array().cast("array<string>")})
    both = changed.select(*plain, "matches", "types").unionByName(untouched.select(*plain, "matches", "types"))
    return both.select(*(F.col(k).alias(c) for k, c in plain.items()), F.size("matches").cast("bigint").alias("n_entities"),
                       F.col("types").alias("entity_types"))
