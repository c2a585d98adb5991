"""Pattern rules that relabel normal requests as anomalous.

Rules are data: a literal table and a regex table. The hit test is one
projection (no join, no shuffle); the hit report explodes the matching
patterns of each row and aggregates them with a map-side partial count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: relabel literals, in their original order (115 entries,
# some repeated); a request containing any of them is anomalous ------------
RELABEL_LITERALS = [
    "sleep(15)",
    "User-Agent: ( ",
    "User-Agent: ) ",
    "User-Agent: + ",
    "User-Agent: '\"\" ",
    "User-Agent: ' ",
    "User-Agent: \"\" ",
    "User-Agent: any ",
    "User-Agent: any? ",
    "Referer: \"\"'",
    "Referer: <!-- ",
    "Referer: ]]> ",
    "Firefox/70.0\"\" ",
    "Firefox/70.0' ",
    "Firefox/70.0'\"\" ",
    "Firefox/70.0( ",
    "Firefox/70.0) ",
    "Firefox/70.0; ",
    "Firefox/70.0NULL ",
    ".chr(",
    "--",
    "<!--#EXECc%3A%5C",
    "c%3A%2F",
    "..\\",
    "../",
    "/.svn",
    "/.git",
    "Set-cookie%3A+Tamper",
    "%3C%21",
    "boot.ini,XYZABCDEFGHIJ",
    "%5D%5D%3E",
    "${",
    "//",
    "owasp.org",
    "passwd",
    "/blog/Set-cookie",
    "/blog/c%3A%2F",
    "/blog/c%3A%5C",
    "%20-%20Copy",
    "SELECT+SLEEP",
    "ORDER+BY",
    "0W45pz4p",
    "ORDER+BY",
    "zApPX",
    "zApPX107sS",
    "030W45pz4p",
    "/%40",
    "/%22",
    "/%27",
    "/%28",
    "/%29",
    "/%2B",
    "/%2F",
    "/%3B",
    "/%40",
    "/%7C",
    "/%5C",
    "/blog%25",
    "/blog%26",
    "/blog%27",
    "/blog%3B",
    "/blog%60",
    "/blog%7C",
    "/blog+%2F",
    "/blog/%00",
    "/blog/%22",
    "/blog%22/blog/%27",
    "/blog/%28",
    "/blog/%2B",
    "/blog/%2F",
    "/blog/%3C",
    "/blog/%40",
    "/blog/%5C",
    "/blog/%7C",
    "/blog/index.php%22",
    "/blog/index.php/%24/blog/index.php%25",
    "/blog/index.php%26",
    "/blog/index.php%27",
    "/blog/index.php%3B",
    "/blog/index.php%60",
    "/blog/index.php%7C",
    "/blog/index.php%29",
    "/blog/index.php+%2F",
    "/blog/index.php/%00",
    "/blog/index.php/%22",
    "/blog/index.php/%27",
    "/blog/index.php/%28",
    "/blog/index.php/%2F",
    "/blog/index.php/%3C",
    "/blog/index.php/%5C",
    "/blog/index.php/2020%22",
    "/blog/index.php/2020%25",
    "/blog/index.php/2020%25",
    "/blog/index.php/2020%26",
    "/blog/index.php/2020%27",
    "/blog/index.php/2020%3B",
    "/blog/index.php/2020%60",
    "/blog/index.php/2020%7C",
    "/blog/index.php/2020+%2F",
    "/blog/index.php/2020/%00",
    "/blog/index.php/2020/%22",
    "/blog/index.php/2020/%27",
    "/blog/index.php/2020/%28",
    "/blog/index.php/2020/%2F",
    "/blog/index.php/2020/%3C",
    "/blog/index.php/2020/%5C",
    "/blog/index.php/2020/03%",
    "/blog/index.php/2020/03/23%",
    "/blog/index.php/2020/03/27/%",
    "/blog/index.php/2020/03/22+%2F",
    "/blog/index.php/2020/03/22%",
    "/blog/index.php/2020/03/27/qui-ratione-maxime-dolores-consequatur/%,%00",
    "/blog/index.php/2020/04/%",
    "/blog/index.php/2020/04/%",
    "/blog/index.php/2020/04/04%",
]

# The two intended regex rules (search semantics). The first is
# the encoded-character fuzzing rule, the second the backup-file rule; the
# backup rule's nested ``(/.+)+`` is written ``/.+`` (same matches, no
# catastrophic backtracking in Java regex).
RELABEL_REGEXES = [
    r"(GET|POST|PUT)\s(/[^\n?]*?)([+/])?%(20|22|24|25|26|27|28|3B|60|7C|2F|00|2B|3C|40|5C|28|29).*HTTP/",
    r"/.+(\.bak|\.backup|\.log|\.swp|~|\.old)\s",
]
# -----------------------------------------------------------------------------
RULES_AT_ONCE = 90


def distinct_literals(literals: list[str] | None = None) -> list[str]:
    """Distinct literals in first-seen order."""
    return list(dict.fromkeys(literals or RELABEL_LITERALS))


def minimal_literals(literals: list[str] | None = None) -> list[str]:
    """Drop every literal that contains a shorter one: the any-hit result is
    the same and the per-row test gets shorter."""
    lits = distinct_literals(literals)
    return [p for p in lits if not any(q != p and q in p for q in lits)]


def literal_hit(col: str = "request", literals: list[str] | None = None) -> Column:
    """P10: any literal is a substring (``exists`` over an array literal keeps
    the generated code small, unlike a chain of 100 ``contains``)."""
    lits = minimal_literals(literals)
    arr = F.array(*[F.lit(x) for x in lits])
    return F.exists(arr, lambda p: F.col(col).contains(p))


def regex_hit(col: str = "request") -> Column:
    """Any regex rule finds a match (search, not full match)."""
    out = F.lit(False)
    for r in RELABEL_REGEXES:
        out = out | F.col(col).rlike(r)
    return out


def pattern_hit(col: str = "request") -> Column:
    """P10 or P11; the cheap literal test comes first and short-circuits."""
    return F.coalesce(literal_hit(col) | regex_hit(col), F.lit(False))


def relabel(df: DataFrame) -> DataFrame:
    """``anomalous=1`` where it was 0 and a rule hits; ``ano_class`` kept.

    Adds ``relabelled`` (true for the rows changed here) so the mislabeled
    list (K2/J4) and the summary (A19) come from the same projection.
    """
    hit = (F.col("anomalous") != 1) & pattern_hit("request")
    return (df.withColumn("relabelled", F.coalesce(hit, F.lit(False)))
              .withColumn("anomalous", F.when(F.col("relabelled"), F.lit(1))
                          .otherwise(F.col("anomalous")).cast("int")))


def mislabeled_indexes(relabelled: DataFrame) -> DataFrame:
    """Index list of the relabelled rows (written as its own table, K2)."""
    return relabelled.filter("relabelled").select("original_index")


def mislabeled_rows(df: DataFrame, index_list: DataFrame) -> DataFrame:
    """Rows of ``df`` whose index is in ``index_list`` (left semi join;
    AQE broadcasts the list when its runtime size is small)."""
    return df.join(index_list.select("original_index"), "original_index", "left_semi")


def relabel_summary(relabelled: DataFrame) -> DataFrame:
    """Number of relabelled rows and their share of all rows."""
    return relabelled.agg(
        F.count_if(F.col("relabelled")).alias("relabelled"),
        F.count(F.lit(1)).alias("total"),
    ).withColumn("share", F.round(F.col("relabelled") / F.col("total"), 6))


def pattern_hit_counts(df: DataFrame, col: str = "request") -> DataFrame:
    """How many rows each rule hits (distinct literals and regexes).

    No join and no row per hit: every rule is a conditional count in one
    aggregate (generated code, one row a task before the shuffle), whose few
    numbers become rows at the end. ``RULES_AT_ONCE`` rules share a pass, as
    wider aggregates leave generated code.
    """
    rules = [("literal", p, F.col(col).contains(p)) for p in distinct_literals()] + [("regex", r, F.col(col).rlike(r)) for r in RELABEL_REGEXES]
    out = None
    for at in range(0, len(rules), RULES_AT_ONCE):
        some = rules[at:at + RULES_AT_ONCE]
        counts = df.agg(*[F.count_if(hit).alias(f"n{i}") for i, (_, _, hit) in enumerate(some)])
        rows = counts.select(F.inline(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(p).alias("pattern"), F.col(f"n{i}").alias("hits"))
                                                for i, (kind, p, _) in enumerate(some)]))).filter("hits > 0")
        out = rows if out is None else out.unionByName(rows)
    return out
