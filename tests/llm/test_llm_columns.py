"""Columns that clash with results (in any case), hold dots or come twice, and the
whole pipeline on rows with nulls, repeats and such columns."""

import random

import pytest
from pyspark.sql import functions as F

from reqlens.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality, substring_dedup, surrogates

P = pytest.importorskip("public_tokenizers")
NAMES = ["doc_id", "text", "a.b", "SCORE", "N_WORDS", "n_hit", "Kept", "N_LINES", "n_removed", "N_Entities", "N_TOKENS", "x`y", "ids"]


def odd(spark, texts):
    rows = [(i, t, *range(len(NAMES) - 2)) for i, t in texts]
    schema = "doc_id bigint, text string, " + ", ".join(f"c{i} int" for i in range(len(NAMES) - 2))
    return spark.createDataFrame(rows, schema).toDF(*NAMES)


TEXTS = [(1, "one two three four five six\nseven"), (2, "one two three four five six\nseven"), (None, "x"), (3, None), (4, "Mr Ivan Berg\n\nx@y.example")]


def operators(spark):
    items = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    model = (quality.np.zeros(1 << quality.Settings().feature_bits, quality.np.float32), 0.0)
    return {
        "quality": (lambda d: quality.score(d, model), ["score"]),
        "decontaminate": (lambda d: decontaminate.contamination(d, items), ["n_words", "n_hit", "spans", "item_ids", "contaminated"]),
        "bpe": (lambda d: byte_bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True), ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]),
        "lines": (lambda d: line_dedup.strip_lines(d, counts=True), ["n_lines", "n_removed", "n_near"]),
        "near": (near_dedup.deduplicate, []),
        "substrings": (substring_dedup.strip, ["n_words", "n_removed", "kept"]),
        "surrogates": (lambda d: surrogates.replace(d, "key"), ["n_entities", "entity_types"]),
    }


@pytest.mark.parametrize("name", ["quality", "decontaminate", "bpe", "lines", "near", "substrings", "surrogates"])
def test_clashing_columns(spark, name):
    run, added = operators(spark)[name]
    out = run(odd(spark, TEXTS))
    taken = {a.lower() for a in added}
    assert [c for c in out.columns if c not in added] == [c for c in NAMES if c.lower() not in taken and (name != "bpe" or c != "text")]
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert len(rows) == (4 if name == "near" else 5)
    assert {r["x`y"] for r in rows} == {9} and {r["a.b"] for r in rows} == {0}


def test_columns_given_twice(spark):
    df = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id bigint, text string, p int, q int").toDF("doc_id", "text", "z", "z")
    assert quality.score(df, (quality.np.zeros(1 << quality.Settings().feature_bits, quality.np.float32), 0.0)).columns == ["doc_id", "text", "z", "z", "score"]


def corpus(r):
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for _ in range(400)]
    texts = [" ".join(r.choice(words) for _ in range(60)) + "\nshared footer line of all pages" for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100, texts[0]), (101, texts[1].replace("\n", " zz\n")), (102, None), (103, ""), (None, texts[2]), (5, texts[5])]
    item = " ".join(r.choice(words) for _ in range(13))
    rows += [(110, item + "\n" + item)]
    return rows, item


def test_pipeline_runs_over_odd_rows(spark, tmp_path):
    import corpus_pipeline
    rows, item = corpus(random.Random(8))
    extra = spark.createDataFrame([(i, t, "l", "s", 1, 2, 3) for i, t in rows],
                                  "doc_id bigint, text string, lang string, source string, n_chars int, p int, q int") \
        .toDF("doc_id", "text", "lang", "source", "n_chars", "a.b", "N_WORDS")
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [x.doc_id for x in got]
    assert 110 not in ids and 101 not in ids  # benchmark, near copy
    assert [x.n_tokens for x in got if x.doc_id == 100] == [0]  # all lines of an exact copy are repeats
    assert set(range(40)) <= set(ids) and ids.count(5) == 2 and None in ids  # clean documents, repeated rows, no id
    assert {x["a.b"] for x in got} == {2} and {x["N_WORDS"] for x in got} == {3}
    assert all(len(x.ids) == x.n_tokens for x in got)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
