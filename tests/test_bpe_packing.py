"""BPE rounds against a plain Python BPE; packing keeps every token once."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from reqlens.operators import bpe, packing


def _python_bpe(words: Counter, num_merges: int):
    """One merge at a time."""
    syms = {w: list(w) for w in words}
    merges = []
    while len(merges) < num_merges:
        pc = Counter()
        for w, f in words.items():
            for a, b in zip(syms[w], syms[w][1:]):
                pc[(a, b)] += f
        if not pc:
            break
        a, b = min(pc, key=lambda p: (-pc[p], p))
        merges.append((a, b))
        for w in syms:
            out = []
            for s in syms[w]:
                if out and (out[-1], s) == (a, b):
                    out[-1] = a + b
                else:
                    out.append(s)
            syms[w] = out
    return merges


def test_bpe_matches_python(spark):
    r = random.Random(1)
    texts = ["GET /index.html HTTP/1.1", "GET /index.php?id=1 HTTP/1.1", "POST /login HTTP/1.1",
             "GET /images/logo.png HTTP/1.1", "hello hello help helm"]
    texts += [" ".join("".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 4))) for _ in range(40))]
    df = spark.createDataFrame([(t,) for t in texts], "request string")
    merges, vocab = bpe.learn(df, num_merges=25)
    got = [(x.left, x.right) for x in merges.orderBy("rank").collect()]
    words = Counter(w for t in texts for w in re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]", t))
    assert got == _python_bpe(words, 25)
    assert vocab.filter(F.col("kind") == "merge").count() == len(set(a + b for a, b in got))


def test_packing_keeps_every_token(spark):
    rows = [(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate([5, 9, 3, 12, 1, 7, 20, 2], start=1)]
    df = spark.createDataFrame(rows, "original_index long, ids array<int>")
    out = packing.pack(df, "ids", block_size=16, batch_rows=3, sep_id=None, truncate=True).collect()
    seen = [x for r in out for x, m in zip(r.input_ids, r.attention_mask) if m == 1]
    expected = [x for _, ids in rows for x in (ids if len(ids) <= 16 else ids[:16])]
    assert sorted(seen) == sorted(expected)
    assert all(len(r.input_ids) == 16 and sum(r.attention_mask) <= 16 for r in out)
    assert {r.batch for r in out} == {0, 1, 2}


def test_packing_splits_long_samples(spark):
    rows = [(i, list(range(i * 100, i * 100 + n))) for i, n in enumerate([5, 40, 9, 16, 15, 32, 3, 0, 33], start=1)]
    df = spark.createDataFrame(rows, "original_index long, ids array<int>")
    out = packing.pack(df, "ids", block_size=16, batch_rows=4, sep_id=7).orderBy("batch", "block").collect()
    seen = [x for r in out for x, m in zip(r.input_ids, r.attention_mask) if m == 1]
    assert seen == [x for _, ids in rows for x in [*ids, 7]]
    assert all(len(r.input_ids) == 16 and r.n_samples > 0 for r in out)
    assert all(len(r.labels) == 16 and r.labels[:sum(r.attention_mask)] == r.input_ids[:sum(r.attention_mask)] for r in out)


def test_pack_sequences_keeps_long_documents(spark, tmp_path):
    from reqlens.plans.q_tokens import q_pack_sequences
    spark.createDataFrame([(1, "ab " * 5000, "en", "s", 15000), (2, "ab cd", "en", "s", 5)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = q_pack_sequences(spark, str(tmp_path)).collect()
    assert len(out) == 2 and sum(sum(r.attention_mask) for r in out) > 5000
