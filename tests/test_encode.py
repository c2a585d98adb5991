"""Encoding with learned merges against a plain Python encoder."""

import random
import re

from reqlens.operators import bpe
from reqlens.operators import tokens as tk

FIXED = ["[r][n]", "[r]", "HTTP/1.1"]


def learned(spark, texts, n=40):
    df = spark.createDataFrame([(t,) for t in texts], "request string")
    merges, vocab = bpe.learn(df, num_merges=n)
    return merges, bpe.token_ids(merges, vocab, FIXED)


def plain_encode(text, merges, ids):
    pattern = "|".join([*(re.escape(t) for t in sorted([*FIXED, *tk.SPECIAL_TOKENS], key=len, reverse=True)), tk.TOKEN_PATTERN])
    out = []
    for word in re.findall(pattern, text or ""):
        if word in FIXED or word in tk.SPECIAL_TOKENS:
            out.append(ids[word])
            continue
        symbols = list(word)
        while True:
            ranks = [merges.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
            if not ranks or min(ranks) == 1 << 30:
                break
            best = min(ranks)
            pair = next(p for p in zip(symbols, symbols[1:]) if merges.get(p) == best)
            done = []
            for s in symbols:
                if done and (done[-1], s) == pair:
                    done[-1] += s
                else:
                    done.append(s)
            symbols = done
        out += [ids.get(s, ids[tk.UNK]) for s in symbols]
    return out


def test_encode_equals_plain_python(spark):
    r = random.Random(2)
    texts = ["GET /index.html HTTP/1.1[r][n]Host: a.example[r][n][r][n]", "aaaa aaa aa a", "hello hello help [PAD] helm"]
    texts += [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(30)) for _ in range(20)]
    merges, vocabulary = learned(spark, texts)
    pairs = {(m.left, m.right): m.rank for m in merges.collect()}
    ids = {v.token: v.id for v in vocabulary.collect()}
    assert sorted(ids.values()) == list(range(len(ids)))  # dense
    assert [ids[t] for t in tk.SPECIAL_TOKENS] == [0, 1, 2, 3, 4]
    other = ["", None, "   ", "héllo ☃ unseen zq9", "[r][n][r]x[n]", "abc" * 400, "a" * 3000 + " b"]
    rows = list(enumerate(texts + other))
    got = {x.original_index: x.ids for x in bpe.encode(
        spark.createDataFrame(rows, "original_index long, request string"), merges, vocabulary, [*FIXED, *tk.SPECIAL_TOKENS]).collect()}
    assert got == {i: plain_encode(t, pairs, ids) for i, t in rows}
    assert got[0].count(ids["[r][n]"]) == 3


def test_encode_without_merges_or_rows(spark):
    merges, vocabulary = learned(spark, ["a b c"], n=5)
    empty = spark.createDataFrame([], "original_index long, request string")
    assert bpe.encode(empty, merges, vocabulary, FIXED).collect() == []
    one = spark.createDataFrame([(1, "c a")], "original_index long, request string")
    assert len(bpe.encode(one, merges, vocabulary, FIXED).first().ids) == 2


def test_hot_words_keep_their_rows(spark, monkeypatch):
    """A word that a third of the rows hold, with and without its own way."""
    texts = [f"GET w{i % 50} x" for i in range(300)]
    merges, vocabulary = learned(spark, texts[:60], n=10)
    df = spark.createDataFrame(list(enumerate(texts)), "original_index long, request string")
    apart = {x.original_index: x.ids for x in bpe.encode(df, merges, vocabulary, FIXED).collect()}
    monkeypatch.setattr(bpe, "HOT_SHARE", 1)
    assert apart == {x.original_index: x.ids for x in bpe.encode(df, merges, vocabulary, FIXED).collect()}


def test_words_are_looked_up_by_partner(spark, monkeypatch):
    """Texts that share a key have the ids of both by position, a null key none; whether words are frequent or not."""
    rows = [(1, "ab cd x"), (1, "x ab"), (2, "cd q"), (2, "cd q"), (None, "ab"), (3, None), (4, "zz ab [r][n]")]
    merges, vocabulary = learned(spark, ["ab cd x q", "ab cd"], n=10)
    df = spark.createDataFrame(rows, "original_index long, request string")
    ids = {v.token: v.id for v in vocabulary.collect()}
    pairs = {(m.left, m.right): m.rank for m in merges.collect()}

    def words(*texts):
        split = [[(i, plain_encode(w, pairs, ids)) for i, w in enumerate(t.split())] for t in texts]
        return [x for _, own in sorted(sum(split, [])) for x in own]
    want = sorted([(1, words("ab cd x", "x ab"))] * 2 + [(2, words("cd q", "cd q"))] * 2 + [(None, []), (3, []), (4, words("zz ab [r][n]"))], key=str)
    for share in (bpe.HOT_SHARE, 6, 1):
        monkeypatch.setattr(bpe, "HOT_SHARE", share)
        out = bpe.encode(df, merges, vocabulary, FIXED)
        assert sorted(((r.original_index, r.ids) for r in out.collect()), key=str) == want


def test_frequent_words_are_not_joined(spark):
    merges, vocabulary = learned(spark, ["a b c"], n=5)
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "original_index long, request string")
    assert "Join" not in bpe.encode(df, merges, vocabulary, FIXED)._jdf.queryExecution().optimizedPlan().toString()  # noqa: SLF001
