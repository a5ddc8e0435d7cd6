"""The n-gram trie: Elias-Fano reads, and scores against plain counts."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsearch.llm import ngram_model, queries
from featsearch.llm.elias_fano import EliasFano, joined, parted
from fixtures import SCHEMA, documents, frame, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 0), (1, 2**63), (5, 3), (700, 40), (3000, 2**40), (70000, 10**6), (300, 2**63)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    (words_,) = parted(np.frombuffer(joined([EliasFano.build(values)]), "<u8"))
    read = EliasFano(words_)
    assert read.length == len(words_)
    assert (read.get(np.arange(n)).astype(np.uint64) == values).all()
    asked = np.concatenate([values, values + 1, r.integers(0, top, 200, dtype=np.uint64, endpoint=True)])
    place, equal = read.successor(asked)
    want = np.searchsorted(values, asked)
    assert (place == want).all()
    assert (equal == (np.append(values, 0)[want] == asked) & (want < n)).all()


def _brute(rows, learn):
    texts = [[*words((t or "").translate(LOW)), None] for _, t, *_ in rows]
    one, two, n_docs = collections.Counter(), collections.Counter(), 0
    for text, on in zip(texts, learn):
        if on:
            n_docs += 1
            one.update(text)
            two.update(zip([0, *text], text))
    total, v, mu = sum(one.values()), len(one), ngram_model.MU
    out = []
    for text in texts:
        p = [(one[w] + 0.1) / (total + 0.1 * (v + 1)) for w in text]
        smoothed = 0.0
        for c, w, base in zip([0, *text], text, p):
            n = n_docs if c == 0 else one[c]
            smoothed += math.log10((two[c, w] + mu * base) / (n + mu))
        out.append((len(text), sum(one[w] > 0 for w in text), sum(map(math.log10, p)), smoothed))
    return out, total


def _check(got, rows, learn):
    want, total = _brute(rows, learn)
    got = sorted(got, key=lambda r: (str(r[0]), r[1:]))
    plan = sorted(zip([r[0] for r in rows], want), key=lambda x: (str(x[0]), x[1]))
    assert len(got) == len(rows)
    for g, (i, (n, known, base, smoothed)) in zip(got, plan):
        assert (g[0], g[1], g[2]) == (i, n, known)
        assert g[3] == pytest.approx(base, abs=1e-6) and abs(g[4] - smoothed) <= n * ngram_model.STEP
    return total


def _held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("shard,block", [(1 << 22, 1 << 20), (300, 500)])
def test_scores(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ngram_model, "BLOCK", block)
    rows = [*documents(), (None, "same words again", None, None, None), (None, None, None, None, None)]
    rows.append((777, "the the the " * 3000, "en", "s", 1))  # a context that no shard holds alone
    df, learn = frame(spark, rows), ~ngram_model.held_out(F.col("doc_id"))
    model = ngram_model.train(df, learn, shard=shard)
    assert model.shards == -(-model.words.n // shard)
    got = ngram_model.score(df, model, learn).collect()
    assert all(r.learn != _held_out(r.id) for r in got)
    total = _check([(r.id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], rows, [not _held_out(r[0]) for r in rows])
    assert model.words.n == total


def test_nothing_to_learn_and_empty_table(spark):
    rows = documents()[:5]
    df = frame(spark, rows)
    model = ngram_model.train(df, F.lit(False))
    got = ngram_model.score(df, model, F.lit(False)).collect()
    assert [(r.n_known, r.base_score, r.score) for r in got] == [(0, 0, 0)] * 5
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_model.score(empty, ngram_model.train(empty, F.lit(True)), F.lit(True)).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_ngrams(spark, "/root/testdata/sf0.001")
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    total = _check([(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got], rows, [not _held_out(r[0]) for r in rows])
    assert {r.train_tokens for r in got} == {total} and all(r.held_out == _held_out(r.doc_id) for r in got)
