"""Alignment against plain overlaps of byte ranges."""

import collections
import hashlib
import random

import numpy as np
import pytest

from featsearch.llm import alignment, queries
from fixtures import SCHEMA, documents, frame

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def _overlaps(ends_a, ends_b):
    a, b = [0, *ends_a], [0, *ends_b]
    return {(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if max(a[i], b[j]) < min(a[i + 1], b[j + 1])}


def test_runs_and_groups():
    r = random.Random(2)
    for case in range(300):
        n = r.randint(1, 60)
        common = {k for k in range(1, n) if r.random() < (0.2, 0.6, 0.95, 0.0)[case % 4]}
        ends = [sorted(common | {k for k in range(1, n) if r.random() < 0.1} | {n}) for _ in range(2)]
        link_a, link_b, last_a, last_b = alignment.align(*(np.array(e) for e in ends))
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == sorted(_overlaps(*ends))
        both = sorted(set(ends[0]) & set(ends[1]))
        assert [ends[0][i] for i in last_a] == both and [ends[1][j] for j in last_b] == both


TEXTS = [
    "plain words and <|endoftext|> marks </s> <s>", "two  blanks\n\n\tand \x00 controls", "café naïve 日本語 \U0001f600!", "a▁b", " ",
    "x" * 500, "don't stop 12345 67.8", "ﬁ Å   wide　space", "tail blank ", "\r\n",
]


def _brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    out = []
    for _, text, *_ in rows:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        parts = [[side.tokens[i] for i in x] for side, x in zip((pair.side_a, pair.side_b), ids)]
        if not text or any(b"".join(p) != b" " + text.encode() for p in parts):
            out.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(t) for t in p]).tolist() for p in parts]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [e.index(end) + 1 for e in ends]
            groups.append("|".join(",".join(map(str, x[s:t])) for x, s, t in zip(ids, at, to)))
            at = to
        links, i, j = [], 0, 0
        while i < len(ends[0]):  # next overlap: the token that ends first is done
            links.append((ids[0][i], ids[1][j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
        out.append((*ids, links, ";".join(groups)))
    return out


@pytest.mark.parametrize("lookup", [alignment.LOOKUP, 0])
def test_documents(spark, monkeypatch, lookup):
    rows = documents() + [(500 + i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    want = _brute(rows)
    counts = collections.Counter(link for w in want for link in w[2])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    assert want[len(rows) - len(TEXTS) + TEXTS.index("a▁b")][3] == ""  # not given back
    docs = alignment.aligned(frame(spark, rows), A, B)
    got = alignment.totals(docs, alignment.pair_counts(docs), lookup).collect()
    want = collections.Counter(
        (str(r[0]), len(a), len(b), g.count(";") + 1 if a else 0, len(links), sum(counts[x] == most[x[1]] for x in links),
         sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if a else "")
        for r, (a, b, links, g) in zip(rows, want)
    )
    assert collections.Counter(
        (str(r.id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got
    ) == want


def test_chunks_do_not_matter(monkeypatch):
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    for text in [documents()[66][1], *TEXTS, " ".join(TEXTS)]:
        with monkeypatch.context() as m:
            m.setattr(alignment, "_CUT", alignment.re.compile("(?!)"))
            whole = alignment.document(pair, list(pair.encode([text])))
        pair.forget()
        with monkeypatch.context() as m:
            m.setattr(alignment, "CHUNK", 3)
            parts = alignment.cut(text)
        assert " ".join(parts) == text
        cut = alignment.document(pair, list(pair.encode(parts)))
        assert (whole is None) == (cut is None)
        if whole:
            assert whole[:5] == cut[:5] and (whole[5] == cut[5]).all() and (whole[6] == cut[6]).all()


def test_empty_table_and_query(spark):
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    got = queries.op11_alignment(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    brute = _brute(docs)
    counts = collections.Counter(link for w in brute for link in w[2])
    got = {r.doc_id: r for r in got.collect()}
    for (i, _), (a, b, links, g) in zip(docs, brute):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_links, r.count_sum) == (len(a), len(b), len(links), sum(counts[x] for x in links))
        assert r.groups_sha256 == (hashlib.sha256(g.encode()).hexdigest() if a else "")


def test_words_met_again_are_not_aligned_again(monkeypatch):
    pair = alignment.Pair(open(A, "rb").read(), open(B, "rb").read())
    sizes, whole = [], alignment.align
    monkeypatch.setattr(alignment, "align", lambda a, b: sizes.append(len(a)) or whole(a, b))
    text = "unhappily tokenizers disagree about 12345 words"
    first = [alignment.document(pair, list(pair.encode([t]))) for t in (text, text + " unhappily")]
    once = sum(sizes)
    again = alignment.document(pair, list(pair.encode([" ".join([text] * 50)])))
    assert sum(sizes) == once == first[0][0]
    assert again[:4] == tuple(50 * n for n in first[0][:4])
    assert again[5].tolist() == first[0][5].tolist() and again[6].tolist() == (50 * first[0][6]).tolist()
