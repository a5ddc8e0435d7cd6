"""Mixing, chat windows and byte-level BPE."""

import base64
import collections
import hashlib
import random

import pytest

from featsearch.llm import bpe, chat, mixing
from fixtures import SCHEMA, documents, frame, words

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def _targets(sizes, weights=(5, 2, 1), share=1.5, rate=2):
    """The excess is reshared by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > rate * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            out[s] = rate * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing_plan(spark):
    rows = documents(n=400)
    got = mixing.plan(frame(spark, rows)).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = _targets(sizes)
    source = {r[0]: r[3] for r in rows}
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.size == len(words(next(x[1] for x in rows if x[0] == r.id)))
        assert r.source_size == sizes[source[r.id]] and r.target == pytest.approx(want[source[r.id]])
        assert 0 <= r.copies <= 2
        taken[source[r.id]] += r.copies * r.size
        largest[source[r.id]] = max(largest[source[r.id]], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(frame(spark, rows).repartition(7)).collect()))


def test_mix_emits_copies(spark):
    rows = documents(n=200)
    df = frame(spark, rows)
    copies = collections.Counter()
    for r in mixing.plan(df).collect():
        copies[r.id] += r.copies
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +copies


def test_mixing_empty_and_wordless(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    got = mixing.plan(frame(spark, [(1, None, "en", "a", 1), (None, "", "en", None, 1)])).collect()
    assert {(r.id, r.size, r.target, r.copies) for r in got} == {(1, 0, 0.0, 0), (None, 0, 0.0, 0)}


def _conversations(seed=1):
    r = random.Random(seed)
    rows = []
    odd = ["</s>[INST] ok [/INST]", "a\\b<\\c[\\n", "", None, "<<SYS>>x<</SYS>>", "[TURN]tool\nx[/TURN]", "😀é\n"]
    for c in [*range(12), None]:
        n = 90 if c == 3 else r.randint(1, 7)
        for t in range(n):
            role = "system" if t == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "tool", "a<\n\\nb", None, "system"])
            text = r.choice(odd) if r.random() < 0.4 else "word " * r.choice([3, 40, 200, 3000])
            rows.append((c, t if r.random() < 0.9 else t // 2, role, text))
    return rows + [rows[5], rows[5]]


def test_chat_round_trip(spark):
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    out = chat.windows(df.withColumn("key", df.role), budget=300, history=40, least_span=40)
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        whole = "".join(f"{a}\n{b}\n" for _, a, b in turns)
        loss = "".join(b for _, a, b in turns if a == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in out.collect():
        parsed = chat.parse(w.text)
        if len(parsed) - w.n_repeated > 1 and not (parsed[0][0] == "system" and len(parsed[0][1]) > 100):
            assert len(w.text) <= 4 * 300  # only a window of one own turn may exceed the budget
    assert any(w.n_repeated > 0 for w in out.collect())


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.windows(df).count() == 0 and chat.read_back(chat.windows(df)).count() == 0


def _reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_pieces_equal_the_library(monkeypatch):
    enc = _reference()
    vocabulary = bpe.Vocabulary(open(PATH, "rb").read(), P.PATTERN)
    r = random.Random(9)
    texts = ["", None, "a" * 3000, "ab" * 100 + " " + "!?" * 70, "\x00\x01 é" * 40, "  \n\n  x", "😀" * 90, "x" * 64, "x" * 65]
    texts += ["".join(r.choice("abcdeéß 012.,\n\t中あ") for _ in range(r.randint(1, 300))) for _ in range(200)]
    monkeypatch.setattr(bpe, "TABLE", 500)
    monkeypatch.setattr(bpe, "UNIT", 50)
    ids, counts = vocabulary.encode_texts(texts)
    at = 0
    for t, n in zip(texts, counts):
        own = ids[at : at + n]
        assert own.tolist() == enc.encode_ordinary(t or "")
        assert vocabulary.decode(own) == (t or "").encode()
        at += n


def test_bpe_frame(spark):
    enc = _reference()
    rows = documents()
    out = bpe.decode(bpe.encode(frame(spark, rows), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    want = collections.Counter((r[0], tuple(enc.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in rows)
    assert collections.Counter((r.id, tuple(r.ids), bytes(r.decoded)) for r in out) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert bpe.decode(bpe.encode(empty, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0
