"""Exact, n-gram and substring dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featsearch.llm import exact_dedup, jaccard, substring_dedup
from fixtures import SCHEMA, documents, frame, near_classes, words


@pytest.mark.parametrize("hash128", [F.md5, lambda c: F.substring(F.md5(c), 1, 1)], ids=["md5", "colliding"])
def test_exact_classes(spark, hash128):
    rows = documents() + [(None, "one two", "en", "x", 1), (None, "lonely text", "en", "x", 1)]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for r in rows:
        ids = [i for i in groups[r[1] or ""] if i is not None]
        keep = max(ids) if ids else None
        want.append((r[0], keep, len(groups[r[1] or ""]), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    got = exact_dedup.classes(frame(spark, rows), keep="largest", hash128=hash128).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_exact_survivors_keep_all_columns(spark):
    df = frame(spark)
    out = exact_dedup.survivors(df, keep="smallest")
    assert out.columns == df.columns
    by = {}
    for r in documents():
        by.setdefault(r[1] or "", []).append(r[0])
    assert sorted(r.doc_id for r in out.collect()) == sorted(min(v) for v in by.values())
    assert all(r.h == "h" for r in out.collect())
    # the only text of its group may be null, and stays null
    lone = frame(spark, [(1, None, "en", "s", 1), (2, "a", "en", "s", 1)])
    assert {r.doc_id: r.text for r in exact_dedup.survivors(lone).collect()} == {1: None, 2: "a"}


def test_exact_survivors_prefer_rows_with_an_id(spark):
    rows = [(None, "t", "a", "s", 1), (4, "t", "b", "s", 1), (9, "t", "c", "s", 1)]
    for keep, want in (("smallest", 4), ("largest", 9)):
        assert [r.doc_id for r in exact_dedup.survivors(frame(spark, rows), keep=keep).collect()] == [want]


def test_jaccard_classes(spark):
    rows = documents(seed=8, n=120)
    classes, sets = near_classes(rows)
    want = collections.Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, classes))
    got = jaccard.classes(frame(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_jaccard_group_of_near_copies_in_blocks(spark, monkeypatch):
    """A frequent column is cut in blocks; the group is one class all the same."""
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        w[(7 * i) % 60] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    got = jaccard.classes(frame(spark, rows)).collect()
    classes, _ = near_classes(rows)
    assert {r.id: r.component_id for r in got} == {r[0]: c for r, c in zip(rows, classes)}


def test_jaccard_few_sets_in_many_blocks(spark, monkeypatch):
    """Exact copies raise a column's count, so its few sets may be alone in their blocks."""
    rows = []
    for g in range(24):
        base = [f"g{g}w{i}" for i in range(60)]
        texts = [" ".join(base)] * 20
        for k in range(1 + g % 3):  # one to three near copies
            texts.append(" ".join([*base[: 58 - k], f"g{g}x{k}", *base[59 - k :]]))
        rows += [(100 * g + i, t, "en", "s", 1) for i, t in enumerate(texts)]
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = jaccard.classes(frame(spark, rows)).collect()
    assert {r.id: r.component_id for r in got} == {r[0]: 100 * (r[0] // 100) for r in rows}


def test_jaccard_keep_one(spark):
    rows = [r for r in documents(seed=8, n=120)]
    classes, _ = near_classes(rows)
    out = jaccard.keep_one(frame(spark, rows))
    assert {r.doc_id for r in out.collect()} == set(classes)
    assert out.columns == frame(spark, rows).columns


def _brute_spans(rows):
    least = {}
    for i, text, *_ in rows:
        w = words(text)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, 1 << 62), i if i is not None else 1 << 62)
    out = []
    for i, text, *_ in rows:
        w, gone = words(text), set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < (i if i is not None else 1 << 62):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_substring(spark):
    rows = documents(seed=2, n=120) + [(None, documents(seed=2, n=120)[1][1], "en", "s", 1)]
    got = substring_dedup.dedup(frame(spark, rows)).select("id", "n_words", "n_removed", "kept").collect()
    want = _brute_spans(rows)
    assert sum(w[2] for w in want) > 0
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)


def test_substring_survives_a_full_bit_table(spark, monkeypatch):
    """A bit table that lets everything through changes no result."""
    full = np.full(1 << (substring_dedup.BITS - 6), np.iinfo(np.uint64).max)
    monkeypatch.setattr(substring_dedup, "bit_table", lambda shared: full)
    rows = documents(seed=2, n=60)
    got = substring_dedup.dedup(frame(spark, rows)).select("id", "n_words", "n_removed", "kept").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(_brute_spans(rows))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for f in (exact_dedup.classes, exact_dedup.survivors, jaccard.classes, jaccard.keep_one, substring_dedup.dedup):
        assert f(empty).count() == 0


def test_sketches_never_exclude_similar_sets(spark):
    """Differing bits are at most the differing shingles, also between sizes."""
    import numpy as np
    from pyspark.sql import functions as F

    r = np.random.default_rng(4)
    rows, want = [], []
    for i in range(400):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 900), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * r.uniform(0.5, 1)))], r.integers(0, 2**63, r.integers(0, 90), dtype=np.uint64)]))
        if 100 * min(len(a), len(b)) < 75 * max(len(a), len(b)):
            continue
        rows.append((len(want), jaccard._sketch(a).tolist(), jaccard._sketch(b).tolist(), len(a), len(b)))
        both = len(np.intersect1d(a, b))
        want.append(100 * both >= 75 * (len(a) + len(b) - both))
    df = spark.createDataFrame(rows, "i long, sx array<long>, sy array<long>, a long, b long")
    kept = {x.i for x in df.where(jaccard._may_be_similar(*map(F.col, ("sx", "sy", "a", "b")), 75)).collect()}
    assert {i for i, w in enumerate(want) if w} <= kept < set(range(len(want)))


def test_many_unrelated_texts_share_a_passage(spark):
    """A column of many components: all are left alone but the near copies."""
    import random

    r = random.Random(12)
    passage = " ".join(f"common{i}" for i in range(12))
    rows = []
    for i in range(150):
        own = [f"w{r.randrange(10**6)}" for _ in range(25)]
        rows.append((i, passage + " " + " ".join(own), "en", "s", 1))
        if i % 10 == 0:
            rows.append((1000 + i, passage + " " + " ".join(own[:-1]), "en", "s", 1))
    want, _ = near_classes(rows)
    got = {x.id: x.component_id for x in jaccard.classes(frame(spark, rows)).collect()}
    assert [got[x[0]] for x in rows] == want and want[1] == 0


def test_keep_one_without_clashing_names(spark):
    from pyspark.sql import functions as F

    rows = documents(n=20)
    df = frame(spark, rows).withColumns({"__id": F.lit(1), "own": F.lit(2), "row_": F.lit(3)})
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want, _ = near_classes(rows)
    assert sorted({x.doc_id for x in kept.collect()}) == sorted({w for w in want if w is not None})


def test_columns_of_the_same_sets_fold(spark):
    """Passages shared by the same texts are one weighted column; links near the bound stay."""
    import random

    r = random.Random(5)
    passages = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(3)]
    rows = []
    for i in range(60):
        own = " ".join(f"o{r.randrange(10**6)}" for _ in range(r.randrange(2, 40)))
        rows.append((i, " ".join([*r.sample(passages, r.randrange(1, 4)), own]), "en", "s", 1))
    df = frame(spark, rows)
    want, sets = near_classes(rows)
    assert len(set(want)) not in (1, len(rows))
    assert {x.id: x.component_id for x in jaccard.classes(df).collect()} == {x[0]: w for x, w in zip(rows, want)}
    posted = jaccard.shared_postings(jaccard.postings(df, jaccard.frequent(jaccard.survey(df))))
    folded = posted.groupBy("col").agg(F.sort_array(F.collect_set("node")).alias("sets"), F.min("weight").alias("w")).collect()
    assert len({tuple(x.sets) for x in folded}) == len(folded) and max(x.w for x in folded) > 1


def test_frequent_columns_are_the_largest(spark):
    rows = [(c, 1 + c // 10) for c in range(1000)]
    df = spark.createDataFrame(rows, "col long, n long")
    keys, order, counts = jaccard.frequent(df, top=200)
    assert 150 <= len(keys) <= 260 and sorted(keys) == list(keys)
    assert counts.min() >= 80 and counts[np.argmax(order)] == 100
    assert len(jaccard.frequent(df, top=5000)[0]) == 1000
    assert len(jaccard.frequent(df.where("n < 0"))[0]) == 0


def test_keep_one_null_ids(spark):
    """A component keeps its smallest id, one without ids one of its rows."""
    r = random.Random(8)
    a, b, lonely = (" ".join(r.choice("abcdefghij") + str(r.randrange(99)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (None, a), (None, a + " more"), (None, b), (None, b), (None, b + " x"), (None, lonely), (None, ""), (None, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((x.doc_id, x.text) for x in jaccard.keep_one(df).collect()), key=str)
    named = [k for k in kept if k[0] is not None]
    texts = [k[1] for k in kept if k[0] is None]
    assert sorted(named) == [(1, a), (7, " ")]
    assert texts.count("") == 1 and texts.count(None) == 1 and texts.count(lonely) == 1
    assert sum(t in (b, b + " x") for t in texts) == 1 and len(texts) == 4


def test_substring_rows_without_ids_are_told_apart(spark):
    """Two texts of one crc32 and no id: what is removed from one stays in the other."""
    import zlib

    r = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(20))
    own = " ".join(f"q{i}" for i in range(32))
    seen, pair = {}, None
    while pair is None:
        tail = str(r.getrandbits(60))
        seen[zlib.crc32(f"{passage} tail {tail}".encode())] = f"{passage} tail {tail}"
        other = f"{own} {r.getrandbits(60)}"
        if zlib.crc32(other.encode()) in seen:
            pair = seen[zlib.crc32(other.encode())], other
    df = spark.createDataFrame([(1, passage), (None, pair[0]), (None, pair[1])], "doc_id long, text string")
    got = sorted((x.n_words, x.n_removed) for x in substring_dedup.dedup(df).where("id is null").collect())
    assert got == [(22, 20), (33, 0)]
    with pytest.raises(TypeError, match="whole number"):
        substring_dedup.dedup(df.selectExpr("'a' as doc_id", "text"))


def test_texts_of_sets_move_packed(spark):
    from featsearch.llm.shingles import shingle_set

    texts = [" ".join(f"word{i * k} größe" for i in range(200)) for k in range(1, 6)] + ["", None]
    rows = [(i, t) for i, t in enumerate(texts + texts)]
    ids = [jaccard._node(shingle_set(t)) for t in texts[:4]]
    got = jaccard.whole_sets(spark.createDataFrame(rows, "id int, text string"), spark.createDataFrame([(i,) for i in ids], "node long"))
    got = {r.node: bytes(r.text) for r in got.collect()}
    assert {n: jaccard._unpacked(t) for n, t in got.items()} == dict(zip(ids, texts))
    assert sum(map(len, got.values())) * 2 < sum(len(t.encode()) for t in texts[:4])
