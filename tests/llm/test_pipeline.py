"""The pipeline against a plain-Python version, and the queries' oracles."""

import collections
import hashlib

import pytest

import corpus_pipeline
from featsearch.llm import mixing, quality
from featsearch.llm import queries as llm
from fixtures import CLASH, SCHEMA, documents, frame, near_classes
from test_tokens import _reference


def test_pipeline_brute_force(spark, tmp_path):
    rows = documents(seed=6, n=150)
    frame(spark, rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ledger = {r.id: r.failed for r in quality.ledger(frame(spark, rows)).collect()}
    rows = [r for r in dict.fromkeys(rows) if not ledger[r[0]] & quality.mask(quality.POLICIES["v1"])]
    largest = {}
    for r in rows:
        largest[r[1] or ""] = max(r[0], largest.get(r[1] or "", -1))
    rows = [r for r in rows if largest[r[1] or ""] == r[0]]
    classes, _ = near_classes(rows)
    rows = [r for r, c in zip(rows, classes) if r[0] == c]
    copies = {r.id: r.copies for r in mixing.plan(frame(spark, rows)).collect()}
    enc, want = _reference(), collections.Counter()
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += copies[r[0]]
    assert got == +want


def test_stages_keep_columns_and_take_empty_tables(spark):
    df = frame(spark)
    empty = spark.createDataFrame([], SCHEMA)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, "")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == df.columns and set(CLASH) <= set(out.columns)
        assert stage(spark, empty, "").count() == 0
    nulls = spark.createDataFrame([(None,) * 5, (None,) * 5, (1, None, None, None, None)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, nulls, "").collect()


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_oracles(spark, name):
    import duckdb

    from conftest import SF001

    con = duckdb.connect()
    for t in ("documents",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = llm.SPARK[name](spark, SF001)
    cur = con.execute(llm.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = collections.Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in cur.fetchall())
    got = collections.Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())
    assert sorted(df.columns) == sorted(names) and got == want
