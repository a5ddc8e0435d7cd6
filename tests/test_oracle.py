"""Spark queries vs their DuckDB twins on sf0.001 (the driver checks sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from featsearch.sources.tables import TABLES
from conftest import SF001

FAST = [
    "rng_u32", "population_init", "stratified_split", "scaler_fit", "scaler_apply", "dataset_load",
    "one_hot_encode", "label_encode", "level_dictionary", "prepare_orders", "prepare_without_ids",
    "sparse_centroid", "feature_subset", "fitness_population", "fitness_single",
    "metrics_confusion", "selection_topk", "generation_best", "crossover_onepoint", "crossover_multipoint",
    "mutation", "mutation_drift", "mating", "next_population", "population_diversity", "ga_generation",
    "random_search", "stop_rule", "forward_selection_round", "ga_search",
]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", FAST)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF001)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _digest(df.columns, srows) == _digest(ocols, orows)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "score" in df.columns
