"""Each query of the engine against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import catalog
from tests.conftest import DATA


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    r = duck.execute(catalog.oracle_sql()[name])
    theirs = [x[0] for x in r.description]
    assert sorted(theirs) == cols
    want = sorted(repr(tuple(plain(x[theirs.index(c)]) for c in cols)) for x in r.fetchall())
    assert sorted(repr(tuple(plain(x[c]) for c in cols)) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_golden_significance(spark):
    q = catalog.queries()
    t, df = q["a20_welch_test"](spark, DATA).select("t", "df").first()
    assert (round(t, 2), round(df, 2)) == (-11.83, 3.31)
    assert abs(q["a19_one_sample_test"](spark, DATA).first()["p"] - 0.0025) < 5e-4


def test_round_trips(spark):
    q = catalog.queries()
    assert q["q17_byte_shuffle"](spark, DATA).where("NOT same").count() == 0
    assert q["q23_tagged_container"](spark, DATA).where("NOT same").count() == 0
    assert q["q7_gptq"](spark, DATA).where("NOT better").count() == 0
    assert q["t9_smaller_encoding"](spark, DATA).where("NOT same OR (kept = 'base3') <> (base3 <= masks)").count() == 0
    assert q["t4s_pruning_to_budget"](spark, DATA).where("NOT fits OR pruned > units").count() == 0
    assert q["l8p_significant_record"](spark, DATA).first()["accepted"]


def test_bisection_finds_the_least():
    import zlib

    import numpy as np

    from quern.plans.quantization import fitting_prune

    codes = np.random.default_rng(1).choice([0, 1, -1, 5], 4000).astype(np.int8).reshape(40, 100)
    order = np.flatnonzero(np.abs(codes.reshape(-1)) == 1)
    budget = len(zlib.compress(codes.tobytes(), 9)) * 9 // 10
    n, size = fitting_prune(codes, order, budget)
    less = codes.copy()
    less.reshape(-1)[order[: n - 1]] = 0
    assert 0 < n < len(order) and size <= budget < len(zlib.compress(less.tobytes(), 9))
