"""Every query with SQL gives the rows of its SQL."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from cinderloom.operators import mixture
from cinderloom.plans import queries
from cinderloom.plans.oracle import ORACLE_SQL
from cinderloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


def test_kpp_fits_are_the_best_of_their_restarts(spark):
    """Each restart by itself, over all markers; the size comes from the sizes' best fits."""
    got = {r.snp_id: r for r in QUERIES["kpp_fits"](spark, SF).collect()}
    rows = queries.points(spark, SF).collect()
    x, y = (np.array([r[c] for r in rows]) for c in ("x", "y"))
    cfg, best = queries.CFG, {1: mixture.single(x, y).loglik}
    for k in (2, 3):
        starts = [mixture.spread_centres(x, y, k, cfg.seed, r) for r in range(cfg.restarts)]
        best[k] = np.max([mixture.expectation_maximisation(x, y, s, cfg.max_iters, cfg.tol).loglik for s in starts], 0)
    assert got.keys() == {r.snp_id for r in rows}
    for i, r in enumerate(rows):
        mine = got[r.snp_id]
        assert mine.loglik == pytest.approx(best[mine.k][i], abs=1e-3)
        assert mine.bic == pytest.approx(-2 * best[mine.k][i] + (5 * mine.k - 1) * np.log(x.shape[1]), abs=1e-3)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_equal_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a, b = (x[names].sort_values(names, ignore_index=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, check_exact=True)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
