"""Every registered query of the library against its SQL, at the smallest size."""

import datetime
import math
import os

import duckdb
import pytest

from panelwright.plans import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


#: Queries that find nothing in the smallest tables: their ten suppliers are too few for a basket or a ranking.
MAY_BE_EMPTY = set(
    "agg_basket_ew agg_corr_intra agg_ic_daily agg_ic_summary agg_latest_covered_year agg_newey_west agg_ols_single agg_quantile_means agg_representative agg_var_share "
    "join_self_pairs pipe_misclass pipe_turnover pipe_walk_forward top_peer_nearest win_median_peer win_residual_z".split()
)


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, datetime.date):
        return v.isoformat()[:10]
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    assert got == want
    assert got or name in MAY_BE_EMPTY


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
