"""Every query with SQL agrees with it on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from strobelake import catalog

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the test tables are not here")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(rows):
    key = lambda v: "" if v is None else f"{v:.6f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(key(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = catalog.queries()[name](spark, DIR)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0


def test_streamed_flow_equals_the_flow_of_the_table(spark):
    from strobelake.operators import flow
    from strobelake.sources import tables

    flows = flow.estimate(flow.neighbours(tables.phase_frames(spark, DIR)), flow.Farneback(levels=1)).collect()
    mean = lambda v: sum(map(float, v)) / len(v)
    want = {(r["seq"], r["idx"]): (mean(r["dx"]), mean(r["dy"])) for r in flows}
    got = {(r["seq"], r["idx"]): (r["dx"], r["dy"]) for r in catalog.queries()["stream_flow_push"](spark, DIR).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) <= 1e-3 for k in want for a, b in zip(got[k], want[k]))
