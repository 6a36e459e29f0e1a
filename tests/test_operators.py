"""Properties of operators, and every query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from boardlake import catalog
from boardlake.operators import filters, joins, lifecycle
from boardlake.sources.postings import postings

SF = "/root/testdata/sf0.001"


def rows(columns, found):
    """Rows as sorted text, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted([plain(r[i]) for i in order] for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_gives_what_its_sql_gives(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_upsert_is_idempotent(spark):
    all_ = postings(spark, SF)
    incoming = all_.filter("posting_id % 2 = 0").select(lifecycle.KEY, "position_name", "location", "job_description", "pay_min", "pay_max", F.lit(1).alias("batch_order"))
    once = lifecycle.upsert(all_, incoming, 5)
    assert rows(once.columns, once.collect()) == rows(once.columns, lifecycle.upsert(once, incoming, 5).collect())


def test_pages_join_to_the_whole_order(spark):
    df = postings(spark, SF)
    whole = [r.posting_id for r in df.orderBy(*joins.order("recent")).collect()]
    found, cursor = [], (1 << 60, 0)
    while page := df.filter(joins.after(*cursor)).orderBy(*joins.order("recent")).limit(70).collect():
        found += [r.posting_id for r in page]
        cursor = (page[-1].last_seen_epoch, page[-1].posting_id)
    assert found == whole


def test_a_further_filter_never_adds_rows(spark):
    df = postings(spark, SF)
    wide = {r.posting_id for r in df.filter(filters.pay_range(low=60_000)).collect()}
    assert {r.posting_id for r in df.filter(filters.pay_range(low=60_000) & filters.search("red")).collect()} <= wide


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["q_education_seen"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "text" not in plan.split("ReadSchema")[1].split("\n")[0]
