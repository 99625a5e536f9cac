"""Registered queries against DuckDB on the smallest tables."""

import datetime as dt
import math

import pytest
from conftest import SF

import __spark_entry__ as entry

FAST = (
    "feature_relevance", "w02_bollinger", "w25_event_features", "f01_equity_filter", "j08_cross_venue", "t05_target_table", "c01_cross_rank",
    "c17_share_sizes", "a05_day_shape", "a06_order_flow", "a30_behaviour_cells", "g04_attribution", "m07_holidays", "s06_position_reports", "r05_volatility_gate",
)


def canon(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v)
    return v.isoformat() if isinstance(v, dt.date) else str(v)


def test_every_oracle_has_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    rows = entry.queries()[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted(tuple(canon(r[c]) for c in cols) for r in rows.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_flagship_runs(spark):
    assert entry.entry(spark).count() == 16


def test_tasks_share_grows_with_no_table(spark):
    """What a task sorts or groups is dealt by the number of rows, not by a fixed number of partitions."""
    from barline import session

    old, session.TASK_ROWS = session.TASK_ROWS, 1000
    try:
        for name in ("x02_source_registry", "c03_symbol_rank"):
            plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert ", 6), REPARTITION_BY_NUM" in plan
    finally:
        session.TASK_ROWS = old


def test_landed_prices_are_compressed(spark):
    files = entry.queries()["s01_daily_prices"](spark, SF).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_rank_products_write_what_they_rank(spark):
    files = [f for f in entry.queries()["c02_rank_products"](spark, SF).inputFiles() if "/returns-" in f]
    assert files and spark.read.parquet(*files).columns == ["sym", "dt", "close", "volume", "ret_5"]
