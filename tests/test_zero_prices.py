"""Prices of zero and equal times in the ticks: queries still agree with their SQL."""

import math

import numpy as np
import pytest
from conftest import SF

from barline import plans
from barline.plans.registry import ORACLES, QUERIES

plans.load()


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Three copies of the events at equal times, with prices of zero at the ends of some hours and inside others."""
    import pandas as pd

    one = pd.read_parquet(f"{SF}/events.parquet")
    rows = pd.concat([one.assign(event_id=one["event_id"] + k * len(one), user_id=one["user_id"] + 10 * k) for k in range(3)], ignore_index=True)
    ends = rows.sort_values(["ts", "event_id"]).groupby([rows["user_id"] % 10, rows["ts"].dt.floor("h")]).tail(1)
    zero = set(ends["event_id"].to_numpy()[5::40] % len(one)) | set(one["event_id"][7::150])
    rows.loc[(rows["event_id"] % len(one)).isin(zero), "value"] = 0.0
    folder = tmp_path_factory.mktemp("odd")
    rows.to_parquet(f"{folder}/events.parquet", index=False, coerce_timestamps="us")
    return str(folder)


def rows_of(table):
    names = sorted(table)
    same = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return sorted(tuple(str(same(v)) for v in row) for row in zip(*[table[n] for n in names], strict=True))


def agrees(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = rows_of(con.execute(ORACLES[name]).to_arrow_table().to_pydict())
    assert rows_of(QUERIES[name](spark, folder).toArrow().to_pydict()) == want
    return want


def test_a06_order_flow(spark, odd):
    assert any("inf" in r for r in agrees(spark, odd, "a06_order_flow"))


def test_r03_stream_order_flow(spark, odd):
    assert any("inf" in r for r in agrees(spark, odd, "r03_stream_order_flow"))


def test_s07_depth_files(spark, odd):
    assert any("inf" in r for r in agrees(spark, odd, "s07_depth_files"))


def test_w34_flow_toxicity(spark, odd):
    assert any("inf" in r and "nan" in r for r in agrees(spark, odd, "w34_flow_toxicity"))
