import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def panel(spark, closes, sym=1, **cols):
    """Daily bars of one symbol from a list of closes."""
    import datetime as dt

    rows = []
    for i, c in enumerate(closes):
        row = {"sym": sym, "dt": dt.date(2020, 1, 1) + dt.timedelta(days=i), "close": c, "open": c, "high": c, "low": c, "volume": 1.0}
        row.update({k: v[i] for k, v in cols.items()})
        rows.append(row)
    schema = "sym bigint, dt date, close double, open double, high double, low double, volume double"
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
