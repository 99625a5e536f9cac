"""Adjustment, alignment, joins, ledgers, graphs, text and streams on small cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from barline.functions import dates, text
from barline.operators import adjust, admission, alignment, graph, ledger, quality, xsection
from barline.plans import streams
from barline.sources import files, sinks, tables
from seed_graph import seed_edges, seed_nodes
from barline.session import scratch_path

D = dt.date


def test_bonus_and_demerger(spark):
    acts = adjust.classify_actions(
        spark.createDataFrame(
            [(1, D(2020, 1, 2), 1, "Bonus 1:1"), (1, D(2020, 1, 3), 1, "Demerger / Dividend Rs 2"), (1, D(2020, 1, 4), 1, "Dividend - Rs 5.50"), (1, D(2020, 1, 5), 1, "Annual meeting")],
            "sym bigint, dt date, seq int, subject string",
        )
    )
    assert [r["kind"] for r in acts.orderBy("dt").collect()] == ["bonus", "demerger", "dividend", "other"]
    px = spark.createDataFrame(
        [(1, D(2020, 1, 2), 51.0, 100.0), (1, D(2020, 1, 3), 60.0, 51.0), (1, D(2020, 1, 4), 54.5, 60.0), (1, D(2020, 1, 5), 90.0, 54.5)],
        "sym bigint, dt date, close double, prev_close double",
    )
    out = [(r["ret"], r["masked"]) for r in adjust.adjust_returns(px, acts).orderBy("dt").collect()]
    assert out[0][0] == pytest.approx(0.02)
    assert out[1] == (None, True) and out[3] == (None, True)
    assert out[2][0] == pytest.approx(0.0)


def test_as_of_needs_a_lag(spark):
    with pytest.raises(ValueError):
        alignment.as_of_lagged(spark.range(1), spark.range(1), [], 0)


def test_as_of_carries_then_delays(spark):
    slow = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 4), 2.0)], "dt date, x double")
    cal = spark.createDataFrame([(D(2020, 1, d),) for d in (2, 3, 5, 6)], "dt date")
    assert [r["x"] for r in alignment.as_of_lagged(slow, cal, ["x"]).orderBy("dt").collect()] == [None, 1.0, 1.0, 2.0]


def test_missing_token_fails_the_job(spark):
    want = spark.createDataFrame([("A",), ("B",)], "name string")
    inst = spark.createDataFrame([("a", "EQ", "5")], "tradingsymbol string, instrument_type string, token string")
    assert {r["name"]: r["token"] for r in alignment.resolve_tokens(want, inst, strict=False).collect()} == {"A": 5, "B": None}
    with pytest.raises(Exception, match="no token for"):
        alignment.resolve_tokens(want, inst).collect()


def test_funds_leave_only_where_isins_exist(spark):
    rows = [(1, "EQ", "STK", "INE1", 1), (1, "EQ", "STK", "INF1", 2), (2, "EQ", "STK", "--", 3), (2, "BE", "STK", "--", 4)]
    df = spark.createDataFrame(rows, "dt int, series string, instrument string, isin string, k int")
    assert sorted(r["k"] for r in quality.equities_only(df).collect()) == [1, 3]


def test_dead_symbol_fails_the_job(spark):
    df = spark.createDataFrame([(1, D(2020, 1, 1), None)], "sym bigint, dt date, close double")
    with pytest.raises(Exception, match="no usable price rows"):
        quality.require_live_symbols(df).collect()


def test_share_sizes_drop_the_weakest_first(spark):
    rows = [(1, s, D(2020, 1, 1), w, 10.0, 0, 100.0) for s, w in ((1, 0.25), (2, 0.2), (3, 0.05))]
    df = spark.createDataFrame(rows, "account int, sym int, dt date, weight double, price double, held int, equity double")
    out = {r["sym"]: r["shares"] for r in xsection.share_sizes(df, cap=1.0).collect()}
    assert out == {1: 2, 2: 2, 3: 0}


def test_order_fold_respects_cash_and_writes_off():
    cols = ["seq", "day", "ticker", "weight", "price", "volume", "cap"]
    o = pd.DataFrame([(1, 1, "A", 0.2, 10.0, 2e7, 1.0), (2, 2, "A", 0.2, 0.0005, 2e7, 1.0)], columns=cols)
    fills, cash = ledger.fold_orders(o, 1000.0, {}, {})
    assert fills[0][3] == "buy" and fills[0][4] == pytest.approx(20.0) and cash == pytest.approx(1000 - 20 * 10 * 1.0005)
    assert fills[1][3] == "writeoff"


def test_seed_graph_effects(spark):
    e = seed_edges(spark)
    out = {r["node"]: r for r in graph.intervention(e, "FED_FUNDS_RATE", 1.0).collect()}
    chain = 0.67 * -0.71 * 0.58 * 0.86 * 0.94
    assert out["SPX"]["effect"] == pytest.approx(0.85 * -0.72 + chain) and out["SPX"]["n_paths"] == 2
    assert graph.longest_path(e) == 9
    new = spark.createDataFrame([("SPX", "US_CPI", 1), ("GOLD", "SPX", 2), ("NOBODY", "SPX", 3)], "source string, target string, seq long")
    got = {r["source"]: r["verdict"] for r in admission.admit_edges(seed_nodes(spark), e, new).collect()}
    assert got == {"SPX": "cycle", "GOLD": "accepted", "NOBODY": "unknown"}


def test_filing_sentiment_known_counts(spark):
    df = spark.createDataFrame([("Record revenue and strong demand, but going concern.",), ("",)], "text string")
    r = text.filing_sentiment(df).collect()
    assert r[0]["positive_density"] == pytest.approx(2 / 8 * 1000) and r[0]["going_concern"]
    assert r[0]["score"] == pytest.approx(1 / 3) and r[1]["score"] == 0.0


def test_mentions_and_markup(spark):
    df = spark.createDataFrame([("buy $ABC not $XYZ  now", "<p>a&amp;b<script>x<y</script>  c</p>")], "t string, h string")
    r = df.select(text.keep_known_mentions("t", ["ABC"]).alias("t"), text.strip_markup("h").alias("h")).first()
    assert r["t"] == "buy $ABC not now" and r["h"] == "a b c"


def test_easter_and_holidays(spark):
    y = spark.createDataFrame([(2019,), (2024,), (2038,)], "year int")
    assert [r["e"] for r in y.orderBy("year").select(dates.easter(F.col("year")).alias("e")).collect()] == [D(2019, 4, 21), D(2024, 3, 31), D(2038, 4, 25)]


def test_position_report(spark):
    raw = 'Participant wise report\nClient Type  , Future Index Long  ,Future Index Short\n"FII","1,200",300\nTOTAL,1,2\n'
    out = files.parse_participants(spark.createDataFrame([(D(2020, 1, 1), raw)], "dt date, text string")).collect()
    assert {(r["participant"], r["field"], r["value"]) for r in out} == {("FII", "future index long", 1200.0), ("FII", "future index short", 300.0)}


def test_torn_depth_line_is_skipped(spark):
    import gzip
    import os

    folder = scratch_path(spark, "torn")
    os.makedirs(folder)
    with gzip.open(f"{folder}/depth_20240105.jsonl.gz", "wt") as f:
        f.write('{"ts": 1, "tk": 7, "ltp": 1.5, "b": [[1, 2, 3]], "a": [[1, 3, 1]]}\n{"ts": 2, "tk"')
    rows = files.read_depth(spark, folder).collect()
    assert len(rows) == 1 and rows[0]["dt"] == D(2024, 1, 5)


def test_missing_columns_are_refused(spark):
    path = scratch_path(spark, "bad")
    spark.createDataFrame([("x",)], "a string").write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        files.read_daily_prices(spark, path)


def test_replaced_day(spark):
    path = scratch_path(spark, "days")
    sinks.append_table(spark.createDataFrame([(1, 5.0), (2, 6.0)], "day int, v double"), path)
    out = sinks.upsert_table(spark, spark.createDataFrame([(2, 9.0)], "day int, v double"), path, scratch_path(spark, "days"))
    assert sorted(map(tuple, out.collect())) == [(1, 5.0), (2, 9.0)]


def test_ledger_stream_equals_batch(spark):
    a = sorted(map(tuple, streams.r12(spark, SF).collect()))
    b = sorted(map(tuple, streams.r12b(spark, SF).collect()))
    assert a == b and a


def test_throttle_matches_a_plain_loop(spark):
    got = {r["event_id"] for r in streams.r02(spark, SF).collect()}
    want, last = set(), {}
    for r in streams._signed(tables.ticks(spark, SF)).orderBy("ts", "event_id").collect():
        at, sig = last.get(r["sym"], (None, None))
        if at is not None and (r["ts"] - at).total_seconds() < 3600 or sig == r["sig"]:
            continue
        last[r["sym"]] = (r["ts"], r["sig"])
        want.add(r["event_id"])
    assert got == want


def test_streams_do_not_depend_on_how_files_landed(spark, tmp_path):
    """One file against 40 shuffled ones, the newest rows first: the same rows come out."""
    from barline.plans.registry import QUERIES

    events = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts", ascending=False)
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i in range(40):
        events.iloc[i::40].to_parquet(folder / f"part-{i:03d}.parquet", index=False, coerce_timestamps="us")
    for name in ("r03_stream_order_flow", "r04_stream_day_bars", "r06_crash_lockout", "r10_stream_imbalance"):
        one, many = (sorted(map(str, QUERIES[name](spark, where).collect())) for where in (SF, str(tmp_path)))
        assert one == many and one


def test_pair_correlations_of_many_names(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 90))
    x[:, 1] += x[:, 0]
    rows = [(i, s, float(x[i, s])) for i in range(30) for s in range(90) if (i + s) % 7]
    got = quality.pair_correlations(spark.createDataFrame(rows, "dt int, sym bigint, ret double"), list(range(90))).toPandas()
    wide = pd.DataFrame(rows, columns=["dt", "sym", "ret"]).pivot(index="dt", columns="sym", values="ret").corr()
    assert len(got) == 90 * 89 // 2
    assert np.allclose(got["corr"], [wide.loc[a, b] for a, b in zip(got["a"], got["b"])])


def test_pairs_meet_block_by_block(spark):
    """No row per pair and session is made, and constant, lone, absent and infinite histories keep their results."""
    rng = np.random.default_rng(5)
    x = {(d, s): float(v) for (d, s), v in np.ndenumerate(rng.normal(3, 1, (40, 300))) if rng.random() < 0.3}
    x |= {(d, 7): 0.1 for d in range(40)} | {(0, 8): 1.0, (1, 9): float("inf")}
    x = {k: v for k, v in x.items() if k[1] != 11 and (k[1] != 8 or k[0] == 0)}
    rows = [(D(2020, 1, 1) + dt.timedelta(days=d), s, v) for (d, s), v in x.items()]
    names = spark.range(0, 300).select(F.col("id").alias("sym"))
    out = quality.pair_correlations(spark.createDataFrame(rows, "dt date, sym bigint, ret double"), names)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1, "sessions are joined with each other"
    got = {(r["a"], r["b"]): (r["n"], r["corr"]) for r in out.collect()}
    assert len(got) == 300 * 299 // 2
    for (a, b), (n, corr) in got.items():
        both = [d for d in range(40) if (d, a) in x and (d, b) in x]
        u, v = (np.array([x[d, s] for d in both]) for s in (a, b))
        assert a < b and n == len(both)
        if not np.isfinite([*u, *v]).all():
            assert np.isnan(corr)
        elif n < 2 or len(set(u)) == 1 or len(set(v)) == 1:
            assert corr is None
        else:
            assert abs(corr - np.corrcoef(u, v)[0, 1]) < 1e-9
    strong = quality.pair_correlations(spark.createDataFrame(rows, "dt date, sym bigint, ret double"), names, least=3, beyond=0.8).collect()
    want = {k for k, (n, c) in got.items() if n >= 3 and c is not None and (np.isnan(c) or abs(c) > 0.8)}
    assert {(r["a"], r["b"]) for r in strong} == want


def test_a_cycle_has_no_longest_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    with pytest.raises(ValueError):
        graph.longest_path(e)
    assert {(r["root"], r["node"]) for r in graph.reachable(e, spark.createDataFrame([("a",)], "root string")).collect()} == {("a", "b"), ("a", "c")}


def test_action_wordings(spark):
    said = {
        "Bonus issue 1:2": "bonus", "BONUS 3 : 1": "bonus", "Scheme of Arrangement": "demerger", "Spin-off of the unit": "demerger", "De-merger": "demerger",
        "Face Value Split (Sub-Division) - From Rs 10/- Per Share To Rs 2/- Per Share": "split", "Stock split from Re.1 to 0.50": "split",
        "Interim Dividend - Rs. 7.50 Per Share": "dividend", "Dividend Re 1": "dividend", "Annual General Meeting": "other", "Dividend": "other",
        "Allotment of bonus equity shares in the ratio of 3:5": "bonus", "Bonus": "other", "Bonus debentures of Rs 10": "other", "Special dividends of INR 12 a share": "dividend",
        "Splitting of one share, face value reduced from ten to two": "other", "Dividend 40% (Rs 4)": "other", "demerged undertaking / dividend Rs 3": "demerger",
        "Spin off of tower assets": "demerger", "Share split from Rs.5 to Re.1 and dividend Rs 2": "split", "Offer to spin yarn": "other", "": "other", None: "other",
    }
    df = spark.createDataFrame([(1, D(2020, 1, 1), i, s) for i, s in enumerate(said)], "sym bigint, dt date, seq int, subject string")
    rows = {r["subject"]: r for r in adjust.classify_actions(df).collect()}
    assert {s: rows[s]["kind"] for s in said} == said
    assert rows["Interim Dividend - Rs. 7.50 Per Share"]["dividend"] == 7.5 and rows["Special dividends of INR 12 a share"]["dividend"] == 12
    assert rows["Allotment of bonus equity shares in the ratio of 3:5"]["price_ratio"] == 5 / 8
    assert rows["Share split from Rs.5 to Re.1 and dividend Rs 2"]["price_ratio"] == 0.2
