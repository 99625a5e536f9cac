"""State in event order: files, their order and micro-batches change nothing; late rows are kept apart."""

import json

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from barline.plans import streams
from barline.streaming import eventtime as et, stateful as sf_

SCHEMA = "sym long, ts timestamp, dt date, event_id long, sig string, px double, pnl double, text string"


@pytest.fixture(scope="module")
def ticks():
    e = pd.read_parquet(f"{SF}/events.parquet").sort_values(["ts", "event_id"], ignore_index=True)
    ts = e["ts"].astype("datetime64[us]")
    return pd.DataFrame({
        "sym": e["user_id"] % 5, "ts": ts, "dt": ts.dt.date, "event_id": e["event_id"], "sig": (e["value"] // 50).astype(str), "px": e["value"],
        "pnl": e["value"] - 52, "text": e["event_type"] + (e["user_id"] % 5).astype(str)})


def land(spark, parts, folder, per_batch=None, schema=SCHEMA):
    """The parts as files that are read in this order."""
    import os

    folder.mkdir()
    for i, part in enumerate(parts):
        part.to_parquet(folder / f"{i:04}.parquet", index=False, coerce_timestamps="us")
        os.utime(folder / f"{i:04}.parquet", (1_700_000_000 + 10 * i,) * 2)
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(str(folder))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def by_key(ticks, key, step, columns):
    """The step over each key's whole history at once."""
    parts = [step({}, own.reset_index(drop=True)) for _, own in ticks.groupby(key)]
    return sorted(pd.concat(parts)[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("files, per_batch", [(40, 7), (9, 1)])
def test_files_and_batches_change_nothing(spark, ticks, tmp_path, files, per_batch):
    want = by_key(ticks, "sym", sf_.suppress_repeats(), ["sym", "event_id"])
    shuffled = ticks.sample(frac=1, random_state=3)
    parts = [shuffled.iloc[i::files] for i in range(files)]
    held = []
    got, late = et.run_in_order(
        land(spark, parts, tmp_path / "in", per_batch), "sym", sf_.suppress_repeats(), sf_.REPEATS, "t", lateness="400 days", progress=held)
    assert rows_of(got) == want and late.count() == 0
    # waiting rows leave the state; a memory and a mark per key remain
    assert held[-1][1] <= 2 * ticks["sym"].nunique() + 2 and sum(n for n, _ in held) == len(ticks) + 1


def test_waiting_state_stays_small_while_rows_come_in_order(spark, ticks, tmp_path):
    held = []
    parts = [ticks.iloc[i: i + len(ticks) // 8] for i in range(0, len(ticks), len(ticks) // 8)]
    stream = land(spark, parts, tmp_path / "in", 1)
    got, late = et.run_in_order(stream, "text", sf_.quiet_alerts(), sf_.ALERTS, "t", lateness="1 hour", progress=held)
    columns = ["text", "event_id", "held"]
    assert rows_of(got) == by_key(ticks, "text", sf_.quiet_alerts(), columns) and late.count() == 0
    assert max(n for _, n in held) < 12 * ticks["text"].nunique()


def test_late_rows_are_kept_apart(spark, ticks, tmp_path):
    cut = ticks["ts"].quantile(0.1)
    old, rest = ticks[ticks["ts"] < cut], ticks[ticks["ts"] >= cut]
    parts = [old.iloc[::2], rest.iloc[: len(rest) // 2], rest.iloc[len(rest) // 2:], old.iloc[1::2]]
    got, late = et.run_in_order(
        land(spark, parts, tmp_path / "in", 1), "sym", sf_.day_return(), sf_.RETURN, "t", lateness="2 hours")
    said = [json.loads(r["late"])["event_id"] for r in late.collect()]
    done = [r[1] for r in rows_of(got)]
    assert sorted(done + said) == sorted(ticks["event_id"]) and set(said) <= set(old.iloc[1::2]["event_id"]) and len(said) > 3
    kept = ticks[ticks["event_id"].isin(done)]
    assert np.allclose([r[2] for r in rows_of(got)], [r[2] for r in by_key(kept, "sym", sf_.day_return(), ["sym", "event_id", "ret"])])


@pytest.mark.parametrize("make", [
    lambda: sf_.suppress_repeats(), lambda: sf_.suppress_repeats(3_600_000_000), lambda: sf_.volatility_gate(), lambda: sf_.crash_lockout(0.5, 4),
    lambda: sf_.day_return(), lambda: sf_.quiet_alerts(), lambda: sf_.account_risk(500.0)])
def test_steps_do_not_depend_on_where_rows_are_cut(ticks, make):
    own = ticks[ticks["sym"] == 1].reset_index(drop=True)
    whole = make()({}, own)
    for size in (1, 3, 50):
        memory, parts = {}, []
        for i in range(0, len(own), size):
            parts.append(make()(memory, own.iloc[i: i + size].reset_index(drop=True)))
            memory = json.loads(json.dumps(memory))
        cut = pd.concat(parts, ignore_index=True)
        pd.testing.assert_frame_equal(cut, whole.reset_index(drop=True), check_dtype=False)


def test_days_leave_the_state_behind_the_watermark(spark, ticks, tmp_path):
    own = ticks.assign(qty=1.0)
    step = len(own) // 10
    cut = [own.iloc[i: i + step] for i in range(0, len(own), step)]
    old = cut[0].iloc[:7]
    held = []
    stream = land(spark, [cut[0].iloc[7:], *cut[1:], old], tmp_path / "in", 1, SCHEMA + ", qty double")
    got = {(r["sym"], str(r["dt"])): r["close"] for r in streams.day_bars(stream, "1 day", held).collect()}
    last = own.drop(old.index).groupby(["sym", "dt"])["px"].last()
    assert {k: got[k] for k in got} == {(s, str(d)): v for (s, d), v in last.items()}
    # days pass out of the state; what came last was too late, and is counted (by symbol and day, as sums reach the state)
    assert max(n for n, _ in held) < len(last) / 2 and sum(late for _, late in held) == old.groupby(["sym", "dt"]).ngroups


def test_large_numbers_keep_their_digits(spark, ticks, tmp_path):
    big = ticks.assign(event_id=ticks["event_id"] + (1 << 60) + 1)
    got, _ = et.run_in_order(land(spark, [big], tmp_path / "in"), "sym", sf_.suppress_repeats(), sf_.REPEATS, "t", lateness="1 day")
    assert rows_of(got) == by_key(big, "sym", sf_.suppress_repeats(), ["sym", "event_id"])


def test_lockout_counts_prints(ticks):
    px = [10.0, 4.0, 4.0, 4.0, 4.0, 1.0, 0.0, 5.0, 2.0, 2.0, 2.0]
    rows = pd.DataFrame({"sym": 1, "event_id": range(len(px)), "px": px})
    got = sf_.crash_lockout(0.5, 3)({}, rows)["locked"].tolist()
    want, last, left = [], None, 0
    for x in px:
        if last and x / last - 1 < -0.5:
            left = 3
        left = max(left - 1, 0)
        last = x
        want.append(left > 0)
    assert got == want
