"""Per-key state steps in event order, whatever the order and the batches in which rows arrive.

Rows wait in the state, by key and time slice, until the watermark has passed their slice;
then a timer hands the slice's rows, sorted, to the step. So results do not depend on how
the rows were spread over files and micro-batches, and a task holds one slice of one key
at a time, not a key's backlog. A row whose slice has been handed on is late: it is not
dropped but comes out as JSON in the column ``late``.

Spark itself would drop rows behind the watermark. The event time it watches is therefore
not the rows' own: each row is followed by a second one without contents that carries its
time, and contents have no time in that column.
"""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, StringType, TimestampType

from barline.session import scratch_path

Step = Callable[[dict, pd.DataFrame], pd.DataFrame]

DAY_US = 86_400_000_000
#: Spark keeps timers and maps only in this state store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A time no row reaches; it closes a stream.
END = dt.datetime(2200, 1, 1)


def micros(ts: pd.Series) -> np.ndarray:
    return ts.to_numpy(dtype="datetime64[us]").astype("int64")


def packed(rows: pd.DataFrame) -> bytes:
    sink = io.BytesIO()
    table = pa.Table.from_pandas(rows, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def unpacked(parts: list[bytes]) -> pd.DataFrame:
    return pd.concat([pa.ipc.open_stream(p).read_all().to_pandas() for p in parts], ignore_index=True)


class InOrder(StatefulProcessor):
    """Runs ``step(memory, rows)`` per key, one time slice after the other.

    ``waiting`` maps (slice, part) to rows as they arrived, ``parts`` a slice to its number of
    parts, so that new rows are put beside old ones without reading these. ``memory`` is the
    step's small JSON object, ``done`` the last slice that was handed on. A step that leaves
    its memory empty, or names in ``m["forget"]`` a time in microseconds after which it
    does not matter, frees the key's state by then.
    """

    def __init__(self, step: Step, columns: list[str], order: list[str], slice_us: int):
        self.step, self.columns, self.order, self.slice_us = step, columns, order, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", "memory string")
        self.done = handle.getValueState("done", "slice bigint")
        self.parts = handle.getMapState("parts", "slice bigint", "n int")
        self.waiting = handle.getMapState("waiting", "slice bigint, part int", "contents binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        done = self.done.get()[0] if self.done.exists() else None
        for frame in rows:
            # a batch without rows comes as a frame without columns
            if frame.empty or not frame["contents__"].any():
                continue
            frame = frame[frame["contents__"]].drop(columns=["contents__", "clock__"])
            slices = pd.Series(micros(frame["ts"]) // self.slice_us, index=frame.index)
            late = slices <= done if done is not None else pd.Series(False, index=frame.index)
            if late.any():
                yield self.late(frame[late])
            for number, own in frame[~late].groupby(slices[~late]):
                n = self.parts.getValue((int(number),))[0] if self.parts.containsKey((int(number),)) else 0
                self.waiting.updateValue((int(number), n), (packed(own),))
                self.parts.updateValue((int(number),), (n + 1,))
                if n == 0:
                    self.handle.registerTimer((int(number) + 1) * self.slice_us // 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        number = at // self.slice_us - 1
        m = json.loads(self.memory.get()[0]) if self.memory.exists() else {}
        if self.parts.containsKey((number,)):
            n = self.parts.getValue((number,))[0]
            frame = unpacked([bytes(self.waiting.getValue((number, i))[0]) for i in range(n)]).sort_values(self.order, ignore_index=True)
            yield self.results(self.step(m, frame))
            self.parts.removeKey((number,))
            for i in range(n):
                self.waiting.removeKey((number, i))
            self.done.update((number,))
            if "forget" in m:
                # timers end slices; this one has no rows of its own unless more arrive
                self.handle.registerTimer((m["forget"] // self.slice_us + 2) * self.slice_us // 1000)
        if m and m.get("forget", at + 1) > at:
            self.memory.update((json.dumps(m),))
        elif self.memory.exists():
            self.memory.clear()

    def results(self, out: pd.DataFrame) -> pd.DataFrame:
        return out.reindex(columns=self.columns).assign(late=None)

    def late(self, rows: pd.DataFrame) -> pd.DataFrame:
        said = [json.dumps(r, default=str) for r in rows.to_dict("records")]
        return pd.DataFrame({c: [None] * len(said) for c in self.columns}).assign(late=said)

    def close(self) -> None:
        pass


def _plain(kind: DataType) -> Column:
    """A value that stands for no contents; a null would turn pandas' whole numbers into floats."""
    if isinstance(kind, NumericType | BooleanType):
        return F.lit(0).cast(kind)
    if isinstance(kind, StringType):
        return F.lit("")
    if isinstance(kind, DateType | TimestampType):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(None).cast(kind)


def in_order(stream: DataFrame, key: str, step: Step, schema: str, lateness: str, order: tuple[str, ...] = ("ts", "event_id"), slice_us: int = DAY_US, ends: str | None = None) -> DataFrame:
    """The stream of the step's results, with rows that came too late in ``late``.

    A slice is handed on when a row ``lateness`` younger than its end has been seen. ``ends``
    is a folder of (ts) files that move the clock without rows of their own.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    clock = F.explode(F.array(F.lit(None).cast("timestamp"), F.col("ts")))
    both = stream.withColumn("clock__", clock)
    contents = F.col("clock__").isNull()
    cells = [F.col(f.name) if f.name == key else F.when(contents, F.col(f.name)).otherwise(_plain(f.dataType)).alias(f.name) for f in stream.schema]
    both = both.select(*cells, "clock__", contents.alias("contents__"))
    if ends is not None:
        pushes = stream.sparkSession.readStream.schema("ts timestamp").parquet(ends).select(F.col("ts").alias("clock__"), F.lit(False).alias("contents__"))
        both = both.unionByName(pushes, allowMissingColumns=True)
    runner = InOrder(step, names, list(order), slice_us)
    return both.withWatermark("clock__", lateness).groupBy(key).transformWithStateInPandas(runner, f"{schema}, late string", "Append", "EventTime")


def run_in_order(stream: DataFrame, key: str, step: Step, schema: str, label: str, lateness: str = "7 days", progress: list | None = None, **kw) -> tuple[DataFrame, DataFrame]:
    """(results, late rows) of all that has landed; the stream is closed at the end, so nothing keeps waiting.

    ``progress`` receives, per micro-batch, the rows read and the rows held by the state.
    """
    spark = stream.sparkSession
    out, state, ends = (scratch_path(spark, f"{label}{x}") for x in ("", "-state", "-ends"))
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    results = in_order(stream, key, step, schema, ends=ends, **{"lateness": lateness, **kw})
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        for last in (False, True):
            if last:
                spark.createDataFrame([(END,)], "ts timestamp").coalesce(1).write.mode("append").parquet(ends)
            q = results.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            q.awaitTermination()
            if progress is not None:
                progress += [(p["numInputRows"], sum(o["numRowsTotal"] for o in p["stateOperators"])) for p in q.recentProgress]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    rows = spark.read.schema(results.schema).parquet(out)
    return rows.where("late IS NULL").drop("late"), rows.where("late IS NOT NULL").select("late")
