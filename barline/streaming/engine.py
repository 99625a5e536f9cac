"""Sources and sinks for the streaming forms of the operators.

Streams run with a checkpoint and files in the shared folder; nothing goes through
the driver. A run with the ``availableNow`` trigger reads everything that has landed
and stops, which is also how a batch job catches up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import scratch_path


def tick_stream(spark: SparkSession, sf: str, books: int = 10, files_per_batch: int | None = None) -> DataFrame:
    """Ticks as they land; the batch twin is ``tables.ticks``.

    ``files_per_batch`` bounds a micro-batch. Neither it nor the order in which files landed
    changes results: state steps take rows in event order (``eventtime``), aggregates have none.
    """
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # a file stream watches a pattern rather than one file; this one matches that name only
    rows = reader.parquet(f"{sf}/events.parque[t]")
    return rows.select(
        (F.col("user_id") % books).cast("bigint").alias("sym"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("ts").cast("date").alias("dt"),
        "event_id", "event_type", F.col("value").alias("px"),
        (F.coalesce(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0)) + 1.0).alias("qty"),
    )


def run_update(stream: DataFrame, keys: Sequence[str], label: str, progress: list | None = None) -> DataFrame:
    """Runs an aggregating stream in update mode; returns the newest row per key.

    Each micro-batch overwrites its own folder, so a repeated batch leaves no double. ``progress``
    receives, per micro-batch, the rows held by the state and those that came after the watermark.
    """
    spark = stream.sparkSession
    out, state = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    q = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    if progress is not None:
        progress += [tuple(sum(o[k] for o in p["stateOperators"]) for k in ("numRowsTotal", "numRowsDroppedByWatermark")) for p in q.recentProgress]
    rows = spark.read.option("basePath", out).parquet(f"{out}/_batch=*")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return newest.select(*keys, "_v.*")
