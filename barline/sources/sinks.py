"""Writers: landed-file shapes, append logs, keyed tables, chunked feature caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.operators.ledger import replace_day


def write_wide_history(panel: DataFrame, path: str, names: list, value: str = "close") -> None:
    """A date-by-symbol sheet. The symbols are stated, so no pass over the data looks for them."""
    wide = panel.groupBy("dt").pivot("sym", names).agg(F.first(value))
    wide.write.option("header", True).csv(path)


def append_by_day(rows: DataFrame, path: str, day: str = "day") -> None:
    """JSON lines, one folder per day; repeated calls add files."""
    rows.write.mode("append").partitionBy(day).json(path)


def write_payloads(payloads: DataFrame, path: str, raw: str = "raw") -> None:
    """Payloads as they were fetched, one per line."""
    payloads.select(raw).write.mode("append").text(path)


def write_documents(documents: DataFrame, path: str, key: str, text: str) -> None:
    """One file per key, holding its document; keys are distinct."""
    documents.select(key, text).repartition(key).write.mode("append").partitionBy(key).text(path)


def write_depth(rows: DataFrame, path: str) -> None:
    """Recorded books as gzipped JSON lines per session; ``pos``, where given, orders books of equal times (``seq``)."""
    packed = lambda side: F.transform(side, lambda e: F.array(e["quantity"].cast("double"), e["price"].cast("double"), e["orders"].cast("double")))
    out = rows.select(
        "dt", (F.unix_micros("ts") * 1000).alias("ts"), F.col("sym").alias("tk"), F.col("px").alias("ltp"),
        F.col("qty").cast("bigint").alias("v"), packed("bids").alias("b"), packed("asks").alias("a"),
        *([F.col("pos").alias("seq")] if "pos" in rows.columns else []),
    )
    out.write.mode("append").partitionBy("dt").option("compression", "gzip").json(path)


def append_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def upsert_table(spark: SparkSession, new: DataFrame, path: str, fresh: str, key: str = "day") -> DataFrame:
    """Keyed overwrite into a new location; readers switch when it is complete."""
    replace_day(spark.read.parquet(path), new, key).write.parquet(fresh)
    return spark.read.parquet(fresh)


def write_chunks(features: DataFrame, path: str, date_col: str = "dt") -> None:
    """Features by year and quarter; a rebuilt quarter replaces only its own folder."""
    out = features.withColumns({"year": F.year(date_col), "quarter": F.quarter(date_col)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)


def merge_chunks(parts: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    """One row per key from disjoint or overlapping chunks; a later part's known value wins."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    pick = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("_part")))
    return both.groupBy(*keys).agg(*[pick(c).alias(c) for c in names])


def write_summary(summary: DataFrame, path: str) -> None:
    """A report-sized result as one JSON file."""
    summary.coalesce(1).write.json(path)
