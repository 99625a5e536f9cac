"""Universe selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_liquid(panel: DataFrame, as_of: str, n: int = 50, back: int = 10, min_price: float = 20.0) -> DataFrame:
    """The ``n`` most traded names of the newest session within ``back`` days of a date.

    Turnover is price times volume where no turnover column exists.
    """
    day = F.lit(as_of).cast("date")
    near = panel.where((F.col("dt") <= day) & (F.col("dt") > F.date_sub(day, back)))
    last = near.agg(F.max("dt").alias("dt"))
    value = F.col("turnover") if "turnover" in panel.columns else F.col("close") * F.col("volume")
    rows = near.join(F.broadcast(last), "dt", "left_semi").withColumn("turnover", value)
    return rows.where((F.col("close") >= min_price) & F.col("turnover").isNotNull()).orderBy(F.desc("turnover"), "sym").limit(n)
