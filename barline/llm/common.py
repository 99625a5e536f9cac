"""Helpers shared by the operators: tables, stepwise durable results, hot groups, components."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

#: A group holding over 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such groups.
HOT_SHARE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only. For pure ASCII texts the built-in ``lower`` does the same, faster."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def step(df: DataFrame, label: str) -> DataFrame:
    """``durable``, after letting Spark drop the shuffle files of the steps before.

    Spark deletes shuffle files once the driver's garbage collector has found the plan
    unused; asking for a collection before each written step keeps disks from filling up
    with the shuffles of all earlier ones. The listener queue holds on to the plan that ended
    last, so a query without a job takes its place first.
    """
    spark = df.sparkSession
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return durable(df, label)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table written by ``step`` that nothing reads any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def identified(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that is different for rows that differ in doc_id or text.

    It is the doc_id itself where only one text has that id. Other rows (no id, or an id that
    several texts share) get a number from a hash of both in the upper half of the positive
    longs, where no other row's id is expected: they come last, in the order of the hashes.
    Rows alike in both stay one document.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("binary")
    per = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("__id")).agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"))
    shared = step(per.where("low <> high").select("__id"), "shared_ids")
    own = F.xxhash64(doc_id, text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    if shared.isEmpty():
        return docs.withColumn(name, F.coalesce(doc_id, own))
    joined = docs.join(shared, doc_id == F.col("__id"), "left")
    return joined.withColumn(name, F.when(F.col("__id").isNull(), F.coalesce(doc_id, own)).otherwise(own)).drop("__id")


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` joined with one row per key; hot groups do not meet in one task.

    ``size`` is the column of ``groups`` with the group's number of rows, ``total`` the
    number of all rows. Groups over ``total / HOT_SHARE`` rows number fewer than HOT_SHARE,
    so that part of ``groups`` is broadcast whatever the input's size; the rest is merged.
    """
    hot = F.col(size) * HOT_SHARE > total
    small = rows.join(groups.where(~hot).hint("merge"), keys)
    return small.unionByName(rows.join(F.broadcast(groups.where(hot)), keys))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected graph; the component is its smallest node.

    Alternating large-star and small-star steps, one written table per round, until every
    node hangs on one node that hangs on none. Nodes are longs; a node without edges does
    not appear.
    """
    cur = step(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while True:
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            cur.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        degrees = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if degrees.agg(F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)"))).first()[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = step(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
