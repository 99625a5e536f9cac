"""Exact deduplication with a persistent digest index.

The index is a table of (digest, keep_id, keep_row, call), bucketed and sorted by digest;
``call`` tells rows of one call from those of later ones, whose numbers start anew. A batch is reduced to one row per digest before it is shuffled, meets the index in
a sort-merge anti-join (the index side is read bucket by bucket without a shuffle), and the
digests the index lacks are appended. Everything is DataFrame code.

Defined cases: a null text counts as empty; a null doc_id never wins over a stated one;
of repeated rows (same doc_id and text) one is kept; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import join_groups, lower_ascii, partitions, step
from barline.session import scratch_path


def digests(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest): SHA-256 of the text with A-Z lower-cased, as 32 bytes."""
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("digest"))


def new_call() -> int:
    return uuid.uuid4().int >> 65


class DigestIndex:
    """A bucketed table of digests seen so far; reopen it by name in a later session of the catalog."""

    SCHEMA = "digest binary, keep_id long, keep_row long, call long"

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
        self.buckets = buckets or partitions(spark)
        self.path = path or scratch_path(spark, self.name)
        if not spark.catalog.tableExists(self.name):
            self._write(spark.createDataFrame([], self.SCHEMA), "errorifexists")

    def _write(self, df: DataFrame, mode: str) -> None:
        (df.repartition(self.buckets, "digest").write.mode(mode).format("parquet").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, batch: DataFrame, call: int | None = None) -> None:
        """Adds the digests of ``batch`` (row, doc_id, digest) that the index lacks.

        Inside the batch the largest doc_id stands for its digest.
        """
        fresh = batch.groupBy("digest").agg(
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("row", "doc_id"), F.max("row")).alias("keep_row"),
            F.lit(new_call() if call is None else call).cast("long").alias("call"))
        self._write(fresh.join(self.read().select("digest").hint("merge"), "digest", "left_anti"), "append")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Documents enter the index in ``batches`` ranges of falling doc_id, so that the largest
    doc_id of equal texts is the one the index holds.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    seen, call = step(digests(docs), "digests"), new_call()
    low, high, total = seen.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if low is not None:
        # range k of falling ids; rows without an id come with the last one
        width = max(1, -(-(high - low + 1) // batches))
        place = F.coalesce(F.floor((F.lit(high) - F.col("doc_id")) / F.lit(width)), F.lit(batches - 1))
        for k in range(batches):
            index.append(seen.where(place == k), call)
    else:
        index.append(seen, call)
    sizes = seen.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = step(sizes.join(index.read().hint("merge"), "digest"), "digest_groups")
    return join_groups(seen, groups, ["digest"], "group_size", total).select(
        "doc_id", "keep_id", "group_size", ((F.col("row") == F.col("keep_row")) & (F.col("call") == call)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
