"""A corpus pipeline from five of the operators: quality, lines, near copies, benchmarks, mixture.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept and returns
a DataFrame; ``run`` writes it as Parquet in the shared folder and reads it back as the next
stage's input. All stages but the last return the columns of ``documents``; the last returns
them too, with a document as often as the mixture takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm.common import step, table
from barline.llm.decontaminate import clean_of
from barline.llm.jaccard import one_per_group
from barline.llm.line_dedup import documents_left
from barline.llm.mixing import mix_sources
from barline.llm.quality import good_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents of which nothing is left go."""
    return documents_left(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    return one_per_group(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return clean_of(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source weights take them."""
    return mix_sources(docs)


STAGES = [
    ("quality", quality), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("mixture", mixture)]

#: The quality model, the edit joins and the Jaccard join have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
