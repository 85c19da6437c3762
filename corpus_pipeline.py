"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; all but the last return
the columns of documents. sf_dir names the folder of the tables that a stage learns from or compares with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siterank.llm import quality
from siterank.llm.decontaminate import drop_contaminated
from siterank.llm.exact_dedup import drop_copies
from siterank.llm.files import ship_package
from siterank.llm.near_dedup import drop_near_copies
from siterank.llm.packing import pack
from siterank.llm.queries import QUALITY, quality_model, tokenizer
from siterank.sources.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY."""
    scored = quality.score(docs, quality_model(spark, sf_dir), name="__quality")
    return scored.filter(F.col("__quality") >= QUALITY).select(*docs.columns)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 80 percent common five-word shingles."""
    ship_package(spark)
    return drop_near_copies(docs, width=5, similarity=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with its own or other parameters."""
    ship_package(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    ship_package(spark)
    return pack(docs, tokenizer())


STAGES = [
    ("quality", keep_good), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("decontaminate", drop_leaks),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
