"""The corpus pipeline: quality rules, line dedup, near-duplicates, mixing, packing. Counted as part of seatwise.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seatwise.llm import line_dedup, mixing, packing, quality, simhash
from seatwise.llm.common import cut


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are taken out; n_chars follows the text."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash prints of three-word shingles, two differing bits at most) the document of the smallest id stays."""
    return simhash.first_of_each(docs, words=3, distance=2)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, and where they are in the packed sequences."""
    return packing.pack(docs, *packing.vocabulary())


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("near_dedup", near_stage), ("mix_sources", mix_stage), ("best_fit_packing", pack_stage)]

#: Near-duplicates, entropy balancing and packing have no SQL form. Tests hold each stage's operator against brute force, and of the
#: whole only that it runs and that no sequence is too long.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
