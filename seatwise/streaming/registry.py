"""The registry of confirmed holders as a stream: each batch is merged into a table, the later entry wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import latest_wins

KEYS = ["course_code", "term", "section"]


def merge_into(path: str, keys: list[str] = KEYS):
    """A foreachBatch function that keeps the winning entry of each key below path, a version per batch.

    A batch that is repeated after a failure merges to the same table, as a winner meets itself; of equal times the entry of
    the earlier batch stays. Entries without a key are passed over.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropna(subset=keys).withColumn("arrival", F.lit(number).cast("long") * (1 << 33) + F.monotonically_increasing_id())
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            rows = old.unionByName(rows)
        latest_wins(rows, keys).write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version's entries."""
    every = spark.read.option("basePath", path).parquet(path)
    newest = every.agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{path}/version={newest}").drop("arrival")
