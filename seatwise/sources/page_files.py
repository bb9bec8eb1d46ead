"""Pages of JSON responses as files, read by Spark: a folder for each course and term, so that what isn't asked for isn't read.

Files are in course_code=.../term=.../page=... below a path that every executor reaches, by any of Spark's file systems.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents
from ..operators.extraction import responses

MOST_PAGES = 25
PART = ["course_code", "term"]


def write_pages(docs: DataFrame, path: str) -> None:
    """docs: course_code, term, page, doc; a file for each row."""
    docs.select("doc", *PART, "page").repartition(*PART, "page").write.partitionBy(*PART, "page").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """course_code, term, page, doc of every file; filters of the first three decide which folders are read."""
    files = spark.read.format("text").option("wholetext", True).schema("value string, course_code string, term int, page int").load(path)
    return files.select(*PART, "page", F.col("value").alias("doc"))


def walked(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The pages that a reader turning them one by one from the first takes: course_code, term, page, path, rows, last_page, total.

    It stops before a missing or broken page, one without rows and one that begins like the first, and behind the last page that
    the page itself names (behind the first, if it names none), or at the most pages. A course and term whose first page isn't there has none.
    """
    at = responses(pages.filter((F.col("page") >= 1) & (F.col("page") <= most)).withColumn("broken", documents.kind_of(F.col("doc")).isNull()).withColumnRenamed("page", "number"), "doc")
    by = Window.partitionBy(*PART).orderBy("number")
    first = F.first("rows").over(by)
    at = at.withColumn("ends", F.col("broken") | (F.size("rows") == 0) | ((F.col("number") > 1) & (F.get("rows", F.lit(0)) == F.get(first, F.lit(0)))) | (F.col("number") != F.row_number().over(by)))
    at = at.withColumn("last", F.col("number") >= F.coalesce("last_page", F.lit(1)))
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    taken = ~F.coalesce(F.max(F.col("ends") | F.col("last")).over(before), F.lit(False)) & ~F.col("ends")
    return at.withColumn("taken", taken).filter("taken").select(*PART, F.col("number").alias("page"), "path", "rows", "last_page", "total")
