"""Pages of a key-value table by prefix, from one key to the next, and global row numbers without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def numbered(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """rows with their place (from 0) in the given order: ranges of the order are numbered each on its own, from the sizes of those before."""
    spark, by = rows.sparkSession, [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = cut(rows.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()))
    before, offsets = 0, []
    for r in ranges.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():  # a row for each range
        offsets.append((r["__range"], before))
        before += r["n"]
    starts = F.broadcast(spark.createDataFrame(offsets, "__range int, __before bigint"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1 + F.col("__before")
    return ranges.join(starts, "__range").withColumn(name, place.cast("long")).drop("__range", "__before")


def page(rows: DataFrame, key: str, prefix: str, cursor: str | None = None, limit: int = 1000) -> tuple[DataFrame, str | None]:
    """The first limit rows behind the cursor whose key has the prefix, in order of the key, and the cursor of the page after; null if this is the last.

    Keys are unique. The range of the prefix and the cursor are comparisons of the key, which reach the scan.
    """
    at = rows.filter(F.col(key).startswith(prefix))
    if cursor is not None:
        at = at.filter(F.col(key) > cursor)
    first = at.orderBy(key).limit(limit)
    last = first.agg(F.max(key)).first()[0]
    more = last is not None and not at.filter(F.col(key) > last).isEmpty()
    return first, last if more else None


def pages(rows: DataFrame, key: str, prefix: str, limit: int = 1000) -> DataFrame:
    """Every row whose key has the prefix, with its page, as page after page would give them; one plan for all of them."""
    return numbered(rows.filter(F.col(key).startswith(prefix)), key).withColumn("page", F.floor(F.col("number") / limit)).drop("number")
