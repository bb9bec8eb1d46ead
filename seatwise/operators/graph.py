"""Seats that overlap in time, and their connected groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Minutes that a seat without an end is taken to last.
LENGTH = 60
ROUNDS = 64


def conflicts(seats: DataFrame) -> DataFrame:
    """Pairs a < b of a course that share a day and overlap: an interval join within the course and day."""
    on_day = seats.filter("start IS NOT NULL").select("course_code", "section", "start", F.explode("days").alias("day"))
    x, y = on_day.alias("x"), on_day.alias("y")
    same = (F.col("x.course_code") == F.col("y.course_code")) & (F.col("x.day") == F.col("y.day")) & (F.col("x.section") < F.col("y.section"))
    over = (F.col("x.start") < F.col("y.start") + LENGTH) & (F.col("y.start") < F.col("x.start") + LENGTH)
    return x.join(y, same & over).select(F.col("x.course_code").alias("course_code"), F.col("x.section").alias("a"), F.col("y.section").alias("b")).distinct()


def conflict_groups(seats: DataFrame) -> DataFrame:
    """course_code, section, grp: the smallest section that overlaps reach. Smallest labels spread until none changes.

    A chain of more than ROUNDS seats raises an error, so no unfinished label is returned.
    """
    edges = conflicts(seats)
    both = edges.union(edges.select("course_code", F.col("b"), F.col("a"))).cache()
    label = seats.select("course_code", "section", F.col("section").alias("grp"))
    for _ in range(ROUNDS):
        near = both.join(label.withColumnRenamed("section", "a"), ["course_code", "a"]).groupBy("course_code", F.col("b").alias("section")).agg(F.min("grp").alias("near"))
        step = label.join(near, ["course_code", "section"], "left").select("course_code", "section", F.least("grp", "near").alias("grp"), (F.col("near") < F.col("grp")).alias("moved")).cache()
        label = step.select("course_code", "section", "grp")
        if not step.filter("moved").limit(1).count():
            return label
    raise RuntimeError(f"labels still change after {ROUNDS} rounds")
