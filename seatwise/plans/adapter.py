"""Offerings as a deterministic mapping of the provided tables, in Spark and as SQL for the oracle.

course_code: part brand; term: four-month slices of the ship date; section: letter and suffix; holder: supplier.
One row stays for each course, term and section: the first by seq.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut

DAYS = ["M W", "T TH", "W F", "M TH", "MWF", "S", "TTH"]
#: The term whose holders are hidden and predicted; earlier ones are history.
TARGET = 1291
BACKTEST = (1273, 1281, 1282, 1283)


def offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows, one per seat: course_code, term, section, prof_key, days, time_start, room, seq.

    They are written to the shared folder, so that a plan which uses them in many places reads the line items once. The first
    seq of each seat is found in numbers, which hash aggregation takes; only lines of such a seq are then made into whole rows.
    """
    seq = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_partkey", "l_suppkey", "l_linenumber", ((120 + F.year("l_shipdate") - 1992) * 10 + 1 + F.floor((F.month("l_shipdate") - 1) / 4)).cast("int").alias("term"),
        (F.col("l_linenumber") % 3).alias("__n"), seq.alias("seq"), F.coalesce(seq, F.lit(2**63 - 1)).alias("__at"))
    part = shuffled_parts(spark, sf_dir, F.col("p_brand").alias("course_code"), (F.col("p_size") % 8).alias("__s"), "p_type")
    key, at = ["course_code", "term", "__s", "__n"], F.col("l_partkey") == F.col("p_partkey")
    first = cut(line.select("l_partkey", "term", "__n", "__at").join(part.drop("p_type"), at).groupBy(*key).agg(F.min("__at").alias("__at")))
    few = line.join(first.select("__at").distinct(), "__at", "left_semi").join(part, at)
    own = reduce(and_, (F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*key, "__at")))
    few = few.alias("x").join(first.alias("y"), own, "left_semi")
    suffix = F.element_at(F.array(F.lit(""), F.lit("1"), F.lit("-1L")), F.col("__n") + 1)
    hour = 7 + F.col("l_partkey") % 10
    clock = F.when(hour < 12, F.concat(hour.cast("string"), F.lit(":00 AM"))).when(hour == 12, "12:00 PM").otherwise(F.concat((hour - 12).cast("string"), F.lit(":30")))
    rows = few.select(
        "course_code", "term", F.concat(F.char(65 + F.col("__s")), suffix).alias("section"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("prof_key"),
        F.element_at(F.array(*(F.lit(d) for d in DAYS)), F.col("l_linenumber") % 7 + 1).alias("days"), clock.alias("time_start"), F.col("p_type").alias("room"), "seq", "__at")
    one = rows.groupBy("course_code", "term", "section").agg(F.min(F.struct("__at", "prof_key", "days", "time_start", "room", "seq")).alias("r"))
    return cut(one.select("course_code", "term", "section", "r.prof_key", "r.days", "r.time_start", "r.room", "r.seq"))


def shuffled_parts(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    """Parts to be joined by p_partkey: shuffled like the line items, since a broadcast of them passes through the driver and grows with the input."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", *columns).hint("shuffle_hash")


def raw_offerings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are scanned: several per seat, some with nobody named (order priority 5), co-holders joined by AND."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = shuffled_parts(spark, sf_dir, "p_brand", "p_size", "p_name")
    year, month = F.year("l_shipdate"), F.month("l_shipdate")
    named = F.when(F.col("l_linenumber") % 5 == 0, "TBA").when(F.col("l_linenumber") % 4 == 0, F.concat(F.col("p_name"), F.lit(" AND S"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("p_brand").alias("course_code"), ((120 + year - 1992) * 10 + 1 + F.floor((month - 1) / 4)).cast("int").alias("term"),
        F.char(97 + F.col("p_size") % 8).alias("section"), named.alias("instructor"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"))


OFFERINGS_SQL = """offerings AS (
  SELECT course_code, term, section, prof_key, days, time_start, room, seq FROM (
    SELECT p_brand AS course_code, CAST((120 + year(l_shipdate) - 1992) * 10 + 1 + (month(l_shipdate) - 1) // 4 AS INT) AS term,
      chr(CAST(65 + p_size % 8 AS INT)) || CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN '1' ELSE '-1L' END AS section, 'S' || l_suppkey AS prof_key,
      CASE l_linenumber % 7 WHEN 0 THEN 'M W' WHEN 1 THEN 'T TH' WHEN 2 THEN 'W F' WHEN 3 THEN 'M TH' WHEN 4 THEN 'MWF' WHEN 5 THEN 'S' ELSE 'TTH' END AS days,
      CASE WHEN 7 + l_partkey % 10 < 12 THEN (7 + l_partkey % 10) || ':00 AM' WHEN 7 + l_partkey % 10 = 12 THEN '12:00 PM' ELSE (l_partkey % 10 - 5) || ':30' END AS time_start,
      p_type AS room, l_orderkey * 8 + l_linenumber AS seq
    FROM lineitem JOIN part ON l_partkey = p_partkey)
  QUALIFY row_number() OVER (PARTITION BY course_code, term, section ORDER BY seq, prof_key, days, time_start, room) = 1
)"""

RAW_SQL = """raw AS (
  SELECT p_brand AS course_code, CAST((120 + year(l_shipdate) - 1992) * 10 + 1 + (month(l_shipdate) - 1) // 4 AS INT) AS term, chr(CAST(97 + p_size % 8 AS INT)) AS section,
    CASE WHEN l_linenumber % 5 = 0 THEN 'TBA' WHEN l_linenumber % 4 = 0 THEN p_name || ' AND S' || l_suppkey ELSE 'S' || l_suppkey END AS instructor, l_orderkey * 8 + l_linenumber AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
