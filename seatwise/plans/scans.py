"""Incremental scans of the raw offerings: three runs into one store, from two sources of which the first fails or is empty for some partitions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..operators.lineage import cut, shared_dir
from .adapter import TARGET, raw_offerings
from .tables import ORACLES as _TABLES

QUERIES, ORACLES = {}, {}
HOUR = 3_600_000


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: Terms from this one on name nobody yet.
HIDDEN = 1283


def _sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, DataFrame, DataFrame]]]:
    """What is wanted, and the sources: pages of the site (fails where course and term are 0 modulo 5, empty at 1, one page only at 2), and an interface (fails at 0 modulo 3)."""
    rows = raw_offerings(spark, sf_dir).withColumn("instructor", F.when(F.col("term") >= HIDDEN, "TBA").otherwise(F.regexp_replace("instructor", "^.* AND ", "T9 AND ")))
    mark = F.regexp_extract("course_code", r"(\d+)$", 1).cast("int") + F.col("term")
    rows = cut(rows.select("course_code", "term", "section", "instructor", F.lit("").alias("days"), F.lit("").alias("time_start"), "seq", mark.alias("mark")))  # read by each run and source
    wanted = cut(rows.select("course_code", "term").distinct())
    pages = wanted.select("*", (mark % 5 != 0).alias("ok"), F.when(mark % 5 == 2, 1).otherwise(3).alias("pages"), (mark % 5 != 2).alias("exhausted"))
    api = wanted.select("*", (mark % 3 != 0).alias("ok"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("boolean").alias("exhausted"))
    return wanted, [("dom", pages, rows.filter((F.col("mark") % 5).isin(2, 3, 4))), ("api", api, rows.filter(F.col("mark") % 3 != 0))]


def _runs(spark: SparkSession, sf_dir: str) -> tuple[str, list[DataFrame]]:
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    wanted, sources = _sources(spark, sf_dir)
    target = wanted.filter(F.col("term") == TARGET)
    return path, [scan.scan(spark, path, wanted, sources, hours * HOUR, target if hours else None) for hours in (0, 1, 8)]


_HELD = f"""held AS (SELECT course_code, term, section, CASE WHEN term >= {HIDDEN} OR instructor = '' THEN '' WHEN regexp_matches(instructor, '^S[0-9]+$') THEN instructor ELSE 'T9' END AS prof_key FROM ({_TABLES['D01_J02_P02_dedupe']})),
counted AS (SELECT course_code, term, count(DISTINCT (section, prof_key)) AS total, count(DISTINCT (section, prof_key)) FILTER (prof_key <> '') AS revealed, CAST(regexp_extract(course_code, '[0-9]+$') AS INT) + term AS m FROM held GROUP BY course_code, term),
first AS (SELECT course_code, term, CASE WHEN m % 5 IN (2, 3, 4) THEN 'dom' WHEN m % 3 <> 0 THEN 'api' WHEN m % 5 = 1 THEN 'dom' END AS source, CASE WHEN m % 5 < 2 AND m % 3 = 0 THEN 0 ELSE total END AS total, CASE WHEN m % 5 < 2 AND m % 3 = 0 THEN 0 ELSE revealed END AS revealed, m FROM counted),
known AS (SELECT *, source IS NOT NULL AND total > 0 AND NOT (source = 'dom' AND m % 5 = 2 AND total <= 5) AS complete FROM first)"""


@query("S16_S17_M07_J03_scan_runs", f"""WITH {_HELD}, runs AS (
  SELECT 1 AS run, *, FALSE AS fresh FROM known UNION ALL SELECT 2, *, complete AND term <> {TARGET} FROM known UNION ALL SELECT 3, *, complete AND revealed > 0 AND term <> {TARGET} FROM known)
SELECT CAST(run AS INT) AS run, course_code, term, CASE WHEN fresh THEN 'cached' WHEN source IS NULL THEN 'failed' ELSE 'done' END AS status, CASE WHEN NOT fresh THEN source END AS source,
  CASE WHEN source IS NOT NULL THEN total END AS total, CASE WHEN source IS NOT NULL THEN revealed END AS revealed FROM runs""")
def scan_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of three runs did: all at first; an hour later what failed, was empty or incomplete, and the forced term; then also what named nobody, as it is over six hours old."""
    _, runs = _runs(spark, sf_dir)
    out = None
    for k, run in enumerate(runs, 1):
        one = run.select(F.lit(k).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("S17_S18_store_rows", f"""WITH {_HELD} SELECT DISTINCT course_code, term, section, prof_key FROM held JOIN known USING (course_code, term) WHERE source IS NOT NULL AND known.total > 0""")
def store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's rows after the three runs."""
    path, _ = _runs(spark, sf_dir)
    return scan.records(spark, path).select("course_code", "term", "section", "prof_key")
