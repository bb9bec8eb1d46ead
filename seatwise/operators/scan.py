"""Incremental scans into a partitioned store: planned by an anti-join with what is fresh, written by overwriting partitions.

A store is a folder with records, partitioned by course and term, and scans, one row for each partition that was ever scanned. A
scan first marks its partitions as unfinished, then overwrites their records, then their rows in scans. One that breaks off
leaves partitions that the next plan takes up again; one that is repeated gives the same store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import semester
from . import store
from .lineage import cut

PART = ["course_code", "term"]
RECORDS = "section string, instructor string, prof_key string, days string, time_start string, seq bigint, scanned_at bigint, course_code string, term int"
SCANS = "total bigint, revealed bigint, source string, pages int, exhausted boolean, copied boolean, scanned_at bigint, course_code string, term int"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def _overwrite(rows: DataFrame, path: str) -> None:
    """Replaces those partitions that rows has; large ones are split over tasks, small ones put together."""
    rows.hint("rebalance", *PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PART).parquet(path)


def scans(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/scans", SCANS)


def records(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows: those that each partition's last finished scan wrote; none of an unfinished one or of one that found nothing."""
    last = scans(spark, path).filter("total > 0").select(*PART, "scanned_at")
    return _read(spark, f"{path}/records", RECORDS).join(last, [*PART, "scanned_at"], "left_semi")


def planned(wanted: DataFrame, seen: DataFrame, now_ms: int, forced: DataFrame | None = None) -> DataFrame:
    """Those of the wanted partitions (course_code, term) that aren't fresh, and those forced."""
    done = store.fresh(seen.filter("total IS NOT NULL"), now_ms).filter("fresh").select(*PART)
    if forced is not None:
        done = done.join(forced.select(*PART), PART, "left_anti")
    return wanted.select(*PART).distinct().join(done, PART, "left_anti")


def chosen(plan: DataFrame, sources: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """course_code, term, source of each planned partition; source is null where every source failed.

    sources: name, outcomes (course_code, term, ok, pages, exhausted), rows, in order. A later source is asked where those before it
    failed or found nothing, and believed where it has rows, or where they failed.
    """
    at, source, found = plan, F.lit(None).cast("string"), F.lit(0)
    for k, (name, outcomes, rows) in enumerate(sources):
        counts = rows.groupBy(*PART).agg(F.count("*").alias(f"n{k}"))
        at = at.join(outcomes.select(*PART, F.col("ok").alias(f"ok{k}")), PART, "left").join(counts, PART, "left")
        n, ok = F.coalesce(f"n{k}", F.lit(0)), F.coalesce(f"ok{k}", F.lit(False))
        takes = ok & (source.isNull() | ((found == 0) & (n > 0)))
        source, found = F.when(takes, name).otherwise(source), F.when(takes, n).otherwise(found)
    return at.select(*PART, source.alias("source"))


def _copied(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Midyear partitions of rows that repeat, row by row, what kept has for the term before."""
    signs = F.concat_ws("|", F.upper("section"), "prof_key", F.coalesce("days", F.lit("")), F.coalesce("time_start", F.lit("")))
    new = rows.filter(semester(F.col("term")) == 3).groupBy(*PART, signs.alias("sign")).agg(F.count("*").alias("n"))
    old = kept.groupBy("course_code", (F.col("term") + 1).alias("term"), signs.alias("sign")).agg(F.count("*").alias("old"))
    both = new.join(old.join(new.select(*PART).distinct(), PART, "left_semi"), [*PART, "sign"], "full")
    return both.groupBy(*PART).agg(F.bool_and(F.coalesce(F.col("n") == F.col("old"), F.lit(False))).alias("copied")).filter("copied")


def scan(spark: SparkSession, path: str, wanted: DataFrame, sources: list[tuple[str, DataFrame, DataFrame]], now_ms: int, forced: DataFrame | None = None) -> DataFrame:
    """Brings the store up to date; a row for each wanted partition: course_code, term, status (cached, done or failed), source, total, revealed.

    Fresh partitions aren't touched. Of the others, rows of the chosen source are cleaned and de-duplicated and take the
    partition's place, which is emptied if there are none; where every source failed it stays as it was, and stale. A midyear partition that repeats
    the term before is marked, so that it is scanned again. rows: course_code, term, section, instructor, days, time_start, seq.
    """
    seen = scans(spark, path)
    plan = cut(chosen(planned(wanted, seen, now_ms, forced), sources))
    taken = plan.filter("source IS NOT NULL")
    if taken.isEmpty():
        return _report(wanted, plan, seen)
    start = F.lit(now_ms).cast("long")
    unfinished = [F.lit(None).cast(t).alias(n) for n, t in (("total", "bigint"), ("revealed", "bigint"))]
    _overwrite(taken.select(*unfinished, "source", F.lit(None).cast("int").alias("pages"), F.lit(None).cast("boolean").alias("exhausted"), F.lit(False).alias("copied"), start.alias("scanned_at"), *PART), f"{path}/scans")
    raw = None
    for name, _, rows in sources:
        own = rows.select(*PART, "section", "instructor", "days", "time_start", "seq").join(taken.filter(F.col("source") == name).select(*PART), PART, "left_semi")
        raw = own if raw is None else raw.unionByName(own)
    clean = cut(store.dedupe(store.canonical(raw)).select("section", "instructor", "prof_key", "days", "time_start", "seq", start.alias("scanned_at"), *PART))
    copied = cut(_copied(clean, records(spark, path)))  # before what it is compared with goes
    _overwrite(clean, f"{path}/records")
    facts = None
    for name, outcomes, _ in sources:
        own = outcomes.select(*PART, F.lit(name).alias("source"), "pages", "exhausted")
        facts = own if facts is None else facts.unionByName(own)
    sums = clean.groupBy(*PART).agg(F.count("*").alias("total"), F.count_if(F.col("prof_key") != "").alias("revealed"))
    done = taken.join(facts, [*PART, "source"], "left").join(sums, PART, "left").join(copied, PART, "left").fillna(0, ["total", "revealed"]).fillna(False, ["copied"])
    _overwrite(done.select("total", "revealed", "source", "pages", "exhausted", "copied", start.alias("scanned_at"), *PART), f"{path}/scans")
    return _report(wanted, plan, scans(spark, path))


def _report(wanted: DataFrame, plan: DataFrame, now: DataFrame) -> DataFrame:
    at = wanted.select(*PART).distinct().join(plan.select(*PART, F.coalesce("source", F.lit("")).alias("from")), PART, "left").join(now.select(*PART, "total", "revealed"), PART, "left")
    status = F.when(F.col("from").isNull(), "cached").when(F.col("from") == "", "failed").otherwise("done")
    return cut(at.select(*PART, status.alias("status"), F.nullif("from", F.lit("")).alias("source"), "total", "revealed"))
