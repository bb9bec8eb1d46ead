"""The store of offerings: canonical rows, de-duplication, overrides, freshness and last-writer-wins merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import semester
from ..functions.names import canonical_key, is_tba, split_people
from .lineage import cut

#: Hours after which a scan that named nobody is stale.
TTL_MS = 6 * 60 * 60 * 1000
NOBODY = "__TBA__"


def canonical(rows: DataFrame) -> DataFrame:
    """Co-holders split into rows, text trimmed, sections upper case, and nobody's name blank. Rows without a section go.

    Each distinct text of instructor is parsed once and written, and joined to its rows.
    """
    said = rows.select(F.col("instructor").alias("__said")).distinct()
    named = F.trim(F.coalesce("instructor", F.lit("")))
    one = said.withColumn("instructor", F.explode(split_people(F.col("__said")))).withColumn("instructor", F.when(is_tba(named), "").otherwise(named))
    one = cut(one.withColumn("__key", F.when(F.col("instructor") == "", "").otherwise(canonical_key(F.col("instructor")))))
    at = rows.withColumnRenamed("instructor", "__raw").withColumn("section", F.upper(F.trim(F.coalesce("section", F.lit(""))))).filter("section <> ''")
    at = at.join(one, F.col("__raw").eqNullSafe(F.col("__said")))
    return at.select(*rows.columns, F.col("__key").alias("prof_key"))


def dedupe(rows: DataFrame) -> DataFrame:
    """The first row (by seq) of each course, term, section and holder; nobody's row goes where the section has a name.

    One partitioning by course, term and section serves both rules.
    """
    seat = Window.partitionBy("course_code", "term", "section")
    own = Window.partitionBy("course_code", "term", "section", "prof_key").orderBy("seq")
    at = rows.withColumn("__n", F.row_number().over(own)).withColumn("__named", F.max(F.when(F.col("prof_key") != "", 1).otherwise(0)).over(seat))
    return at.filter("__n = 1 AND (prof_key <> '' OR __named = 0)").drop("__n", "__named")


def override(rows: DataFrame, verified: DataFrame) -> DataFrame:
    """Confirmed holders take the place of scanned ones in every row of their section."""
    v = verified.select("course_code", "term", "section", F.col("prof_key").alias("__prof"), F.col("at").alias("__at"))
    at = rows.join(v, ["course_code", "term", "section"], "left")
    return at.withColumn("source", F.when(F.col("__prof").isNotNull(), "verified").otherwise("scan")).withColumn("prof_key", F.coalesce("__prof", "prof_key")).withColumnRenamed("__at", "verified_at").drop("__prof")


def latest_wins(log: DataFrame, keys: list[str], at: str = "at", arrival: str = "arrival") -> DataFrame:
    """The row of each key with the largest time; of equal times the one that came first. Partial sums, no window."""
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(-F.col(at), F.col(arrival))).alias("r"))
    return picked.select(*keys, "r.*")


def accepted(log: DataFrame, keys: list[str], at: str = "at", arrival: str = "arrival") -> DataFrame:
    """Rows of the log that a merge in order of arrival takes: later than all of their key before them."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("__most", F.max(at).over(before)).filter(F.col("__most").isNull() | (F.col(at) > F.col("__most"))).drop("__most")


def incomplete(total: Column, source: Column, pages: Column, exhausted: Column) -> Column:
    """A scan without rows, or a page walk that may have stopped at the first page."""
    walk = (source == "dom") & ~F.coalesce(exhausted, F.lit(False)) & (pages.isNull() | ((pages == 1) & (total <= 5)))
    return (F.coalesce(total, F.lit(0)) == 0) | walk


def fresh(scans: DataFrame, now_ms: int) -> DataFrame:
    """Adds fresh to scans (total, revealed, source, pages, exhausted, scanned_at, copied)."""
    final = F.col("revealed") > 0
    young = F.lit(now_ms) - F.col("scanned_at") < TTL_MS
    return scans.withColumn("fresh", ~incomplete(F.col("total"), F.col("source"), F.col("pages"), F.col("exhausted")) & ~F.col("copied") & (final | young))


def copied_terms(rows: DataFrame) -> DataFrame:
    """Course and midyear term whose rows are, as a multiset, those of the term before."""
    sig = F.concat_ws("|", F.upper("section"), "prof_key", "days", "time_start")
    whole = rows.groupBy("course_code", "term").agg(F.array_sort(F.collect_list(sig)).alias("sig"))
    prior = whole.select("course_code", (F.col("term") + 1).alias("term"), F.col("sig").alias("prior"))
    return whole.filter(semester(F.col("term")) == 3).join(prior, ["course_code", "term"]).select("course_code", "term", (F.col("sig") == F.col("prior")).alias("copied"))


def inherit_sections(rows: DataFrame, target: int) -> DataFrame:
    """The target's own sections, and each section it lacks from its newest earlier row, with nobody named."""
    own = rows.filter(F.col("term") == target).withColumn("inherited_from", F.lit(None).cast("int"))
    old = rows.filter(F.col("term") < target).join(own.select("course_code", "section").distinct(), ["course_code", "section"], "left_anti")
    newest = Window.partitionBy("course_code", "section").orderBy(F.desc("term"), "seq")
    old = old.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n").withColumn("inherited_from", F.col("term"))
    return own.unionByName(old.withColumn("term", F.lit(target)).withColumn("prof_key", F.lit("")))


def cleared(rows: DataFrame, courses: DataFrame) -> DataFrame:
    """rows without the partitions of courses (course_code)."""
    return rows.join(courses.select("course_code").distinct(), "course_code", "left_anti")
