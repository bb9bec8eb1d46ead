"""Canonical rows from JSON documents of unknown shape, and a report of where their fields were found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import documents as d


def records(docs: DataFrame, doc_col: str, course: Column) -> DataFrame:
    """docs without doc_col, with section, instructor, days, time_start, time_end, room, class_id, status and paths (what:path of each field found).

    Left out: what is no JSON object, documents of another course, and, after that, rows without a section (its paths are
    still counted by field_report, over located). A null document is none. Nothing is shuffled.
    """
    return located(docs, doc_col, course).filter("section <> ''")


def located(docs: DataFrame, doc_col: str, course: Column) -> DataFrame:
    """records, with the rows that have no section."""
    once = lambda df, name, value: df.select("*", F.explode(F.array(value)).alias(name))  # noqa: E731  what filters look at isn't worked out again for them
    at = once(docs.filter(d.kind_of(F.col(doc_col)) == "OBJECT"), "__entries", d.entries(F.col(doc_col), 4, kind=F.lit("OBJECT")))
    listed = F.col("__entries")
    at = once(at.filter(d.course_fits(listed, course)), "__section", d.section_of(listed))
    own = lambda k: d.find(listed, [k], lambda e: e["text"].isNotNull() & (e["kind"] != "VOID"), 0)["text"]
    # Columns of their own: what a query doesn't ask for isn't searched.
    at = at.withColumns({
        "__instructor": d.instructor_of(listed), "__schedule": d.schedule_of(listed),
        "__id": F.coalesce(own("id"), own("class_id"), own("class_nbr")), "__status": d.find(listed, d.STATUS, depth=2)["text"],
    })
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    path = lambda what: F.when(F.col(f"__{what}.path").isNotNull(), F.concat(F.lit(f"{what}:"), F.col(f"__{what}.path")))
    paths = F.concat(
        F.array_compact(F.array(path("section"), F.coalesce(path("instructor"), F.lit("instructor missing")))),
        F.transform("__schedule.paths", lambda p: F.concat(F.lit("schedule:"), p)))
    return at.select(
        *(c for c in docs.columns if c != doc_col), blank("__section.value").alias("section"), blank("__instructor.value").alias("instructor"),
        *(F.col(f"__schedule.{n}").alias(n) for n in ("days", "time_start", "time_end", "room")), F.col("__id").alias("class_id"), blank("__status").alias("status"), paths.alias("paths"))


def field_report(found: DataFrame) -> DataFrame:
    """what, path, n: how many of located's rows have a field at each path; a missing instructor has path null. Counted before the shuffle."""
    one = found.select(F.explode("paths").alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    missing = F.col("p") == "instructor missing"
    return one.select(F.when(missing, "missing").otherwise(F.regexp_extract("p", "^([^:]*):", 1)).alias("what"), F.when(~missing, F.regexp_extract("p", "^[^:]*:(.*)$", 1)).alias("path"), "n")


def document_paths(docs: DataFrame, doc_col: str, depth: int = 4) -> DataFrame:
    """path, kind, n: every path of the documents with the kinds of its values, and how many documents' entries are there."""
    listed = docs.select(F.explode(F.transform(d.entries(F.col(doc_col), depth), lambda e: F.struct(e["path"].alias("path"), e["kind"].alias("kind")))).alias("e"))
    return listed.groupBy("e.path", "e.kind").agg(F.count("*").alias("n"))


def responses(pages: DataFrame, doc_col: str) -> DataFrame:
    """pages without doc_col, with path (of the list that holds the rows; null without one), rows (its elements as JSON), last_page, page, total."""
    at = pages.withColumn("__list", d.record_list(F.col(doc_col))).withColumn("__info", d.page_info(F.col(doc_col)))
    rows = F.coalesce(F.col("__list.rows"), F.array().cast("array<string>"))
    return at.select(*(c for c in pages.columns if c != doc_col), F.col("__list.path").alias("path"), rows.alias("rows"), "__info.last_page", "__info.page", "__info.total")
