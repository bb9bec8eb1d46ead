"""The table of a page that lists classes, chosen by the words of its header, and its rows by what the header says each cell is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.documents import let
from ..functions.sections import code_in_text, code_matches

#: What a header's words count (of one list only the first that is there), what a table's text counts, and the least for a choice.
HEADER_POINTS = [[("CODE", 3)], [("CLASS DETAILS", 4), ("CLASS", 2)], [("INSTRUCTOR", 4), ("FACULTY", 4)], [("SECTION", 2)], [("SCHEDULE", 2)], [("DETAILS", 1)]]
BODY_POINTS = [(r"(?i)FACULTY\s*:", 5), (r"(?i)INACTIVE TERM", 2)]
LEAST = 3
#: Words that tell a table of what somebody is enlisted in, and the words by which header cells are known.
NOT_OFFERED = ["FINALIZED", "ENLISTMENT CAN'T", "ENLISTMENT CANT"]
COLUMNS = {"section": ["SECTION"], "details": ["CLASS DETAILS", "DETAILS"], "code": ["CODE", "COURSE", "SUBJECT"], "instructor": ["INSTRUCTOR", "FACULTY", "PROFESSOR", "TEACHER"], "schedule": ["SCHEDULE", "TIME", "DAY"], "room": ["ROOM", "VENUE", "LOCATION"]}


def _plain(cells: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.array_join(cells, " ")), r"\s+", " "))


def _has(words: Column, one: str) -> Column:
    return F.contains(words, F.lit(one))


def _header(rows: Column) -> Column:
    """The position of a table's header: its first row of header words that doesn't name a faculty; else its first row."""
    told = lambda r: _plain(r).rlike("CODE|CLASS DETAILS|INSTRUCTOR|SECTION") & ~_plain(r).rlike(r"FACULTY\s*:")
    return F.coalesce(F.get(F.filter(F.transform(rows, lambda r, i: F.when(told(r), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(0))


def _points(rows: Column, header: Column) -> Column:
    body = F.array_join(F.transform(rows, _plain), " ")
    head = _plain(F.get(rows, header))
    first = lambda options: reduce(lambda rest, o: F.when(_has(head, o[0]), o[1]).otherwise(rest), reversed(options), F.lit(0))
    action = F.when(_has(head, "ACTION") & ~_has(head, "STATUS/ACTION"), 1).otherwise(0)
    total = reduce(lambda a, b: a + b, [first(o) for o in HEADER_POINTS] + [F.when(body.rlike(p), n).otherwise(0) for p, n in BODY_POINTS], action)
    enlisted = reduce(lambda a, b: a | b, (_has(body, w) for w in NOT_OFFERED)) | (_has(body, "STATUS/ACTION") & ~_has(body, "INSTRUCTOR") & ~_has(body, "FACULTY"))
    return F.when(enlisted, 0).otherwise(total)


def elected(pages: DataFrame) -> DataFrame:
    """pages (with tables: array of block, rows) with the table of the most points, the first of equals, as block, header, rows, points in place of tables; pages without one that has LEAST are left out."""
    rated = F.transform("tables", lambda t: let(_header(t["rows"]), lambda h: F.struct(_points(t["rows"], h).alias("points"), (-t["block"]).alias("order"), h.alias("header"), t["rows"].alias("rows"))))
    at = pages.select("*", F.explode(F.array(F.array_max(rated))).alias("__best")).filter(F.col("__best.points") >= LEAST)
    return at.select(*(c for c in pages.columns if c != "tables"), (-F.col("__best.order")).alias("block"), "__best.header", "__best.rows", "__best.points")


def _at(cells: Column, position: Column) -> Column:
    return F.coalesce(F.when(position >= 0, F.trim(F.get(cells, position))), F.lit(""))


def table_rows(chosen: DataFrame, course: str = "course_code") -> DataFrame:
    """Canonical rows of elected tables: the other columns of chosen, row, section, instructor, days, time_start, time_end, room, status, and fits.

    Cells are known by the header's words, so columns may come in any order. A row without a section is left out, like one that says that there is
    no data; fits tells rows of the wanted course (which a column names) from those of others.
    """
    others = [c for c in chosen.columns if c not in ("block", "header", "rows", "points")]
    head = F.transform(F.get("rows", F.col("header")), lambda c: F.upper(c))
    where = lambda words: F.coalesce(F.get(F.filter(F.transform(head, lambda c, i: F.when(reduce(lambda a, b: a | b, (_has(c, w) for w in words)), i)), lambda i: i.isNotNull()), F.lit(0)), F.lit(-1))
    at = chosen.select(*others, "header", F.explode(F.array(F.struct(*(where(w).alias(n) for n, w in COLUMNS.items())))).alias("p"), "rows")
    at = at.select(*others, "p", "header", F.posexplode("rows").alias("row", "cells")).filter("row <> header")
    cell = {n: _at(F.col("cells"), F.col(f"p.{n}")) for n in COLUMNS}
    whole = F.array_join(F.filter(F.concat(F.array(cell["details"]), F.col("cells")), lambda c: c != ""), " | ")
    at = at.select(*others, "row", "p", *(c.alias(f"__{n}") for n, c in cell.items()), F.explode(F.array(whole)).alias("__text")).filter(~F.upper("__text").rlike("NO DATA|NO CLASS"))
    said = lambda c: F.nullif(c, F.lit(""))
    details, row_text = F.col("__details"), F.col("__text")
    section = F.coalesce(said(text.section(details)), said(text.section(row_text)), said(text.section(F.col("__section"))), said(F.element_at(F.split(F.upper("__section"), r"\s+"), -1)), F.lit(""))
    person = F.coalesce(said(F.col("__instructor")), said(text.person(details)), text.person(row_text))
    timed = text.schedule(F.when(details != "", details).when(F.col("p.schedule") >= 0, F.col("__schedule")).otherwise(row_text))
    fits = F.when(F.col("p.code") >= 0, code_matches(F.col("__code"), F.col(course))).otherwise(code_in_text(row_text, F.col(course)))
    place = lambda t: F.coalesce(said(F.col("__room")), said(text.room(F.when(details != "", details).otherwise(row_text))), t["room"], F.lit(""))
    status = F.when(F.upper("__text").contains("CLOSED"), "Closed").when(F.upper("__text").contains("OPEN"), "Open").otherwise("")
    blank = lambda t, n: F.coalesce(t[n], F.lit("")).alias(n)
    row = let(timed, lambda t: F.struct(section.alias("section"), person.alias("instructor"), blank(t, "days"), blank(t, "time_start"), blank(t, "time_end"), place(t).alias("room"), status.alias("status"), fits.alias("fits")))
    return at.select(*others, "row", F.explode(F.array(row)).alias("r")).filter("r.section <> ''").select(*others, "row", "r.*")
