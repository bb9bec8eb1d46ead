"""Sections, course codes and text around them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import normalize


def _tight(section: Column) -> Column:
    return F.regexp_replace(normalize(section), r"\s+", "")


def section_family(section: Column) -> Column:
    """Leading letters, or else the first character."""
    s = _tight(section)
    return F.when(s.rlike("^[A-Z]"), F.regexp_extract(s, "^([A-Z]+)", 1)).otherwise(F.substring(s, 1, 1))


def section_kind(section: Column) -> Column:
    s = _tight(section)
    return F.when(s.rlike(r"(?:LAB|RECIT|RECI)$|-\d*L$|[A-Z]+\d+L$"), "lab").otherwise("lecture")


def section_number(section: Column) -> Column:
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(F.upper(section), r"(\d+)", 1), F.lit("")), F.lit("999999999")).cast("long"), F.lit(0).cast("long"))


def section_filter(raw: Column) -> Column:
    """The families asked for; an empty array means all."""
    letters = F.regexp_replace(F.upper(F.coalesce(raw, F.lit(""))), "[^A-Z]", "")
    single = F.array_distinct(F.filter(F.split(F.regexp_replace(letters, "ALL", ""), ""), lambda c: c != ""))
    return F.when((letters == "") | (letters == "ALL"), F.array().cast("array<string>")).otherwise(single)


def section_allowed(section: Column, families: Column) -> Column:
    return (F.size(families) == 0) | F.array_contains(families, section_family(section))


def course_key(code: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(code, F.lit(""))), r"\s+", " "))


def code_matches(row: Column, want: Column) -> Column:
    """Same code, or the wanted one followed by anything but a digit. Empty codes pass."""
    a, b = (F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), r"\s+", "") for x in (row, want))
    after = F.substring(a, F.length(b) + 1, F.lit(1))
    return (a == "") | (b == "") | (a == b) | (F.startswith(a, b) & ~after.rlike(r"^\d"))


def code_in_text(text: Column, want: Column) -> Column:
    """Whether the code's first place in the text has no letter before it and no digit behind it."""
    up, code = F.upper(F.coalesce(text, F.lit(""))), F.upper(F.coalesce(want, F.lit("")))
    at = F.position(code, up)
    before, after = F.substring(up, at - 1, F.lit(1)), F.substring(up, at + F.length(code), F.lit(1))
    return (code == "") | ((at > 0) & ~((at > 1) & before.rlike("[A-Z]")) & ~after.rlike(r"\d"))


def format_percent(p: Column) -> Column:
    """A share as text: whole percent from 10 on, one decimal below, and bounds for the very large and small."""
    percent = F.round(p * 100, 7)
    return (
        F.when(percent >= 99.95, ">99.9%").when(percent >= 10, F.concat(F.round(percent, 0).cast("int").cast("string"), F.lit("%")))
        .when(percent >= 0.1, F.format_string("%.1f%%", F.round(percent, 1))).when(percent > 0, "<0.1%").otherwise("0%")
    )


#: Fixed pattern: a section behind a dash at a label's end.
DASHED = r"[-\u2013]\s*([A-Za-z0-9][A-Za-z0-9-]*)\s*$"


def labelled_section(section: Column, label: Column) -> Column:
    """The section itself, or where it is missing what stands behind the last dash of a label such as "MATH 31 - A1"."""
    behind = F.regexp_extract(label, DASHED, 1)
    return F.coalesce(section, F.when(behind != "", behind))
