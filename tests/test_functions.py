"""Unit tables of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from seatwise.functions import calendar as cal
from seatwise.functions import names, sections, text


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("term, label", [(1261, "1261 - First Semester (2026-2027)"), (1233, "1233 - Midyear (2023-2024)"), (1201, "1201 - First Semester (2030-2031)"), (1264, "1264")])
def test_label(one, term, label):
    assert value(one, cal.label(F.lit(term))) == label


def test_distance_and_history(one):
    assert value(one, cal.distance(F.lit(1251), F.lit(1261))) == 3 and value(one, cal.distance(F.lit(1253), F.lit(1261))) == 1 and value(one, cal.distance(F.lit(1250), F.lit(1261))) == 0
    assert value(one, cal.history(F.lit(1261))) == [1231, 1232, 1233, 1241, 1242, 1243, 1251, 1252, 1253]


@pytest.mark.parametrize("days, want", [("T TH", ["T", "TH"]), ("MWF", ["M", "W", "F"]), ("TTh", ["T", "TH"]), ("", []), (None, []), ("S SU", ["S", "SU"])])
def test_days(one, days, want):
    assert value(one, cal.parse_days(F.lit(days).cast("string"))) == want


@pytest.mark.parametrize("time, want", [("8:30 AM", 510), ("1:00 PM", 780), ("1:00", 780), ("10:00", 600), ("830", None), ("0830", 510), ("12:00 AM", 0), ("25:00", None), ("", None), ("noon", None)])
def test_time(one, time, want):
    assert value(one, cal.parse_time(F.lit(time))) == want


@pytest.mark.parametrize("raw, key, display", [("DELA ROSA, MARCO P.", "DELA ROSA|M", "DELA ROSA, MARCO P."), ("Dr. Marco P. dela Rosa Jr.", "DELA ROSA|M", "DELA ROSA, MARCO P."), ("TARDEN", "TARDEN", "TARDEN"), ("", "", ""), ("Prof.", "PROF", "Prof.")])
def test_names(one, raw, key, display):
    assert value(one, names.canonical_key(F.lit(raw))) == key and value(one, names.display_name(F.lit(raw))) == display


@pytest.mark.parametrize("raw, want", [("TBA", True), ("To Be Announced", True), ("", True), ("---", True), ("n/a", True), ("T.B.A.", True), ("QUIMBO, LENA", False)])
def test_tba(one, raw, want):
    assert value(one, names.is_tba(F.lit(raw))) == want


def test_jaro_winkler():
    assert names.jaro_winkler_of("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6)
    assert names.jaro_winkler_of("DIXON", "DICKSONX") == pytest.approx(0.813333, abs=1e-6)
    assert names.jaro_winkler_of("", "A") == 0 and names.jaro_winkler_of("", "") == 1


def test_similarity(spark):
    pairs = [("Marco dela Rosa", "DELA ROSA, MARCO P."), ("Rekalde", "RECALDE, IRIS"), ("Quimbo", "PALUGA, TOMAS L."), ("", "X")]
    got = [r.similarity for r in names.with_similarity(spark.createDataFrame(pairs, "q string, k string"), "q", "k").collect()]
    assert got[0] == 1.0 and got[1] > 0.6 > got[2] and got[3] == 0.0


@pytest.mark.parametrize("section, family, kind", [("E-3L", "E", "lab"), ("B1", "B", "lecture"), ("G-1L", "G", "lab"), ("B1L", "B", "lab"), ("AL", "AL", "lecture"), ("G", "G", "lecture")])
def test_sections(one, section, family, kind):
    assert value(one, sections.section_family(F.lit(section))) == family and value(one, sections.section_kind(F.lit(section))) == kind


@pytest.mark.parametrize("row, want, same", [("PI 10-1", "PI 10", True), ("PI 100", "PI 10", False), ("", "PI 10", True)])
def test_codes(one, row, want, same):
    assert value(one, sections.code_matches(F.lit(row), F.lit(want))) == same


def test_schedule(one):
    s = value(one, text.schedule(F.lit("TTh 8:30 AM - 10:00 AM HALL B")))
    assert (s.days, s.time_start, s.time_end, s.room) == ("TTH", "8:30 AM", "10:00 AM", "HALL B")
    assert value(one, text.schedule(F.lit("garbage"))) is None
