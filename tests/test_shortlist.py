"""Shortlists: lift and coverage on hand-made seats, choices by accuracy, term labels and spelling suggestions."""

import pytest
from pyspark.sql import functions as F

from seatwise.functions import calendar as cal
from seatwise.functions import names
from seatwise.operators import shortlist


def test_lift_takes_an_owner_into_the_shortlist():
    flat = [(p, 0.0) for p in (0.12, 0.09, 0.07, 0.06, 0.05, 0.04)] + [(0.03, 0.3)]
    got = shortlist._lifted(flat, 5)
    assert got[0] == (0, False) and (6, True) in got[:5] and sorted(i for i, _ in got) == list(range(7))


@pytest.mark.parametrize("last", [(0.001, 0.4), (0.03, 0.0)])
def test_lift_leaves_ghosts_and_strangers(last):
    rows = [(p, 0.0) for p in (0.12, 0.09, 0.07, 0.06, 0.05, 0.04)] + [last]
    assert [i for i, _ in shortlist._lifted(rows, 5)] == list(range(7))


def test_coverage_fills_and_never_replaces_by_less():
    probs = [0.5, 0.2, 0.1, 0.05, 0.04, 0.03, 0.0]
    assert shortlist._covered([0, 1, 2], probs, [5, 6], 5) == [0, 1, 2, 5]
    assert shortlist._covered([0, 1, 2, 3, 4], probs, [5], 5) == [0, 1, 2, 3, 4]
    assert shortlist._covered([0, 1, 2, 3, 5], probs, [4], 5) == [0, 1, 2, 3, 4]


def chosen(df, column):
    return [r[column] for r in df.collect() if r.chosen]


@pytest.mark.parametrize(("b4", "b6", "b8", "want"), [(0.6, 0.9, 0.9, 4.0), (0.3, 0.31, 0.32, 8.0), (0.3, 0.55, 0.9, 6.0), (0.3, 0.2, 0.3, 4.0)])
def test_half_life(spark, b4, b6, b8, want):
    tried = spark.createDataFrame([(4.0, b4), (6.0, b6), (8.0, b8)], "half_life double, topn double")
    assert chosen(shortlist.choose_half_life(tried, 4.0), "half_life") == [want]


def test_recipe(spark):
    rows = lambda *v: spark.createDataFrame(list(enumerate(v)), "recipe int, topn double")
    assert chosen(shortlist.choose_recipe(rows(0.4, 0.4, 0.41, 0.415, 0.5, 0.505)), "recipe") == [4]
    assert chosen(shortlist.choose_recipe(rows(0.7, 0.9, 0.9, 0.9, 0.9, 0.9)), "recipe") == [0]


def test_term_labels(spark):
    cases = [
        ("1261 - First Semester (2026-2027)", 1261, True), ("12612", 1261, False), ("First Semester AY 2026-2027", 1261, True), ("1st sem 26-27", 1261, True),
        ("Midyear 2024", 1233, True), ("Second Semester 2026", 1261, False), ("Midterm", 1233, False), ("", 1261, False), (None, 1261, False),
    ]
    rows = spark.createDataFrame(cases, "text string, term int, want boolean")
    assert rows.filter(~cal.matches_term(F.col("text"), F.col("term")).eqNullSafe(F.col("want"))).count() == 0
    one = spark.createDataFrame([("1261 and 1261", True), ("1261, 1262", False), (" ", False), (None, False)], "text string, want boolean")
    assert one.filter(cal.names_one_term(F.col("text")) != F.col("want")).count() == 0


def test_suggestions(spark):
    known = spark.createDataFrame([("c", "DELA ROSA, MARCO P."), ("c", "QUIMBO, LENA M.")], "c string, known string")
    typed = spark.createDataFrame([("c", "Dela Rosa, Marko"), ("c", "QUIMBO, LENA M."), ("c", "Qu"), ("c", "ZZYZX, OOO"), ("c", None)], "c string, typed string")
    got = {r.typed: r.known for r in names.suggestions(typed, known, "typed", "known", ["c"]).collect()}
    assert "QUIMBO, LENA M." not in got and "Qu" not in got and None not in got and got.get("Dela Rosa, Marko", "DELA ROSA, MARCO P.") == "DELA ROSA, MARCO P."
