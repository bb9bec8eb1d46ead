"""Term codes, clock times and decay, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the term calendar: a code is prefix (2 digits), year digit, semester.
SEMESTERS = {1: "First Semester", 2: "Second Semester", 3: "Midyear"}
FLOOR = 1231
HALF_LIFE = 4.0
#: Half-width of time similarity, in minutes.
TIME_REACH = 180
DAY_PATTERN = "(TH|SA|SU|M|T|W|F|S)"


def _text(term: Column) -> Column:
    return F.trim(F.coalesce(term.cast("string"), F.lit("")))


def is_term_code(term: Column) -> Column:
    return _text(term).rlike(r"^\d{4}$")


def is_term(term: Column) -> Column:
    """A code of four digits whose last is a semester."""
    return _text(term).rlike(r"^\d{3}[123]$")


def _digit(term: Column, at: int, n: int = 1) -> Column:
    return F.when(is_term(term), F.substring(_text(term), at, n).cast("int"))


def semester(term: Column) -> Column:
    return _digit(term, 4)


def start_year(term: Column) -> Column:
    """The starting year: digits 0 to 2 belong to the 2030s."""
    digit = _digit(term, 3)
    return digit + F.when(digit >= 3, 2020).otherwise(2030)


def parsed(term: Column) -> Column:
    """Struct of a term's parts, null if it isn't a term."""
    year = start_year(term)
    label = F.element_at(F.create_map(*(F.lit(x) for kv in SEMESTERS.items() for x in kv)), semester(term))
    whole = F.struct(
        _text(term).cast("int").alias("code"), _digit(term, 1, 2).alias("prefix"), _digit(term, 3).alias("year_digit"), semester(term).alias("semester"),
        year.alias("start_year"), (year + 1).alias("end_year"), F.concat_ws("-", year, year + 1).alias("academic_year"), label.alias("semester_label"))
    return F.when(is_term(term), whole)


def label(term: Column) -> Column:
    p = parsed(term)
    return F.when(is_term(term), F.concat(_text(term), F.lit(" - "), p["semester_label"], F.lit(" ("), p["academic_year"], F.lit(")"))).otherwise(term.cast("string"))


def short_label(term: Column) -> Column:
    p = parsed(term)
    tag = F.when(p["semester"] == 3, "MY").otherwise(F.concat(F.lit("S"), p["semester"].cast("string")))
    return F.when(is_term(term), F.concat(_text(term), F.lit(" "), tag, F.lit(" "), (p["start_year"] % 100).cast("string"), F.lit("-"), (p["end_year"] % 100).cast("string"))).otherwise(term.cast("string"))


def ordinal(term: Column) -> Column:
    """Semesters since prefix 0: neighbouring terms differ by one."""
    return (_digit(term, 1, 2) * 10 + _digit(term, 3)) * 3 + semester(term) - 1


def distance(start: Column, end: Column) -> Column:
    """Semesters from start to end; 0 if either isn't a term."""
    return F.coalesce(ordinal(end) - ordinal(start), F.lit(0))


def history(target: Column, floor: int = FLOOR) -> Column:
    """Array of the terms from floor up to but without target."""
    codes = F.sequence(F.lit(floor), F.greatest(F.lit(floor), target.cast("int")))
    return F.when(is_term(target), F.filter(codes, lambda c: (c < target.cast("int")) & (c % 10).between(1, 3))).otherwise(F.array().cast("array<int>"))


def same_semester_history(target: Column, floor: int = FLOOR) -> Column:
    return F.filter(history(target, floor), lambda c: c % 10 == semester(target))


def parse_days(days: Column) -> Column:
    """Distinct day tokens in order, longest first: 'T TH' gives T, TH."""
    letters = F.regexp_replace(F.upper(F.coalesce(days, F.lit(""))), "[^A-Z]", "")
    return F.array_distinct(F.regexp_extract_all(letters, F.lit(DAY_PATTERN), F.lit(1)))


def parse_time(time: Column) -> Column:
    """Minutes past midnight of the leading clock time, or null. Bare hours from 1 to 6 are afternoon."""
    pattern = r"^(\d{1,2})[:.]?(\d{2})?\s*(AM|PM)?"
    text = F.upper(F.trim(F.coalesce(time, F.lit(""))))
    part = lambda i: F.regexp_extract(text, pattern, i)
    hour, minute = part(1).cast("int"), F.coalesce(F.nullif(part(2), F.lit("")).cast("int"), F.lit(0))
    half = part(3)
    clock = F.when((half == "PM") & (hour < 12), hour + 12).when((half == "AM") & (hour == 12), 0).when((half == "") & hour.between(1, 6), hour + 12).otherwise(hour)
    return F.when(text.rlike(r"^\d") & (clock <= 23) & (minute <= 59), clock * 60 + minute)


def day_jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def time_similarity(a: Column, b: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.abs(a - b) / float(TIME_REACH)), F.lit(0.0))


def decay_weight(term: Column, target: Column, half_life: float | Column = HALF_LIFE) -> Column:
    return F.pow(F.lit(0.5), F.abs(distance(term, target)) / half_life)


#: Words by which labels name a semester.
SEMESTER_WORDS = {1: ("FIRST", "1ST"), 2: ("SECOND", "2ND"), 3: ("MIDYEAR", "MID-YEAR", "MID YEAR", "SUMMER")}


def _upper(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"\s+", " "))


def matches_term(text: Column, term: Column) -> Column:
    """Whether a label names the term: its code standing alone, or a word of its semester with its year in some form."""
    upper, p = _upper(text), parsed(term)
    alone = F.regexp_like(upper, F.concat(F.lit("(^|[^0-9])"), _text(term), F.lit("([^0-9]|$)")))
    short = [(p[c] % 100).cast("string") for c in ("start_year", "end_year")]
    year = upper.contains(p["start_year"].cast("string")) | upper.contains(F.concat_ws("-", *short)) | upper.contains(F.concat(*short))
    year = year | ((p["semester"] == 3) & upper.contains(p["end_year"].cast("string")))
    word = F.lit(False)
    for number, words in SEMESTER_WORDS.items():
        word = word | ((p["semester"] == number) & upper.rlike("|".join(words)))
    return (upper != "") & (alone | F.coalesce(word & year, F.lit(False)))


def looks_termish(text: Column) -> Column:
    """Whether a text seems to name some term."""
    upper = _upper(text)
    return upper.rlike(r"\b\d{2}[3-9][123]\b\s*[-–]") | upper.rlike(r"(FIRST|SECOND|MID|MIDYEAR|MID-YEAR)\s*(SEMESTER|SEM|YEAR)")


def names_one_term(text: Column) -> Column:
    """Whether a text isn't blank and holds at most one distinct term code."""
    codes = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(1[2-9]\d[123])\b"), F.lit(1))
    return (F.trim(F.coalesce(text, F.lit(""))) != "") & (F.size(F.array_distinct(codes)) <= 1)
