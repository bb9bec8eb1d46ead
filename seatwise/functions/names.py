"""Person names: cleaning, keys and similarity parts, as column expressions; Jaro-Winkler as a vectorised function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .binding import let

#: Tokens that carry no identity, suffixes, and particles that stay with the surname.
TITLES = ["DR", "DRA", "PROF", "PROFESSOR", "ASSOC", "ASSOCIATE", "ASST", "ASSISTANT", "ENGR", "ATTY", "ARCH", "MR", "MRS", "MS", "SIR", "MAAM", "MA'AM", "INSTR", "INSTRUCTOR", "LECTURER", "PHD", "MD", "DVM", "CPA", "RN", "MSC", "MS."]
SUFFIXES = ["JR", "SR", "II", "III", "IV", "V", "VI"]
PARTICLES = ["DE", "DELA", "DELOS", "DELAS", "DEL", "DES", "DI", "DA", "DOS", "DUS", "LA", "LAS", "LOS", "SAN", "SANTA", "STA", "STO", "VAN", "VON", "MAC", "MC"]
#: What stands for "nobody named yet", on cleaned text.
TBA = r"^(T\.?B\.?A\.?|TO\s*BE\s*A(NNOUNCED|SSIGNED)|N/?A|NONE|-+|STAFF|FACULTY|TBD|UNASSIGNED|NULL)?$"
#: Latin letters with a mark, and the plain ones.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīŁłŃńŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlNnNnOoOoRrRrSsSsSsTtTtUuUuUuZzZzZz"


def strip_marks(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), MARKED.replace("Ł", "").replace("ł", ""), PLAIN.replace("L", "").replace("l", ""))


def normalize(text: Column) -> Column:
    """Upper case, no accents, punctuation as a space (hyphens stay), single spaces."""
    up = F.upper(strip_marks(text))
    spaced = F.regexp_replace(F.regexp_replace(up, r"""[.,_/\\|;:()\[\]{}<>"'`*]+""", " "), r"[^A-Z0-9\s-]", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def is_tba(text: Column) -> Column:
    cleaned = F.regexp_replace(F.trim(F.regexp_replace(F.upper(strip_marks(text)), r"[^A-Z0-9/\s.-]", "")), r"\s+", " ")
    return cleaned.rlike(TBA)


def tokens(text: Column) -> Column:
    """The words of a name that carry identity."""
    dropped = F.array(*(F.lit(x) for x in [*TITLES, *SUFFIXES, ""]))
    return F.filter(F.split(normalize(text), " "), lambda t: ~F.array_contains(dropped, t))


def parse(name: Column) -> Column:
    """Struct surname (array), given (array). With a comma the surname stands first; else it is the last word, and the particles before it."""
    return let(F.trim(F.coalesce(name, F.lit(""))), _parsed)


def _parsed(text: Column) -> Column:
    left, right = tokens(F.substring_index(text, ",", 1)), tokens(F.regexp_replace(F.regexp_replace(text, r"^[^,]*,", ""), ",", " "))
    known = F.array(*(F.lit(x) for x in PARTICLES))

    def plain(every: Column) -> Column:
        n = F.size(every)
        # Of the words before the last: the ones after the last non-particle belong to the surname.
        places = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & ~F.array_contains(known, F.element_at(every, i)))
        cut = F.when(n <= 1, 0).otherwise(F.coalesce(F.array_max(places), F.lit(0)))
        return let(cut, lambda c: F.struct(F.slice(every, c + 1, F.greatest(n - c, F.lit(0))).alias("surname"), F.when(n <= 1, F.array().cast("array<string>")).otherwise(F.slice(every, F.lit(1), c)).alias("given")))

    return F.when(F.contains(text, F.lit(",")), F.struct(left.alias("surname"), right.alias("given"))).otherwise(let(tokens(text), plain))


def canonical_key(name: Column) -> Column:
    """SURNAME, or SURNAME|I with the first given initial; the normalised text where there is no surname."""
    initial = lambda p: F.substring(F.coalesce(F.try_element_at(p["given"], F.lit(1)), F.lit("")), 1, 1)
    key = lambda k: F.when(k["surname"] == "", normalize(name)).when(k["initial"] == "", k["surname"]).otherwise(F.concat_ws("|", k["surname"], k["initial"]))
    return let(parse(name), lambda p: let(F.struct(F.array_join(p["surname"], " ").alias("surname"), initial(p).alias("initial")), key))


def display_name(name: Column) -> Column:
    given = lambda p: F.array_join(F.transform(p["given"], lambda t: F.when(F.length(t) == 1, F.concat(t, F.lit("."))).otherwise(t)), " ")
    shown = lambda k: F.when(k["surname"] == "", F.trim(F.coalesce(name, F.lit("")))).when(k["given"] == "", k["surname"]).otherwise(F.concat_ws(", ", k["surname"], k["given"]))
    return let(parse(name), lambda p: let(F.struct(F.array_join(p["surname"], " ").alias("surname"), given(p).alias("given")), shown))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / most)


def name_soundex(word: Column) -> Column:
    return F.soundex(F.regexp_replace(normalize(word), "[^A-Z]", ""))


def token_set_ratio(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)))


def surname_variants(name: Column) -> Column:
    """What may have been meant as the surname: it, and every one, two or three neighbouring tokens run together."""

    def variants(whole: Column, every: Column) -> Column:
        grams = F.flatten(F.transform(every, lambda t, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.size(every) - i)), lambda k: F.array_join(F.slice(every, i + 1, k), ""))))
        return F.filter(F.array_distinct(F.concat(F.array(whole), grams)), lambda v: F.length(v) >= 2)

    return let(parse(name), lambda p: let(F.concat(p["surname"], p["given"]), lambda every: variants(F.array_join(p["surname"], ""), every)))


def with_keys(rows: DataFrame, name: str) -> DataFrame:
    """Adds surname, given, key, display and variants (joined by commas) of a column of names. Each distinct name is parsed once."""
    raw, p = F.col("__name"), parse(F.col("__name"))
    known = rows.select(F.col(name).alias("__name")).distinct()
    known = known.select("__name", let(p, lambda q: F.array_join(q["surname"], " ")).alias("surname"), let(p, lambda q: F.array_join(q["given"], " ")).alias("given"), canonical_key(raw).alias("key"), display_name(raw).alias("display"), F.array_join(surname_variants(raw), ",").alias("variants"))
    return rows.join(known, F.col(name).eqNullSafe(F.col("__name"))).drop("__name")


def split_people(names: Column) -> Column:
    """Names joined by AND, without the ones that name nobody; the whole text if none is left."""
    parts = F.transform(F.split(F.coalesce(names, F.lit("")), r"(?i)\s+AND\s+"), lambda x: F.trim(x))
    named = F.array_distinct(F.filter(parts, lambda x: ~is_tba(x)))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.coalesce(names, F.lit(""))))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro with the common prefix always credited (0.1 for each of up to 4), transpositions halved and not rounded."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    from_a = []
    for i, c in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if at is not None:
            free[at] = False
            from_a.append(c)
    m = len(from_a)
    if not m:
        return 0.0
    from_b = [c for j, c in enumerate(b) if not free[j]]
    swapped = sum(x != y for x, y in zip(from_a, from_b, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def best_surname(variants: pd.Series, surname: pd.Series) -> pd.Series:
    """The best Jaro-Winkler value of any variant against the surname."""
    return pd.Series([max((jaro_winkler_of(v, s or "") for v in vs), default=0.0) for vs, s in zip(variants, surname, strict=True)], dtype="float64")


# Marked so that the optimizer keeps them where they stand, and never moves them into a join's condition.
jaro_winkler, best_surname = jaro_winkler.asNondeterministic(), best_surname.asNondeterministic()


def with_similarity(rows: DataFrame, query: str, known: str, to: str = "similarity") -> DataFrame:
    """Adds how alike a typed and a known name are, 0 to 1: surname .5, whole .15, tokens .15, sound .1, initials .1.

    Each distinct name is parsed once, ahead of the pairing, and joined to the pairs.
    """
    flat, in_order = (lambda c: F.array_join(c, "")), (lambda c: F.array_join(F.array_sort(c), ""))
    q = rows.select(F.col(query).alias("__qn")).distinct().withColumn("__q", parse(F.col("__qn")))
    q = q.select("__qn", F.concat("__q.surname", "__q.given").alias("__qa"), surname_variants(F.col("__qn")).alias("__variants"), canonical_key(F.col("__qn")).alias("__qk"), F.array_distinct(tokens(F.col("__qn"))).alias("__qt"))
    k = rows.select(F.col(known).alias("__kn")).distinct().withColumn("__k", parse(F.col("__kn")))
    k = k.select("__kn", F.concat("__k.surname", "__k.given").alias("__ka"), F.col("__k.given").alias("__kg"), flat("__k.surname").alias("__surname"), canonical_key(F.col("__kn")).alias("__kk"), F.array_distinct(tokens(F.col("__kn"))).alias("__kt"))
    q = q.withColumn("__qf", flat("__qa")).withColumn("__qs", in_order("__qa"))
    k = k.withColumn("__kf", flat("__ka")).withColumn("__ks", in_order("__ka"))
    at = rows.join(q, F.col(query).eqNullSafe(F.col("__qn"))).join(k, F.col(known).eqNullSafe(F.col("__kn")))
    at = at.withColumn("__jw", best_surname("__variants", "__surname")).withColumn("__jf", jaro_winkler("__qf", "__kf")).withColumn("__js", jaro_winkler("__qs", "__ks"))
    surname = F.col("__surname")
    code = lambda v: F.soundex(F.regexp_replace(v, "[^A-Z]", ""))
    by_edits = F.coalesce(F.array_max(F.transform("__variants", lambda v: levenshtein_ratio(v, surname))), F.lit(0.0))
    sounds = (F.exists("__variants", lambda v: code(v) == code(surname)) & (surname != "")).cast("int")
    whole = F.greatest("__jf", "__js", levenshtein_ratio(F.col("__qf"), F.col("__kf")), levenshtein_ratio(F.col("__qs"), F.col("__ks")))
    dice = F.when((F.size("__qt") == 0) | (F.size("__kt") == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect("__qt", "__kt")) / (F.size("__qt") + F.size("__kt")))
    first = lambda xs: F.transform(xs, lambda t: F.substring(t, 1, 1))
    initials = F.when(F.size("__kg") == 0, 0.5).when(F.arrays_overlap(first(F.col("__qa")), first(F.col("__kg"))), 1.0).otherwise(0.35)
    score = 0.5 * F.greatest(F.col("__jw"), by_edits) + 0.15 * whole + 0.15 * dice + 0.1 * sounds + 0.1 * initials
    equal = F.col("__qk") == F.col("__kk")
    out = F.when((F.col("__qf") == "") | (F.col("__kf") == ""), F.lit(0.0)).when(equal, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    kept = [c for c in rows.columns if c != to]
    return at.withColumn(to, out).select(*kept, to)


def best_matches(queries: DataFrame, known: DataFrame, query: str, name: str, on: list[str], limit: int = 5, least: float = 0.4) -> DataFrame:
    """The best known names for each typed name, among those that agree in the columns on; a similarity join by equality."""
    scored = with_similarity(queries.join(known, on), query, name).filter(F.col("similarity") >= least)
    by = Window.partitionBy(*on, query).orderBy(F.desc("similarity"), name)
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit)


def suggestions(queries: DataFrame, known: DataFrame, query: str, name: str, on: list[str], least: float = 0.5) -> DataFrame:
    """A known spelling for each typed name of three characters or more, unless it already is that person's."""
    long = queries.filter(F.char_length(F.trim(query)) >= 3)
    best = best_matches(long, known, query, name, on, 1, least)
    return best.filter(~canonical_key(F.col(query)).eqNullSafe(canonical_key(F.col(name)))).drop("rank")
