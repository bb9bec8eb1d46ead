"""Shortlist queries: reasons, seat bonus, lift, coverage, slower decay, ways of voting; names suggested and term labels matched."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import names
from ..operators import ensemble, history, learn, shortlist
from ..operators.lineage import cut
from .adapter import BACKTEST, OFFERINGS_SQL, TARGET, offerings
from .prediction import BLEND, DIGITS, FEATURES, MODELS, TERM_SQL, _full, _parts, _rounded, _targets
from .scalars import _RAW, _VALID, _YEAR
from .sql import FEATURES_SQL, HEURISTIC_SQL, evidence_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_PARTS = ", ".join(f"{{'i': {i}, 'name': '{n}', 'label': '{shortlist.LABELS[n]}', 'c': CAST({w} * {n} AS DOUBLE)}}" for i, (n, w) in enumerate(history.WEIGHTS.items()) if n in FEATURES)


@query("O05_E20_explain", f"""{TERM_SQL}, {FEATURES_SQL}, x AS (SELECT course_code, target, section, prof_key, unnest([{_PARTS}]) AS r FROM features), y AS (
  SELECT course_code, target, section, prof_key, row_number() OVER (PARTITION BY course_code, target, section, prof_key ORDER BY round(r.c, 9) DESC, r.i) AS place, r.name AS name, r.label AS label, r.c AS contribution FROM x WHERE r.c > 0.05
) SELECT course_code, target, section, prof_key, CAST(place AS INT) AS place, name, label, round(contribution, {DIGITS}) AS contribution FROM y WHERE place <= 3""")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(shortlist.explain(history.features(seats, ev)))


@query("E17_seat_bonus", f"""{TERM_SQL}, {FEATURES_SQL} SELECT f.course_code, f.target, f.section, f.prof_key, round(CAST(0.12 * section_exact + CASE WHEN last_same_prof = f.prof_key THEN 0.18 WHEN last_prof = f.prof_key THEN 0.1 WHEN prev_prof = f.prof_key THEN 0.06 ELSE 0 END AS DOUBLE), {DIGITS}) AS bonus
FROM features f LEFT JOIN memory m USING (course_code, target, section)""")
def seat_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bonus(*_parts(spark, sf_dir)[1:]).select("course_code", "target", "section", "prof_key", "bonus"))


def _bonus(ev: DataFrame, seats: DataFrame) -> DataFrame:
    return shortlist.seat_bonus(history.features(seats, ev), history.seat_memory(ev, history.profiles(ev)))


def _post(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, ev, seats = _parts(spark, sf_dir)
    scored = history.heuristic(history.features(seats, ev)).withColumn("score", F.col("heuristic"))
    return ev, seats, ensemble.posterior(scored, history.novelty_rate(rows, _targets(spark, (TARGET,))), 1.5)


@query("E17_lift")
def lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, seats, post = _post(spark, sf_dir)
    return _rounded(shortlist.lift(post, _bonus(ev, seats)))


@query("E18_coverage_keys", f"""{TERM_SQL}, firsts AS (SELECT course_code, target, prof_key, min(seq) AS cand_seq FROM ev GROUP BY ALL), recent AS (
  SELECT course_code, target, section, unnest([last_same_prof, last_prof, prev_prof]) AS prof_key, 0 AS tier, unnest([0, 1, 2]) AS place FROM memory JOIN seats USING (course_code, target, section)
), exact AS (
  SELECT course_code, target, section, prof_key, 1 AS tier, row_number() OVER (PARTITION BY course_code, target, section ORDER BY w DESC, last DESC, cand_seq, prof_key) AS place
  FROM (SELECT e.course_code, e.target, e.section, e.prof_key, round(sum(w), 9) AS w, max(term) AS last FROM ev e SEMI JOIN seats USING (course_code, target, section) GROUP BY ALL) JOIN firsts USING (course_code, target, prof_key)
), slot AS (
  SELECT course_code, target, section, prof_key, 2 AS tier, row_number() OVER (PARTITION BY course_code, target, section ORDER BY w DESC, cand_seq, prof_key) AS place FROM (
    SELECT s.course_code, s.target, s.section, e.prof_key, round(sum(w), 9) AS w FROM seats s JOIN ev e USING (course_code, target)
    WHERE abs(e.start - seat_start) <= 30 AND (len(dlist) = 0 OR len(seat_days) = 0 OR list_has_any(dlist, seat_days)) GROUP BY ALL) JOIN firsts USING (course_code, target, prof_key)
), kin AS (
  SELECT course_code, target, section, prof_key, 3 AS tier, row_number() OVER (PARTITION BY course_code, target, section ORDER BY w DESC, cand_seq, prof_key) AS place FROM (
    SELECT s.course_code, s.target, s.section, e.prof_key, round(sum(w), 9) AS w FROM seats s JOIN ev e USING (course_code, target, family) GROUP BY ALL) JOIN firsts USING (course_code, target, prof_key)
), every AS (
  SELECT * FROM recent WHERE prof_key IS NOT NULL UNION ALL SELECT * FROM exact UNION ALL SELECT * FROM slot WHERE place <= 3 UNION ALL SELECT * FROM kin WHERE place <= 3
), once AS (SELECT course_code, target, section, prof_key, min(tier * 1000000 + place) AS spot FROM every GROUP BY ALL)
SELECT course_code, target, section, prof_key, CAST(row_number() OVER (PARTITION BY course_code, target, section ORDER BY spot, prof_key) AS INT) AS place FROM once QUALIFY place <= 5""")
def coverage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return shortlist.coverage_keys(seats, ev, history.seat_memory(ev, history.profiles(ev)))


@query("E18_coverage")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, seats, post = _post(spark, sf_dir)
    return _rounded(shortlist.cover(post, shortlist.coverage_keys(seats, ev, history.seat_memory(ev, history.profiles(ev)))))


def _half_life_sql(h: float) -> str:
    body = f"WITH {evidence_sql(BACKTEST)}, {FEATURES_SQL}, {HEURISTIC_SQL}".replace("/ 4.0)", f"/ {h})")
    return f"""({body}, placed AS (SELECT *, row_number() OVER (PARTITION BY course_code, target, section ORDER BY round(heuristic, 9) DESC, cand_seq, prof_key) AS rank FROM scored),
hit AS (SELECT course_code, target, section, rank FROM placed WHERE prof_key = truth)
SELECT CAST({h} AS DOUBLE) AS half_life, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS top1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS topn FROM seats LEFT JOIN hit USING (course_code, target, section))"""


@query("E16_half_life", f"""WITH tried AS ({" UNION ALL ".join(f"SELECT * FROM {_half_life_sql(h)}" for h in (cal.HALF_LIFE, *shortlist.HALF_LIVES))}), b AS (
  SELECT max(CASE WHEN half_life = 4 THEN topn END) AS b4, max(CASE WHEN half_life = 6 THEN topn END) AS b6, max(CASE WHEN half_life = 8 THEN topn END) AS b8 FROM tried
), s AS (SELECT *, CASE WHEN b4 < 0.5 AND b6 > b4 + 0.01 THEN b6 ELSE b4 END AS v, CASE WHEN b4 < 0.5 AND b6 > b4 + 0.01 THEN 6 ELSE 4 END AS h FROM b),
c AS (SELECT CASE WHEN v < 0.5 AND b8 > v + 0.01 THEN 8 ELSE h END AS h FROM s)
SELECT half_life, round(top1, 6) AS top1, round(topn, 6) AS topn, half_life = h AS chosen FROM tried, c""")
def half_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlist accuracy of the hand-set score over the backtest at three speeds of decay."""
    rows, terms = offerings(spark, sf_dir), _targets(spark, BACKTEST)
    seats, tried = history.seats_of(rows, terms), []
    for h in (cal.HALF_LIFE, *shortlist.HALF_LIVES):
        scored = history.heuristic(history.features(seats, history.evidence(rows, terms, h), h)).withColumn("heuristic", F.round("heuristic", 9))
        ranked = ensemble.ranks(scored, ["heuristic"])
        tried.append(shortlist.accuracy(ranked, seats).withColumn("half_life", F.lit(h)))
    return _rounded(shortlist.choose_half_life(cut(reduce(DataFrame.unionByName, tried)), cal.HALF_LIFE).select("half_life", "top1", "topn", "chosen"))


@query("E15_vote_recipes")
def vote_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlist accuracy over the backtest with the ways of voting; 0 is as usual."""
    _, ev, seats = _parts(spark, sf_dir, BACKTEST)
    scored = ensemble.blend(_full(seats, ev), BLEND).withColumns({m: F.round(m, 9) for m in MODELS}).withColumn("score", F.round("score", 9))
    tried = cut(shortlist.accuracy_by(shortlist.recipe_ranks(scored, BLEND), seats, "recipe"))  # the choice reads it twice
    return _rounded(shortlist.choose_recipe(tried).select("recipe", "top1", "topn", "chosen"))


@query("G28_importance")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir, BACKTEST)
    return _rounded(learn.importances(history.features(seats, ev)))


@query("Q07_spelling")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each distinct raw name of a brand the best known part name, unless it is the same person or the name is too short."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    typed = part.select("p_brand", F.expr(_RAW).alias("typed")).distinct()
    return names.suggestions(typed, part.select("p_brand", F.col("p_name").alias("known")).distinct(), "typed", "known", ["p_brand"])


_WORD = "CASE {0} % 10 WHEN 1 THEN 'first semester' WHEN 2 THEN '2nd  sem' ELSE 'Midyear' END"
_TEXT = f"""CASE form WHEN 0 THEN 'Term ' || u || ' - open' WHEN 1 THEN {_WORD.format('u')} || ' AY ' || y || '-' || (y + 1) WHEN 2 THEN {_WORD.format('u')} || ' ' || (y % 100) || '-' || ((y + 1) % 100)
WHEN 3 THEN {_WORD.format('u')} || ' ' || (y + 1) WHEN 4 THEN 'Midterm exam ' || y ELSE u || '2' END"""
_HIT = {1: ("FIRST", "1ST"), 2: ("SECOND", "2ND"), 3: ("MIDYEAR", "MID-YEAR", "MID YEAR", "SUMMER")}


@query("P13_term_label_match", f"""WITH {OFFERINGS_SQL}, t AS (SELECT seq, term AS u, {_YEAR} AS y, CAST(seq % 6 AS INT) AS form, CAST(1231 + (seq // 6) % 69 AS INT) AS other FROM offerings),
n AS (SELECT seq, u, form, other, text, trim(regexp_replace(upper(text), '\\s+', ' ', 'g')) AS up FROM (SELECT *, {_TEXT} AS text FROM t)),
m AS (SELECT *, {_YEAR} AS y FROM (SELECT seq, u, form, text, up, unnest(list_distinct([u, other])) AS term FROM n) WHERE {_VALID})
SELECT seq, u, form, text, term, regexp_matches(up, '(^|[^0-9])' || term || '([^0-9]|$)') OR (
  CASE term % 10 {" ".join(f"WHEN {s} THEN {' OR '.join(f"contains(up, '{w}')" for w in ws)}" for s, ws in _HIT.items())} END
  AND (contains(up, CAST(y AS VARCHAR)) OR contains(up, (y % 100) || '-' || ((y + 1) % 100)) OR contains(up, (y % 100) || '' || ((y + 1) % 100)) OR (term % 10 = 3 AND contains(up, CAST(y + 1 AS VARCHAR))))) AS matched,
  regexp_matches(up, '\\b[0-9]{{2}}[3-9][123]\\b\\s*[-–]') OR regexp_matches(up, '(FIRST|SECOND|MID|MIDYEAR|MID-YEAR)\\s*(SEMESTER|SEM|YEAR)') AS termish FROM m""")
def term_label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each seat's term as a label, in one of six forms, matched with that term and with another."""
    seat = offerings(spark, sf_dir).select("seq", F.col("term").alias("u"), cal.start_year(F.col("term")).alias("y"), (F.col("seq") % 6).cast("int").alias("form"), (1231 + F.floor(F.col("seq") / 6) % 69).cast("int").alias("other"))
    both = seat.select("seq", "u", "form", F.expr(_TEXT).alias("text"), F.explode(F.array_distinct(F.array("u", "other"))).alias("term")).filter(cal.is_term(F.col("term")))
    return both.select("seq", "u", "form", "text", "term", cal.matches_term(F.col("text"), F.col("term")).alias("matched"), cal.looks_termish(F.col("text")).alias("termish"))
