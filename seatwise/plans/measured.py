"""The prediction by measured weights: held-out accuracy, derived and pinned weights, fitted temperature, two passes, confidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts, ensemble, history, weighting
from ..operators.lineage import cut
from .adapter import BACKTEST, TARGET, offerings
from .prediction import MODELS, _parts, _r, _rounded, _targets
from .second_pass import _FLAGGED, _FULL, CONFIRMED_SQL, _confirmed
from .sql import GUESSES_SQL, HEURISTIC_SQL, PAIRS_SQL, evidence_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: The terms that weights, temperatures and hits are measured on.
MEASURED = BACKTEST
#: The temperatures that calibration tries, written out for the oracle.
_GRID = "[0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0, 4.0, 6.0]"
_SEAT = "PARTITION BY course_code, target, section"
_HELD_OUT = f"target IN ({', '.join(map(str, MEASURED))})"

_ON = lambda a, b, *more: " AND ".join(f"{a}.{x} = {b}.{y}" for x, y in (("course_code", "course_code"), ("target", "target"), *more))
#: Partner features by rows that aren't zero, from guesses on; the plain form over all pairs is the oracle of V13.
_SPARSE = f"""said AS (SELECT course_code, target, section, family, prof_key, probability AS p FROM guesses WHERE probability >= 0.05),
conds AS (SELECT course_code, target, section, prof_key, sum(v) AS cond FROM (
  SELECT a.course_code, a.target, a.section, a.prof_key, p * p_seat AS v FROM said JOIN seat_seat a ON {_ON('a', 'said', ('g_section', 'section'), ('g_prof', 'prof_key'))}
  UNION ALL SELECT s.course_code, s.target, s.section, s.prof_key, p * p_family FROM said JOIN fam_fam f ON {_ON('f', 'said', ('g_family', 'family'), ('g_prof', 'prof_key'))}
    JOIN scored s ON {_ON('s', 'f', ('family', 'family'), ('prof_key', 'prof_key'))} AND s.section <> said.section
    LEFT JOIN seat_seat a ON {_ON('a', 's', ('section', 'section'), ('prof_key', 'prof_key'))} AND a.g_section = said.section AND a.g_prof = said.prof_key WHERE a.p_seat IS NULL) GROUP BY ALL),
both_ways AS (SELECT course_code, target, a AS prof_key, b AS g_prof, together FROM pairs UNION ALL SELECT course_code, target, b, a, together FROM pairs),
paired AS (SELECT s.course_code, s.target, s.section, s.prof_key, sum(p * least(1, together / least(x.active, y.active))) AS pair FROM said JOIN both_ways w ON {_ON('w', 'said', ('g_prof', 'prof_key'))}
  JOIN active x ON {_ON('x', 'w', ('prof_key', 'prof_key'))} JOIN active y ON {_ON('y', 'w', ('prof_key', 'g_prof'))} JOIN scored s ON {_ON('s', 'w', ('prof_key', 'prof_key'))} AND s.section <> said.section GROUP BY ALL),
same AS (SELECT s.course_code, s.target, s.section, s.prof_key, sum(p) AS ps, count(*) AS ns, sum(p * coalesce(p_bundle, 0)) AS bun FROM scored s JOIN said ON {_ON('s', 'said', ('prof_key', 'prof_key'))} AND s.section <> said.section
  LEFT JOIN bundle b ON {_ON('b', 's', ('prof_key', 'prof_key'), ('family', 'family'))} AND b.g_family = said.family GROUP BY ALL),
here AS (SELECT course_code, target, section, sum(p) AS ph, count(*) AS nh FROM said GROUP BY ALL), every AS (SELECT course_code, target, sum(p) AS pa, count(*) AS na FROM said GROUP BY ALL),
partner AS (SELECT course_code, target, section, prof_key, CASE WHEN na > coalesce(nh, 0) THEN coalesce(cond, 0) / (pa - coalesce(ph, 0)) ELSE 0 END AS partner_cond,
  CASE WHEN na > coalesce(nh, 0) + coalesce(ns, 0) THEN coalesce(pair, 0) / (pa - coalesce(ph, 0) - coalesce(ps, 0)) ELSE 0 END AS partner_pair, CASE WHEN ns > 0 THEN bun / ps ELSE 0 END AS bundle_fit
  FROM scored JOIN every USING (course_code, target) LEFT JOIN here USING (course_code, target, section) LEFT JOIN conds USING (course_code, target, section, prof_key) LEFT JOIN paired USING (course_code, target, section, prof_key) LEFT JOIN same USING (course_code, target, section, prof_key))"""
SPARSE_SQL = f"{GUESSES_SQL}, {PAIRS_SQL}, {_SPARSE}"

LONG_SQL = f"""long AS (
  SELECT course_code, target, section, family, prof_key, cand_seq, truth, unnest([{", ".join(f"'{m}'" for m in MODELS)}]) AS model, unnest([{", ".join(f"CAST({m} AS DOUBLE)" for m in MODELS)}]) AS value FROM full1
), listed AS (SELECT *, row_number() OVER (PARTITION BY course_code, target, section, model ORDER BY round(value, 9) DESC, cand_seq, prof_key) AS rank FROM long)"""
WEIGHTS_SQL = f"""accuracy AS (
  SELECT course_code, model, n, coalesce(hits, 0) / n AS accuracy
  FROM (SELECT course_code, count(*) AS n FROM seats WHERE {_HELD_OUT} GROUP BY course_code) CROSS JOIN (SELECT DISTINCT model FROM long)
  LEFT JOIN (SELECT course_code, model, count(*) AS hits FROM listed WHERE rank = 1 AND prof_key = truth AND {_HELD_OUT} GROUP BY ALL) USING (course_code, model)
), raw AS (SELECT *, CASE WHEN model = 'heuristic' THEN greatest(0.1, accuracy * accuracy) ELSE accuracy * accuracy END AS r, model IN ('cooccur', 'bundle') AS across FROM accuracy),
shared AS (SELECT *, r / sum(r) OVER (PARTITION BY course_code) AS w FROM raw),
courses AS (
  SELECT course_code, sum(w) FILTER (across) AS mass, max(w) FILTER (across) AS most, count(*) FILTER (NOT across AND w > 1e-6) AS live,
    5.0 * sum(w) FILTER (NOT across) / greatest(1, count(*) FILTER (NOT across AND w > 1e-6)) AS goal FROM shared GROUP BY course_code
), moved AS (
  SELECT course_code, model, n, accuracy, w, live <= 1 AND most < 1e-9 AS stays, CASE WHEN NOT across THEN w WHEN mass < 1e-9 THEN goal / 2 ELSE w * goal / mass END AS v FROM shared JOIN courses USING (course_code)
), weights AS (SELECT course_code, model, n, accuracy, CASE WHEN stays THEN w ELSE v / sum(v) OVER (PARTITION BY course_code) END AS weight FROM moved)"""
VOTED_SQL = f"""mixed AS (
  SELECT course_code, target, section, family, prof_key, cand_seq, truth,
    round(sum(weight * CASE WHEN model = 'heuristic' THEN value ELSE ln(greatest(1e-6, least(1 - 1e-6, value)) / (1 - greatest(1e-6, least(1 - 1e-6, value)))) END) FILTER (weight > 0) / sum(weight) FILTER (weight > 0), 9) AS score0,
    sum(CASE WHEN weight > 0.02 AND rank <= 5 THEN weight * (7 - rank) ELSE 0 END) AS borda, count(*) FILTER (weight > 0.02 AND rank = 1) / greatest(1, count(*) FILTER (weight > 0.02)) AS agree
  FROM listed JOIN weights USING (course_code, model) GROUP BY ALL
), voted AS (
  SELECT course_code, target, section, family, prof_key, cand_seq, truth, agree,
    CASE WHEN count(*) OVER s < 2 OR max(borda) OVER s <= 0 THEN score0 ELSE 0.6 * score0 + 0.4 * greatest(0.2, max(score0) OVER s - min(score0) OVER s) * borda / greatest(1e-9, max(borda) OVER s) END AS score
  FROM mixed WINDOW s AS ({_SEAT})
)"""
WARMTH_SQL = f"""gaps AS (SELECT *, score - max(score) OVER ({_SEAT}) AS gap FROM voted WHERE {_HELD_OUT}),
tried AS (SELECT course_code, target, section, t, sum(exp(gap / t)) AS z, max(CASE WHEN prof_key = truth THEN exp(gap / t) END) AS own FROM gaps, (SELECT unnest({_GRID}) AS t) GROUP BY ALL),
losses AS (SELECT course_code, t, round(avg(-ln(greatest(1e-6, coalesce(own / z * (1 - novelty), novelty)))), 9) AS loss FROM tried JOIN novelty USING (course_code, target) GROUP BY ALL),
warmth AS (SELECT course_code, CAST(t AS DOUBLE) AS temperature, loss FROM losses QUALIFY row_number() OVER (PARTITION BY course_code ORDER BY loss, t) = 1)"""
PLACED_SQL = f"""placed AS (
  SELECT *, row_number() OVER ({_SEAT} ORDER BY round(prob, 9) DESC, cand_seq, prof_key) AS place FROM (
    SELECT *, e / sum(e) OVER ({_SEAT}) * (1 - novelty) AS prob FROM (SELECT v.*, exp((score - max(score) OVER ({_SEAT})) / coalesce(temperature, 1)) AS e FROM voted v LEFT JOIN warmth USING (course_code)) JOIN novelty USING (course_code, target))
)"""
BASE_SQL = f"WITH {evidence_sql((*MEASURED, TARGET))}, {CONFIRMED_SQL}, {_FLAGGED}, {HEURISTIC_SQL}, {SPARSE_SQL}, {_FULL}, {LONG_SQL}, {WEIGHTS_SQL}"
FIT_SQL = f"{BASE_SQL}, {VOTED_SQL}, {WARMTH_SQL}, {PLACED_SQL}, top AS (SELECT course_code, avg(hit) AS top1 FROM (SELECT course_code, target, section, max(CASE WHEN place = 1 AND prof_key = truth THEN 1.0 ELSE 0.0 END) AS hit FROM placed WHERE {_HELD_OUT} GROUP BY ALL) GROUP BY course_code)"

_AGAIN = {"guesses": "refreshed"} | {n: f"{n}_again" for n in ("said", "conds", "both_ways", "paired", "same", "here", "every", "partner", "full0", "full1", "long", "listed", "mixed", "voted", "placed")}


def _again(sql: str) -> str:
    """The same steps over the refreshed guesses of the open term; every step has to be there."""
    out, found = sql, set(re.findall(r"\w+", sql))
    assert found >= set(_AGAIN), set(_AGAIN) - found
    for name, other in _AGAIN.items():
        out = re.sub(rf"\b{name}\b", other, out)
    return out


AGAIN_SQL = f"""{FIT_SQL}, refreshed AS (SELECT course_code, target, section, family, prof_key, cand_seq, prob AS probability FROM placed WHERE place <= 5 AND target = {TARGET}), {_again(f"{_SPARSE}, {_FULL}, {LONG_SQL}, {VOTED_SQL}, {PLACED_SQL}")}"""
_FIRST = f"""(SELECT course_code, target, section, max(CASE WHEN place = 1 THEN prof_key END) AS prof_key, max(CASE WHEN place = 1 THEN prob END) AS p1, coalesce(max(CASE WHEN place = 2 THEN prob END), 0) AS p2, max(CASE WHEN place = 1 THEN agree END) AS agree
  FROM placed_again WHERE target = {TARGET} GROUP BY ALL)"""
SURE_SQL = f"sure AS (SELECT course_code, target, section, prof_key, round(greatest(0.05, least(0.99, 0.42 * p1 + 0.32 * agree + 0.16 * greatest(0, p1 - p2) + 0.1 * coalesce(top1, 0))) * 100, 1) AS confidence FROM {_FIRST} LEFT JOIN top USING (course_code))"


class Fit:
    """What the backtest gives for every course: weights, temperatures, and the share of first places."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.rows, self.evidence, seats = _parts(spark, sf_dir, (*MEASURED, TARGET))
        self.novelty, self.confirmed = history.novelty_rate(self.rows, _targets(spark, (*MEASURED, TARGET))), _confirmed(self.rows)
        self.alone = cut(history.heuristic(history.features(seats, self.evidence, verified=self.confirmed)))
        self.listed = cut(self.models(self.alone, ensemble.first_guesses(self.alone)))
        held_out = F.col("target") != TARGET
        accuracy = weighting.accuracies(self.listed.filter(held_out), seats.filter(held_out), MODELS)
        self.weights = cut(weighting.pinned(weighting.derived(accuracy)))

    def models(self, alone: DataFrame, guesses: DataFrame) -> DataFrame:
        full = ensemble.specialists(history.heuristic(cohorts.partner_features(alone.drop("heuristic"), guesses, self.evidence)))
        return weighting.ranked(weighting.long_scores(full, MODELS))

    def warm(self) -> Fit:
        """Adds the first pass's blend, temperatures and hits."""
        self.voted = cut(weighting.voted(self.listed, self.weights))
        self.warmth = cut(weighting.temperatures(self.voted.filter(F.col("target") != TARGET), self.novelty))
        self.placed = weighting.placed(self.voted, self.novelty, self.warmth)
        self.top1 = cut(weighting.first_hits(self.placed.filter(F.col("target") != TARGET)))
        return self

    def second(self) -> DataFrame:
        """The open term's seats and candidates, placed after the second pass."""
        few = self.placed.filter((F.col("place") <= 5) & (F.col("target") == TARGET))
        guesses = cut(few.select("course_code", "target", "section", "family", "prof_key", "cand_seq", F.col("prob").alias("probability")))
        listed = self.models(self.alone.filter(F.col("target") == TARGET), guesses)
        return cut(weighting.placed(weighting.voted(listed, self.weights), self.novelty, self.warmth))


@query("E10_E11_P09_weights", f"{BASE_SQL} SELECT course_code, model, n, {_r('accuracy', 'weight')}, weight > 0.02 AS votes FROM weights")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each course's accuracy and weight of every model, and whether it votes."""
    return _rounded(Fit(spark, sf_dir).weights).withColumn("votes", F.col("weight") > ensemble.VOTE["floor"])


@query("E14_A11_temperatures", f"{FIT_SQL} SELECT course_code, temperature, {_r('loss', 'top1')} FROM warmth JOIN top USING (course_code)")
def temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each course's fitted temperature, its log loss, and how often the held-out holder came first by it."""
    fit = Fit(spark, sf_dir).warm()
    return _rounded(fit.warmth.join(fit.top1, "course_code"))


@query("Q01_E04_E10_E11_E14_E19_measured", f"""{AGAIN_SQL}, shown AS (
  SELECT f.course_code, f.target, f.section, f.prof_key, prob, place + 1 AS place, FALSE AS confirmed, CASE WHEN c.prof_key IS NULL THEN novelty ELSE 0 END AS new_share
  FROM placed_again f LEFT JOIN confirmed c ON c.course_code = f.course_code AND c.target = f.target AND c.section = f.section
  WHERE f.target = {TARGET} AND place <= 5 AND (place = 1 OR prob >= 0.005) AND f.prof_key IS DISTINCT FROM c.prof_key
  UNION ALL SELECT course_code, target, section, prof_key, 1.0, 1, TRUE, 0.0 FROM confirmed
)
SELECT course_code, target, section, prof_key, {_r('prob')}, confirmed, {_r('new_share')}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER ({_SEAT} ORDER BY place) AS rank FROM shown) WHERE rank <= 5""")
def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lists of the open term, from models weighted by how well they did on held-out terms and at the fitted temperature, in two passes, confirmed holders on top."""
    fit = Fit(spark, sf_dir).warm()
    return _rounded(ensemble.confirmed_shortlist(fit.second(), fit.confirmed))


@query("E09_W08_measured_confidence", f"{AGAIN_SQL}, {SURE_SQL} SELECT course_code, target, section, prof_key, confidence FROM sure")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of each open seat's first name, by the course's measured accuracy."""
    fit = Fit(spark, sf_dir).warm()
    return weighting.confidence(fit.second(), fit.top1)


@query("A15_measured_mean", f"{AGAIN_SQL}, {SURE_SQL} SELECT course_code, round(coalesce(mean, 100 * top1, 0), 4) AS confidence FROM (SELECT DISTINCT course_code FROM offerings) LEFT JOIN (SELECT course_code, avg(confidence) AS mean FROM sure GROUP BY course_code) USING (course_code) LEFT JOIN top USING (course_code)")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each course's open seats; of a course without any its measured share of first places."""
    fit = Fit(spark, sf_dir).warm()
    mean = weighting.confidence(fit.second(), fit.top1).groupBy("course_code").agg(F.avg("confidence").alias("mean"))
    every = fit.rows.select("course_code").distinct().join(mean, "course_code", "left").join(fit.top1, "course_code", "left")
    return every.select("course_code", F.round(F.coalesce("mean", 100 * F.col("top1"), F.lit(0.0)), 4).alias("confidence"))
