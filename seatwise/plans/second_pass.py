"""The second pass of a prediction, confirmed holders, ensemble metrics, and the views that remain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sections import labelled_section
from ..operators import cohorts, ensemble, history, store
from ..operators.lineage import cut
from .adapter import BACKTEST, OFFERINGS_SQL, TARGET, offerings
from .prediction import BLEND_SQL, FOLD_SQL, PARTNER_SQL, POST_SQL, SPECIAL_SQL, TERM_SQL, _blended, _parts, _r, _rounded, _targets, voted
from .prediction import ORACLES as _PREDICTION
from .sql import FEATURES_SQL, HEURISTIC_SQL, PAIRS_SQL
from .tables import _PEOPLE, _canonical

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_SEAT = "PARTITION BY course_code, target, section"
_PLACED = f"""(SELECT *, row_number() OVER ({_SEAT} ORDER BY round(prob, 9) DESC, cand_seq, prof_key) AS place FROM (
    SELECT *, e / sum(e) OVER ({_SEAT}) * (1 - novelty) AS prob FROM (SELECT *, exp(score - max(score) OVER ({_SEAT})) AS e FROM voted) JOIN novelty USING (course_code, target)))"""
REFRESHED_SQL = f"refreshed AS (SELECT course_code, target, section, family, prof_key, cand_seq, prob AS probability FROM {_PLACED} WHERE place <= 5)"
_AGAIN = {"guesses": "refreshed", "pairing2": "pairing3"} | {n: f"{n}_again" for n in ("partner", "full0", "full1", "blended", "ballots", "voted")}


def _again(sql: str) -> str:
    """The same steps over the refreshed guesses."""
    return re.sub(rf"\b({'|'.join(_AGAIN)})\b", lambda m: _AGAIN[m[1]], sql)


@query("E03_refreshed_guesses", f"{TERM_SQL}, {SPECIAL_SQL}, {BLEND_SQL}, {REFRESHED_SQL} SELECT course_code, target, section, family, prof_key, {_r('probability')} FROM refreshed")
def refreshed_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ev, seats = _parts(spark, sf_dir)
    novelty = history.novelty_rate(rows, _targets(spark, (TARGET,)))
    return _rounded(ensemble.refreshed_guesses(_blended(seats, ev), novelty).drop("cand_seq"))


#: Some of the target's seats are confirmed: half by who holds them, half by somebody who never held one.
CONFIRMED_SQL = f"""confirmed AS (SELECT course_code, CAST({TARGET} AS INT) AS target, section, CASE WHEN seq % 2 = 0 THEN prof_key ELSE 'V' || (seq % 50) END AS prof_key FROM offerings WHERE term = {TARGET} AND time_start = '12:00 PM')"""
_FLAGGED = FEATURES_SQL.replace("0.0 AS verified", "CASE WHEN c.prof_key IS NULL THEN 0.0 ELSE 1.0 END AS verified").replace("FROM pairing\n", "FROM pairing LEFT JOIN confirmed c USING (course_code, target, section, prof_key)\n")
_FULL = SPECIAL_SQL.split(f"{PARTNER_SQL}, ")[1]
_PARTNER = PARTNER_SQL.split(f"{PAIRS_SQL}, ")[1]


def _confirmed(rows: DataFrame) -> DataFrame:
    named = F.when(F.col("seq") % 2 == 0, F.col("prof_key")).otherwise(F.concat(F.lit("V"), (F.col("seq") % 50).cast("string")))
    return rows.filter((F.col("term") == TARGET) & (F.col("time_start") == "12:00 PM")).select("course_code", "term", "section", named.alias("prof_key"), F.col("seq").alias("at"))


@query("E04_E19_J13_J14_two_pass", f"""{TERM_SQL}, {CONFIRMED_SQL}, {_FLAGGED}, {HEURISTIC_SQL}, {PARTNER_SQL}, {_FULL}, {BLEND_SQL}, {REFRESHED_SQL}, {_again(f"{_PARTNER}, {_FULL}, {BLEND_SQL}")}, listed AS (
  SELECT f.course_code, f.target, f.section, f.prof_key, prob, place + 1 AS place, FALSE AS confirmed, CASE WHEN c.prof_key IS NULL THEN novelty ELSE 0 END AS new_share
  FROM {_again(_PLACED)} f LEFT JOIN confirmed c ON c.course_code = f.course_code AND c.target = f.target AND c.section = f.section WHERE place <= 5 AND (place = 1 OR prob >= 0.005) AND f.prof_key IS DISTINCT FROM c.prof_key
  UNION ALL SELECT course_code, target, section, prof_key, 1.0, 1, TRUE, 0.0 FROM confirmed
)
SELECT course_code, target, section, prof_key, {_r('prob')}, confirmed, {_r('new_share')}, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER ({_SEAT} ORDER BY place) AS rank FROM listed) WHERE rank <= 5""")
def two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First guesses, all models, blend and votes; then the same over the refreshed guesses, with confirmed holders on top.

    Features and refreshed guesses are written once, so the second pass isn't planned on top of the first.
    """
    rows, ev, seats = _parts(spark, sf_dir)
    novelty, confirmed = history.novelty_rate(rows, _targets(spark, (TARGET,))), _confirmed(rows)
    alone = cut(history.heuristic(history.features(seats, ev, verified=confirmed)))

    def full(guesses: DataFrame) -> DataFrame:
        return ensemble.specialists(history.heuristic(cohorts.partner_features(alone.drop("heuristic"), guesses, ev)))

    first = voted(full(ensemble.first_guesses(alone)))
    second = voted(full(cut(ensemble.refreshed_guesses(first, novelty))))
    return _rounded(ensemble.confirmed_shortlist(ensemble.placed(second, novelty), confirmed))


@query("A12_A13_A18_ensemble_metrics", f"""{FOLD_SQL}, {SPECIAL_SQL}, {BLEND_SQL}, {POST_SQL}, placed AS (
  SELECT *, row_number() OVER ({_SEAT} ORDER BY round(prob, 9) DESC, cand_seq, prof_key) AS place FROM post
), per_seat AS (
  SELECT course_code, target, section, max(CASE WHEN prof_key = truth THEN place END) AS r, max(CASE WHEN prof_key = truth THEN prob END) AS p FROM placed GROUP BY ALL
), folds AS (
  SELECT target, count(*) AS samples, {", ".join(f"avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END) AS top{k}" for k in (1, 3, 5))}, avg(pow(1 - coalesce(p, 0), 2)) AS brier, avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 END) AS ceiling FROM per_seat GROUP BY target
)
SELECT target, samples, {_r('top1', 'top3', 'top5', 'brier', 'ceiling')} FROM folds UNION ALL
SELECT CAST(NULL AS INT), CAST(sum(samples) AS BIGINT), {", ".join(f"round(CAST(avg({c}) AS DOUBLE), 6)" for c in ('top1', 'top3', 'top5', 'brier', 'ceiling'))} FROM folds""")
def ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ev, seats = _parts(spark, sf_dir, BACKTEST)
    return _rounded(ensemble.ensemble_metrics(ensemble.placed(_blended(seats, ev), history.novelty_rate(rows, _targets(spark, BACKTEST)))))


@query("A15_mean_confidence", f"""SELECT course_code, round(coalesce(mean, 50.0), 4) AS confidence FROM (WITH {OFFERINGS_SQL} SELECT DISTINCT course_code FROM offerings)
LEFT JOIN (SELECT course_code, avg(confidence) AS mean FROM ({_PREDICTION['E09_W08_confidence']}) GROUP BY course_code) USING (course_code)""")
def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence of each course's open seats; of a course without one the backtest's first-place share, here half."""
    from .prediction import confidence

    mean = confidence(spark, sf_dir).groupBy("course_code").agg(F.avg("confidence").alias("mean"))
    every = offerings(spark, sf_dir).select("course_code").distinct()
    return every.join(mean, "course_code", "left").select("course_code", F.round(F.coalesce("mean", F.lit(50.0)), 4).alias("confidence"))


@query("P06_unnamed_rows", f"WITH {_PEOPLE} SELECT course_code, term, section, seq FROM canon WHERE instructor = ''")
def unnamed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).filter("instructor = ''").select("course_code", "term", "section", "seq")


@query("M06_clear_courses", f"WITH {OFFERINGS_SQL} SELECT course_code, term, section, seq FROM offerings WHERE course_code NOT IN (SELECT p_brand FROM part WHERE p_partkey % 97 = 0)")
def clear_courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey % 97 = 0").select(F.col("p_brand").alias("course_code"))
    return store.cleared(offerings(spark, sf_dir), gone).select("course_code", "term", "section", "seq")


@query("S11_section_labels", f"""WITH {OFFERINGS_SQL}, l AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN section END AS section, course_code || CASE seq % 4 WHEN 0 THEN ' - ' WHEN 1 THEN '\u2013' WHEN 2 THEN ' -  ' ELSE ' ' END || section || ' ' AS label FROM offerings)
SELECT seq, coalesce(section, nullif(regexp_extract(label, '[-\u2013]\\s*([A-Za-z0-9][A-Za-z0-9-]*)\\s*$', 1), '')) AS section FROM l""")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dash = F.element_at(F.array(F.lit(" - "), F.lit("\u2013"), F.lit(" -  "), F.lit(" ")), (F.col("seq") % 4 + 1).cast("int"))
    rows = offerings(spark, sf_dir).withColumn("label", F.concat("course_code", dash, "section", F.lit(" ")))
    return rows.select("seq", labelled_section(F.when(F.col("seq") % 3 == 0, F.col("section")), F.col("label")).alias("section"))
