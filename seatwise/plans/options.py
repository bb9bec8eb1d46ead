"""The option grid: twelve ways to predict, tried on a term whose holders are known, in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cohorts, ensemble, history, weighting
from ..operators.lineage import cut
from .adapter import BACKTEST, OFFERINGS_SQL, TARGET, offerings
from .measured import LONG_SQL, SPARSE_SQL
from .prediction import MODELS, _r, _rounded, _targets
from .second_pass import _FULL
from .sql import FEATURES_SQL, HEURISTIC_SQL, evidence_sql

QUERIES, ORACLES = {}, {}
#: The terms that weights are measured on.
MEASURED = BACKTEST[-2:]
#: trial, half-life, cross-seat prior, and how models vote: mix, depth, pad. They are judged on TARGET, with weights from the terms before.
TRIALS = [
    (1, 4, 5.0, 0.4, 5, 1), (2, 6, 5.0, 0.4, 5, 1), (3, 8, 5.0, 0.4, 5, 1), (4, 3, 5.0, 0.4, 5, 1), (5, 4, 2.0, 0.4, 5, 1), (6, 4, 9.0, 0.4, 5, 1),
    (7, 4, 5.0, 0.6, 5, 1), (8, 4, 5.0, 0.0, 5, 1), (9, 4, 5.0, 0.4, 8, 2), (10, 8, 2.0, 0.4, 5, 1), (11, 6, 9.0, 0.6, 5, 1), (12, 8, 9.0, 0.0, 5, 1),
]
HALF_LIVES = sorted({t[1] for t in TRIALS})


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _replaced(sql: str, old: str, new: str) -> str:
    assert sql.count(old) == 1, (old, sql.count(old))
    return sql.replace(old, new)


_LIFE = "CAST(split_part(course_code, '|', 1) AS DOUBLE)"
_WORLDS = _replaced(evidence_sql((*MEASURED, TARGET)), OFFERINGS_SQL, f"""{OFFERINGS_SQL.replace('offerings AS (', 'plain AS (', 1)}, offerings AS (SELECT h || '|' || course_code AS course_code, term, section, prof_key, days, time_start, room, seq FROM plain, (VALUES {", ".join(f"({h})" for h in HALF_LIVES)}) t(h))""")
_WORLDS = _replaced(_WORLDS, "/ 4.0) AS w FROM parsed", f"/ {_LIFE}) AS w FROM parsed")
_FEATURES = _replaced(FEATURES_SQL, "pow(0.5, gap / 4.0)", f"pow(0.5, gap / {_LIFE})")
_HELD_OUT = f"target IN ({', '.join(map(str, MEASURED))})"
_WHO = "PARTITION BY trial, course_code, section"


@query("Q09_J15_Q03_A18_options", f"""WITH {_WORLDS}, {_FEATURES}, {HEURISTIC_SQL}, {SPARSE_SQL}, {_FULL}, {LONG_SQL},
trials(trial, half_life, prior, mix, depth, pad) AS (VALUES {", ".join(str(t) for t in TRIALS)}),
accuracy AS (
  SELECT course_code, model, (coalesce(hits, 0) / n) ** 2 AS a2 FROM (SELECT course_code, count(*) AS n FROM seats WHERE {_HELD_OUT} GROUP BY course_code) CROSS JOIN (SELECT DISTINCT model FROM long)
  LEFT JOIN (SELECT course_code, model, count(*) AS hits FROM listed WHERE rank = 1 AND prof_key = truth AND {_HELD_OUT} GROUP BY ALL) USING (course_code, model)
), raw AS (SELECT course_code, model, model IN ('cooccur', 'bundle') AS across, CASE WHEN model = 'heuristic' THEN greatest(0.1, a2) ELSE a2 END AS r FROM accuracy),
shared AS (SELECT *, r / sum(r) OVER (PARTITION BY course_code) AS w FROM raw),
courses AS (SELECT course_code, sum(w) FILTER (across) AS mass, max(w) FILTER (across) AS most, count(*) FILTER (NOT across AND w > 1e-6) AS live, sum(w) FILTER (NOT across) AS others FROM shared GROUP BY course_code),
moved AS (SELECT trial, mix, depth, pad, course_code, model, w, live <= 1 AND most < 1e-9 AS stays, prior * others / greatest(1, live) AS goal, across, mass FROM shared JOIN courses USING (course_code) JOIN trials ON {_LIFE} = half_life),
pinned AS (SELECT trial, mix, depth, pad, course_code, model, stays, w, CASE WHEN NOT across THEN w WHEN mass < 1e-9 THEN goal / 2 ELSE w * goal / mass END AS v FROM moved),
weights AS (SELECT trial, mix, depth, pad, course_code, model, CASE WHEN stays THEN w ELSE v / sum(v) OVER (PARTITION BY trial, course_code) END AS weight FROM pinned),
mixed AS (
  SELECT trial, mix, course_code, section, prof_key, cand_seq, truth,
    round(sum(weight * CASE WHEN model = 'heuristic' THEN value ELSE ln(greatest(1e-6, least(1 - 1e-6, value)) / (1 - greatest(1e-6, least(1 - 1e-6, value)))) END) FILTER (weight > 0) / sum(weight) FILTER (weight > 0), 9) AS score0,
    sum(CASE WHEN weight > 0.02 AND rank <= depth THEN weight * (depth + 1 + pad - rank) ELSE 0 END) AS borda FROM listed JOIN weights USING (course_code, model) WHERE target = {TARGET} GROUP BY ALL
), scores AS (SELECT *, CASE WHEN count(*) OVER s < 2 OR max(borda) OVER s <= 0 THEN score0 ELSE (1 - mix) * score0 + mix * greatest(0.2, max(score0) OVER s - min(score0) OVER s) * borda / greatest(1e-9, max(borda) OVER s) END AS score FROM mixed WINDOW s AS ({_WHO})),
places AS (SELECT trial, course_code, section, max(place) FILTER (prof_key = truth) AS r FROM (SELECT *, row_number() OVER ({_WHO} ORDER BY round(score, 9) DESC, cand_seq, prof_key) AS place FROM scores) GROUP BY ALL),
judged AS (SELECT trial, count(*) AS seats, count(r) AS reachable, {", ".join(f"count(*) FILTER (r <= {k}) / count(*) AS top{k}" for k in (1, 3, 5))}, count(*) FILTER (r <= 5) / greatest(1, count(r)) AS reachable5 FROM places GROUP BY trial)
SELECT CAST(trial AS INT) AS trial, seats, reachable, {_r("top1", "top3", "top5", "reachable5")}, row_number() OVER (ORDER BY top5 DESC, top1 DESC, trial) = 1 AS best FROM judged""")
def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each trial's first, first three and first five names hold the truth, of all seats and of those whose holder is a candidate at all; the best by first five, then first.

    Each half-life makes a world of courses of its own, so evidence, features and ranks of all of them are one plan. Trials are
    a relation of twelve rows, joined to measured weights and to scores.
    """
    rows, terms = offerings(spark, sf_dir), _targets(spark, (*MEASURED, TARGET))
    worlds = rows.select("*", F.explode(F.array(*(F.lit(h) for h in HALF_LIVES))).alias("h")).withColumn("course_code", F.concat_ws("|", "h", "course_code")).drop("h")
    ev = history.evidence(worlds, terms, _life(F.col("course_code")))
    seats = history.seats_of(worlds, terms)
    alone = cut(history.heuristic(history.features(seats, ev, _life(F.col("course_code")))))
    full = ensemble.specialists(history.heuristic(cohorts.partner_features(alone.drop("heuristic"), ensemble.first_guesses(alone), ev)))
    listed = cut(weighting.ranked(weighting.long_scores(full, MODELS)))
    held_out = F.col("target") != TARGET
    measured = weighting.derived(weighting.accuracies(listed.filter(held_out), seats.filter(held_out), MODELS))
    trials = F.broadcast(spark.createDataFrame(TRIALS, "trial int, half_life int, prior double, mix double, depth int, pad int"))  # twelve rows
    tried = lambda df: df.join(trials, _life(df["course_code"]) == F.col("half_life")).withColumn("course_code", F.concat_ws("|", "trial", "course_code"))
    weights = weighting.pinned(tried(measured).select("course_code", "model", "weight", "prior"), F.col("prior"))
    vote = {"floor": ensemble.VOTE["floor"], "mix": F.col("mix"), "depth": F.col("depth"), "pad": F.col("pad")}
    scored = weighting.voted(tried(listed.filter(~held_out)), weights, vote, ("trial", "mix"))
    by = Window.partitionBy(*ensemble.SEAT).orderBy(F.round("score", 9).desc(), "cand_seq", "prof_key")
    seat = scored.withColumn("place", F.row_number().over(by)).groupBy("trial", *ensemble.SEAT).agg(F.max(F.when(F.col("prof_key") == F.col("truth"), F.col("place"))).alias("r"))
    within = lambda k: F.count_if(F.col("r") <= k)
    judged = seat.groupBy("trial").agg(F.count("*").alias("seats"), F.count("r").alias("reachable"), *((within(k) / F.count("*")).alias(f"top{k}") for k in (1, 3, 5)), (within(5) / F.greatest(F.lit(1), F.count("r"))).alias("reachable5"))
    best = F.row_number().over(Window.orderBy(F.desc("top5"), F.desc("top1"), "trial")) == 1  # over twelve rows
    return _rounded(judged.withColumn("best", best))


def _life(course: Column) -> Column:
    return F.substring_index(course, "|", 1).cast("double")
