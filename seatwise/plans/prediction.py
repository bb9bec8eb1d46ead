"""Prediction, backtest and what they consist of, over the adapter's offerings."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohorts, ensemble, history, learn, vectors
from ..operators.lineage import cut
from .adapter import BACKTEST, TARGET, offerings
from .sql import FEATURES_SQL, GUESSES_SQL, HEURISTIC_SQL, PAIRS_SQL, evidence_sql

DIGITS = 6
QUERIES, ORACLES = {}, {}


def _targets(spark: SparkSession, targets: tuple[int, ...]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in targets], "target int")


def _parts(spark: SparkSession, sf_dir: str, targets: tuple[int, ...] = (TARGET,)) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, terms = offerings(spark, sf_dir), _targets(spark, targets)
    return rows, history.evidence(rows, terms), history.seats_of(rows, terms)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, DIGITS).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {DIGITS}) AS {n}" for n in names)


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


TERM_SQL = "WITH " + evidence_sql((TARGET,))
FOLD_SQL = "WITH " + evidence_sql(BACKTEST)


@query("A01_A02_profiles", f"{TERM_SQL} SELECT course_code, target, prof_key, n_rows, n_terms, first_term, last_term, {_r('weight', 'total_weight', 'w_lecture', 'w_lab', 'avg_load', 'tenure')}, CAST(gap AS INT) AS gap FROM prof")
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, _ = _parts(spark, sf_dir)
    out = history.profiles(ev).select("course_code", "target", "prof_key", "n_rows", "n_terms", "first_term", "last_term", "weight", "total_weight", "w_lecture", "w_lab", "avg_load", "tenure", "gap")
    return _rounded(out)


@query("A03_J16_W01_W02_W03_seat_memory", f"{TERM_SQL} SELECT course_code, target, section, last_prof, last_seat_term, prev_prof, last_same_prof, last_same_term, {_r('turnover')}, vacant FROM memory")
def seat_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, _ = _parts(spark, sf_dir)
    out = history.seat_memory(ev, history.profiles(ev))
    return _rounded(out.select("course_code", "target", "section", "last_prof", "last_seat_term", "prev_prof", "last_same_prof", "last_same_term", "turnover", "vacant"))


@query("A05_W06_novelty", f"{FOLD_SQL} SELECT course_code, target, {_r('novelty')} FROM novelty")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(history.novelty_rate(offerings(spark, sf_dir), _targets(spark, BACKTEST)))


FEATURES = [f for f in history.WEIGHTS if f not in ("partner_cond", "partner_pair", "bundle_fit")]


@query("V00_V19_J04_J05_J06_features", f"{TERM_SQL}, {FEATURES_SQL} SELECT course_code, target, section, prof_key, {_r(*FEATURES)} FROM features")
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(history.features(seats, ev).select("course_code", "target", "section", "prof_key", *FEATURES))


@query("V20_G01_heuristic", f"{TERM_SQL}, {FEATURES_SQL}, {HEURISTIC_SQL} SELECT course_code, target, section, prof_key, {_r('heuristic')} FROM scored")
def heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(history.heuristic(history.features(seats, ev)).select("course_code", "target", "section", "prof_key", "heuristic"))


PREDICT_SQL = f"""{TERM_SQL}, {FEATURES_SQL}, {HEURISTIC_SQL}, soft AS (
  SELECT *, exp((heuristic - max(heuristic) OVER s) / 1.5) AS e FROM scored WINDOW s AS (PARTITION BY course_code, target, section)
), post AS (
  SELECT course_code, target, section, prof_key, cand_seq, e / sum(e) OVER (PARTITION BY course_code, target, section) * (1 - novelty) AS prob FROM soft JOIN novelty USING (course_code, target)
  UNION ALL SELECT DISTINCT course_code, target, section, '__NEW_OR_UNKNOWN__', CAST(NULL AS BIGINT), novelty FROM scored JOIN novelty USING (course_code, target)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY course_code, target, section ORDER BY prob DESC, cand_seq NULLS LAST, prof_key) AS rank FROM post
)
SELECT course_code, target, section, prof_key, round(CAST(prob AS DOUBLE), {DIGITS}) AS prob, CAST(rank AS INT) AS rank FROM placed WHERE rank <= 5 AND (rank = 1 OR prob >= 0.005)"""


@query("Q01_E07_O04_O07_P08_predict", PREDICT_SQL)
def predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ev, seats = _parts(spark, sf_dir)
    scored = history.heuristic(history.features(seats, ev)).withColumn("score", F.col("heuristic"))
    post = ensemble.posterior(scored, history.novelty_rate(rows, _targets(spark, (TARGET,))), 1.5)
    return _rounded(ensemble.shortlist(post).drop("cand_seq"))


@query("A04_J08_pairs", f"{TERM_SQL}, {PAIRS_SQL} SELECT course_code, target, a, b, {_r('together')} FROM pairs")
def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohorts.pairs(_parts(spark, sf_dir)[1]))


@query("A04_J07_seat_given_seat", f"{TERM_SQL}, {PAIRS_SQL} SELECT course_code, target, g_section, g_prof, section, prof_key, {_r('p_seat')} FROM seat_seat")
def seat_given_seat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohorts.seat_given_seat(_parts(spark, sf_dir)[1]))


@query("A04_J09_family_given_family", f"{TERM_SQL}, {PAIRS_SQL} SELECT course_code, target, g_family, g_prof, family, prof_key, {_r('p_family')} FROM fam_fam")
def family_given_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohorts.family_given_family(_parts(spark, sf_dir)[1]))


@query("A04_J10_bundles", f"{TERM_SQL}, {PAIRS_SQL} SELECT course_code, target, prof_key, g_family, family, {_r('p_bundle')} FROM bundle")
def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohorts.bundles(_parts(spark, sf_dir)[1]))


@query("A04_activity", f"{TERM_SQL}, {PAIRS_SQL} SELECT course_code, target, prof_key, {_r('active')} FROM active")
def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cohorts.activity(_parts(spark, sf_dir)[1]))


@query("E02_first_guesses", f"{TERM_SQL}, {FEATURES_SQL}, {HEURISTIC_SQL}, {GUESSES_SQL} SELECT course_code, target, section, family, prof_key, {_r('probability')} FROM guesses")
def first_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(ensemble.first_guesses(history.heuristic(history.features(seats, ev))).drop("cand_seq"))


PARTNER_SQL = f"""{GUESSES_SQL}, {PAIRS_SQL}, pairing2 AS (
  SELECT s.course_code, s.target, s.section, s.prof_key, g.prof_key AS g_prof, g.probability AS p, CASE WHEN coalesce(p_seat, 0) > 0 THEN p_seat ELSE coalesce(p_family, 0) END AS cond,
    least(1, coalesce(together, 0) / least(x.active, y.active)) AS pair, coalesce(p_bundle, 0) AS bun, g.prof_key = s.prof_key AS same
  FROM scored s JOIN guesses g ON g.course_code = s.course_code AND g.target = s.target AND g.section <> s.section AND g.probability >= 0.05
  LEFT JOIN seat_seat a ON a.course_code = s.course_code AND a.target = s.target AND a.g_section = g.section AND a.g_prof = g.prof_key AND a.section = s.section AND a.prof_key = s.prof_key
  LEFT JOIN fam_fam f ON f.course_code = s.course_code AND f.target = s.target AND f.g_family = g.family AND f.g_prof = g.prof_key AND f.family = s.family AND f.prof_key = s.prof_key
  LEFT JOIN bundle b ON b.course_code = s.course_code AND b.target = s.target AND b.prof_key = s.prof_key AND b.g_family = g.family AND b.family = s.family
  LEFT JOIN pairs p ON p.course_code = s.course_code AND p.target = s.target AND p.a = least(s.prof_key, g.prof_key) AND p.b = greatest(s.prof_key, g.prof_key)
  LEFT JOIN active x ON x.course_code = s.course_code AND x.target = s.target AND x.prof_key = s.prof_key LEFT JOIN active y ON y.course_code = s.course_code AND y.target = s.target AND y.prof_key = g.prof_key
), partner AS (
  SELECT course_code, target, section, prof_key, coalesce(sum(p * cond) / sum(p), 0) AS partner_cond, coalesce(sum(p * pair) FILTER (NOT same) / sum(p) FILTER (NOT same), 0) AS partner_pair,
    coalesce(sum(p * bun) FILTER (same) / sum(p) FILTER (same), 0) AS bundle_fit FROM pairing2 GROUP BY ALL
)"""


@query("V13_V15_J11_A14_P14_partners", f"{TERM_SQL}, {FEATURES_SQL}, {HEURISTIC_SQL}, {PARTNER_SQL} SELECT s.course_code, s.target, s.section, s.prof_key, round(CAST(coalesce(partner_cond, 0) AS DOUBLE), 6) AS partner_cond, round(CAST(coalesce(partner_pair, 0) AS DOUBLE), 6) AS partner_pair, round(CAST(coalesce(bundle_fit, 0) AS DOUBLE), 6) AS bundle_fit FROM scored s LEFT JOIN partner USING (course_code, target, section, prof_key)")
def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(_full(seats, ev).select("course_code", "target", "section", "prof_key", "partner_cond", "partner_pair", "bundle_fit"))


def _full(seats: DataFrame, ev: DataFrame) -> DataFrame:
    """All features, the partner ones from first guesses; heuristic and specialists on them."""
    alone = cut(history.heuristic(history.features(seats, ev)))  # the guesses and the rows they fill both read it
    filled = cohorts.partner_features(alone.drop("heuristic"), ensemble.first_guesses(alone), ev)
    return ensemble.specialists(history.heuristic(filled))


SPECIAL_SQL = f"""{FEATURES_SQL}, {HEURISTIC_SQL}, {PARTNER_SQL}, full0 AS (
  SELECT s.*, coalesce(partner_cond, 0) AS partner_cond, coalesce(partner_pair, 0) AS partner_pair, coalesce(bundle_fit, 0) AS bundle_fit FROM scored s LEFT JOIN partner USING (course_code, target, section, prof_key)
), full1 AS (
  SELECT * EXCLUDE (heuristic), heuristic + 9.0 * partner_cond + 6.0 * partner_pair + 7.0 * bundle_fit AS heuristic, {", ".join(f"{t} AS {n}" for n, t in ensemble.SPECIALISTS.items())} FROM full0
)"""
MODELS = ["heuristic", *ensemble.SPECIALISTS]


@query("G09_G25_specialists", f"{TERM_SQL}, {SPECIAL_SQL} SELECT course_code, target, section, prof_key, {_r(*MODELS)} FROM full1")
def specialists(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(_full(seats, ev).select("course_code", "target", "section", "prof_key", *MODELS))


RANKS_SQL = f"""ranks AS (
  SELECT course_code, target, section, prof_key, truth, model, row_number() OVER (PARTITION BY course_code, target, section, model ORDER BY value DESC, cand_seq, prof_key) AS rank
  FROM (SELECT course_code, target, section, prof_key, cand_seq, truth, unnest([{", ".join(f"'{m}'" for m in MODELS)}]) AS model, unnest([{", ".join(f"round({m}, 9)" for m in MODELS)}]) AS value FROM full1)
)"""


@query("Q02_A11_W07_W11_W12_fold_metrics", f"""{FOLD_SQL}, {SPECIAL_SQL}, {RANKS_SQL}, hit AS (SELECT * FROM ranks WHERE prof_key = truth)
SELECT target, model, count(*) AS n, {", ".join(f"round(CAST(avg({e}) AS DOUBLE), 6) AS {n}" for n, e in (("top1", "CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END"), ("top3", "CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END"), ("mrr", "coalesce(1.0 / rank, 0)"), ("coverage", "CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END")))}
FROM (SELECT course_code, target, section, model FROM seats, (SELECT DISTINCT model FROM ranks)) LEFT JOIN hit USING (course_code, target, section, model) GROUP BY target, model""")
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir, BACKTEST)
    nine = _full(seats, ev).withColumns({m: F.round(m, 9) for m in MODELS})
    return _rounded(ensemble.fold_metrics(ensemble.ranks(nine, MODELS), seats))


#: Weights of one blend, for the queries that show blending without a search.
BLEND = {"heuristic": 0.2, "seat_exact": 0.15, "slot": 0.15, "recent": 0.1, "last_exact": 0.1, "cooccur": 0.2, "bundle": 0.1}
_LOGIT = "ln(greatest(1e-6, least(1 - 1e-6, {0})) / (1 - greatest(1e-6, least(1 - 1e-6, {0}))))"
BLEND_SQL = f"""blended AS (
  SELECT *, round(({" + ".join(f"{w} * {m if m == 'heuristic' else _LOGIT.format(m)}" for m, w in BLEND.items())}) / {sum(BLEND.values())}, 9) AS score0 FROM full1
), ballots AS (
  SELECT *, {" + ".join(f"CASE WHEN r_{m} <= 5 THEN {w} * (7 - r_{m}) ELSE 0 END" for m, w in BLEND.items())} AS borda
  FROM (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY course_code, target, section ORDER BY round({m}, 9) DESC, cand_seq, prof_key) AS r_{m}" for m in BLEND)} FROM blended)
), voted AS (
  SELECT *, CASE WHEN count(*) OVER s < 2 THEN score0 ELSE 0.6 * score0 + 0.4 * greatest(0.2, max(score0) OVER s - min(score0) OVER s) * borda / greatest(1e-9, max(borda) OVER s) END AS score
  FROM ballots WINDOW s AS (PARTITION BY course_code, target, section)
)"""


def voted(full: DataFrame) -> DataFrame:
    """Blend and votes of rows with all models."""
    scored = ensemble.blend(full, BLEND).withColumn("score", F.round("score", 9))
    return ensemble.votes(scored.withColumns({m: F.round(m, 9) for m in MODELS}), BLEND)


def _blended(seats: DataFrame, ev: DataFrame) -> DataFrame:
    return voted(_full(seats, ev))


@query("E05_E06_F02_W10_blend_votes", f"{TERM_SQL}, {SPECIAL_SQL}, {BLEND_SQL} SELECT course_code, target, section, prof_key, {_r('borda', 'score')} FROM voted")
def blend_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return _rounded(_blended(seats, ev).select("course_code", "target", "section", "prof_key", "borda", "score"))


@query("E08_model_picks", f"{TERM_SQL}, {SPECIAL_SQL}, {RANKS_SQL} SELECT course_code, target, section, {', '.join(f'''max(CASE WHEN model = '{m}' THEN prof_key END) AS {m}''' for m in BLEND)} FROM ranks WHERE rank = 1 GROUP BY ALL")
def model_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir)
    return ensemble.model_picks(_full(seats, ev).withColumns({m: F.round(m, 9) for m in MODELS}), list(BLEND))


POST_SQL = """post AS (
  SELECT course_code, target, section, prof_key, cand_seq, truth, e / sum(e) OVER s * (1 - novelty) AS prob, novelty
  FROM (SELECT *, exp(score - max(score) OVER (PARTITION BY course_code, target, section)) AS e FROM voted) JOIN novelty USING (course_code, target) WINDOW s AS (PARTITION BY course_code, target, section)
)"""


@query("E09_W08_confidence", f"""{TERM_SQL}, {SPECIAL_SQL}, {RANKS_SQL}, {BLEND_SQL}, {POST_SQL}, placed AS (
  SELECT *, row_number() OVER s AS rn, lead(prob) OVER s AS second FROM post WINDOW s AS (PARTITION BY course_code, target, section ORDER BY prob DESC, cand_seq, prof_key)
), agree AS (SELECT course_code, target, section, prof_key, count(*) / {len(BLEND)} AS agree FROM ranks WHERE rank = 1 AND model IN ({", ".join(f"'{m}'" for m in BLEND)}) GROUP BY ALL)
SELECT course_code, target, section, prof_key, round(greatest(0.05, least(0.99, 0.42 * prob + 0.32 * coalesce(agree, 0) + 0.16 * greatest(0, prob - coalesce(second, 0)) + 0.05)) * 100, 1) AS confidence
FROM placed LEFT JOIN agree USING (course_code, target, section, prof_key) WHERE rn = 1""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ev, seats = _parts(spark, sf_dir)
    voted = _blended(seats, ev)
    agree = ensemble.agreement(ensemble.model_picks(voted, list(BLEND)), list(BLEND))
    post = ensemble.posterior(voted, history.novelty_rate(rows, _targets(spark, (TARGET,))))
    return ensemble.confidence(post, agree, 0.5)


@query("E14_F07_calibration", f"""{FOLD_SQL}, {SPECIAL_SQL}, {BLEND_SQL}, grid AS (
  SELECT course_code, target, section, prof_key, truth, score, unnest([{", ".join(map(str, ensemble.TEMPERATURES))}]) AS temperature FROM voted
), soft AS (
  SELECT *, exp((score - max(score) OVER (PARTITION BY course_code, target, section, temperature)) / temperature) AS e FROM grid
), seat AS (SELECT course_code, target, section, temperature, sum(e) AS z, sum(e) FILTER (prof_key = truth) AS own FROM soft GROUP BY ALL)
SELECT CAST(temperature AS DOUBLE) AS temperature, round(avg(-ln(greatest(1e-6, coalesce(own / z * (1 - novelty), novelty)))), {DIGITS}) AS loss FROM seat JOIN novelty USING (course_code, target) GROUP BY temperature""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, ev, seats = _parts(spark, sf_dir, BACKTEST)
    return _rounded(ensemble.calibrate(_blended(seats, ev), seats, history.novelty_rate(rows, _targets(spark, BACKTEST))))


@query("G02_G03_G04_G06_G26_trained")
def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models trained on the backtest terms score the target term."""
    _, ev, seats = _parts(spark, sf_dir, (*BACKTEST, TARGET))
    return learn.trained_scores(history.features(seats, ev), TARGET)


@query("E12_weight_search")
def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir, BACKTEST)
    models = ["seat_exact", "slot", "recent", "last_exact", "frequent", "cooccur", "bundle"]
    rows = _full(seats, ev).withColumn("label", (F.col("prof_key") == F.col("truth")).cast("double"))
    return learn.search_weights(rows.select("course_code", "target", "section", "prof_key", "cand_seq", "label", *models), models)


@query("R01_R03_R04_lineup")
def lineup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tables

    rows, ev, seats = _parts(spark, sf_dir)
    scored = history.heuristic(history.features(seats, ev)).withColumn("score", F.col("heuristic"))
    post = ensemble.posterior(scored, history.novelty_rate(rows, _targets(spark, (TARGET,))), 1.5).filter(F.col("prof_key") != ensemble.NOVEL)
    return learn.lineup(post, tables.capacity(spark, sf_dir), tables.conflict_groups(spark, sf_dir))


@query("G05_naive_bayes", f"""{FOLD_SQL}, {FEATURES_SQL}, x AS (SELECT course_code, target, section, prof_key, CASE WHEN prof_key = truth THEN 1 ELSE 0 END AS label, section_exact AS a, slot_affinity AS b, recency AS c FROM features),
f AS (SELECT label, count(*) AS n, avg(a) AS ma, var_pop(a) AS va, avg(b) AS mb, var_pop(b) AS vb, avg(c) AS mc, var_pop(c) AS vc FROM x GROUP BY label),
d AS (SELECT x.course_code, x.target, x.section, x.prof_key, f.label, ln(n / (SELECT sum(n) FROM f)) - 0.5 * ln(2 * pi() * greatest(va, 1e-4)) - pow(a - ma, 2) / (2 * greatest(va, 1e-4)) - 0.5 * ln(2 * pi() * greatest(vb, 1e-4)) - pow(b - mb, 2) / (2 * greatest(vb, 1e-4))
  - 0.5 * ln(2 * pi() * greatest(vc, 1e-4)) - pow(c - mc, 2) / (2 * greatest(vc, 1e-4)) AS l FROM x, f)
SELECT course_code, target, section, prof_key, round(CAST(1 / (1 + exp(greatest(-700, least(700, max(l) FILTER (label = 0) - max(l) FILTER (label = 1))))) AS DOUBLE), 6) AS p FROM d GROUP BY ALL""")
def naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir, vectors.naive_bayes)


@query("G08_mean_gap", f"""{FOLD_SQL}, {FEATURES_SQL}, x AS (SELECT course_code, target, section, prof_key, prof_key = truth AS label, section_exact AS a, slot_affinity AS b, recency AS c FROM features),
g AS (SELECT avg(a) FILTER (label) - avg(a) FILTER (NOT label) AS ga, avg(b) FILTER (label) - avg(b) FILTER (NOT label) AS gb, avg(c) FILTER (label) - avg(c) FILTER (NOT label) AS gc FROM x)
SELECT course_code, target, section, prof_key, round(CAST(1 / (1 + exp(-(ga * a + gb * b + gc * c))) AS DOUBLE), 6) AS p FROM x, g""")
def mean_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closed(spark, sf_dir, vectors.mean_gap)


def _closed(spark: SparkSession, sf_dir: str, fit) -> DataFrame:
    _, ev, seats = _parts(spark, sf_dir, BACKTEST)
    rows = history.features(seats, ev).withColumn("label", (F.col("prof_key") == F.col("truth")).cast("int"))
    # The fit and the rows that it is applied to both read these columns: features are worked out once.
    rows = cut(rows.select("course_code", "target", "section", "prof_key", "section_exact", "slot_affinity", "recency", "label"))
    return _rounded(fit(rows, ["section_exact", "slot_affinity", "recency"], "label").select("course_code", "target", "section", "prof_key", "p"))
