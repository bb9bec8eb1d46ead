"""History features: profiles of holders, memory of seats, novelty, and the pairs of seat and candidate with their features.

Every operator is keyed by (course_code, target) so that many courses and many targets, such as all folds of a backtest,
run in one plan. evidence rows carry both: a row of history is repeated for each target after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import HALF_LIFE, day_jaccard, decay_weight, distance, parse_days, parse_time, semester, time_similarity
from ..functions.names import normalize
from ..functions.sections import section_family, section_kind

KEY = ["course_code", "target"]
#: Features in order, with the weights of the hand-set score.
WEIGHTS = {
    "freq_decay": 1.6, "same_sem_share": 1.1, "section_exact": 2.2, "section_family": 0.7, "slot_affinity": 2.6, "day_affinity": 0.5, "time_affinity": 0.5,
    "room_affinity": 0.6, "recency": 1.4, "streak": 0.9, "load_share": 0.3, "tenure": 0.4, "verified": 6.0, "partner_cond": 9.0, "partner_pair": 6.0,
    "bundle_fit": 7.0, "last_same_sem": 2.8, "newcomer_fit": 1.7, "successor_fit": 1.5, "component_fit": 1.8,
}
#: Semesters away from which a seat counts as left, and bounds of the newcomer rules.
GONE, RECENT_GAP, FEW_TERMS, HIGH_TURNOVER = 4, 2, 2, 0.45
NOVELTY_LOW, NOVELTY_HIGH, NOVELTY_DEFAULT = 0.02, 0.6, 0.15


def evidence(records: DataFrame, targets: DataFrame, half_life: float | Column = HALF_LIFE) -> DataFrame:
    """Rows before each target, with decay weight and parsed columns computed once, ahead of any pairing.

    targets: a column target. It is a short list of terms, and joined by range; this is the barrier that keeps what is to be
    predicted, and anything later, out of the features.
    """
    rows = records.filter(F.col("prof_key") != "").select(
        "course_code", "term", "section", "prof_key", "seq", parse_days(F.col("days")).alias("days"), parse_time(F.col("time_start")).alias("start"),
        normalize(F.col("room")).alias("room"), section_family(F.col("section")).alias("family"), section_kind(F.col("section")).alias("kind"), semester(F.col("term")).alias("sem"))
    return rows.join(F.broadcast(targets.select("target").distinct()), F.col("term") < F.col("target")).withColumn("w", decay_weight(F.col("term"), F.col("target"), half_life))


def profiles(ev: DataFrame) -> DataFrame:
    """One row per course, target and holder: weights, counts, terms, slots, load, tenure and gap."""
    sem = [F.sum(F.when(F.col("sem") == s, F.col("w")).otherwise(0.0)).alias(f"w_sem{s}") for s in (1, 2, 3)]
    kinds = [F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0)).alias(f"w_{k}") for k in ("lecture", "lab")]
    own = ev.groupBy(*KEY, "prof_key").agg(
        F.sum("w").alias("weight"), F.count("*").alias("n_rows"), F.count_distinct("term").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"),
        F.min("seq").alias("cand_seq"), F.collect_set("term").alias("terms"), F.collect_set(F.struct("days", "start")).alias("slots"), *sem, *kinds)
    whole = ev.groupBy(*KEY).agg(F.sum("w").alias("total_weight"), F.array_sort(F.collect_set("term")).alias("history"))
    p = own.join(whole, KEY)
    p = p.withColumn("avg_load", F.col("n_rows") / F.col("n_terms")).withColumn("tenure", F.col("n_terms") / F.size("history"))
    return p.withColumn("gap", F.abs(distance(F.col("last_term"), F.col("target"))))


def keyed_weights(ev: DataFrame, column: str) -> DataFrame:
    """Decayed weight and first term of each holder by section, family, kind or room."""
    return ev.groupBy(*KEY, "prof_key", column).agg(F.sum("w").alias("w"), F.min("term").alias("first_term"))


def seat_memory(ev: DataFrame, prof: DataFrame) -> DataFrame:
    """One row per seat: last, previous and last same-semester holder, turnover, and whether the seat looks left."""
    order = F.struct("term", "seq")
    same = F.when(F.col("sem") == semester(F.col("target")), order)
    by = Window.partitionBy(*KEY, "section").orderBy(F.desc("term"), F.desc("seq"))
    ranked = ev.withColumn("rn", F.row_number().over(by))
    seat = ranked.groupBy(*KEY, "section").agg(
        F.max_by("prof_key", order).alias("last_prof"), F.max("term").alias("last_seat_term"), F.max(F.when(F.col("rn") == 2, F.col("prof_key"))).alias("prev_prof"),
        F.max_by("prof_key", same).alias("last_same_prof"), F.max(F.when(same.isNotNull(), F.col("term"))).alias("last_same_term"),
        (F.count_distinct("prof_key") / F.count_distinct("term")).alias("turnover"))
    gaps = prof.select(*KEY, F.col("prof_key").alias("last_prof"), F.col("gap").alias("last_gap"))
    return seat.join(gaps, [*KEY, "last_prof"], "left").withColumn("vacant", F.coalesce(F.col("last_gap"), F.lit(99)) >= GONE).drop("last_gap")


def novelty_rate(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Share of rows, after a course's first term, whose holder had not been seen in any earlier term. By course and target."""
    rows = records.filter("prof_key <> ''").select("course_code", "term", "prof_key").join(F.broadcast(targets.select("target").distinct()), F.col("term") < F.col("target"))
    course, person = Window.partitionBy(*KEY), Window.partitionBy(*KEY, "prof_key")
    rows = rows.withColumn("opening", F.min("term").over(course)).withColumn("debut", F.min("term").over(person))
    later = F.when(F.col("term") > F.col("opening"), (F.col("debut") == F.col("term")).cast("double"))
    share = F.greatest(F.lit(NOVELTY_LOW), F.least(F.lit(NOVELTY_HIGH), F.avg(later)))
    return rows.groupBy(*KEY).agg(F.coalesce(share, F.lit(NOVELTY_DEFAULT)).alias("novelty"))


def candidates(seats: DataFrame, prof: DataFrame) -> DataFrame:
    """Every seat of a course with every holder its history knows: an equi-join on course and target."""
    return seats.join(prof, KEY)


def seats_of(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The first row of each section of each target term."""
    own = records.join(F.broadcast(targets.select("target").distinct()), F.col("term") == F.col("target"))
    first = own.groupBy(*KEY, "section").agg(F.min_by(F.struct("days", "time_start", "room", "prof_key", "seq"), "seq").alias("r"))
    return first.select(
        *KEY, "section", parse_days(F.col("r.days")).alias("seat_days"), parse_time(F.col("r.time_start")).alias("seat_start"), normalize(F.col("r.room")).alias("seat_room"),
        section_family(F.col("section")).alias("family"), section_kind(F.col("section")).alias("kind"), F.col("r.prof_key").alias("truth"), F.col("r.seq").alias("seat_seq"))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), F.coalesce(part, F.lit(0.0)) / whole)).otherwise(0.0)


def features(seats: DataFrame, ev: DataFrame, half_life: float | Column = HALF_LIFE, verified: DataFrame | None = None) -> DataFrame:
    """Features of every seat and candidate that need no guess about other seats (the three partner features are 0).

    All joins are on course and target and more, so one partitioning by (course_code, target) serves the whole plan. The
    match of slots is taken within the candidate's array of slots, without a shuffle.
    """
    prof = profiles(ev)
    pairs = candidates(seats, prof)
    named = lambda column, key, *more: keyed_weights(ev, column).select(*KEY, "prof_key", F.col(column).alias(key), *more)
    at = pairs.join(named("section", "section", F.col("w").alias("w_section"), F.col("first_term").alias("section_first")), [*KEY, "prof_key", "section"], "left")
    at = at.join(named("family", "family", F.col("w").alias("w_family"), F.col("first_term").alias("family_first")), [*KEY, "prof_key", "family"], "left")
    at = at.join(named("room", "seat_room", F.col("w").alias("w_room")), [*KEY, "prof_key", "seat_room"], "left")
    at = at.join(seat_memory(ev, prof), [*KEY, "section"], "left")
    if verified is None:
        at = at.withColumn("verified", F.lit(0.0))
    else:
        mark = verified.select("course_code", F.col("term").alias("target"), "section", "prof_key", F.lit(1.0).alias("verified")).distinct()
        at = at.join(mark, [*KEY, "section", "prof_key"], "left").withColumn("verified", F.coalesce("verified", F.lit(0.0)))
    day, time = (lambda s: day_jaccard(F.col("seat_days"), s["days"])), (lambda s: time_similarity(F.col("seat_start"), s["start"]))
    best = lambda f: F.coalesce(F.array_max(F.transform("slots", f)), F.lit(0.0))
    target_sem = semester(F.col("target"))
    sem_weight = F.when(target_sem == 1, F.col("w_sem1")).when(target_sem == 2, F.col("w_sem2")).otherwise(F.col("w_sem3"))
    recent = F.slice("history", F.greatest(F.lit(1), F.size("history") - 3), F.lit(4))
    known = F.col("last_prof").isNotNull()
    few = (F.col("n_terms") <= FEW_TERMS) & (F.col("gap") <= RECENT_GAP)
    first_here = F.coalesce("section_first", "family_first")
    newcomer = F.least(F.lit(1.0), 0.35 + F.when(F.col("vacant"), 0.45).otherwise(0.0) + F.when(F.col("turnover") >= HIGH_TURNOVER, 0.2).otherwise(0.0))
    columns = {
        "freq_decay": _share(F.col("weight"), F.col("total_weight")),
        "same_sem_share": F.when(F.col("w_sem1") + F.col("w_sem2") + F.col("w_sem3") > 0, sem_weight / (F.col("w_sem1") + F.col("w_sem2") + F.col("w_sem3"))).otherwise(0.0),
        "section_exact": _share(F.col("w_section"), F.col("weight")),
        "section_family": _share(F.col("w_family"), F.col("weight")),
        "slot_affinity": best(lambda s: day(s) * time(s)),
        "day_affinity": best(day),
        "time_affinity": best(time),
        "room_affinity": F.when(F.col("seat_room") != "", _share(F.col("w_room"), F.col("weight"))).otherwise(0.0),
        "recency": F.pow(F.lit(0.5), F.col("gap") / half_life),
        "streak": F.size(F.array_intersect(recent, F.col("terms"))) / F.size(recent),
        "load_share": F.least(F.lit(1.0), F.col("avg_load") / 4),
        "tenure": F.least(F.lit(1.0), F.col("tenure")),
        "verified": F.col("verified"),
        "partner_cond": F.lit(0.0), "partner_pair": F.lit(0.0), "bundle_fit": F.lit(0.0),
        "last_same_sem": F.when(known & (F.col("last_same_prof") == F.col("prof_key")) & (F.col("gap") < GONE), 1.0).otherwise(0.0),
        "newcomer_fit": F.when(known & few, newcomer).otherwise(0.0),
        "successor_fit": F.when(known & F.col("vacant") & (F.col("last_prof") != F.col("prof_key")) & few, F.when(first_here > F.col("last_seat_term"), 0.9).otherwise(0.45)).otherwise(0.0),
        "component_fit": _share(F.when(F.col("kind") == "lab", F.col("w_lab")).otherwise(F.col("w_lecture")), F.col("weight")),
    }
    return at.select(*KEY, "section", "family", "kind", "prof_key", "cand_seq", "truth", *(c.alias(n) for n, c in columns.items()))


def heuristic(features_: DataFrame) -> DataFrame:
    """Adds the hand-set linear score."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.col(name)
    return features_.withColumn("heuristic", total)
