"""Closed-form models, blending, votes, posteriors and fold metrics, over rows of seat and candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .history import KEY

SEAT = [*KEY, "section"]
NOVEL = "__NEW_OR_UNKNOWN__"
#: The specialists as formulas over the features.
SPECIALISTS = {
    "knn": "(section_exact + section_family + slot_affinity + room_affinity + time_affinity) / 5", "seat_exact": "section_exact", "seat_family": "section_family",
    "slot": "0.6 * slot_affinity + 0.2 * day_affinity + 0.2 * time_affinity", "recent": "recency * (0.55 + 0.45 * freq_decay)", "same_semester": "same_sem_share * (0.5 + 0.5 * recency)",
    "days": "day_affinity", "hours": "time_affinity", "rooms": "room_affinity", "frequent": "freq_decay", "streaks": "streak", "last_exact": "section_exact * (0.4 + 0.6 * recency)",
    "cooccur": "0.65 * partner_cond + 0.35 * partner_pair", "bundle": "bundle_fit", "last_same": "last_same_sem", "newcomer": "newcomer_fit", "successor": "successor_fit",
}
CROSS = ("cooccur", "bundle")
#: How models vote, and the mass of the cross-seat models against one typical other.
VOTE = {"pad": 1, "depth": 5, "floor": 0.02, "mix": 0.4}
CROSS_PRIOR = 5.0
LEAST_SHARE = 0.005
#: Temperatures that calibration tries.
TEMPERATURES = (0.15, 0.25, 0.4, 0.6, 0.8, 1.0, 1.3, 1.7, 2.2, 3.0, 4.0, 6.0)


def specialists(features: DataFrame) -> DataFrame:
    return features.withColumns({name: F.expr(text) for name, text in SPECIALISTS.items()})


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def blend(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: the weighted mean of the heuristic and the models' logits, models without a value left out."""
    live = {k: w for k, w in weights.items() if w > 0}
    value = lambda k: F.col(k) if k == "heuristic" else logit(F.col(k))
    total = reduce(lambda a, b: a + b, (F.coalesce(w * value(k), F.lit(0.0)) for k, w in live.items()))
    used = reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), w).otherwise(0.0) for k, w in live.items()))
    return scored.withColumn("score", F.when(used > 0, total / used).otherwise(F.col("heuristic")))


def votes(scored: DataFrame, weights: dict[str, float], vote: dict = VOTE) -> DataFrame:
    """Pulls score towards a weighted Borda count: each live model gives its first depth names points.

    One partitioning by seat serves all models' ranks.
    """
    live = {k: w for k, w in weights.items() if w > vote["floor"]}
    if not live or not vote["mix"]:
        return scored
    points = F.lit(0.0)
    ranked = scored
    for k, w in live.items():
        place = F.row_number().over(Window.partitionBy(*SEAT).orderBy(F.col(k).desc_nulls_last(), "cand_seq", "prof_key"))
        ranked = ranked.withColumn(f"__{k}", place)
        points = points + F.when(F.col(f"__{k}") <= vote["depth"], w * (vote["depth"] + 1 - F.col(f"__{k}") + vote["pad"])).otherwise(0.0)
    seat = Window.partitionBy(*SEAT)
    ranked = ranked.withColumn("borda", points).drop(*(f"__{k}" for k in live))
    span = F.greatest(F.lit(0.2), F.max("score").over(seat) - F.min("score").over(seat))
    most = F.greatest(F.lit(1e-9), F.max("borda").over(seat))
    pulled = (1 - vote["mix"]) * F.col("score") + vote["mix"] * span * F.col("borda") / most
    return ranked.withColumn("score", F.when(F.count("*").over(seat) < 2, F.col("score")).otherwise(pulled))


def softmax(scored: DataFrame, score: str, temperature: float = 1.0) -> DataFrame:
    """Adds share: the softmax of score over a seat's candidates."""
    seat = Window.partitionBy(*SEAT)
    e = F.exp((F.col(score) - F.max(score).over(seat)) / max(0.05, temperature))
    return scored.withColumn("__e", e).withColumn("share", F.col("__e") / F.sum("__e").over(seat)).drop("__e")


def posterior(scored: DataFrame, novelty: DataFrame, temperature: float = 1.0) -> DataFrame:
    """prob of each candidate and of somebody new, ranked: the novelty row comes last among equals."""
    known = softmax(scored, "score", temperature).join(novelty, KEY).select(*SEAT, "prof_key", "cand_seq", (F.col("share") * (1 - F.col("novelty"))).alias("prob"))
    new = scored.select(*SEAT).distinct().join(novelty, KEY).select(*SEAT, F.lit(NOVEL).alias("prof_key"), F.lit(None).cast("long").alias("cand_seq"), F.col("novelty").alias("prob"))
    by = Window.partitionBy(*SEAT).orderBy(F.desc("prob"), F.col("cand_seq").asc_nulls_last(), "prof_key")
    return known.unionByName(new).withColumn("rank", F.row_number().over(by))


def shortlist(post: DataFrame, limit: int = 5, least: float = LEAST_SHARE) -> DataFrame:
    """The first limit rows of each seat, those below least left out (never the first)."""
    return post.filter((F.col("rank") <= limit) & ((F.col("rank") == 1) | (F.col("prob") >= least)))


def first_guesses(scored: DataFrame, per_seat: int = 5, temperature: float = 1.5) -> DataFrame:
    """The heuristic's best few of each seat, with their softmax among themselves: what other seats are then judged by."""
    by = Window.partitionBy(*SEAT).orderBy(F.desc("heuristic"), "cand_seq", "prof_key")
    few = scored.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= per_seat)
    return softmax(few, "heuristic", temperature).select(*SEAT, "family", "prof_key", "cand_seq", F.col("share").alias("probability"))


def placed(scored: DataFrame, novelty: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds novelty, prob (the softmax of score times 1 - novelty) and place; of equal probs (by 9 digits) the earliest known is first."""
    at = softmax(scored, "score", temperature).join(novelty, KEY).withColumn("prob", F.col("share") * (1 - F.col("novelty")))
    by = Window.partitionBy(*SEAT).orderBy(F.round("prob", 9).desc(), "cand_seq", "prof_key")
    return at.withColumn("place", F.row_number().over(by))


def refreshed_guesses(scored: DataFrame, novelty: DataFrame, per_seat: int = 5, temperature: float = 1.0) -> DataFrame:
    """The first few of each seat after blending and votes, with their probabilities as they are (not shared out anew)."""
    few = placed(scored, novelty, temperature).filter(F.col("place") <= per_seat)
    return few.select(*SEAT, "family", "prof_key", "cand_seq", F.col("prob").alias("probability"))


def confirmed_shortlist(at: DataFrame, confirmed: DataFrame, limit: int = 5, least: float = LEAST_SHARE) -> DataFrame:
    """Short lists of placed rows, where a confirmed holder comes first with prob 1 and leaves no share to somebody new.

    confirmed: course_code, term, section (trimmed and upper-cased here), prof_key, at. Of several of a seat the last by at
    counts. The holder may be no candidate; lists stay at limit names.
    """
    mark = confirmed.select("course_code", F.col("term").alias("target"), F.upper(F.trim("section")).alias("section"), F.struct("at", F.col("prof_key").alias("named")).alias("last"))
    last = mark.groupBy(*SEAT).agg(F.max("last").alias("last")).select(*SEAT, F.col("last.named").alias("named"))
    few = at.filter((F.col("place") <= limit) & ((F.col("place") == 1) | (F.col("prob") >= least))).join(last, SEAT, "left")
    others = few.filter(~F.col("prof_key").eqNullSafe(F.col("named"))).select(*SEAT, "prof_key", "prob", (F.col("place") + 1).alias("place"), F.lit(False).alias("confirmed"), F.when(F.col("named").isNull(), F.col("novelty")).otherwise(0.0).alias("new_share"))
    own = last.select(*SEAT, F.col("named").alias("prof_key"), F.lit(1.0).alias("prob"), F.lit(1).alias("place"), F.lit(True).alias("confirmed"), F.lit(0.0).alias("new_share"))
    by = Window.partitionBy(*SEAT).orderBy("place")
    return others.union(own).withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).drop("place")


def ensemble_metrics(at: DataFrame) -> DataFrame:
    """Per fold, and as the mean of folds (target null), of placed rows with truth: hits, Brier score, and the share that could be hit.

    A truth that is no candidate is a miss with probability 0.
    """
    own = lambda c: F.max(F.when(F.col("prof_key") == F.col("truth"), F.col(c)))
    seat = at.groupBy(*SEAT).agg(own("place").alias("r"), own("prob").alias("p"))
    within = lambda k: F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)).alias(f"top{k}")
    miss = 1 - F.coalesce("p", F.lit(0.0))
    folds = seat.groupBy("target").agg(F.count("*").alias("samples"), within(1), within(3), within(5), F.avg(miss * miss).alias("brier"), F.avg(F.col("r").isNotNull().cast("double")).alias("ceiling"))
    means = [F.avg(c).alias(c) for c in ("top1", "top3", "top5", "brier", "ceiling")]
    return folds.union(folds.agg(F.lit(None).cast("int").alias("target"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), *means))


def confidence(post: DataFrame, agree: DataFrame, top1: float) -> DataFrame:
    """Percent by seat from the first share, agreement of models, margin and backtest accuracy."""
    known = post.filter(F.col("prof_key") != NOVEL)
    by = Window.partitionBy(*SEAT).orderBy(F.desc("prob"), "cand_seq", "prof_key")
    first = known.withColumn("second", F.lead("prob").over(by)).withColumn("rn", F.row_number().over(by)).filter("rn = 1")
    at = first.join(agree, [*SEAT, "prof_key"], "left")
    raw = 0.42 * F.col("prob") + 0.32 * F.coalesce("agree", F.lit(0.0)) + 0.16 * F.greatest(F.lit(0.0), F.col("prob") - F.coalesce("second", F.lit(0.0))) + 0.1 * top1
    return at.select(*SEAT, "prof_key", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), raw)) * 100, 1).alias("confidence"))


def model_picks(scored: DataFrame, models: list[str]) -> DataFrame:
    """Each model's first name of each seat, in the order of ranks: a missing value is 0, of equal ones the earliest known is first."""
    first = ranks(scored, models).filter("rank = 1")
    return first.groupBy(*SEAT).agg(*(F.max(F.when(F.col("model") == m, F.col("prof_key"))).alias(m) for m in models))


def agreement(picks: DataFrame, models: list[str]) -> DataFrame:
    """Share of models that picked each name that any model picked."""
    long = picks.select(*SEAT, F.explode(F.array(*models)).alias("prof_key"))
    return long.groupBy(*SEAT, "prof_key").agg((F.count("*") / len(models)).alias("agree"))


def ranks(scored: DataFrame, models: list[str]) -> DataFrame:
    """Place of every candidate under every model, long: seat, prof_key, truth, model, rank."""
    out = scored.select(*SEAT, "prof_key", "cand_seq", "truth", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).alias("value")) for m in models))).alias("m"))
    by = Window.partitionBy(*SEAT, "m.model").orderBy(F.coalesce("m.value", F.lit(0.0)).desc(), "cand_seq", "prof_key")
    return out.withColumn("rank", F.row_number().over(by)).select(*SEAT, "prof_key", "truth", F.col("m.model").alias("model"), "rank")


def fold_metrics(ranked: DataFrame, seats: DataFrame) -> DataFrame:
    """Per model and fold: seats, share of truths first and within three, mean reciprocal rank, and share that are candidates."""
    hit = ranked.filter(F.col("prof_key") == F.col("truth")).select(*SEAT, "model", "rank")
    models = ranked.select("model").distinct()
    grid = seats.select(*SEAT).crossJoin(F.broadcast(models))  # a short list of models
    at = grid.join(hit, [*SEAT, "model"], "left")
    rank = F.col("rank")
    return at.groupBy("target", "model").agg(
        F.count("*").alias("n"), F.avg(F.when(rank == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.when(rank <= 3, 1.0).otherwise(0.0)).alias("top3"),
        F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"), F.avg(rank.isNotNull().cast("double")).alias("coverage"))


def derive_weights(accuracy: dict[str, float]) -> dict[str, float]:
    """Weights from measured accuracy: squared, the heuristic at least 0.1, normalised, cross-seat models pinned."""
    raw = {k: a * a for k, a in accuracy.items()}
    raw["heuristic"] = max(0.1, raw.get("heuristic", 0.0))
    total = sum(raw.values())
    return pin({k: v / total for k, v in raw.items()})


def pin(weights: dict[str, float], prior: float = CROSS_PRIOR) -> dict[str, float]:
    """Gives the cross-seat models together prior times the mean weight of the other live ones."""
    others = {k: w for k, w in weights.items() if k not in CROSS}
    live = [w for w in others.values() if w > 1e-6]
    cross = {k: weights.get(k, 0.0) for k in CROSS}
    if len(live) <= 1 and all(w < 1e-9 for w in cross.values()):
        return dict(weights)
    goal = prior * (sum(others.values()) / (len(live) or len(others)) or 1 / len(weights))
    mass = sum(cross.values())
    cross = {k: goal / len(CROSS) if mass < 1e-9 else w * goal / mass for k, w in cross.items()}
    total = sum(others.values()) + sum(cross.values())
    return {k: (cross.get(k, w)) / total for k, w in {**weights, **cross}.items()}


def calibrate(blended: DataFrame, seats: DataFrame, novelty: DataFrame) -> DataFrame:
    """Mean log loss for each temperature; a truth that is no candidate scores the novelty share. One pass for the whole grid."""
    grid = blended.select(*SEAT, "prof_key", "truth", "score", F.explode(F.array(*(F.lit(t) for t in TEMPERATURES))).alias("temperature"))
    by = [*SEAT, "temperature"]
    top = Window.partitionBy(*by)
    e = grid.withColumn("e", F.exp((F.col("score") - F.max("score").over(top)) / F.col("temperature")))
    seat = e.groupBy(*by).agg(F.sum("e").alias("z"), F.sum(F.when(F.col("prof_key") == F.col("truth"), F.col("e"))).alias("own"))
    at = seat.join(novelty, KEY)
    p = F.coalesce(F.col("own") / F.col("z") * (1 - F.col("novelty")), F.col("novelty"))
    return at.groupBy("temperature").agg(F.avg(-F.log(F.greatest(F.lit(1e-6), p))).alias("loss"))
