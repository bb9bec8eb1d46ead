"""Measured weights: accuracy of each model on held-out terms, weights from it as a relation, and blends, votes, temperature and confidence by it.

Every course has weights and a temperature of its own. Scores are held long, a row for each seat, candidate and model, so that weights
are joined to them like any other table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ensemble import CROSS, CROSS_PRIOR, KEY, SEAT, TEMPERATURES, VOTE, logit

#: The least raw weight of the heuristic, and what counts as a live model.
LEAST_HEURISTIC, LIVE = 0.1, 1e-6
#: Shares of first probability, agreement, margin and measured accuracy in a seat's confidence.
CONFIDENCE = (0.42, 0.32, 0.16, 0.1)


def long_scores(full: DataFrame, models: list[str]) -> DataFrame:
    """Seat, family, prof_key, cand_seq, truth, model, value: a row for each model of each row of full. A missing value stays null."""
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("value")) for m in models))
    return full.select(*SEAT, "family", "prof_key", "cand_seq", "truth", F.explode(each).alias("m")).select("*", "m.model", "m.value").drop("m")


def ranked(long: DataFrame) -> DataFrame:
    """Adds rank under each model: missing values last, of equal ones (by 9 digits) the earliest known first. One partitioning by seat serves all models."""
    by = Window.partitionBy(*SEAT, "model").orderBy(F.round("value", 9).desc_nulls_last(), "cand_seq", "prof_key")
    return long.repartition(*SEAT).withColumn("rank", F.row_number().over(by))


def accuracies(placed: DataFrame, seats: DataFrame, models: list[str]) -> DataFrame:
    """course_code, model, n (held-out seats), accuracy: how often each model ranks the holder first. placed: ranked rows of held-out terms."""
    hits = placed.filter((F.col("rank") == 1) & (F.col("prof_key") == F.col("truth"))).groupBy("course_code", "model").agg(F.count("*").alias("hits"))
    grid = seats.groupBy("course_code").agg(F.count("*").alias("n")).select("*", F.explode(F.array(*(F.lit(m) for m in models))).alias("model"))
    return grid.join(hits, ["course_code", "model"], "left").select("course_code", "model", "n", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("accuracy"))


def derived(accuracy: DataFrame) -> DataFrame:
    """Adds weight: the squared accuracy's share of the course's, the heuristic's never below a least raw weight."""
    square = F.col("accuracy") * F.col("accuracy")
    raw = F.when(F.col("model") == "heuristic", F.greatest(F.lit(LEAST_HEURISTIC), square)).otherwise(square)
    course = Window.partitionBy("course_code")
    return accuracy.withColumn("raw", raw).withColumn("weight", F.col("raw") / F.sum("raw").over(course)).drop("raw")


def pinned(weights: DataFrame, prior: float | Column = CROSS_PRIOR) -> DataFrame:
    """weights (course_code, model, weight) where the cross-seat models together have prior times the mean weight of a live other model.

    They keep their shares of it, or share it evenly if they had none. A course with one live model and no cross-seat weight stays as it is.
    """
    course, cross = Window.partitionBy("course_code"), F.col("model").isin(*CROSS)
    over = lambda c: F.sum(F.when(c[0], c[1])).over(course)
    at = weights.withColumns({
        "__others": over((~cross, F.col("weight"))), "__live": F.coalesce(over((~cross & (F.col("weight") > LIVE), F.lit(1))), F.lit(0)), "__many": over((~cross, F.lit(1))),
        "__mass": over((cross, F.col("weight"))), "__most": F.max(F.when(cross, F.col("weight"))).over(course), "__all": F.count("*").over(course), "__cross": over((cross, F.lit(1))),
    })
    unit = F.col("__others") / F.when(F.col("__live") > 0, F.col("__live")).otherwise(F.col("__many"))
    goal = prior * F.when(unit > 0, unit).otherwise(1.0 / F.col("__all"))
    moved = F.when(~cross, F.col("weight")).when(F.col("__mass") < 1e-9, goal / F.col("__cross")).otherwise(F.col("weight") * goal / F.col("__mass"))
    stays = (F.col("__live") <= 1) & (F.col("__most") < 1e-9)
    at = at.withColumn("__moved", moved).withColumn("__total", F.sum("__moved").over(course))
    return at.withColumn("weight", F.when(stays, F.col("weight")).otherwise(F.col("__moved") / F.col("__total"))).drop(*(c for c in at.columns if c.startswith("__")))


def voted(placed: DataFrame, weights: DataFrame, vote: dict = VOTE, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each seat and candidate of placed (ranked rows): score, agree, and the columns to keep, which are the same for all of a seat's rows.

    The vote's depth, pad and mix are numbers, or columns of placed, so that one plan can try several; mix is then one of keep.

    The score is the weighted mean of the heuristic and the models' logits, pulled towards a weighted Borda count of the live models'
    first names. agree: the share of live models that rank the candidate first.
    """
    at = placed.join(weights.select("course_code", "model", "weight"), ["course_code", "model"])
    value = F.when(F.col("model") == "heuristic", F.col("value")).otherwise(logit(F.col("value")))
    used, live = (F.col("weight") > 0) & F.col("value").isNotNull(), F.col("weight") > vote["floor"]
    points = F.when(live & (F.col("rank") <= vote["depth"]), F.col("weight") * (vote["depth"] + 1 + vote["pad"] - F.col("rank"))).otherwise(0.0)
    one = at.groupBy(*SEAT, "family", "prof_key", "cand_seq", "truth", *keep).agg(
        F.sum(F.when(used, F.col("weight") * value)).alias("total"), F.sum(F.when(used, F.col("weight"))).alias("mass"), F.max(F.when(F.col("model") == "heuristic", F.col("value"))).alias("heuristic"),
        F.sum(points).alias("borda"), (F.count_if(live & (F.col("rank") == 1)) / F.greatest(F.lit(1), F.count_if(live))).alias("agree"))
    seat = Window.partitionBy(*SEAT)
    one = one.withColumn("score", F.round(F.when(F.col("mass") > 0, F.col("total") / F.col("mass")).otherwise(F.col("heuristic")), 9))
    span = F.greatest(F.lit(0.2), F.max("score").over(seat) - F.min("score").over(seat))
    pulled = (1 - vote["mix"]) * F.col("score") + vote["mix"] * span * F.col("borda") / F.greatest(F.lit(1e-9), F.max("borda").over(seat))
    plain = (F.count("*").over(seat) < 2) | (F.max("borda").over(seat) <= 0)
    return one.withColumn("__pulled", F.when(plain, F.col("score")).otherwise(pulled)).select(*SEAT, "family", "prof_key", "cand_seq", "truth", *keep, F.col("__pulled").alias("score"), "agree")


def temperatures(scored: DataFrame, novelty: DataFrame, grid: tuple[float, ...] = TEMPERATURES) -> DataFrame:
    """course_code, temperature, loss: of the grid the temperature with the least mean log loss on held-out seats, of equal ones (by 9 digits) the lowest.

    A holder that is no candidate scores the share of somebody new. Seats are summed for all temperatures in one pass.
    """
    gap = F.col("score") - F.max("score").over(Window.partitionBy(*SEAT))
    own = F.when(F.col("prof_key") == F.col("truth"), F.col("gap"))
    each = F.array(*(F.lit(float(t)) for t in grid))
    seat = scored.withColumn("gap", gap).groupBy(*SEAT).agg(F.max(own).alias("own"), *(F.sum(F.exp(F.col("gap") / t)).alias(f"z{i}") for i, t in enumerate(grid)))
    long = seat.join(novelty, KEY).select("course_code", "own", "novelty", F.explode(F.arrays_zip(each.alias("t"), F.array(*(F.col(f"z{i}") for i in range(len(grid)))).alias("z"))).alias("at"))
    p = F.coalesce(F.exp(F.col("own") / F.col("at.t")) / F.col("at.z") * (1 - F.col("novelty")), F.col("novelty"))
    loss = long.groupBy("course_code", F.col("at.t").alias("temperature")).agg(F.round(F.avg(-F.log(F.greatest(F.lit(1e-6), p))), 9).alias("loss"))
    best = loss.groupBy("course_code").agg(F.min(F.struct("loss", "temperature")).alias("b"))
    return best.select("course_code", "b.temperature", "b.loss")


def placed(scored: DataFrame, novelty: DataFrame, warmth: DataFrame) -> DataFrame:
    """scored with novelty, prob and place, each course at its own temperature (1 for a course without one)."""
    seat, by = Window.partitionBy(*SEAT), Window.partitionBy(*SEAT).orderBy(F.round("prob", 9).desc(), "cand_seq", "prof_key")
    at = scored.join(warmth.select("course_code", "temperature"), "course_code", "left").join(novelty, KEY)
    e = F.exp((F.col("score") - F.max("score").over(seat)) / F.coalesce("temperature", F.lit(1.0)))
    at = at.withColumn("__e", e).withColumn("prob", F.col("__e") / F.sum("__e").over(seat) * (1 - F.col("novelty"))).drop("__e", "temperature")
    return at.withColumn("place", F.row_number().over(by))


def first_hits(held_out: DataFrame) -> DataFrame:
    """course_code, top1: the share of held-out seats whose holder has the first place."""
    seat = held_out.groupBy(*SEAT).agg(F.max(((F.col("place") == 1) & (F.col("prof_key") == F.col("truth"))).cast("double")).alias("hit"))
    return seat.groupBy("course_code").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("top1"))


def confidence(at: DataFrame, top1: DataFrame, shares: tuple[float, ...] = CONFIDENCE) -> DataFrame:
    """Seat, prof_key, confidence (percent) of each seat's first place, from its probability, its margin, the models' agreement and the course's measured accuracy."""
    seat = at.groupBy(*SEAT).agg(F.max(F.when(F.col("place") == 1, F.struct("prob", "agree", "prof_key"))).alias("a"), F.max(F.when(F.col("place") == 2, F.col("prob"))).alias("second"))
    first: Column = F.col("a.prob")
    raw = shares[0] * first + shares[1] * F.col("a.agree") + shares[2] * F.greatest(F.lit(0.0), first - F.coalesce("second", F.lit(0.0))) + shares[3] * F.coalesce("top1", F.lit(0.0))
    return seat.join(top1, "course_code", "left").select(*SEAT, "a.prof_key", F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), raw)) * 100, 1).alias("confidence"))
