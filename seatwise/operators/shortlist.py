"""What a seat's shortlist shows: reasons, owners of a seat lifted or added, and choices made by shortlist accuracy."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ensemble import LEAST_SHARE, NOVEL, SEAT, VOTE
from .history import KEY, WEIGHTS

#: Names a shortlist shows.
SHORTLIST = 5
#: What each feature says about a candidate.
LABELS = {
    "freq_decay": "teaches this course often", "same_sem_share": "usually this semester", "section_exact": "taught this exact section before", "section_family": "taught sibling sections",
    "slot_affinity": "same day + time slot", "day_affinity": "same days", "time_affinity": "same time of day", "room_affinity": "same room", "recency": "active recently",
    "streak": "teaches nearly every term", "load_share": "carries several sections", "tenure": "long tenure in this course", "verified": "confirmed by a moderator",
    "partner_cond": "paired with other sections this term", "partner_pair": "teaches in the same term as likely colleagues", "bundle_fit": "usually takes this letter with another section",
    "last_same_sem": "taught this section last same semester", "newcomer_fit": "recent one-term or new name on a changing seat", "successor_fit": "replaced the last person on this section",
    "component_fit": "usually teaches this lecture or lab component",
}
#: A reason counts from here; reasons shown.
LEAST_REASON, REASONS = 0.05, 3
#: What owning a seat is worth, as last same-semester, last and previous holder, and by share of one's rows.
BONUS = (0.18, 0.10, 0.06, 0.12)
#: Fixed values of the lift, as shares of the first probability: least worth of owning, and margin over the weakest shown.
LIFT_GATE, LIFT_MARGIN, GHOST = 0.03, 0.01, 6
#: Minutes apart that a slot still counts as the same; names taken by slot and by family.
SLOT_MINUTES, BY_SLOT, BY_FAMILY = 30, 3, 3
#: Shortlist accuracy below which slower decay is tried, the half-lives tried, and the least gain.
FLOOR, HALF_LIVES, GAIN = 0.5, (6.0, 8.0), 0.01
#: Ways of voting tried for a poor shortlist, the accuracy below which they are, and the least gain of one.
RECIPES = (
    {"pad": 1, "depth": 5, "mix": 0.4, "floor": 0.02}, {"pad": 2, "depth": 5, "mix": 0.55, "floor": 0.02}, {"pad": 1, "depth": 7, "mix": 0.5, "floor": 0.02},
    {"pad": 2, "depth": 8, "mix": 0.6, "floor": 0.02}, {"pad": 3, "depth": 5, "mix": 0.7, "floor": 0.02},
)
POOR, RECIPE_GAIN = 0.6, 0.008


def explain(features: DataFrame) -> DataFrame:
    """A candidate's largest contributions to the hand-set score, over LEAST_REASON, at most REASONS; of equal ones the earlier feature."""
    parts = [F.struct((-F.round(w * F.col(n), 9)).alias("order"), F.lit(i).alias("i"), F.lit(n).alias("name"), F.lit(LABELS[n]).alias("label"), (w * F.col(n)).alias("contribution")) for i, (n, w) in enumerate(WEIGHTS.items())]
    few = F.slice(F.array_sort(F.filter(F.array(*parts), lambda r: r["contribution"] > LEAST_REASON)), 1, REASONS)
    out = features.select(*SEAT, "prof_key", F.posexplode(few).alias("at", "r"))
    return out.select(*SEAT, "prof_key", (F.col("at") + 1).alias("place"), "r.name", "r.label", "r.contribution")


def seat_bonus(features: DataFrame, memory: DataFrame) -> DataFrame:
    """Adds bonus: how much a candidate owns the seat."""
    held = memory.select(*SEAT, "last_same_prof", "last_prof", "prev_prof")
    own = lambda c: F.col(c) == F.col("prof_key")
    rank = F.when(own("last_same_prof"), BONUS[0]).when(own("last_prof"), BONUS[1]).when(own("prev_prof"), BONUS[2]).otherwise(0.0)
    return features.join(held, SEAT, "left").withColumn("bonus", rank + BONUS[3] * F.col("section_exact")).drop("last_same_prof", "last_prof", "prev_prof")


def coverage_keys(seats: DataFrame, ev: DataFrame, memory: DataFrame, want: int = SHORTLIST) -> DataFrame:
    """Names that belong on each seat's list, in order: its recent holders, all who held it, then the first few by slot and by family."""
    first = ev.groupBy(*KEY, "prof_key").agg(F.min("seq").alias("cand_seq"))
    recent = memory.join(seats.select(*SEAT), SEAT).select(*SEAT, F.posexplode(F.array("last_same_prof", "last_prof", "prev_prof")).alias("place", "prof_key")).filter("prof_key IS NOT NULL")
    recent = recent.select(*SEAT, "prof_key", F.lit(0).alias("tier"), "place")

    def ranked(rows: DataFrame, tier: int, most: int | None, *order: Column) -> DataFrame:
        by = Window.partitionBy(*SEAT).orderBy(*order, "cand_seq", "prof_key")
        out = rows.join(first, [*KEY, "prof_key"]).withColumn("place", F.row_number().over(by))
        out = out if most is None else out.filter(F.col("place") <= most)
        return out.select(*SEAT, "prof_key", F.lit(tier).alias("tier"), "place")

    total = F.round(F.sum("w"), 9).alias("w")
    exact = ranked(ev.join(seats.select(*SEAT), SEAT).groupBy(*SEAT, "prof_key").agg(total, F.max("term").alias("last")), 1, None, F.desc("w"), F.desc("last"))
    held = ev.groupBy(*KEY, "prof_key", "days", "start").agg(F.sum("w").alias("w"))
    near = (F.abs(F.col("start") - F.col("seat_start")) <= SLOT_MINUTES) & ((F.size("days") == 0) | (F.size("seat_days") == 0) | F.arrays_overlap("days", "seat_days"))
    slot = ranked(seats.select(*SEAT, "seat_days", "seat_start").join(held, KEY).filter(near).groupBy(*SEAT, "prof_key").agg(total), 2, BY_SLOT, F.desc("w"))
    family = ranked(seats.select(*SEAT, "family").join(ev.groupBy(*KEY, "family", "prof_key").agg(total), [*KEY, "family"]), 3, BY_FAMILY, F.desc("w"))
    once = recent.unionByName(exact).unionByName(slot).unionByName(family).groupBy(*SEAT, "prof_key").agg(F.min(F.struct("tier", "place")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*SEAT).orderBy("at", "prof_key"))).filter(F.col("place") <= want).select(*SEAT, "prof_key", "place")


def _lifted(rows: list[tuple], n: int) -> list[tuple[int, bool]]:
    """rows: (probability, bonus) by rank. The new order as numbers of rows, each with whether it was lifted. The first stays."""
    n = min(n, len(rows))
    if len(rows) <= 2:
        return [(i, False) for i in range(len(rows))]
    scale = max(0.01, rows[0][0])
    ghost = max(1e-4, rows[n - 1][0] / GHOST)
    worth = [p + b * scale for p, b in rows]
    shown = list(range(n))
    for i in sorted(range(n, len(rows)), key=lambda i: (-worth[i], i)):
        if rows[i][0] < ghost or worth[i] - rows[i][0] < LIFT_GATE * scale or n < 2:
            continue
        weakest = min(range(1, n), key=lambda k: (worth[shown[k]], k))
        if worth[i] > worth[shown[weakest]] + LIFT_MARGIN * scale:
            shown[weakest] = i
    rest = [i for i in range(len(rows)) if i not in set(shown)]
    return [(i, at < n <= i) for at, i in enumerate(shown + rest)]


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*SEAT, "prof_key"])


def lift(post: DataFrame, bonus: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """Posteriors of known candidates in a new order: who owns a seat may take one of the places 2 to n. One task works on whole seats.

    bonus: as seat_bonus gives it. Returns the seat, prof_key, prob, rank (new) and lifted.
    """

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        got = _lifted(list(zip(pdf.prob, pdf.bonus, strict=True)), n)
        out = pdf.iloc[[i for i, _ in got]][[*SEAT, "prof_key", "prob"]].copy()
        return out.assign(rank=range(1, len(out) + 1), lifted=[b for _, b in got])

    known = post.filter(F.col("prof_key") != NOVEL).join(bonus.select(*SEAT, "prof_key", "bonus"), [*SEAT, "prof_key"], "left").withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))
    return known.select(*SEAT, "prof_key", "prob", "rank", "bonus").groupBy(*SEAT).applyInPandas(order, f"{_kinds(known)}, prob double, rank int, lifted boolean")


def _covered(shown: list[int], probs: list[float], wanted: list[int], limit: int) -> list[int]:
    """shown and wanted: numbers of candidates. Wanted ones fill free places, else replace the weakest unprotected one if likelier."""
    shown = list(shown)
    for new in wanted:
        if new in shown or not probs[new] > 0:
            continue
        if len(shown) < limit:
            shown.append(new)
            continue
        safe = min(SHORTLIST, len(shown)) if limit > SHORTLIST else 1
        if safe < len(shown):
            weakest = min(range(safe, len(shown)), key=lambda k: (probs[shown[k]], k))
            if probs[new] > probs[shown[weakest]]:
                shown[weakest] = new
    return shown[:limit]


def cover(post: DataFrame, keys: DataFrame, limit: int = SHORTLIST, least: float = LEAST_SHARE) -> DataFrame:
    """Each seat's shortlist of known candidates with names of keys added where there is room, or in place of less likely ones."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        few = pdf.head(limit)
        shown = [i for i in few.index if i == 0 or few.prob[i] >= least]
        got = _covered(shown, pdf.prob.tolist(), pdf[pdf.place.notna()].sort_values("place").index.tolist(), limit)
        return pdf.iloc[got][[*SEAT, "prof_key", "prob"]].assign(place=range(1, len(got) + 1), covered=[i not in shown for i in got])

    known = post.filter(F.col("prof_key") != NOVEL).join(keys, [*SEAT, "prof_key"], "left")
    return known.select(*SEAT, "prof_key", "prob", "rank", "place").groupBy(*SEAT).applyInPandas(add, f"{_kinds(known)}, prob double, place int, covered boolean")


def accuracy(ranked: DataFrame, seats: DataFrame, n: int = SHORTLIST) -> DataFrame:
    """One row: the share of seats whose truth is first (top1) and within n (topn)."""
    hit = ranked.select(*SEAT, "prof_key", "rank")
    at = seats.select(*SEAT, F.col("truth").alias("prof_key")).join(hit, [*SEAT, "prof_key"], "left")
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return at.agg(share(1).alias("top1"), share(n).alias("topn"))


def choose_half_life(tried: DataFrame, start: float) -> DataFrame:
    """tried: half_life and topn, a few rows. Adds chosen: slower decay is taken while the shortlist is below FLOOR and gains."""
    of = lambda h: F.max(F.when(F.col("half_life") == h, F.col("topn")))
    best, at = of(start), F.lit(start)
    for h in HALF_LIVES:
        better = (best < FLOOR) & (of(h) > best + GAIN)
        best, at = F.when(better, of(h)).otherwise(best), F.when(better, F.lit(h)).otherwise(at)
    return tried.crossJoin(F.broadcast(tried.agg(at.alias("__at")))).withColumn("chosen", F.col("half_life") == F.col("__at")).drop("__at")  # one row


def recipe_ranks(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Candidates' places under each way of voting, recipe 0 being the usual one: models' ranks are taken once for all."""
    live = {k: w for k, w in weights.items() if w > VOTE["floor"]}
    for k in live:
        scored = scored.withColumn(f"__{k}", F.row_number().over(Window.partitionBy(*SEAT).orderBy(F.col(k).desc_nulls_last(), "cand_seq", "prof_key")))
    each = F.array(*(F.struct(F.lit(i).alias("recipe"), *(F.lit(v[c]).alias(c) for c in ("pad", "depth")), F.lit(float(v["mix"])).alias("mix")) for i, v in enumerate((VOTE, *RECIPES))))
    long = scored.select(*SEAT, "prof_key", "cand_seq", "score", *(f"__{k}" for k in live), F.inline(each))
    points = F.lit(0.0)
    for k, w in live.items():
        points = points + F.when(F.col(f"__{k}") <= F.col("depth"), w * (F.col("depth") + 1 - F.col(f"__{k}") + F.col("pad"))).otherwise(0.0)
    seat = Window.partitionBy(*SEAT, "recipe")
    long = long.withColumn("borda", points)
    span = F.greatest(F.lit(0.2), F.max("score").over(seat) - F.min("score").over(seat))
    pulled = (1 - F.col("mix")) * F.col("score") + F.col("mix") * span * F.col("borda") / F.greatest(F.lit(1e-9), F.max("borda").over(seat))
    voted = long.withColumn("voted", F.round(F.when(F.count("*").over(seat) < 2, F.col("score")).otherwise(pulled), 9))
    return voted.withColumn("rank", F.row_number().over(seat.orderBy(F.desc("voted"), "cand_seq", "prof_key"))).select(*SEAT, "prof_key", "recipe", "rank")


def accuracy_by(ranked: DataFrame, seats: DataFrame, by: str, n: int = SHORTLIST) -> DataFrame:
    """As accuracy, one row for each value of by; seats without a candidate count as misses."""
    hit = ranked.join(seats.select(*SEAT, F.col("truth").alias("prof_key")), [*SEAT, "prof_key"])
    found = hit.groupBy(by).agg(*(F.sum((F.col("rank") <= k).cast("int")).alias(c) for k, c in ((1, "top1"), (n, "topn"))))
    every = seats.agg(F.count("*").alias("n"))
    return found.crossJoin(F.broadcast(every)).select(by, (F.col("top1") / F.col("n")).alias("top1"), (F.col("topn") / F.col("n")).alias("topn"))  # one row


def choose_recipe(tried: DataFrame) -> DataFrame:
    """tried: recipe (0: as it was, then those of RECIPES by number) and topn. Adds chosen."""
    of = lambda k: F.max(F.when(F.col("recipe") == k, F.col("topn")))
    best, at, poor = of(0), F.lit(0), of(0) < POOR
    for k in range(1, len(RECIPES) + 1):
        better = poor & (of(k) > best + RECIPE_GAIN)
        best, at = F.when(better, of(k)).otherwise(best), F.when(better, F.lit(k)).otherwise(at)
    return tried.crossJoin(F.broadcast(tried.agg(at.alias("__at")))).withColumn("chosen", F.col("recipe") == F.col("__at")).drop("__at")  # one row
