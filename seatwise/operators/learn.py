"""Trained scorers and the line-up: one grouped task per course, many courses in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import WEIGHTS

FEATURES = list(WEIGHTS)
#: Rows below which nothing is trained.
LEAST_ROWS = 24
LOGISTIC = {"steps": 600, "rate": 0.25, "decay": 0.02}
PERCEPTRON = {"epochs": 70, "rate": 0.12}
FOREST = {"trees": 60, "depth": 5, "split": 6, "leaf": 2, "sample": 0.8, "seed": 1337}
EXTRA = {"trees": 24, "depth": 4, "split": 6, "leaf": 2, "sample": 0.65, "seed": 2026}
#: Costs of a name outside a seat's list and of an empty seat; names considered for a seat.
MISS, EMPTY, NAMES, MOST_SLOTS = 40.0, 50.0, 8, 600


def _squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int, rate: float, decay: float) -> Callable:
    """Balanced, standardised, full-batch gradient descent for a fixed number of steps."""
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd == 0, 1, sd)
    z = (x - mean) / sd
    weight = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        miss = (_squash(z @ w + b) - y) * weight
        w, b = w - rate * (miss @ z / weight.sum() + decay * w), b - rate * miss.sum() / weight.sum()
    return lambda new: _squash((new - mean) / sd @ w + b)


def fit_perceptron(x: np.ndarray, y: np.ndarray, epochs: int, rate: float) -> Callable:
    """Mistake-driven updates in the order of the rows."""
    wide = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(wide.shape[1])
    for _ in range(epochs):
        for row, want in zip(wide, y, strict=True):
            if (miss := want - (row @ w > 0)) != 0:
                w += rate * miss * row
    return lambda new: _squash(new @ w[:-1] + w[-1])


def _split(x: np.ndarray, y: np.ndarray, w: np.ndarray, leaf: int) -> tuple[float, float] | None:
    """Gain and threshold of the best cut of one feature, by the fall in weighted impurity."""
    order = np.argsort(x, kind="stable")
    x, pos, all_ = x[order], np.cumsum((w * y)[order]), np.cumsum(w[order])
    k = np.arange(leaf, len(x) - leaf + 1)
    k = k[x[k - 1] < x[np.minimum(k, len(x) - 1)]] if len(k) else k
    if not len(k):
        return None
    impure = lambda p, t: 2 * (p / t) * (1 - p / t)
    left, total = all_[k - 1], all_[-1]
    gain = impure(pos[-1], total) - left / total * impure(pos[k - 1], left) - (total - left) / total * impure(pos[-1] - pos[k - 1], total - left)
    best = int(gain.argmax())
    return (float(gain[best]), float((x[k[best] - 1] + x[k[best]]) / 2)) if gain[best] > 1e-9 else None


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, split: int, leaf: int, sample: float, seed: int) -> tuple[Callable, np.ndarray]:
    """Balanced classification trees on bootstrap samples, some features a split, smoothed leaves; and summed gains by feature."""
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, (y == 0).sum() / y.sum(), 1.0)
    tried, gains = int(np.ceil(np.sqrt(x.shape[1]))), np.zeros(x.shape[1])

    def grow(rows: np.ndarray, level: int):
        w, yy = weight[rows], y[rows]
        value = ((w * yy).sum() + 0.5) / (w.sum() + 1)
        if level == depth or len(rows) < split or yy.min() == yy.max():
            return value
        found = [(got[0], f, got[1]) for f in r.permutation(x.shape[1])[:tried] if (got := _split(x[rows, f], yy, w, leaf))]
        if not found:
            return value
        gain, f, cut = max(found)
        gains[f] += gain
        low = x[rows, f] <= cut
        return f, cut, grow(rows[low], level + 1), grow(rows[~low], level + 1)

    grown = [grow(r.integers(0, len(x), max(4, int(len(x) * sample))), 0) for _ in range(trees)]

    def walk(tree, new: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(tree, tuple):
            out[rows] += tree
            return
        low = new[rows, tree[0]] <= tree[1]
        walk(tree[2], new, rows[low], out)
        walk(tree[3], new, rows[~low], out)

    def score(new: np.ndarray) -> np.ndarray:
        out = np.zeros(len(new))
        for tree in grown:
            walk(tree, new, np.arange(len(new)), out)
        return out / trees

    return score, gains / (gains.sum() or 1)


def trained_scores(examples: DataFrame, target: int) -> DataFrame:
    """Scores the target's seats and candidates by models trained on the earlier targets' rows of the same course.

    examples: features of all targets, each from evidence before it. A course with too few rows, or without both labels,
    has null scores. A course's rows, seats times candidates, are one group; nothing larger meets in a task.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target", "section", "cand_seq", "prof_key"])
        old, new = pdf[pdf.target < target], pdf[pdf.target == target]
        out = new[["course_code", "target", "section", "prof_key"]].copy()
        x, y, ahead = old[FEATURES].to_numpy(float), old.label.to_numpy(float), new[FEATURES].to_numpy(float)
        if len(old) < LEAST_ROWS or not 0 < y.sum() < len(y) or not len(new):
            return out.assign(logistic=None, perceptron=None, forest=None, extra_trees=None)
        forest, _ = fit_forest(x, y, **FOREST)
        extra, _ = fit_forest(x, y, **EXTRA)
        return out.assign(logistic=fit_logistic(x, y, **LOGISTIC)(ahead), perceptron=fit_perceptron(x, y, **PERCEPTRON)(ahead), forest=forest(ahead), extra_trees=extra(ahead))

    labelled = examples.withColumn("label", (F.col("prof_key") == F.col("truth")).cast("double")).select("course_code", "target", "section", "prof_key", "cand_seq", "label", *FEATURES)
    schema = "course_code string, target int, section string, prof_key string, logistic double, perceptron double, forest double, extra_trees double"
    return labelled.groupBy("course_code").applyInPandas(fit, schema)


def importances(examples: DataFrame) -> DataFrame:
    """Each feature's share of the gain of a course's forest over the given targets; none for a course with too few rows."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target", "section", "cand_seq", "prof_key"])
        y = pdf.label.to_numpy(float)
        if len(pdf) < LEAST_ROWS or not 0 < y.sum() < len(y):
            return pd.DataFrame([], columns=["course_code", "feature", "importance"], dtype=object)  # empty columns of numbers can't become strings
        _, gains = fit_forest(pdf[FEATURES].to_numpy(float), y, **FOREST)
        return pd.DataFrame({"course_code": pdf.course_code.iloc[0], "feature": FEATURES, "importance": gains})

    labelled = examples.withColumn("label", (F.col("prof_key") == F.col("truth")).cast("double")).select("course_code", "target", "section", "prof_key", "cand_seq", "label", *FEATURES)
    return labelled.groupBy("course_code").applyInPandas(fit, "course_code string, feature string, importance double")


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost (columns at least as many as rows).

    Rows are added one by one; each time the cheapest path of swaps is found over reduced costs, all columns at a time.
    """
    n, m = cost.shape
    row_price, col_price, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for new in range(n):
        dist, before, done = cost[new] - row_price[new] - col_price, np.full(m, -1), np.zeros(m, bool)
        while True:
            at = int(np.where(done, np.inf, dist).argmin())
            done[at] = True
            if owner[at] < 0:
                break
            via = dist[at] + cost[owner[at]] - row_price[owner[at]] - col_price
            better = ~done & (via < dist)
            dist[better], before[better] = via[better], at
        settled = np.flatnonzero(done)
        settled = settled[settled != at]
        row_price[owner[settled]] += dist[at] - dist[settled]
        col_price[settled] -= dist[at] - dist[settled]
        row_price[new] += dist[at]
        while before[at] >= 0:
            owner[at] = owner[before[at]]
            at = before[at]
        owner[at] = new
    out = np.full(n, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def lineup(ranked: DataFrame, capacity: DataFrame, groups: DataFrame) -> DataFrame:
    """One name for each seat so that the summed -log probability is least and nobody has more seats than they use to.

    ranked: course_code, section, prof_key, prob, rank. In each group of overlapping seats the surer ones keep a name that
    two have got; the other takes its best name that is free there, or stays empty. One task per course. A fixed rule of the
    assignment: of a course's places by capacity, in the order of names, the first MOST_SLOTS take part.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        seats = sorted(pdf.section.unique())
        chance = {s: dict(zip(g.prof_key, g.prob, strict=True)) for s, g in pdf.sort_values("rank").groupby("section")}
        slots = [p for p, n in sorted(dict(zip(pdf.prof_key, pdf.capacity, strict=True)).items()) for _ in range(int(n))][:MOST_SLOTS]
        slots += [None] * max(0, len(seats) - len(slots))
        cost = np.array([[EMPTY if p is None else -np.log(max(1e-9, chance[s][p])) if p in chance[s] else MISS for p in slots] for s in seats])
        picked = {s: slots[c] for s, c, row in zip(seats, assign(cost), cost, strict=True) if row[c] < MISS}
        group = dict(zip(pdf.section, pdf.grp, strict=True))
        for g in sorted(set(group.values())):
            own, taken = [s for s in seats if group[s] == g], set()
            for s in sorted(own, key=lambda s: -chance[s].get(picked.get(s), 0)) if len(own) > 1 else []:
                name = picked.get(s) if picked.get(s) not in taken else None
                name = name or next((p for p in chance[s] if p not in taken), None)
                picked.pop(s, None)
                if name:
                    picked[s] = name
                    taken.add(name)
        return pd.DataFrame({"course_code": pdf.course_code.iloc[0], "section": seats, "prof_key": [picked.get(s) for s in seats], "prob": [chance[s].get(picked.get(s)) for s in seats]})

    at = ranked.filter(F.col("rank") <= NAMES).join(capacity, ["course_code", "prof_key"], "left").join(groups, ["course_code", "section"])
    at = at.select("course_code", "section", "prof_key", "prob", "rank", F.coalesce("capacity", F.lit(1)).alias("capacity"), "grp")
    return at.groupBy("course_code").applyInPandas(solve, "course_code string, section string, prof_key string, prob double")


def search_weights(rows: DataFrame, models: list[str]) -> DataFrame:
    """Weights by coordinate ascent on the share of truths ranked first, one search per course in parallel.

    rows: course_code, target, section, label, and one column for each model. A change is kept only if strictly better.
    """
    grid = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["target", "section", "cand_seq"])
        p = np.clip(pdf[models].to_numpy(float), 1e-6, 1 - 1e-6)
        x, label = np.log(p / (1 - p)), pdf.label.to_numpy()
        starts = np.flatnonzero((pdf[["target", "section"]] != pdf[["target", "section"]].shift()).any(axis=1).to_numpy())
        seat = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pdf)))

        def hits(w: np.ndarray) -> float:
            score = x @ w
            best = np.maximum.reduceat(score, starts)
            first = np.unique(seat[score == best[seat]], return_index=True)[1]
            return label[np.flatnonzero(score == best[seat])[first]].mean()

        w = np.full(len(models), 1 / len(models))
        reached = base = hits(w)
        for _ in range(3):
            before = reached
            for i in range(len(models)):
                for value in grid:
                    new = w.copy()
                    new[i] = value
                    if new.sum() > 0 and (got := hits(new)) > reached:
                        w, reached = new, got
            if reached == before:
                break
        return pd.DataFrame({"course_code": pdf.course_code.iloc[0], "model": models, "weight": w / w.sum(), "base": base, "top1": reached})

    return rows.groupBy("course_code").applyInPandas(search, "course_code string, model string, weight double, base double, top1 double")
