"""Numbers and vectors: squashing, impurity, cosine and the closed-form trainers on labelled vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANCE_FLOOR = 1e-4


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def logit(p: Column) -> Column:
    held = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(held / (1 - held))


def gini(positive: Column, negative: Column) -> Column:
    """Impurity of two weights."""
    total = positive + negative
    return F.when(total > 0, 1 - F.pow(positive / total, 2) - F.pow(negative / total, 2)).otherwise(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine01(a: Column, b: Column) -> Column:
    """Cosine moved to 0..1; 0.5 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, (dot(a, b) / F.when(norm > 0, norm) + 1) / 2).otherwise(0.5)


def label_means(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label: place by place with partial sums, never a list of rows."""
    long = rows.select(label, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(label, "i").agg(F.avg("x").alias("m"))
    return mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def standardizer(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population deviation of each column (0 counts as 1), one row."""
    sd = lambda c: F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0))
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), *(sd(c).alias(f"sd_{c}") for c in columns))


def naive_bayes(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Adds p: probability of label 1 by Gaussians with a variance floor, fitted on the same rows."""
    moments = [f(c).alias(f"{k}_{c}") for c in columns for k, f in (("m", F.avg), ("v", F.var_pop))]
    fit = rows.groupBy(label).agg(F.count("*").alias("n"), *moments)
    one, zero = (fit.filter(F.col(label) == v).select(*(F.col(c).alias(f"{c}_{v}") for c in fit.columns if c != label)) for v in (1, 0))
    at = rows.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(zero))  # one row each

    def density(v: int) -> Column:
        total = F.log(F.col(f"n_{v}") / (F.col("n_0") + F.col("n_1")))
        for c in columns:
            var = F.greatest(F.col(f"v_{c}_{v}"), F.lit(VARIANCE_FLOOR))
            total = total - 0.5 * F.log(2 * F.pi() * var) - F.pow(F.col(c) - F.col(f"m_{c}_{v}"), 2) / (2 * var)
        return total

    return at.withColumn("p", 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), density(0) - density(1))))))


def mean_gap(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Adds p: sigmoid of the dot product with the difference of the labels' means."""
    gap = rows.agg(*((F.avg(F.when(F.col(label) == 1, F.col(c))) - F.avg(F.when(F.col(label) == 0, F.col(c)))).alias(f"g_{c}") for c in columns))
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(f"g_{c}") * F.col(c)
    return rows.crossJoin(F.broadcast(gap)).withColumn("p", sigmoid(total))  # one row
