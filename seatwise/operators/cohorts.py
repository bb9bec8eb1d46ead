"""Who held what beside whom in one term, and what guesses about other seats then say about a candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sections import section_family
from .history import KEY
from .lineage import cut

#: Guesses below this share are ignored.
LEAST_GUESS = 0.05


def _rows(ev: DataFrame) -> DataFrame:
    return ev.select(*KEY, "term", "section", "family", "prof_key", "w")


def activity(ev: DataFrame) -> DataFrame:
    """Decayed number of terms in which each holder was active."""
    return _rows(ev).select(*KEY, "term", "prof_key", "w").distinct().groupBy(*KEY, "prof_key").agg(F.sum("w").alias("active"))


def pairs(ev: DataFrame) -> DataFrame:
    """Decayed number of terms that two holders shared, a < b."""
    one = _rows(ev).select(*KEY, "term", "prof_key", "w").distinct()
    a, b = one.withColumnRenamed("prof_key", "a"), one.select(*KEY, "term", F.col("prof_key").alias("b"))
    return a.join(b, [*KEY, "term"]).filter("a < b").groupBy(*KEY, "a", "b").agg(F.sum("w").alias("together"))


def seat_given_seat(ev: DataFrame) -> DataFrame:
    """p: given that a holder has a seat, the share of (decayed) times that another holder had another seat in that term."""
    r = _rows(ev)
    other, own = r.select(*KEY, "term", F.col("section").alias("g_section"), F.col("prof_key").alias("g_prof"), "w"), r.select(*KEY, "term", "section", "prof_key")
    hits = other.join(own, [*KEY, "term"]).filter("section <> g_section").groupBy(*KEY, "g_section", "g_prof", "section", "prof_key").agg(F.sum("w").alias("hit"))
    base = other.groupBy(*KEY, "g_section", "g_prof").agg(F.sum("w").alias("base"))
    return hits.join(base, [*KEY, "g_section", "g_prof"]).select(*KEY, "g_section", "g_prof", "section", "prof_key", (F.col("hit") / F.col("base")).alias("p_seat"))


def family_given_family(ev: DataFrame) -> DataFrame:
    """The same by family, each holder and family once a term."""
    r = _rows(ev).select(*KEY, "term", "family", "prof_key", "w").distinct()
    other, own = r.select(*KEY, "term", F.col("family").alias("g_family"), F.col("prof_key").alias("g_prof"), "w"), r.select(*KEY, "term", "family", "prof_key")
    hits = other.join(own, [*KEY, "term"]).filter("NOT (family = g_family AND prof_key = g_prof)").groupBy(*KEY, "g_family", "g_prof", "family", "prof_key").agg(F.sum("w").alias("hit"))
    base = other.groupBy(*KEY, "g_family", "g_prof").agg(F.sum("w").alias("base"))
    return hits.join(base, [*KEY, "g_family", "g_prof"]).select(*KEY, "g_family", "g_prof", "family", "prof_key", (F.col("hit") / F.col("base")).alias("p_family"))


def bundles(ev: DataFrame) -> DataFrame:
    """Given that a holder has a family's seat, the share of times that they had another seat, by its family."""
    r = _rows(ev)
    own = r.select(*KEY, "term", "prof_key", F.col("section").alias("g_section"), F.col("family").alias("g_family"), "w")
    hits = own.join(r.select(*KEY, "term", "prof_key", "section", "family"), [*KEY, "term", "prof_key"]).filter("section <> g_section").groupBy(*KEY, "prof_key", "g_family", "family").agg(F.sum("w").alias("hit"))
    base = own.groupBy(*KEY, "prof_key", "g_family").agg(F.sum("w").alias("base"))
    return hits.join(base, [*KEY, "prof_key", "g_family"]).select(*KEY, "prof_key", "g_family", "family", (F.col("hit") / F.col("base")).alias("p_bundle"))


def partner_features(scored: DataFrame, guesses: DataFrame, ev: DataFrame) -> DataFrame:
    """Fills partner_cond, partner_pair and bundle_fit of every seat and candidate from the guesses about other seats.

    Candidates and guesses are never paired: guesses are joined to what was seen together, so only what isn't zero is a row. A seat's
    sums are those over all guesses less those about the seat itself; whether any guess is left is told by whole numbers.
    """
    ev = cut(_rows(ev))  # several sums read both: worked out once
    g = cut(guesses.filter(F.col("probability") >= LEAST_GUESS).select(*KEY, F.col("section").alias("g_section"), F.col("family").alias("g_family"), F.col("prof_key").alias("g_prof"), F.col("probability").alias("p")))
    ours = ["p_same", "n_same", "seat", "seat_family", "own_family", "own_pair", "own_bundle"]

    def rows(df: DataFrame, section: str, **given) -> DataFrame:
        return df.select(*KEY, "prof_key", F.col(section).alias("section"), *(given.get(c, F.lit(0.0)).cast("double").alias(c) for c in ours))

    families = family_given_family(ev)
    by_seat = g.join(seat_given_seat(ev), [*KEY, "g_section", "g_prof"]).withColumn("family", section_family(F.col("section"))).join(families, [*KEY, "g_family", "g_prof", "family", "prof_key"], "left")
    by_family = g.join(families, [*KEY, "g_family", "g_prof"]).withColumn("v", F.col("p") * F.col("p_family"))
    busy = activity(ev)
    known = pairs(ev).join(busy.select(*KEY, F.col("prof_key").alias("a"), F.col("active").alias("x")), [*KEY, "a"]).join(busy.select(*KEY, F.col("prof_key").alias("b"), F.col("active").alias("y")), [*KEY, "b"])
    known = known.select(*KEY, F.explode(F.array(F.struct(F.col("a").alias("prof_key"), F.col("b").alias("g_prof")), F.struct(F.col("b").alias("prof_key"), F.col("a").alias("g_prof")))).alias("d"), F.least(F.lit(1.0), F.col("together") / F.least("x", "y")).alias("v"))
    by_pair = g.join(known.select(*KEY, "d.prof_key", "d.g_prof", "v"), [*KEY, "g_prof"]).withColumn("v", F.col("p") * F.col("v"))
    by_bundle = g.withColumn("prof_key", F.col("g_prof")).join(bundles(ev), [*KEY, "prof_key", "g_family"]).withColumn("v", F.col("p") * F.col("p_bundle"))
    kin = F.col("g_family") == F.col("family")
    own = rows(g.withColumn("prof_key", F.col("g_prof")), "g_section", p_same=F.col("p"), n_same=F.lit(1)).unionByName(rows(by_seat, "section", seat=F.col("p") * F.col("p_seat"), seat_family=F.col("p") * F.coalesce("p_family", F.lit(0.0))))
    own = own.unionByName(rows(by_family.filter(kin), "g_section", own_family=F.col("v"))).unionByName(rows(by_pair, "g_section", own_pair=F.col("v"))).unionByName(rows(by_bundle.filter(kin), "g_section", own_bundle=F.col("v")))
    own = own.groupBy(*KEY, "prof_key", "section").agg(*(F.sum(c).alias(c) for c in ours))
    holder = g.groupBy(*KEY, F.col("g_prof").alias("prof_key")).agg(F.sum("p").alias("all_same"), F.count("*").alias("all_n_same"))
    holder = holder.join(by_pair.groupBy(*KEY, "prof_key").agg(F.sum("v").alias("all_pair")), [*KEY, "prof_key"], "full")
    family = by_family.groupBy(*KEY, "prof_key", "family").agg(F.sum("v").alias("all_family")).join(by_bundle.groupBy(*KEY, "prof_key", "family").agg(F.sum("v").alias("all_bundle")), [*KEY, "prof_key", "family"], "full")
    here, every = g.groupBy(*KEY, F.col("g_section").alias("section")).agg(F.sum("p").alias("p_here"), F.count("*").alias("n_here")), g.groupBy(*KEY).agg(F.sum("p").alias("p_all"), F.count("*").alias("n_all"))
    sums = [*ours, "all_same", "all_n_same", "all_pair", "all_family", "all_bundle", "p_here", "n_here", "p_all", "n_all"]
    at = scored.drop("partner_cond", "partner_pair", "bundle_fit").join(own, [*KEY, "prof_key", "section"], "left").join(holder, [*KEY, "prof_key"], "left").join(family, [*KEY, "prof_key", "family"], "left")
    at = at.join(here, [*KEY, "section"], "left").join(every, KEY, "left").fillna(0, sums)
    c = F.col
    n, n_same = c("n_all") - c("n_here"), c("all_n_same") - c("n_same")
    p, p_same = c("p_all") - c("p_here"), c("all_same") - c("p_same")
    share = lambda part, whole, any_: F.when(any_ > 0.5, F.greatest(F.lit(0.0), part / whole)).otherwise(0.0)
    at = at.withColumn("partner_cond", share(c("seat") + c("all_family") - c("own_family") - c("seat_family"), p, n)).withColumn("partner_pair", share(c("all_pair") - c("own_pair"), p - p_same, n - n_same)).withColumn("bundle_fit", share(c("all_bundle") - c("own_bundle"), p_same, n_same))
    return at.drop(*sums)
