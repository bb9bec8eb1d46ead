"""Mixing sources to target weights by entropy balancing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Words are runs of anything but these; weights go round over the sources by code point.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
LIMIT = 2.0

#: The most Newton steps.
STEPS = 60
#: A source's dual is solved when its words are this near the target, relative to it.
NEAR = 1e-7
#: The rounding threshold is looked for in parts of this width, and the last part holds all beyond.
PART, LAST_PART = 1 / 1024, 4095
#: Passes that close the gap left by the document on the threshold.
REPAIRS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """Adds weight and target to sources (source, source_size).

    Water filling: with level v a source gets min(limit * size, weight * v). Sources sorted by limit * size / weight are
    full one after another; the level follows from the sums over the full ones, so one window pass over the sources
    settles what repeated resharing would. Empty sources get 0.
    """
    numbered = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    listed = F.array(*(F.lit(float(w)) for w in weights))
    s = numbered.withColumn("weight", F.element_at(listed, F.pmod("place", F.lit(len(weights))) + 1)).withColumn("most", limit * F.col("source_size"))
    s = s.withColumn("full_at", F.col("most") / F.col("weight"))
    by_level = Window.orderBy("full_at", "place")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", share * F.sum("source_size").over(whole)).withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if all sources before this one are full and this one and the later ones aren't.
    s = s.withColumn("here", (F.col("total") - F.col("used")) / F.col("open"))
    s = s.withColumn("level", F.min(F.when(F.col("here") <= F.col("full_at"), F.struct("full_at", "place", "here"))).over(whole)["here"])
    filled = F.least(F.col("most"), F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return s.select("source", "source_size", "weight", filled.alias("target"))


def tilt(dual: Column, size: Column, mean: Column) -> Column:
    return F.exp(F.least(F.lit(30.0), F.greatest(F.lit(-200.0), dual * size / mean)))


def balance(cells: DataFrame, sources: DataFrame, limit: float) -> DataFrame:
    """Solves the dual of each source (column dual); sources at their limit, or with nothing to take, are left out.

    Primal: the rates r, between 0 and limit, nearest to one copy of each document in relative entropy (the sum of
    r ln r - r) whose words sum to the source's target. Dual: a convex function of one multiplier per source, of
    gradient sum(size * min(limit, exp(dual * size / mean))) - target. cells counts the documents by source and size,
    which is all that gradient and curvature need. Each step sums both over the cells of all sources at once, by partial
    sums, and goes to Newton's point, at most max(1, |dual|) away, or to the middle of the known bracket if that is left.
    """
    unknown = F.lit(None).cast("double")
    state = sources.filter((F.col("target") > 0) & (F.col("target") < limit * F.col("source_size") * (1 - 1e-12)))
    state = cut(state.select("source", "target", "mean", F.log(F.col("target") / F.col("source_size")).alias("dual"), unknown.alias("low"), unknown.alias("high"), unknown.alias("off")), "dual")
    for _ in range(STEPS):
        at = cells.join(state, cells.source.eqNullSafe(state.source)).drop(cells.source)
        grown = tilt(F.col("dual"), F.col("size"), F.col("mean"))
        flow = F.col("docs") * F.col("size") * F.least(F.lit(limit), grown)
        bend = F.when(grown < limit, F.col("docs") * F.col("size") * F.col("size") / F.col("mean") * grown).otherwise(0.0)
        sums = at.groupBy("source", "target", "mean", "dual", "low", "high").agg(F.sum(flow).alias("flow"), F.sum(bend).alias("bend"))
        dual, over = F.col("dual"), F.col("flow") - F.col("target")
        low, high = F.when(over <= 0, dual).otherwise(F.col("low")), F.when(over >= 0, dual).otherwise(F.col("high"))
        reach = F.greatest(F.lit(1.0), F.abs(dual))
        move = F.coalesce(-over / F.when(F.col("bend") > 0, F.col("bend")), -F.signum(over) * reach)
        step = dual + F.greatest(-reach, F.least(reach, move))
        outside = F.coalesce(step <= low, F.lit(False)) | F.coalesce(step >= high, F.lit(False))
        step = F.when(outside, F.coalesce((low + high) / 2, step)).otherwise(step)
        off = F.abs(over) / F.col("target")
        state = cut(sums.select("source", "target", "mean", F.when(off <= NEAR, dual).otherwise(step).alias("dual"), low.alias("low"), high.alias("high"), off.alias("off")), "dual")
        if (state.agg(F.max("off")).first()[0] or 0) <= NEAR:
            break
    return state.select("source", F.round("dual", 6).alias("dual"))


def _rates(rows: DataFrame, plan: DataFrame, limit: float) -> DataFrame:
    """rows (id, source, size) with the plan's columns, rate, whole copies, and draw: the order in which parts of copies are rounded up."""
    at = rows.join(plan.withColumnRenamed("source", "plan_source"), F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    tilted = F.least(F.lit(limit), tilt(F.col("dual"), F.col("size"), F.col("mean")))
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("dual").isNull(), F.lit(limit)).otherwise(tilted)
    at = at.withColumn("rate", F.when(F.col("size") == 0, F.least(F.lit(1.0), F.lit(limit))).otherwise(rate))
    at = at.withColumn("whole", F.floor("rate"))
    part = F.col("rate") - F.col("whole")
    even = (F.pmod(F.xxhash64(F.col("id"), F.col("size")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return at.withColumn("draw", F.when((part > 0) & (F.col("size") > 0) & (F.col("whole") + 1 <= limit), even / part))


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: target, dual, and where rounding stops. rows: id, source, size.

    Rounding: copies are floor(rate), and one more for the documents first in the order of draw = u / fraction (u: a
    hash of the id, so even and the same in every run; the more of a copy is due, the earlier), as far as the source's
    words allow. The place where that ends is found in two steps, so no source is sorted whole: words summed by source and
    part of the order, then the one part that holds the end. What is then missing is less than one document; REPAIRS times
    the largest document that still fits is added.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("mean"))
    sizes = cut(sizes, "sizes")
    goal = cut(targets(sizes.select("source", "source_size"), weights, share, limit).withColumnRenamed("source", "s").join(sizes.select("source", "mean"), F.col("s").eqNullSafe(F.col("source"))).drop("s"), "targets")
    cells = cut(rows.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")), "cells")
    duals = balance(cells, goal, limit)
    plan = goal.join(duals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = cut(plan, "plan")
    rated = _rates(rows, plan, limit).select("id", "source", "size", "target", "whole", "draw", F.least(F.lit(LAST_PART), F.floor(F.col("draw") / PART)).alias("part"))
    due = F.greatest(F.lit(0.0), F.max("target") - F.sum(F.col("whole") * F.col("size")))
    budget = rated.groupBy("source").agg(due.alias("due"))
    parts = rated.filter("draw IS NOT NULL").groupBy("source", "part").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("part")
    parts = parts.join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("upto", F.sum("words").over(upto))
    # The part in which the budget ends; without one, all parts are taken.
    ends = cut(parts.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("due"), F.struct("part", (F.col("due") - F.col("upto") + F.col("words")).alias("left")))).alias("end"), (F.max("due") - F.max("upto")).alias("over")), "ends")
    last = rated.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("end.part"))).drop("s")
    taken = last.withColumn("upto", F.sum("size").over(Window.partitionBy("source").orderBy("draw", "id"))).filter(F.col("upto") <= F.col("end.left"))
    stop = taken.groupBy("source").agg(F.max(F.struct("draw", "id")).alias("stop"), F.max("upto").alias("got")).withColumnRenamed("source", "s")
    none = F.struct(F.lit(-1.0).alias("draw"), F.lit(None).cast(rows.schema["id"].dataType).alias("id"))
    stops = ends.join(stop, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("s"), F.col("end.part").alias("end_part"), F.coalesce("stop", none).alias("stop"), F.coalesce(F.col("end.left") - F.coalesce("got", F.lit(0)), F.col("over")).alias("gap"),
        F.array().cast(f"array<{rows.schema['id'].dataType.simpleString()}>").alias("more"))
    stops = cut(stops, "stops")
    for _ in range(REPAIRS):
        at = rated.join(stops, F.col("source").eqNullSafe(F.col("s")))
        fits = at.filter(~_extra() & F.col("draw").isNotNull() & (F.col("size") <= F.col("gap"))).groupBy("source").agg(F.max(F.struct("size", "id")).alias("best"))
        stops = stops.join(fits, F.col("source").eqNullSafe(F.col("s")), "left")
        stops = cut(stops.select("s", "end_part", "stop", (F.col("gap") - F.coalesce("best.size", F.lit(0))).alias("gap"), F.when(F.col("best").isNull(), F.col("more")).otherwise(F.concat("more", F.array("best.id"))).alias("more")), "stops")
    return cut(plan.join(stops, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "gap"), "plan")


def _extra() -> Column:
    """Whether a document gets one copy beyond the whole ones, from the columns of _rates and the plan."""
    part = F.least(F.lit(LAST_PART), F.floor(F.col("draw") / PART))
    order = F.struct("draw", "id")
    first = F.when(F.col("end_part").isNull(), F.lit(True)).when(part < F.col("end_part"), F.lit(True)).when(part > F.col("end_part"), F.lit(False)).otherwise(order <= F.col("stop"))
    return F.col("draw").isNotNull() & (first | F.coalesce(F.array_contains("more", F.col("id")), F.lit(False)))


def mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """Decides every document by the plan, where it lies: id, source, size, source_size, target, rate, copies, taken."""
    return _decide(sized(docs, id_col, source_col, text_col), plan, limit)


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """id, source and size (in words; null text: 0) of every row."""
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))


def _decide(rows: DataFrame, plan: DataFrame, limit: float) -> DataFrame:
    at = _rates(rows, plan, limit)
    copies = (F.col("whole") + _extra().cast("int")).cast("int")
    return at.withColumn("copies", copies).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """How often each document goes into the mix: doc id, size, source_size, target, taken, source, rate, copies.

    Sources by code point, null last, have weights in turn and share `share` times all words; no source's target is over
    limit times its words, the excess going to the others by weight. Rates come from entropy balancing (see balance) and
    are rounded to copies (see plan_mix). Null text has size 0, gets one copy and takes nothing; an empty table gives an
    empty result. Rows repeated with the same id and size are decided alike. A source of one large document can be off
    its target by up to half of it or more, since copies are whole. Only id, source and text are read.
    """
    rows = cut(sized(docs, id_col, source_col, text_col), "sized")
    out = _decide(rows, plan_mix(rows, weights, share, limit), limit)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken", "source", "rate", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """The rows of docs as the mix takes them: each repeated as often as it has copies, none for a rate rounded to 0."""
    plan = plan_mix(cut(sized(docs, id_col, source_col, text_col), "sized"), weights, share, limit)
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    out = _decide(held, plan, limit).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
