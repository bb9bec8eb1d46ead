"""Near-duplicates by Jaccard similarity of word shingles: MinHash bands for candidates, exact verification, components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64
from .components import components
from .simhash import STEP, shingle_hashes

#: Least hashes of a band, all of which must agree; and the share of pairs at the wanted similarity that may share no band.
ROWS, MISSED = 5, 0.0005


def band_count(similarity: float) -> int:
    """Bands needed at that similarity: the number of prints plays no part."""
    if not 0 < similarity <= 1:
        raise ValueError("similarity is over 0 and 1 at most")
    shared = similarity**ROWS
    return 1 if shared == 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-shared)))


def bands_of(grams: np.ndarray, sizes: np.ndarray, bands: int) -> np.ndarray:
    """For each run of hashes (none of size 0) a key for each band: a hash of ROWS least values under hashes of their own."""
    starts = np.cumsum(sizes) - sizes
    salts = mix64(np.arange(1, 2 * ROWS * bands + 1, dtype=np.uint64))
    out = np.empty((len(sizes), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(sizes), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            least = np.minimum.reduceat((grams ^ salts[2 * k]) * (salts[2 * k + 1] | np.uint64(1)), starts)
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = key
    return out


def _scan(words: int, bands: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            n = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate(sets)
            node = np.add.reduceat(mix64(flat), np.cumsum(n) - n) if len(flat) else np.zeros(len(n), np.uint64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(bands_of(flat, n, bands).view(np.int64).ravel()))
            grams = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array((flat >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            return pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), batch.column(1).slice(done, len(n)), pa.array(mix64(node).view(np.int64)), keys, grams], ["id", "mark", "node", "bands", "grams"])

        for batch in batches:
            done, sets, held = 0, [], 0
            for text in batch.column(2):
                own = np.unique(np.array(shingle_hashes(text.as_py(), words) or [0], np.uint64))
                sets.append(own)
                held += len(own)
                if held >= STEP:
                    yield flush()
                    done, sets, held = done + len(sets), [], 0
            if sets:
                yield flush()

    return scan


def _alike(similarity: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (v.values.to_numpy() for v in (x, y))
                both = len(a) + len(b) - len(np.union1d(a, b))
                near.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return alike


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, grams: 32 bits of each shingle's hash, sorted) have the similarity."""
    x, y = (sets.select(F.col("node").alias(n), F.col("grams").alias(f"of_{n}")) for n in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "of_a", "of_b").mapInArrow(_alike(similarity), "a bigint, b bigint")


def _starred(keyed: DataFrame, order: Column) -> DataFrame:
    """Every node of a bucket (key) with the bucket's largest by order, its leader."""
    leaders = keyed.groupBy("key").agg(F.max(F.struct(order.alias("order"), "node")).alias("l")).select("key", F.col("l.node").alias("b"))
    return keyed.select("key", F.col("node").alias("a")).join(leaders, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect the classes (node, bands, grams) of that similarity which share a band.

    First each bucket is compared with its leader, the class that meets the most others in all its buckets, and those that
    share two neighbouring bands with a leader of their own. Pairs in a bucket that these links connect already need no
    comparison; all others are compared. So no pair is lost, and a large bucket of copies of one text stays a row each.
    """
    following = F.concat(F.slice("bands", 2, F.size("bands")), F.slice("bands", 1, 1))
    keyed = classes.select("node", F.size("grams").alias("size"), F.explode(F.arrays_zip(F.col("bands").alias("key"), following.alias("next"))).alias("k"))
    keyed = keyed.select("node", "size", "k.key", "k.next")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = cut(keyed.join(sizes, "key"), "bands")
    meets = keyed.groupBy("node").agg(F.sum("n").alias("meets"))
    sets = cut(classes.join(meets.select("node"), "node", "left_semi").select("node", "grams"), "sets")
    star = _starred(keyed.join(meets, "node"), F.col("meets"))
    star = star.union(_starred(keyed.filter("n > 2").select(F.xxhash64("key", "next").alias("key"), "node"), F.lit(0)))
    star = cut(_verified(star.distinct(), sets, similarity), "star")
    rooted = keyed.join(components(star), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    split = rooted.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h"), F.count("*").alias("n")).filter("l <> h AND n > 2").select("key")
    rooted = cut(rooted.join(split, "key"), "split")
    x, y = rooted.alias("x"), rooted.alias("y")
    fits = F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size") - 1e-9
    rest = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & fits)
    rest = rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    return star.union(_verified(rest, sets, similarity))


def similar_groups(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """id, mark (xxhash64 of the text), node (a hash of the text's set of shingles), least: the smallest (id, mark) that its links reach.

    Texts of equal sets are one class. A null id is never the smallest unless there is no other.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    prints = cut(texts.mapInArrow(_scan(words, band_count(similarity)), f"id {kind}, mark bigint, node bigint, bands array<bigint>, grams array<int>"), "prints")
    classes = prints.select("node", "bands", "grams").dropDuplicates(["node"])
    links = similar_links(classes, similarity)
    rows = prints.select("id", "mark", "node").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = cut(rows, "rooted")
    least = rows.groupBy("root").agg(F.min(_order("id", "mark")).alias("least"))
    return rows.join(least, "root").select("id", "mark", "node", "least")


def _order(id_: str, mark: str) -> Column:
    return F.struct(F.col(id_).isNull().alias("none"), F.col(id_).alias("id"), F.col(mark).alias("mark"))
