"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, confirmed on full sets of shingles, and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, blocks, cut, drop, mix64, span_hashes, text_buffers, trim, word_spans
from .components import components

#: The signature: chunks of so many 16-bit values. A chunk counts as met with at most ERRORS values differing.
CHUNKS, WIDTH, ERRORS = 12, 4, 1
#: By pigeonhole, signatures that differ in at most this many of the values meet in a chunk.
DISTANCE = (ERRORS + 1) * CHUNKS - 1
#: A bucket whose unconnected pairs are over this many for each of its members is joined by rare shingles.
PAIRS = 16
#: Shingles and bytes of text of one vectorised step, and bytes kept of a shingle's hash when sets are compared.
STEP, PIECE, KEPT = 1 << 17, 1 << 19, 5


def _sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 64-bit shingle hashes of the batch's texts (its last column), ascending, end to end; and how many each has."""
    raw, off = text_buffers(batch.column(batch.num_columns - 1))
    data = LOWER[raw]
    start, end, owner = word_spans(data, off)
    hashes = span_hashes(data, start, end)
    n = np.bincount(owner, minlength=batch.num_rows)
    first = np.cumsum(n) - n
    size = np.where(n, np.maximum(1, n - words + 1), 0)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    last = np.repeat(first + n, size)
    grams = np.zeros(len(at), np.uint64)
    for k in range(words):  # a text shorter than a shingle is one, of the words it has
        here = at + k < last
        grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + np.where(here, hashes[np.minimum(at + k, len(hashes) - 1)], np.uint64(k + 1)) if len(hashes) else grams)
    text = np.repeat(np.arange(batch.num_rows), size)
    order = np.lexsort((grams, text))
    grams, text = grams[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    return grams[new], np.bincount(text[new], minlength=batch.num_rows)


def signatures(grams: np.ndarray, sizes: np.ndarray, values: int) -> np.ndarray:
    """For each run of hashes 16 bits of its least value under each of so many hash functions; runs of size 0 give zeros."""
    out, full = np.zeros((len(sizes), values), np.uint64), np.flatnonzero(sizes)
    if len(full):
        starts = (np.cumsum(sizes) - sizes)[full]
        salts = mix64(np.arange(1, 2 * values + 1, dtype=np.uint64))
        for k in range(values):
            out[full, k] = np.minimum.reduceat((grams ^ salts[2 * k]) * (salts[2 * k + 1] | np.uint64(1)), starts)
    return (mix64(out) >> np.uint64(48)).astype(np.uint16).view(np.int16)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from blocks([batch], batch.num_columns - 1, PIECE)
    trim()


def _prints(words: int, values: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            grams, n = _sets(batch, words)
            full, whole = np.flatnonzero(n), np.zeros(len(n), np.uint64)
            if len(full):
                whole[full] = np.add.reduceat(mix64(grams), (np.cumsum(n) - n)[full])
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * values), pa.array(signatures(grams, n, values).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mix64(whole).view(np.int64)), pa.array(n.astype(np.int64)), sig], ["id", "mark", "whole", "n", "sig"])

    return run


def _packed(words: int):
    """node, n and the sorted hashes of its text's shingles, KEPT bytes of each end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            grams, n = _sets(batch, words)
            bytes_ = (grams >> np.uint64(64 - 8 * KEPT)).view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()
            ends = np.concatenate([[0], np.cumsum(n)]) * KEPT
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array([bytes_[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["node", "n", "grams"])

    return run


def _unpacked(grams: bytes) -> np.ndarray:
    wide = np.zeros((len(grams) // KEPT, 8), np.uint8)
    wide[:, :KEPT] = np.frombuffer(grams, np.uint8).reshape(-1, KEPT)
    return wide.view(np.uint64).ravel()


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                both = len(np.intersect1d(_unpacked(x), _unpacked(y)))
                near.append(100 * both >= percent * (n + m - both))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return run


def _differing(x: str, y: str) -> Column:
    return F.size(F.filter(F.zip_with(x, y, lambda a, b: a != b), lambda d: d))


def confirmed(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, distance: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures are within the distance and whose sets overlap by percent of their union."""
    with_sig = lambda df, n: df.join(sigs.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}")), n)
    close = with_sig(with_sig(pairs, "a"), "b").filter(_differing("sig_a", "sig_b") <= distance).select("a", "b")
    x, y = (sets.select(F.col("node").alias(n), F.col("n").alias(f"n_{n}"), F.col("grams").alias(f"grams_{n}")) for n in "ab")
    return close.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "grams_a", "grams_b").mapInArrow(_confirmed(percent), "a bigint, b bigint")


def chunk_keys(sig: str = "sig") -> Column:
    """Every key of a signature: of each chunk, all choices of values to leave out as errors; the chunk and the choice are part of the key."""
    left = list(combinations(range(WIDTH), WIDTH - ERRORS))
    return F.array(*(F.xxhash64(F.lit(c * len(left) + i), *(F.col(sig)[c * WIDTH + k] for k in kept)) for c in range(CHUNKS) for i, kept in enumerate(left)))


def _stars(keyed: DataFrame, order: Column) -> DataFrame:
    """Every node of a bucket with the bucket's leader, its largest by order."""
    leaders = keyed.groupBy("key").agg(F.max(F.struct(order.alias("order"), "node")).alias("l")).select("key", F.col("l.node").alias("b"))
    return keyed.select("key", F.col("node").alias("a")).join(leaders, "key").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unconnected(rooted: DataFrame) -> DataFrame:
    """key, n (nodes), pairs, main of each bucket (key, node, root, size) that holds several roots; pairs are those of different roots, main the commonest root."""
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("k"))
    one = parts.groupBy("key").agg(F.count("*").alias("roots"), F.sum("k").alias("n"), F.sum(F.col("k").cast("double") * F.col("k")).alias("squares"), F.max(F.struct("k", "root")).alias("m"))
    return one.filter("roots > 1").select("key", "n", ((F.col("n").cast("double") * F.col("n") - F.col("squares")) / 2).alias("pairs"), F.col("m.root").alias("main"))


def _met(rooted: DataFrame, percent: int) -> DataFrame:
    """All pairs of a bucket (key, node, root, size, place, main) with different roots that may be similar. Nodes of the main root aren't joined with each other.

    place: the key's in the order of the node's set, from 1. Two sets that overlap by enough have, at the first key they share, as many
    left on either side as the overlap needs.
    """
    x, y, z = rooted.filter("root <> main").alias("x"), rooted.filter("root = main").alias("y"), rooted.filter("root <> main").alias("y")
    left = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1
    fits = (F.least("x.size", "y.size") * 100 >= F.greatest("x.size", "y.size") * percent) & (left * (100 + percent) >= (F.col("x.size") + F.col("y.size")) * percent)
    key = F.col("x.key") == F.col("y.key")
    both = x.join(y, key & fits).union(x.join(z, key & fits & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            grams = _unpacked(batch.column(3)[row].as_py()).view(np.int64)
            for k in range(0, len(grams), STEP):
                part = grams[k : k + STEP]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(part), batch.column(c)[row].as_py())) for c in range(3)), pa.array(part)], ["node", "root", "size", "key"])


def _rare_pairs(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of the nodes (node, root, size) that may overlap by percent and have different roots, by their rarest shingles.

    In any one order, two such sets share one of the first n - percent of n + 1 shingles of each. The order puts those first that
    meet one root only, and then the rare ones; so texts that share a long passage and nothing else don't meet.
    """
    listed = cut(hot.join(sets.select("node", "grams"), "node").select("node", "root", "size", "grams").mapInArrow(_listed, "node bigint, root bigint, size bigint, key bigint"), "listed")
    at = listed.join(_unconnected(listed).select("key", "n", "main"), "key")
    own, ranked = Window.partitionBy("node"), Window.partitionBy("node").orderBy("n", "key")
    place = F.row_number().over(ranked) + F.col("size") - F.count("*").over(own)
    return _met(at.withColumn("place", place).filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1), percent)


def near_links(classes: DataFrame, texts_of, percent: int, most: int = PAIRS) -> DataFrame:
    """Links (a, b) that connect all classes (node, size, sig) whose signatures are within DISTANCE and whose sets overlap by percent.

    Classes meet under the keys of their chunks. First each is compared with its buckets' leaders, the class that meets the most; of
    the rest, only pairs that these links leave unconnected are compared. The nodes of buckets with too many of them, such as of a
    passage in many texts, are paired by rare shingles instead, which loses none. texts_of: gives (node, n, grams) of some nodes.
    """
    spark = classes.sparkSession
    keyed = classes.select("node", "size", F.explode(chunk_keys()).alias("key"))
    keyed = cut(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key"), "keyed")
    meets = cut(keyed.groupBy("node").agg(F.sum("n").alias("meets")), "meets")
    sigs = cut(classes.join(meets, "node", "left_semi").select("node", "sig"), "sigs")
    sets = cut(texts_of(meets.select("node")), "sets")
    star = cut(confirmed(_stars(keyed.join(meets, "node"), F.col("meets")), sigs, sets, percent, DISTANCE), "star")
    rooted = keyed.join(components(star), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    rooted = cut(rooted, "rooted")
    open_ = cut(_unconnected(rooted), "open")
    large = F.col("pairs") > most * F.col("n")
    rest = _met(rooted.join(open_.filter(~large).select("key", "main", F.lit(1).alias("place")), "key"), percent)
    hot = rooted.join(open_.filter(large).select("key"), "key", "left_semi").select("node", "root", "size").distinct()
    rest = rest.union(_rare_pairs(hot, sets, percent)).distinct()
    links = cut(star.union(confirmed(rest, sigs, sets, percent, DISTANCE)), "links")
    drop(spark, keyed, meets, sigs, sets, star, rooted, open_)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """For every row of docs: id_col, n_shingles (distinct), component_id (the smallest id that its links reach), kept (it is that id).

    Texts are linked where the sets of their shingles of so many words (A-Z in lower case; fewer words are one shingle) overlap by
    percent of their union or more. Candidates are all pairs whose signatures of 48 values of 16 bits differ in at most 23;
    at a similarity of just 0.8 all but 4 pairs in a million do, whatever the number of texts. Candidates are then
    compared by their full sets, whose sizes count 64-bit hashes and whose overlap counts 40 bits of these.

    Texts of equal sets are one class, so copies are never paired. Null and empty texts, and those without a word, have no
    shingles and link with nothing, not even each other. A null id is never the smallest unless there is no other, and a repeated row is
    linked to itself. A long text is a block of its own, some 60 times its bytes for a moment. An empty table gives an empty
    result; other columns are neither read nor returned.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("mark"), F.col(text_col).cast("string").alias("text"))
    prints = cut(texts.mapInArrow(_prints(words, CHUNKS * WIDTH), f"id {kind}, mark bigint, whole bigint, n bigint, sig array<smallint>"), "prints")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    classes = prints.filter("n > 0").groupBy("whole", "n").agg(F.min(F.struct(own.alias("own"), "sig")).alias("r"))
    classes = cut(classes.select("whole", F.col("n").alias("size"), "r.own", "r.sig").withColumn("node", F.monotonically_increasing_id()), "classes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        """Of each class the text of one document."""
        at = classes.join(nodes, "node").select("node", F.xxhash64("own.id", "own.mark").alias("pick"))
        first = texts.select("text", F.xxhash64("id", "mark").alias("pick")).join(at, "pick").dropDuplicates(["pick", "node"])
        return first.select("node", "text").mapInArrow(_packed(words), "node bigint, n bigint, grams binary")

    links = near_links(classes.select("node", "size", "sig"), texts_of, percent)
    rooted = cut(classes.join(components(links), "node", "left").select("whole", "size", "own", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("many"))
    groups = cut(rooted.join(least.filter("many > 1").drop("many"), "root", "left").select("whole", F.col("size").alias("n"), F.coalesce("least", "own").alias("least")), "groups")
    drop(spark, links, rooted, classes)
    first = F.when(F.col("n") > 0, F.col("least.id")).otherwise(F.col("id"))
    out = prints.select("id", "whole", "n").join(groups, ["whole", "n"], "left").withColumn("first", first)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"), F.col("id").eqNullSafe(F.col("first")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
listed AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM listed),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT doc_id, l.b FROM reach JOIN links l ON l.a = other)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id, m IS NULL OR doc_id < m AS kept
FROM listed LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach WHERE other <> doc_id GROUP BY doc_id) USING (doc_id)
"""
