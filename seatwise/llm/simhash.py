"""SimHash near-duplicates: fingerprints, a join on blocks of bits, verified Hamming distances, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mix64
from .components import components

SEED = 42
#: Shingles of one vectorised step.
STEP = 1 << 17
#: Fingerprints in one block's bucket up to which its pairs are compared one by one.
BUCKET = 256
_LANE = 0x9E3779B97F4A7C15
_ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 of each run of so many words, ASCII letters lower-cased; of the whole sequence if it is shorter; of nothing if empty."""
    w = (text or "").encode().lower().split()
    if not w:
        return []
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bits that are set in over half of each run of hashes; runs of size 0 give 0.

    Eight bits are counted at a time, each in a byte of its own, over at most 255 hashes; these counts are then added up.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    ends = np.cumsum(n)
    parts = (n + 254) // 255
    owner = np.repeat(np.arange(len(full)), parts)
    first = np.cumsum(parts) - parts
    starts = (ends - n)[owner] + (np.arange(len(owner)) - first[owner]) * 255
    for bit in range(8):
        counted = np.add.reduceat((hashes >> np.uint64(bit)) & _ONES, starts).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(counted.astype(np.int64), first, axis=0)
        over = (total * 2 > n[:, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + bit)
    return out


def _fingerprints(words: int, lanes: int):
    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            flat, n = np.array(hashes, np.uint64), np.array(sizes, np.int64)
            prints = [majority(flat if lane == 0 else mix64(flat + np.uint64(_LANE * lane % (1 << 64))), n).view(np.int64) for lane in range(lanes)]
            offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * lanes)
            rows = pa.ListArray.from_arrays(offsets, pa.array(np.stack(prints, 1).ravel()))
            return pa.RecordBatch.from_arrays([ids.slice(done, len(n)), marks.slice(done, len(n)), rows], ["id", "mark", "print"])

        for batch in batches:
            ids, marks, done, hashes, sizes = batch.column(0), batch.column(1), 0, [], []
            for text in batch.column(2):
                own = shingle_hashes(text.as_py(), words)
                hashes.extend(own)
                sizes.append(len(own))
                if len(hashes) >= STEP:
                    yield flush()
                    done, hashes, sizes = done + len(sizes), [], []
            if sizes:
                yield flush()

    return fingerprints


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int, lanes: int = 1) -> DataFrame:
    """id, mark (xxhash64 of the text), print (lanes longs of 64 bits): lane 0 from the XXH64 of the shingles, the others from remixed hashes."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_fingerprints(words, lanes), f"id {kind}, mark bigint, print array<bigint>")


def _bits(print_: Column, start: int, width: int) -> Column:
    """width bits from bit start on, which may cross lanes."""
    lane, shift = divmod(start, 64)
    here = F.shiftrightunsigned(print_[lane], shift)
    if shift + width > 64:
        here = here.bitwiseOR(F.shiftleft(print_[lane + 1], 64 - shift))
    return here.bitwiseAND(F.lit((1 << width) - 1))


def _distance(a: Column, b: Column, lanes: int) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(lanes)))


def _keyed(classes: DataFrame, keys: list[Column]) -> DataFrame:
    """One row for each class and key; the key's number is in the upper bits, so that different blocks never meet."""
    listed = F.array(*(k.bitwiseOR(F.lit(i << 48)) for i, k in enumerate(keys)))
    return classes.select("node", "print", F.explode(listed).alias("key"))


def close_links(classes: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) that connect all 64-bit prints (node, print) at the given distance, 2 at most.

    Pigeonhole: of four blocks of 16 bits two differing bits leave two untouched, so a close pair shares one of the six
    pairs of blocks. Buckets of up to BUCKET prints are joined with themselves and verified. The prints of larger buckets
    are linked without comparing pairs: each is put under its own value and the 64 values one bit away, and those that meet
    under a value are at most two bits apart; prints two bits apart always meet. All are linked to the smallest there.
    """
    if not 0 <= distance <= 2:
        raise ValueError("use wide_links for larger distances")
    b = [_bits(F.col("print"), 16 * i, 16) for i in range(4)]
    keyed = cut(_keyed(classes, [F.shiftleft(b[i], 16).bitwiseOR(b[j]) for i in range(4) for j in range(i + 1, 4)]), "blocks")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    small = keyed.join(sizes.filter(F.col("n") <= BUCKET).select("key"), "key")
    small = cut(small, "small")
    x, y = small.alias("x"), small.alias("y")
    near = _distance(F.col("x.print"), F.col("y.print"), 1) <= distance
    links = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    large = sizes.filter(F.col("n") > BUCKET).select("key")
    hot = keyed.join(large, "key", "left_semi").select("node", F.col("print")[0].alias("value")).distinct()
    flips = [F.col("value"), *(F.col("value").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64))] if distance == 2 else [F.col("value")]
    if distance == 1:  # prints one bit apart are each other's flips: meet under the smaller
        flips = [F.least("value", f) for f in (F.col("value").bitwiseXOR(F.lit((1 << i) - (1 << 64 if i == 63 else 0))) for i in range(64))]
    met = hot.select("node", F.explode(F.array(*flips)).alias("value"))
    least = met.groupBy("value").agg(F.min("node").alias("least"), F.count("*").alias("n")).filter("n > 1").select("value", "least")
    return links.union(met.join(least, "value").filter("node <> least").select("node", "least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """One row per row of docs: id_col, fingerprint, component_id (the smallest id that its links reach).

    By distance (2 at most): 64-bit prints, all pairs that close linked. By similarity, such as 0.8: texts linked where the
    Jaccard similarity of their sets of shingles is that or more; candidates share a MinHash band, which of pairs at just
    that similarity all but 1 in 2000 do, whatever the number of texts. fingerprint is then a hash of the set.

    Equal prints are one class, so exact copies are never paired. Null and empty texts, and those without a word, have
    print zero (by similarity: are one class), linked like any other. A null id is never the smallest unless there is no
    other. Repeated rows each get their row. An empty table gives an empty result; other columns are not read.
    """
    found = _grouped(docs, id_col, text_col, words, distance, similarity)
    return found.select(F.col("id").alias(id_col), "fingerprint", F.col("least.id").alias("component_id"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int = 3, distance: int = 2, similarity: float | None = None) -> DataFrame:
    """id, mark, fingerprint, least: the smallest (id, mark) of the row's group, as a struct whose field none puts null ids last."""
    if similarity is not None:
        from .jaccard import similar_groups

        return similar_groups(docs, id_col, text_col, words, similarity).withColumn("fingerprint", F.lower(F.lpad(F.hex("node"), 16, "0")))
    prints = cut(fingerprints(docs, id_col, text_col, words), "prints")
    own = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    classes = prints.groupBy("print").agg(F.min(own).alias("own")).withColumn("node", F.monotonically_increasing_id())
    classes = cut(classes, "classes")
    roots = components(close_links(classes, distance))
    rooted = cut(classes.join(roots, "node", "left").select("print", "own", F.coalesce("root", "node").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("own").alias("least"), F.count("*").alias("n"))
    groups = cut(rooted.join(least.filter("n > 1").drop("n"), "root", "left").select("print", F.coalesce("least", "own").alias("least")), "groups")
    hexed = F.lower(F.lpad(F.hex(F.col("print")[0]), 16, "0"))
    return prints.join(groups, "print").select("id", "mark", hexed.alias("fingerprint"), "least")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, with their columns, that are the smallest of their group by id and hash of the text; of repeated rows one stays."""
    found = _grouped(docs, id_col, text_col, **how)
    first = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("mark") == F.col("least.mark"))
    stay = found.filter(first).select(F.col("id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    kept = docs.join(stay, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__mark")), "left_semi")
    own = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.col(text_col).asc_nulls_first())
    return kept.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, distance=2)
