"""Resampling towards a target distribution: hashed n-gram counts as CSR blocks, gains from column sums, weights by a sparse product, Gumbel draws."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, cut, drop, text_buffers

#: Letters A-Z lower-cased, and every ASCII byte that is neither letter nor digit a space; bytes of other characters stay.
_FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
#: Bytes of one text that are handled at a time, entries of a block of the matrix, and blocks that are read at a time.
PIECE, BLOCK, BLOCKS = 1 << 20, 1 << 15, 16


def buckets_of(text: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Words and feature buckets of a text, a piece of it at a time; runs of words go on over the pieces' ends.

    A run's CRC-32 goes on from that of the run without its last word, so no run is put together.
    """
    folded, start, before = text.translate(_FOLD), 0, []
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        new = folded[start:end].split()
        words = before + new
        runs = list(map(crc32, words))
        found = [runs[len(before) :]]
        spaced = [b" " + w for w in words]
        for n in range(1, longest):
            runs = list(map(crc32, spaced[n:], runs))
            found.append(runs[max(0, len(before) - n) :])
        yield len(new), np.concatenate([np.array(f, np.uint32) for f in found]) % np.uint32(buckets)
        before, start = words[-(longest - 1) :] if longest > 1 else [], end


def _csr(longest: int, buckets: int, kind: pa.DataType):
    def block(ids: pa.Array, words: list[int], rows: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        n = len(words)
        one = lambda values, type_: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, type_))
        columns = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([ids.cast(kind)])), one(words, pa.int64())]
        columns += [one(np.cumsum([len(r) for r in rows]), pa.int32()), one(np.concatenate(rows), pa.int32()), one(np.concatenate(counts), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["ids", "words", "ends", "buckets", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            done, words, rows, counts, held = 0, [], [], [], 0
            for i in range(batch.num_rows):
                n, row = 0, np.zeros(buckets, np.int64)
                for more, found in buckets_of(raw[off[i] : off[i + 1]].tobytes(), longest, buckets):
                    n, row = n + more, row + np.bincount(found, minlength=buckets)
                met = np.flatnonzero(row)
                words.append(n)
                rows.append(met)
                counts.append(row[met])
                held += len(met)
                if held >= BLOCK:
                    yield block(batch.column(0).slice(done, len(words)), words, rows, counts)
                    done, words, rows, counts, held = i + 1, [], [], [], 0
            if words:
                yield block(batch.column(0).slice(done, len(words)), words, rows, counts)

    return run


def count_matrix(docs: DataFrame, id_col: str, text_col: str, longest: int, buckets: int) -> DataFrame:
    """The document by bucket matrix in blocks of rows, compressed: ids, words (of each document), ends (of each row in the lists that follow), buckets, counts."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_csr(longest, buckets, to_arrow_type(kind)), f"ids array<{kind.simpleString()}>, words array<bigint>, ends array<int>, buckets array<int>, counts array<int>")


def _column_sums(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            at, n = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns)
            sums += np.bincount(at, n, buckets).astype(np.int64)  # exact: a batch holds far below 2**53 features
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met])], ["bucket", "n"])

    return run


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall in each bucket: each task adds up its blocks, and one number for each bucket meets on the driver."""
    found = matrix.select("buckets", "counts").mapInArrow(_column_sums(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's share of each bucket to the source's, one feature added to every bucket, rounded down."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _product(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, words, ends, at, n = (batch.column(c).slice(row, 1).flatten() for c in range(5))
                ends, at, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (ends, at, n))
                upto = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[ends], prepend=0)
                features, total = upto(n), upto(n * gain[at])
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(features), pa.array(weight)], ["id", "words", "n_features", "weight"])

    return run


def importance_weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, words, n_features, weight of every document: the mean gain of its features, rounded down; 0 without any."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()
    return matrix.mapInArrow(_product(gain), f"id {kind}, words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7) -> DataFrame:
    """For every row of docs: id_col, n_features, weight, score, rank. percent of those with least_words are drawn, without
    replacement, by importance: highest weight plus Gumbel noise first, which comes from the id and the seed alone.

    Features are runs of up to longest words (letters, digits and non-ASCII characters; A-Z in lower case), hashed by CRC-32 into
    buckets. The counts are written once, as blocks of a compressed matrix that both passes read: column sums give the
    distributions, and a product with the gains gives the weights. Both read a few blocks at a time, however large a task's
    share of the table is. Only numbers for each bucket meet on the driver.
    Ranks are numbered within ranges of scores, from counts of the ranges before.

    Null and empty texts have no words, weight 0 and no rank. Equal scores rank the smaller id first, null ids last; a null id's noise is
    that of the empty id. Repeated rows are each counted, weighed and ranked. A long text is handled in pieces and has at most
    one entry for each bucket. Empty tables give an empty result, or gains of an empty target. Other columns aren't read.
    """
    spark = docs.sparkSession
    matrix = cut(count_matrix(docs, id_col, text_col, longest, buckets), "matrix", BLOCKS)
    with batches_of(spark, BLOCKS):
        wanted = column_sums(count_matrix(target.withColumn("__n", F.lit(0)), "__n", target_text, longest, buckets), buckets)
        weighed = importance_weights(matrix, gains(column_sums(matrix, buckets), wanted))
        digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
        scored = cut(weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(uniform)))), "scored")
    drop(spark, matrix)
    fit = F.col("words") >= least_words
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    ranges = cut(scored.filter(fit).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    sizes = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    drawn, before, offset = sum(sizes.values()) * percent // 100, 0, {}
    for k in sorted(sizes):
        offset[k], before = before, before + sizes[k]
    offsets = spark.createDataFrame(list(offset.items()), "range int, before bigint")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.col("before")
    ranked = ranges.join(F.broadcast(offsets), "range").withColumn("rank", place)
    out = lambda rank: [F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank")]
    return ranked.select(*out(F.when(F.col("rank") <= drawn, F.col("rank")))).union(scored.filter(~fit).select(*out(F.lit(None))))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT doc_id, TRUE AS own, text FROM documents UNION ALL SELECT item_id, FALSE, text FROM benchmark),
words AS MATERIALIZED (SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT doc_id, own, unnest(w) AS f FROM words UNION ALL SELECT doc_id, own, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) FROM words WHERE len(w) > 1),
counted AS MATERIALIZED (SELECT doc_id, own, f, count(*) AS n FROM runs GROUP BY ALL),
features AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)),
bytes AS (SELECT f, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b FROM features),
hashed AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
cells AS MATERIALIZED (SELECT doc_id, own, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT bucket, CAST(coalesce(sum(n) FILTER (own), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (NOT own), 0) AS DOUBLE) AS t FROM cells GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS g FROM sums),
weighed AS (SELECT doc_id, sum(n) AS n_features, floor(sum(n * g) / sum(n)) AS weight FROM cells JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (doc_id) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n >= 20) AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n >= 20 AND r <= 25 * many // 100 THEN r END AS rank FROM ranked
"""
