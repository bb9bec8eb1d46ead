"""Exact de-duplication with a heavy-hitter split."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: The white space that equality ignores.
IGNORED = b"\x20\x09\x0a\x0b\x0c\x0d"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        sizes, digests = [], []
        for text in texts:
            raw = (text.as_py() or "").encode()
            sizes.append(len(raw.decode()))
            digests.append(hashlib.sha256(raw.translate(None, IGNORED)).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary())], ["id", "chars", "digest"])


def misra_gries(counts: dict[bytes, int], new: dict[bytes, int], k: int) -> dict[bytes, int]:
    """Merges two summaries and cuts to k counters by taking the (k+1)-th largest count off all."""
    for key, n in new.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) > k:
        least = sorted(counts.values(), reverse=True)[k]
        counts = {key: n - least for key, n in counts.items() if n > least}
    return counts


def _frequent(k: int):
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            seen = batch.column(0).value_counts()
            counts = misra_gries(counts, dict(zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], ["digest", "seen"])

    return summary


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 1024) -> DataFrame:
    """One row per row of docs: its group, which row of the group stays and why.

    Texts are equal when identical without white space; null counts as empty. Of equal texts the one with the most
    code points in the original stays, then the smallest id (a null id sorts first). Returns id_col, keep_id,
    group_size, kept, text_sha256.

    Each task sums its digests up in a Misra-Gries summary of k counters, so that whatever holds more than a k-th of
    some task's rows is a candidate. The k candidates with the largest sums are counted exactly; their winners, k rows
    at most, are broadcast and settle their rows where these lie. All other digests are shuffled.

    Rows repeated with the same id, length and digest are one document: each is reported like the other. An empty table
    gives an empty result; other columns are neither read nor returned, so their names may be anything.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("chars", T.LongType()), T.StructField("digest", T.BinaryType())])
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_digests, schema), "digests")
    summaries = rows.select("digest").mapInArrow(_frequent(k), "digest binary, seen long")
    candidates = summaries.groupBy("digest").agg(F.sum("seen").alias("seen")).orderBy(F.desc("seen"), "digest").limit(k).select("digest")
    order = F.struct((-F.col("chars")).alias("chars"), F.col("id").alias("id"))
    winners = rows.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("keep"), F.count("*").alias("group_size"))
    winners = cut(winners, "winners")
    heavy = rows.join(F.broadcast(winners), "digest")
    whole = Window.partitionBy("digest")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select("*", F.min(order).over(whole).alias("keep"), F.count("*").over(whole).alias("group_size"))
    return heavy.unionByName(light).select(F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", kept(F.col("id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def kept(own: Column) -> Column:
    return own.eqNullSafe(F.col("keep.id"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM d WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id)
"""
