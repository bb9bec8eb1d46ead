"""Line de-duplication: winnowing over line hashes, matches extended both ways, later repeated runs deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Words of a gram (shorter repeats never count), and words of a window (repeats from here on are always found).
GRAM_WORDS, WINDOW_WORDS = 25, 50


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """Of each line with a word: its number, its hash (words joined by a space, ASCII letters lower-cased) and its words."""
    numbers, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        w = line.encode().lower().split()
        if w:
            numbers.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(w)))
            words.append(len(w))
    return numbers, hashes, words


def fingerprints(hashes: list[int], words: list[int], gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> list[tuple[int, int]]:
    """Chosen grams as (first line, hash), by place.

    A gram starts at every line and ends with the line that brings it to `gram` words; a window likewise to `window` words.
    Of the grams within a window the one with the smallest hash is chosen, the last of equal ones. Any two runs of equal
    lines with `window` words or more hold an equal window, and so share a chosen gram.
    """
    n = len(hashes)
    packed = np.array(hashes, np.uint64).tobytes()

    def ends(least: int) -> list[int]:
        out, j, total = [], 0, 0
        for i in range(n):
            while j < n and total < least:
                total += words[j]
                j += 1
            if total < least:
                break
            out.append(j)
            total -= words[i]
        return out

    gram_ends, window_ends = ends(gram), ends(window)
    grams = [xxhash.xxh64_intdigest(packed[8 * i : 8 * j]) for i, j in enumerate(gram_ends)]
    chosen: dict[int, int] = {}
    best = -1
    last = 0
    for i, end in enumerate(window_ends):
        if best < i:  # the best has left the window: look at all again
            best, last = i, i
        while last < len(gram_ends) and gram_ends[last] <= end:
            if grams[last] <= grams[best]:
                best = last
            last += 1
        chosen[best] = grams[best]
    return sorted(chosen.items())


def windows(hashes: list[int], words: list[int], window: int = WINDOW_WORDS) -> list[tuple[int, int, int]]:
    """The shortest runs of lines with `window` words from each line on, and up to each line: first line, lines and hash.

    A line of a longer run is in the one that starts at it or, near the run's end, in the one that ends with the run.
    """
    packed = np.array(hashes, np.uint64).tobytes()
    before = np.concatenate([[0], np.cumsum(np.array(words, np.int64))])
    ahead = np.searchsorted(before, before[:-1] + window)
    back = np.searchsorted(before, before[1:] - window, "right") - 1
    spans = {(i, int(j)) for i, j in enumerate(ahead) if j < len(before)} | {(int(i), j + 1) for j, i in enumerate(back) if i >= 0}
    return [(i, j - i, xxhash.xxh64_intdigest(packed[8 * i : 8 * j])) for i, j in sorted(spans)]


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _scan(gram: int, window: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "mark", "n_lines", "numbers", "hashes", "words", "places", "grams", "starts", "sizes", "windows"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(2):
                    numbers, hashes, words = lines_of(text.as_py() or "")
                    found = fingerprints(hashes, words, gram, window)
                    whole = windows(hashes, words, window)
                    rows.append((numbers, _signed(hashes), words, [x[0] for x in found], _signed([x[1] for x in found]), [x[0] for x in whole], [x[1] for x in whole], _signed([x[2] for x in whole])))
                kinds = [pa.list_(k) for k in (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())]
                arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(r[0]) for r in rows], pa.int32()), *arrays], names)

    return scan


def _removed(gram: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for numbers, hashes, words, matches in zip(*(batch.column(i) for i in (2, 3, 4, 5)), strict=True):
                own, weight = np.array(hashes.as_py(), np.int64), np.array(words.as_py(), np.int64)
                gone = np.zeros(len(own), bool)
                for m in matches.as_py():
                    if m["other"] is None:  # a window, equal as a whole
                        gone[m["start"] : m["start"] + m["size"]] = True
                        continue
                    place, start, other = m["place"], m["start"], np.array(m["other"], np.int64)
                    equal = own[start : start + len(other)] == other[: len(own) - start]
                    at = place - start
                    breaks = np.flatnonzero(~equal)
                    a = int(breaks[breaks < at].max()) + 1 if (breaks < at).any() else 0
                    b = int(breaks[breaks > at].min()) if (breaks > at).any() else len(equal)
                    if equal[at] and weight[start + a : start + b].sum() >= gram:
                        gone[start + a : start + b] = True
                out.append(np.array(numbers.as_py(), np.int32)[gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["id", "mark", "removed"])

    return removed


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS) -> DataFrame:
    """id, mark (xxhash64 of the text), removed: the numbers of the lines that repeat an earlier run. Other rows are left out.

    Each chosen gram is joined with its first occurrence only (smallest id, then mark, then place), so there is a row for
    each occurrence and not for each pair. Line hashes around both are then compared outwards, and the run of equal lines
    is removed at the later place. `window` lines each way reach the end of every run of fewer than `window` words; longer ones
    are found by their windows. Every window that has an earlier occurrence, found the same way, is removed whole; so of a
    repeat of `window` words no line is left, wherever its parts stood before. Every removed line is thus still somewhere
    earlier.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    lists = "numbers array<int>, hashes array<bigint>, words array<int>, places array<int>, grams array<bigint>, starts array<int>, sizes array<int>, windows array<bigint>"
    scanned = cut(texts.mapInArrow(_scan(gram, window), f"id {kind}, mark bigint, n_lines int, {lists}"), "lines")
    found = scanned.select("id", "mark", "n_lines", F.explode(F.arrays_zip("places", "grams")).alias("f")).select("id", "mark", "n_lines", F.col("f.places").alias("place"), F.col("f.grams").alias("gram"))
    firsts = found.groupBy("gram").agg(F.min(F.struct("id", "mark", "place")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    firsts = cut(firsts, "firsts")
    here = F.struct("id", "mark", "place")
    later = found.join(firsts, "gram").filter(~here.eqNullSafe(F.col("first"))).select("id", "mark", "place", "n_lines", "first").distinct()
    source = scanned.select(F.col("id").alias("first_id"), F.col("mark").alias("first_mark"), F.col("hashes").alias("other")).dropDuplicates(["first_id", "first_mark"])
    later = later.join(source, F.col("first.id").eqNullSafe(F.col("first_id")) & (F.col("first.mark") == F.col("first_mark")))
    back = F.least(F.lit(window), F.col("place"), F.col("first.place"))
    ahead = F.least(F.lit(window), F.col("n_lines") - F.col("place"), F.size("other") - F.col("first.place"))
    match = F.struct("place", (F.col("place") - back).alias("start"), F.lit(0).alias("size"), F.slice("other", F.col("first.place") - back + 1, back + ahead).alias("other"))
    whole = scanned.select("id", "mark", F.explode(F.arrays_zip("starts", "sizes", "windows")).alias("w")).select("id", "mark", F.col("w.starts").alias("place"), F.col("w.sizes").alias("size"), F.col("w.windows").alias("window"))
    earliest = cut(whole.groupBy("window").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "earliest")
    again = whole.join(earliest, "window").filter(~here.eqNullSafe(F.col("first"))).select("id", "mark", "place", "size").distinct()
    span = F.struct("place", F.col("place").alias("start"), "size", F.lit(None).cast("array<bigint>").alias("other"))
    matches = later.select("id", "mark", match.alias("match")).union(again.select("id", "mark", span.alias("match"))).groupBy("id", "mark").agg(F.collect_list("match").alias("matches"))
    own = scanned.select(F.col("id").alias("own_id"), F.col("mark").alias("own_mark"), "numbers", "hashes", "words").dropDuplicates(["own_id", "own_mark"])
    at = matches.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))).select("id", "mark", "numbers", "hashes", "words", "matches")
    return cut(at.mapInArrow(_removed(gram), f"id {kind}, mark bigint, removed array<int>"), "removed")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, removed: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None or gone is None:
            return t
        drop = set(gone)
        return "\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop)

    return pd.Series([one(t, g) for t, g in zip(text, removed, strict=True)])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM_WORDS, window: int = WINDOW_WORDS, report: str | None = None) -> DataFrame:
    """docs with later repeated runs of lines taken out of the text; all rows and columns stay.

    A run of equal lines (ASCII case and white space inside lines aside; lines without a word are passed over) with
    `window` words or more that stands at two places, in one or two texts, is always taken out whole; one with at least `gram` words
    may be. It stays where the id is smallest. Text may become empty; null text stays null. Rows repeated with the same id
    and text count as one document, so both keep or lose the same lines. report: name of an added column with the numbers
    of the lines taken out (null: none). An empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, gram, window).select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.col("removed").alias("__removed"))
    # Texts are dealt by id whatever the size of gone: without this Spark broadcasts it while it is small, and shuffles
    # all texts only on large inputs. So cost and disk follow the input alike at every size.
    at = docs.join(gone.hint("merge"), docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col]) == gone["__mark"]), "left")
    changed = F.col("__removed").isNotNull()
    text = F.when(changed, _without(F.when(changed, docs[text_col]), F.col("__removed"))).otherwise(docs[text_col])
    columns = [text.alias(c) if c == text_col else docs[c] for c in docs.columns]
    return at.select(*columns, *([F.col("__removed").alias(report)] if report else []))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = line_dedup(docs, report="removed_lines")
    return cleaned.select("doc_id", F.coalesce(F.size("removed_lines"), F.lit(0)).alias("n_removed"), "removed_lines", F.char_length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))
