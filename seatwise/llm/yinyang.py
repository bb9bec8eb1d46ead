"""Product quantisation of vectors in integers: Lloyd rounds that skip entries by Yinyang bounds for groups of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop

#: Components are whole multiples of 1 / SCALE, rounded down; larger integers than LARGEST are refused, so that distances stay exact.
SCALE, LARGEST = 1024, 1 << 25
#: Bounds are rounded away from the distance by this share, far over what single precision loses.
SLACK = 1e-6
#: Components that one vectorised step handles.
STEP = 1 << 20
#: Labels up to which their sums are broadcast.
FEW = 100_000


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows x to integer rows c, exact."""
    span = int(np.abs(x).max(initial=0)) + int(np.abs(c).max(initial=0))
    kind = np.float64 if span * span * x.shape[1] < 1 << 52 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


def grouped(book: np.ndarray, groups: int) -> list[np.ndarray]:
    """The entries' numbers in groups of near ones, by a few rounds of k-means on the codebook itself. They decide what is skipped, never the result."""
    if not len(book):
        return []
    seeds = book[:: max(1, len(book) // groups)][:groups].astype(float)
    for _ in range(5):
        own = ((book[:, None, :] - seeds) ** 2).sum(2).argmin(1)
        seeds = np.stack([book[own == g].mean(0) if (own == g).any() else seeds[g] for g in range(len(seeds))])
    return [np.flatnonzero(own == g) for g in range(len(seeds)) if (own == g).any()]


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry has moved, rounded up."""
    return np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + SLACK)


def reassign(x: np.ndarray, book: np.ndarray, groups: list[np.ndarray], code: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray):
    """Each row's nearest entry (of equals the lowest number), its bounds for the next round, and how many distances that took.

    upper: at least the distance to the row's entry. lower, by group: at most the distance to any other entry of the group. Both
    are first moved by the entries' drift. A group is scanned only where its bound doesn't exceed the best distance so far; a
    strictly larger bound rules out ties too. Scanned distances are whole numbers, so ties are ties.
    """
    owner = np.empty(len(book), np.int64)
    for g, members in enumerate(groups):
        owner[members] = g
    code, upper = code.copy(), upper + drift[code]
    lower = lower - np.array([drift[m].max() for m in groups])
    lower -= np.abs(lower) * SLACK
    rows, work = np.flatnonzero(~(lower.min(1) > upper)), 0
    own = ((x[rows] - book[code[rows]]) ** 2).sum(1)  # int64: exact within LARGEST
    work += len(rows)
    upper[rows] = np.sqrt(own) * (1 + SLACK)
    still = ~(lower[rows].min(1) > upper[rows])
    rows, own = rows[still], own[still]
    best, pick, before = own.copy(), code[rows].copy(), code[rows]
    first, second = (np.full((len(rows), len(groups)), np.inf) for _ in range(2))
    which = np.full((len(rows), len(groups)), -1)
    for g, members in enumerate(groups):
        at = np.flatnonzero(~(lower[rows, g] > np.sqrt(best) * (1 + SLACK)))
        if not len(at):
            continue
        d = distances(x[rows[at]], book[members])
        work += d.size
        near = d.argmin(1)  # the first of equals; members are in ascending order
        least, entry = d[np.arange(len(at)), near], members[near]
        first[at, g], which[at, g] = least, entry
        d[np.arange(len(at)), near] = np.iinfo(np.int64).max
        if len(members) > 1:
            second[at, g] = d.min(1)
        wins = (least < best[at]) | ((least == best[at]) & (entry < pick[at]))
        best[at], pick[at] = np.where(wins, least, best[at]), np.where(wins, entry, pick[at])
    scanned = which >= 0
    found = np.sqrt(np.where(which == pick[:, None], second, first)) * (1 - SLACK)
    bound = np.where(scanned, found, lower[rows])
    left = np.flatnonzero((pick != before) & ~scanned[np.arange(len(rows)), owner[before]])  # the entry left now counts among its group's others
    bound[left, owner[before[left]]] = np.minimum(bound[left, owner[before[left]]], np.sqrt(own[left]) * (1 - SLACK))
    lower[rows], code[rows], upper[rows] = bound, pick, np.sqrt(best) * (1 + SLACK)
    return code, upper, lower, work


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1), kind))


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(0, batch.num_rows, max(1, STEP // width)):
            yield batch.slice(row, max(1, STEP // width))


def _assigned(books: list[np.ndarray], groups: list[list[np.ndarray]], drifts: list[np.ndarray], last: bool):
    """A round over rows (id, label, x[, code, upper, lower]): the same with the new codes and bounds, or at last codes and errors alone."""
    width, parts, many = books[0].shape[1], len(books), max(len(g) for g in groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _steps(batches, width * parts):
            n, x = batch.num_rows, _matrix(batch.column(2), np.int64)
            if batch.num_columns > 3:
                code, upper, lower = _matrix(batch.column(3), np.int64), _matrix(batch.column(4), float), _matrix(batch.column(5), float)
            else:
                code, upper, lower = np.zeros((n, parts), np.int64), np.full((n, parts), np.inf), np.full((n, parts * many), -np.inf)
            error = np.zeros(n, np.int64)
            for p in range(parts):
                own, span = x[:, p * width : (p + 1) * width], slice(p * many, p * many + len(groups[p]))
                code[:, p], upper[:, p], lower[:, span], _ = reassign(own, books[p], groups[p], code[:, p], upper[:, p], lower[:, span], drifts[p])
                error += ((own - books[p][code[:, p]]) ** 2).sum(1)
            out = [batch.column(0), batch.column(1)]
            if last:
                yield pa.RecordBatch.from_arrays([*out, _lists(code, pa.int16()), pa.array(error)], ["id", "label", "code", "error"])
            else:
                up, low = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
                yield pa.RecordBatch.from_arrays([*out, batch.column(2), _lists(code, pa.int16()), _lists(up, pa.float32()), _lists(low, pa.float32())], ["id", "label", "x", "code", "upper", "lower"])

    return run


def _summed(width: int, parts: int, size: int):
    """For each task, the sums and the number of rows of each entry that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * size, width), np.int64), np.zeros(parts * size, np.int64)
        for batch in _steps(batches, width * parts):
            key = (_matrix(batch.column(1), np.int64) + np.arange(parts) * size).ravel()
            x, order = _matrix(batch.column(0), np.int64).reshape(-1, width), np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            sums[key[order[starts]]] += np.add.reduceat(x[order], starts)
            counts += np.bincount(key, minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(counts[met]), *(pa.array(sums[met, i]) for i in range(width))], ["entry", "n", *(f"s{i}" for i in range(width))])

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = None, parts: int = 4, size: int = 256, rounds: int = 4, groups: int = 16):
    """Codes of all vectors (id, label, code: an entry's number for each part, error: the squared distance), and the codebooks.

    A component x is the integer floor(1024 x). A vector is cut into equal consecutive parts, each with a codebook of its own: at
    first that part of the size smallest ids' vectors (of equal ids the smaller vector first), then moved by rounds of Lloyd's
    algorithm to the floored mean of what is nearest (of equally near entries the lowest is). An entry without vectors stays.
    Each round carries a bound for each group of entries, and scans only groups whose bound, moved by how far entries have
    moved, doesn't exclude them; the codes are those of a full scan. Codebooks (parts x size entries, whatever the table) are all
    that meets on the driver, from sums that each task has added up by itself.

    Left out: null vectors, vectors with a null or non-finite component, and vectors of another length than the longest kept (an
    empty vector is one). Null ids sort last, repeated rows are coded each, null labels are kept; other columns aren't read. An empty table
    has no codebooks and no rows. The length must be a multiple of parts, and a component below 2**25 / 1024 in size; both raise.
    """
    spark, value = vectors.sparkSession, F.col(vector_col)
    finite = value.isNotNull() & ~F.exists(value, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    whole = F.transform(value, lambda e: F.floor(e.cast("double") * SCALE))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    kept = vectors.filter(finite).select(F.col(id_col).alias("id"), label.alias("label"), whole.alias("whole"))
    facts = kept.agg(F.max(F.size("whole")).alias("length"), F.max(F.greatest(F.abs(F.array_max("whole")), F.abs(F.array_min("whole")))).alias("most")).first()
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    length = facts["length"] or 0
    if not length:
        return spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code array<smallint>, error bigint"), []
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    if facts["most"] >= LARGEST:
        raise ValueError(f"components are {LARGEST // SCALE} at most")
    kept, width = kept.filter(F.size("whole") == length).select("id", "label", F.col("whole").cast("array<int>").alias("x")), length // parts
    few = np.array([r["x"] for r in kept.select("id", "x").orderBy(F.col("id").asc_nulls_last(), "x").limit(size).collect()], np.int64)
    books = [few[:, p * width : (p + 1) * width] for p in range(parts)]
    near, still = [grouped(b, groups) for b in books], [np.zeros(len(few)) for _ in books]
    state, drifts = kept, still
    kind = f"id {kinds['id']}, label {kinds['label']}, x array<int>, code array<smallint>, upper array<float>, lower array<float>"
    for _ in range(rounds):
        before, state = state, cut(state.mapInArrow(_assigned(books, near, drifts, False), kind), "codes")
        sums = state.select("x", "code").mapInArrow(_summed(width, parts, len(few)), "entry int, n bigint, " + ", ".join(f"s{i} bigint" for i in range(width)))
        added = sums.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).collect()
        new = [b.copy() for b in books]
        for r in added:
            p, e = divmod(r["entry"], len(few))
            new[p][e] = np.array([r[f"s{i}"] // r["n"] for i in range(width)])
        books, drifts = new, [moved(a, b) for a, b in zip(books, new, strict=True)]
        if before is not kept:
            drop(spark, before)
    return state.mapInArrow(_assigned(books, near, drifts, True), f"id {kinds['id']}, label {kinds['label']}, code array<smallint>, error bigint"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over equal labels, nulls together. Sums are broadcast if they are few, which is counted first; else they are joined."""
    sums = cut(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    side = F.broadcast(sums) if sums.count() <= FEW else sums
    return coded.join(side, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label_col="label")
    at = label_errors(cut(coded, "coded"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    return at.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT n, p, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), e := e)) AS m FROM cut JOIN book{r} USING (p) GROUP BY n, p)""")
        if r < rounds:
            steps.append(f"""mean{r} AS (SELECT p, e, list(floor(s / k) ORDER BY i) AS c FROM (SELECT p, m.e AS e, i, sum(v) AS s, count(*) AS k FROM (SELECT p, m, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM cut JOIN near{r} USING (n, p)) GROUP BY ALL) GROUP BY p, e),
book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{r}.c, book{r}.c) AS c FROM book{r} LEFT JOIN mean{r} USING (p, e))""")
    return f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS n, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), cut AS MATERIALIZED (SELECT n, p, list_slice(x, p * (len(x) // {parts}) + 1, (p + 1) * (len(x) // {parts})) AS x FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM cut WHERE n <= {size}),
{", ".join(steps)},
hashed AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM book{rounds})),
coded AS (SELECT n, string_agg(format('{{:02x}}', CAST(m.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY n)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (n), hashed"""


ORACLE = _oracle()
