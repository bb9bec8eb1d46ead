"""Best-fit packing: a configuration linear program over the length histogram, rounded to whole sequences."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights; each gives a configuration 1 / ROUNDS of the sequences.
ROUNDS = 200
#: How fast a length's weight falls as it is covered, and how much more a long piece is worth at first than its ids.
RATE, LARGE = 0.1, 0.1
#: Pieces of one length that are numbered in one part.
NUMBERED = 1 << 17
#: Strings that are one id each, wherever they stand.
WHOLE = {"<|endoftext|>": 50256}

#: The vocabulary's split pattern, and the same without its look-ahead. They split alike where no two white
#: space characters stand side by side; the second runs on a faster matcher.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
_TWO_SPACES = re.compile(r"\s\s")
_WHOLE = re.compile("(" + "|".join(map(re.escape, WHOLE)) + ")")


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, from its ranks. They are the ids that its tokenizers file gives (tested), in less time."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks_path, self.pattern = ranks_path, pattern

    def load(self) -> None:
        import tiktoken

        with open(self.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.whole, self.plain = make("whole", self.pattern), make("plain", PLAIN_SPLIT)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in _WHOLE.split(text) if "<|" in text else (text,):
            if part in WHOLE:
                ids.append(WHOLE[part])
            elif part:
                ids += (self.whole if _TWO_SPACES.search(part) else self.plain).encode_ordinary(part)
        return ids


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _loaded(ranks_path: str, pattern: str) -> ByteBpe:
    """One vocabulary per Python worker."""
    if (ranks_path, pattern) not in _LOADED:
        bpe = ByteBpe(ranks_path, pattern)
        bpe.load()
        _LOADED[ranks_path, pattern] = bpe
    return _LOADED[ranks_path, pattern]


def cuts(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of n ids: full ones at the end, what is over in front."""
    first = n % capacity or min(n, capacity)
    start = 0
    while start < n:
        length = first if not start else capacity
        yield start, length
        start += length


def _pieces(ranks_path: str, pattern: str, capacity: int, end_id: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows, piece, start, length, crc, ids_out = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1).slice(at, 512)):
                    ids = np.array([*bpe.encode(text.as_py() or ""), end_id], "<u4")
                    for k, (a, n) in enumerate(cuts(len(ids), capacity)):
                        own = ids[a : a + n]
                        rows.append(at + i)
                        piece.append(k)
                        start.append(a)
                        length.append(n)
                        crc.append(zlib.crc32(own.tobytes()))
                        if with_ids:
                            ids_out.append(own.astype(np.int32))
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(ids_out, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return pieces


def best_filling(prices: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration (how many of each length) of most value that capacity holds: a knapsack by dynamic programming.

    Lengths that have none left aren't used; a length is used at most as often as it is left.
    """
    lengths = np.flatnonzero(left)
    value, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    priced = prices[lengths]
    for room in range(int(lengths[0]), capacity + 1):
        fit = int(np.searchsorted(lengths, room, "right"))
        got = value[room - lengths[:fit]] + priced[:fit]
        best = int(got.argmax())
        if got[best] > value[room - 1]:
            value[room], pick[room] = got[best], lengths[best]
        else:
            value[room] = value[room - 1]
    used = np.zeros(len(left), np.int64)
    room = capacity
    while room > 0:
        if not pick[room]:
            room -= 1
            continue
        one = int(pick[room])
        if used[one] == left[one]:  # all of this length are used: the rest is filled best-fit
            fits = np.flatnonzero((left > used)[: room + 1])
            if not len(fits):
                break
            one = int(fits[-1])
        used[one] += 1
        room -= one
    return used


def solve(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """A solution of the configuration LP by multiplicative weights: configurations and how many sequences use each, not whole.

    The LP: fewest sequences so that configurations times uses cover the pieces of each length. Each length has a weight; a
    round prices the lengths by weight, finds the best configuration by knapsack, gives it one of `rounds` equal shares of the
    least number of sequences, and takes from the weight of each length by how much of its pieces that covers. So weights
    fall all the way through with what is covered, and lengths that lag behind come up. First weights are as the ids, a
    little more for long pieces, which are harder to place.
    """
    lengths = np.arange(len(histogram))
    weight = lengths / capacity * (1 + LARGE * lengths / capacity)
    share = (lengths * histogram).sum() / capacity / rounds
    found: dict[bytes, list] = {}
    for _ in range(rounds):
        used = best_filling(weight, histogram, capacity)
        found.setdefault(used.tobytes(), [used, 0.0])[1] += share
        weight = weight * np.exp(-RATE * np.minimum(1.0, share * used / np.maximum(histogram, 1)))
        weight /= weight[histogram > 0].max()
    return [(used, x) for used, x in found.values()]


def configurations(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences use each, which together hold every piece exactly once.

    Pieces of full length are sequences of their own. The LP's solution for the others is rounded: each configuration,
    those with the most sequences first, is used as often as the LP says, rounded down, and as pieces are left; then once
    more, those with the largest rest first, if all its pieces are left. What the LP has covered least is packed best-fit. The
    histogram has capacity + 1 entries, however many pieces there are, and a knapsack is solved once a round.
    """
    left = histogram.astype(np.int64).copy()
    out = []

    def take(used: np.ndarray, times: int) -> None:
        some = np.flatnonzero(used)
        times = int(min(times, (left[some] // used[some]).min()))
        if times > 0:
            left[some] -= used[some] * times
            out.append((used, times))

    if left[capacity]:
        full = np.zeros(len(left), np.int64)
        full[capacity] = 1
        take(full, int(left[capacity]))
    if left.any():
        solved = solve(left, capacity, rounds)
        for used, times in sorted(solved, key=lambda x: -x[1]):
            take(used, int(times))
        for used, times in sorted(solved, key=lambda x: -(x[1] % 1)):
            if times % 1:
                take(used, 1)
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and uses: the longest pieces first, each where least room is left that holds it; alike sequences in one step."""
    groups: dict[int, list[tuple[np.ndarray, int]]] = {}
    rooms: list[int] = []

    def put(used: np.ndarray, times: int, room: int) -> None:
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append((used, times))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                used, times = groups[room].pop()
                now = min(n, times)
                if now < times:
                    groups[room].append((used, times - now))
                elif not groups[room]:
                    del groups[room], rooms[at]
                used = used.copy()
                used[length] += 1
                put(used, now, room - length)
                n -= now
                continue
            each = min(n, capacity // length)
            used = np.zeros(len(left), np.int64)
            used[length] = each
            put(used, n // each, capacity - each * length)
            n -= n // each * each
    return [x for group in groups.values() for x in group]


def slots(plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length: the ends of its ranges of piece numbers, and each range's first sequence, pieces per sequence and offset."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    base = 0
    for used, times in plan:
        offset = 0
        for length in np.flatnonzero(used)[::-1]:
            found.setdefault(int(length), []).append((times * int(used[length]), base, int(used[length]), offset))
            offset += int(used[length] * length)
        base += times
    return {k: (np.concatenate([[0], np.cumsum([x[0] for x in v])]), np.array([x[1:] for x in v], np.int64)) for k, v in found.items()}


def place(plan: dict, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the number-th piece of each length."""
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        own = int(length[rows[0]])
        ends, table = plan[own]
        k = np.searchsorted(ends, number[rows], "right") - 1
        copy, at = np.divmod(number[rows] - ends[k], table[k, 1])
        sequence[rows], offset[rows] = table[k, 0] + copy, table[k, 2] + at * own
    return sequence, offset


def _placed(places):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            length, number = (batch.column(names.index(x)).to_numpy(zero_copy_only=False) for x in ("length", "number"))
            sequence, offset = place(places.value, length, number)
            keep = [x for x in names if x != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(x)) for x in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs all texts into sequences of at most capacity ids; one row per piece.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, the ids themselves. A text is its
    ids and then end_id; null counts as empty, so every row has a piece. Longer ones are cut into full pieces, the first
    piece taking what is over. Rows repeated with one id are packed each for itself; pieces that tie in everything may
    swap places; an empty table gives none. Other columns are not read, so they may have any name. A very long text is
    encoded whole, in memory of some 40 times its bytes at most, and its pieces lie in sequences like any other.

    Only the histogram of lengths, capacity + 1 counts, comes to the driver, where the LP is solved (see configurations).
    Full pieces are sequences of their own where they lie, with negative ids. The others are numbered within their length,
    length and salt at a time, as many salts as make NUMBERED pieces each, and look up their places in the broadcast plan.
    The plan's size follows the number of lengths, not of pieces.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(texts.mapInArrow(_pieces(ranks_path, pattern, capacity, end_id, with_ids), schema), "pieces")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").agg(F.count("*")).collect():  # capacity rows at most
        histogram[length] = n
    full = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    histogram[capacity] = 0
    salts = max(1, int(histogram.max()) // NUMBERED)
    salted = pieces.filter(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    places = docs.sparkSession.sparkContext.broadcast(slots(configurations(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own)).join(base, ["length", "salt"])  # both dealt by length and salt
    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("own") - 1 + F.col("base")).alias("number"))
    placed = numbered.mapInArrow(_placed(places), schema + ", sequence_id long, offset long")
    return placed.unionByName(full).withColumnRenamed("id", id_col)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabulary())


def vocabulary() -> tuple[str, str]:
    """The public vocabulary byte_bpe_50k as ranks, and its split pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
