"""Importance resampling, MinHash near-duplicates and vector codes: brute force, and the cases every operator has to bear."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import minhash, resample, yinyang

SCHEMA = "doc_id long, text string, id string, node string, score string, key string, n int, rank int"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(r.choice(["Ab", "cD", "é", "x9"]) + str(r.randint(0, vocabulary)) for _ in range(n))


def swapped(text, every, seed):
    r, w = random.Random(seed), text.split()
    return " ".join("zz" + str(r.randint(0, 10**6)) if i % every == 5 else x for i, x in enumerate(w))


def texts():
    base, long = prose(200, 1), prose(30_000, 2, 5000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, long), (8, swapped(long, 40, 1)), (9, base), (9, base), (None, base), (None, None), (10, "a b c " * 60), (11, "c b a " * 60)]
    rows += [(20 + i, swapped(base, every, i)) for i, every in enumerate([9, 11, 13, 15, 18, 22, 30, 40, 60, 100])]
    rows += [(40 + i, swapped(prose(40 + 7 * (i % 5), 50 + i % 5), [12, 25, 39][i % 3], i)) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", 0, 1) for i, t in texts()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))
    return len(w), Counter(crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def test_resample_against_brute_force(docs, none, spark):
    goal = spark.createDataFrame([("Ab1 cD2, x9-é3",), (None,), (prose(500, 9),)], "text string")
    got = [tuple(r) for r in resample.resample(docs, goal).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    rows = [(i, *features(t)) for i, t in texts()]
    s, t = (sum((c for _, c in counted), Counter()) for counted in ([r[1:] for r in rows], [features(x.text) for x in goal.collect()]))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s | t}
    want = []
    for i, n, c in rows:
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in c.items()) // c.total() if c else 0
        want.append((i, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = fit[: 25 * len(fit) // 100]
    expect = Counter((*(r[0], *r[2:]), ranks.index(r) + 1 if r in ranks else None) for r in want)
    twice = [r for r in ranks if ranks.count(r) > 1]
    assert len(got) == len(rows) and sorted(r[4] for r in got if r[4]) == list(range(1, len(ranks) + 1))
    assert Counter(g[:4] for g in got) == Counter(r[:4] for r in expect.elements())
    assert all(g in expect for g in got if not any(g[0] == r[0] for r in twice))
    assert resample.resample(none, goal).count() == 0
    assert resample.resample(docs, none).count() == len(rows)


def test_buckets_go_on_over_pieces(monkeypatch):
    text = prose(400, 3)
    whole = features(text)
    monkeypatch.setattr(resample, "PIECE", 37)
    parts = list(resample.buckets_of(text.encode(), 2, 10_000))
    assert len(parts) > 20 and sum(n for n, _ in parts) == whole[0]
    assert sum((Counter(b.tolist()) for _, b in parts), Counter()) == whole[1]
    three = Counter(crc32(" ".join(w).encode()) % 50 for n in (1, 2, 3) for w in zip(*(text.translate(UP).split()[k:] for k in range(n)), strict=False))
    assert sum((Counter(b.tolist()) for _, b in resample.buckets_of(text.encode(), 3, 50)), Counter()) == three


def test_resample_blocks_hold_the_matrix(docs, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 200)
    found = {}
    for r in resample.count_matrix(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), "doc_id", "text", 2, 10_000).collect():
        assert len(r.ids) == len(r.words) == len(r.ends)
        for i, a, b in zip(r.ids, [0, *r.ends], r.ends, strict=False):
            found[i] = Counter(dict(zip(r.buckets[a:b], r.counts[a:b], strict=True)))
    assert found == {i: features(t)[1] for i, t in texts() if i is not None}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y, (_, b) in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    out = []
    for x, (i, s) in enumerate(sets):
        mine = [j for y, (j, t) in enumerate(sets) if find(y) == find(x)] if s else [i]
        least = min((j for j in mine if j is not None), default=None)
        out.append((i, len(s), least, i == least))
    return Counter(out)


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_against_all_pairs(docs, words):
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, words=words).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups(texts(), words)


def test_minhash_pairs_large_buckets_by_rare_shingles(docs, none, monkeypatch):
    monkeypatch.setattr(minhash, "near_links", lambda *a, f=minhash.near_links: f(*a, most=0))
    got = Counter(tuple(r) for r in minhash.near_duplicates(docs, words=2).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups(texts(), 2)
    assert minhash.near_duplicates(none).count() == 0


def test_signatures_within_the_distance_share_a_chunk(spark):
    """The pigeonhole: any DISTANCE differences, and no fewer chunks than promised."""
    r, values = random.Random(4), minhash.CHUNKS * minhash.WIDTH
    rows = []
    for i in range(200):
        a = [r.randint(-(2**15), 2**15 - 1) for _ in range(values)]
        b = a[:]
        at = r.sample(range(values), minhash.DISTANCE) if i % 2 else [c * minhash.WIDTH + k for c in range(minhash.CHUNKS) for k in (0, 3)]
        for k in at[: minhash.DISTANCE]:
            b[k] ^= 1
        rows.append((a, b))
    pairs = spark.createDataFrame(rows, "a array<smallint>, b array<smallint>")
    both = pairs.select(F.array_intersect(minhash.chunk_keys("a"), minhash.chunk_keys("b")).alias("k"), minhash._differing("a", "b").alias("d"))
    for row in both.collect():
        assert row.d == minhash.DISTANCE and row.k


def lloyd(rows, parts, size, rounds):
    kept = sorted(((i is None, i or 0, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)))
    x = np.array([v for *_, v in kept], np.int64)
    out, books = [], []
    for p in range(parts):
        own = x[:, p * x.shape[1] // parts : (p + 1) * x.shape[1] // parts]
        book = own[:size].copy()
        for r in range(rounds + 1):
            d = ((own[:, None, :] - book[None]) ** 2).sum(2)
            code = d.argmin(1)
            if r < rounds:
                for e in set(code.tolist()):
                    book[e] = own[code == e].sum(0) // (code == e).sum()
        out.append((code, d.min(1)))
        books.append(book)
    return Counter((None if n else i, tuple(int(c[k]) for c, _ in out), int(sum(e[k] for _, e in out))) for k, (n, i, _) in enumerate(kept)), books


@pytest.fixture(scope="module")
def vectors():
    r = random.Random(6)
    rows = [(i, [r.choice([-1.0, 0.0, 0.5, r.gauss(0, 1)]) for _ in range(12)], r.choice([1, 2, None])) for i in range(400)]
    rows += [(i, rows[i - 400][1], 1) for i in range(400, 430)]  # copies: ties
    rows += [(5, rows[5][1], 2), (None, rows[6][1], None), (500, None, 1), (501, [], 1), (502, [1.0] * 11 + [None], 1), (503, [float("nan")] * 12, 2), (504, [float("inf")] + [0.0] * 11, 2)]
    return rows


def test_codes_are_those_of_a_full_scan(spark, vectors):
    table = spark.createDataFrame([(*v, "x", 1) for v in vectors], "vec_id long, embedding array<float>, label int, code string, error int").repartition(3)
    coded, books = yinyang.compress(table, label_col="label", size=24, rounds=4, groups=5)
    got = yinyang.label_errors(coded).collect()
    want, full = lloyd(vectors, 4, 24, 4)
    assert all((a == b).all() for a, b in zip(books, full, strict=True))
    assert Counter((r.id, tuple(r.code), r.error) for r in got) == want
    sums = Counter()
    for r in got:
        sums[r.label] += r.error
    assert all(r.label_error == sums[r.label] for r in got) and None in sums


def test_codes_of_small_and_empty_tables(spark, vectors):
    few = spark.createDataFrame(vectors[:3], "vec_id long, embedding array<double>, label int")
    coded, books = yinyang.compress(few)
    assert [(r.id, r.code, r.error) for r in coded.orderBy("id").collect()] == [(i, [i] * 4, 0) for i in range(3)] and len(books[0]) == 3
    coded, books = yinyang.compress(few.limit(0))
    assert coded.count() == 0 and books == [] and yinyang.label_errors(coded).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        yinyang.compress(few, parts=5)
    with pytest.raises(ValueError, match="components"):
        yinyang.compress(few.select("vec_id", F.transform("embedding", lambda e: e * 0 + 1e9).alias("embedding")))


def test_bounds_skip_distances_and_never_a_nearer_entry():
    r = np.random.default_rng(2)
    centres = r.integers(-3000, 3000, (64, 8))
    x = np.concatenate([centres[r.integers(0, 64, 4000)] + r.integers(-60, 60, (4000, 8)), centres[:50] * 2])
    book, drift = x[:64].copy(), np.zeros(64)
    near = yinyang.grouped(book, 8)
    assert sorted(np.concatenate(near).tolist()) == list(range(64))
    code, upper, lower, all_work = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full((len(x), len(near)), -np.inf), []
    for _ in range(6):
        code, upper, lower, work = yinyang.reassign(x, book, near, code, upper, lower, drift)
        d = yinyang.distances(x, book)
        assert (code == d.argmin(1)).all() and (upper**2 >= d[np.arange(len(x)), code]).all()
        for g, members in enumerate(near):
            others = np.where(members[None] == code[:, None], np.iinfo(np.int64).max, d[:, members]).min(1)
            assert (lower[:, g] <= np.sqrt(others.astype(float))).all()
        all_work.append(work)
        new = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) if (code == e).any() else book[e] for e in range(64)])
        book, drift = new, yinyang.moved(book, new)
    assert all_work[-1] < all_work[0] / 4
