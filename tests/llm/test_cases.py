"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from seatwise.llm import chat, exact_dedup, licenses, line_dedup, lm, mixing, packing, quality, simhash, warc
from seatwise.llm.common import new_path, span_hashes
from seatwise.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, kept string, size string, digest string, label int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgé") for _ in range(r.randint(1, 7))) for _ in range(n))


def texts():
    long = words(6000, 1)
    base = words(120, 2).split()
    near = base[:]
    near[60] = "zzz"
    lines = "\n".join(words(14, 100 + i) for i in range(6))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two"), (6, long), (7, " ".join(base)), (8, " ".join(near)), (9, " ".join(base)), (9, " ".join(base)),
        (10, f"first words here\n{lines}\nlast words"), (11, f"{words(30, 5)}\n{lines}\n{words(30, 6)}"), (12, "a b c " * 60), (13, "Naïve   text with odd spaces"),
        (None, "no id at all"), (14, "Released under the MIT License.\nand more"), (15, "x" * 5000),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ["en", "de", None][k % 3], ["b", "a", None, "c"][k % 4], 0, "x", "y", "z", "d", 1) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = [r.asDict() for r in exact_dedup.exact_dedup(docs, k=2).collect()]
    assert len(got) == len(texts())
    groups = defaultdict(list)
    for i, t in texts():
        bare = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(bare.encode()).hexdigest()].append((-len(t or ""), -1 if i is None else i))
    for r in got:
        group = groups[r["text_sha256"]]
        keep = min(group)[1]
        assert (r["keep_id"], r["group_size"]) == (None if keep == -1 else keep, len(group))
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup.exact_dedup(none).count() == 0


def test_misra_gries_keeps_every_frequent_key():
    r = random.Random(3)
    counts, true = {}, Counter()
    for _ in range(50):
        new = Counter(b"%d" % min(r.randint(0, 400), r.randint(0, 400), r.randint(0, 400)) for _ in range(100))
        new[b"hot"] += 20
        true += new
        counts = exact_dedup.misra_gries(counts, dict(new), 10)
        assert len(counts) <= 10
    assert all(k in counts for k, n in true.items() if n > sum(true.values()) / 11)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/ ü", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (5, "v", "x" * 300_000), (5, "v", "y"), (None, "w", "z"), (7, "w\n", "z")], "page_id long, url string, html string, digest string".replace(", digest string", ""))
    pages = pages.withColumn("digest", F.lit("clash"))
    files = warc.write_warc(pages, new_path(spark, "t"), roll_bytes=200)
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload) for r in warc.read_warc(files).collect()}
    assert got == {(1, 5, "response", None, "<p>é"), (2, 5, "revisit", 1, None), (3, 0, "response", None, ""), (4, 0, "revisit", 3, None), (5, 300_000, "response", None, "x" * 300_000), (5, 1, "response", None, "y"), (None, 1, "response", None, "z"), (7, 1, "revisit", None, None)}
    files = warc.write_warc(pages, new_path(spark, "t"), min_revisit_bytes=6)
    assert {r.record_type for r in warc.read_warc(files).collect()} == {"response"}
    assert warc.read_warc(warc.write_warc(pages.limit(0), new_path(spark, "t"))).count() == 0


def test_warc_damage():
    raw = warc.record(1, "u", b"abc", warc.digest_of(b"abc"), None, False)
    assert [x[2] for x in warc.read_bytes(raw + raw)] == [b"abc", b"abc"]
    with pytest.raises(warc.Damaged):
        warc.read_bytes(raw[:-4])
    with pytest.raises(warc.Damaged):
        warc.read_bytes(warc.record(1, "u", b"abc", warc.digest_of(b"abd"), None, False))


def test_mixing(docs, none, spark):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(texts())
    size = sum(len(WORD.findall(t or "")) for _, t in texts())
    per = {r.source: (r.target, r.source_size) for r in got}
    assert abs(sum(t for t, _ in per.values()) - 1.5 * size) < 1e-6
    assert all(t <= 2 * s + 1e-9 for t, s in per.values()) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mixing.mix_sources(docs.repartition(5)).collect()}
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixing_targets_by_repeated_resharing(spark):
    sizes = {f"s{i:02}": random.Random(i).randint(1, 500) for i in range(17)} | {None: 40}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, (3.0, 1.0, 2.0), 1.5, 2.0).collect()}
    order = sorted((s for s in sizes if s), key=lambda s: s) + [None]
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        level = rest / sum(w for s, w in weight.items() if s not in full)
        over = {s for s in order if s not in full and weight[s] * level > 2 * sizes[s] + 1e-12}
        if not over:
            break
        full |= over
    assert all(abs(got[s] - (2 * sizes[s] if s in full else weight[s] * level)) < 1e-6 for s in order)


def test_mixing_near_targets(spark):
    r = random.Random(5)
    rows = spark.createDataFrame([(i, f"s{min(r.randint(0, 9), 5)}", "w " * r.randint(1, 300)) for i in range(3000)], "doc_id long, source string, text string")
    by = defaultdict(lambda: [0, 0.0])
    for x in mixing.mix_sources(rows).collect():
        by[x.source][0] += x.taken
        by[x.source][1] = x.target
    assert all(abs(t - g) <= 0.005 * g for t, g in by.values())


def test_packing(docs, none):
    vocabulary = packing.vocabulary()
    got = [r.asDict() for r in packing.pack(docs, *vocabulary, with_ids=True).collect()]
    bpe = packing.ByteBpe(*vocabulary)
    bpe.load()
    want = Counter()
    for i, t in texts():
        ids = [*bpe.encode(t or ""), 2]
        for k, (a, n) in enumerate(packing.cuts(len(ids), 1024)):
            want[i, k, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    room = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == r["length"]
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in room.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert packing.pack(none, *vocabulary).count() == 0


def test_bpe_ids_are_the_tokenizers_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = packing.ByteBpe(*packing.vocabulary())
    bpe.load()
    for text in ["<|endoftext|>", "hi <|endoftext|> there", "a<|endoftext|><|endoftext|>  b", "<|endoftext| >", "x <|x|> <|endoftext|>\n\n", "", " ", "a  b\n\n c\t\td ", "it's we'll  'S 'tis", "x   y　z", "é1٣½ #!?\n", "\r\n\r\n  end  ", *(t for _, t in texts() if t)]:
        assert bpe.encode(text) == want.encode(text, add_special_tokens=False).ids


def test_packing_lp_bound_and_whole_rounding():
    """Many pieces, so the LP's solution is used: near the bound by ids, every piece exactly once, at most capacity."""
    r = np.random.default_rng(6)
    histogram = np.bincount(np.minimum(1024, (r.exponential(300, 20_000) + 1).astype(int)), minlength=1025)
    plan = packing.configurations(histogram, 1024)
    assert (sum(u * k for u, k in plan) == histogram).all() and all((u * np.arange(1025)).sum() <= 1024 for u, _ in plan)
    assert sum(k for _, k in plan) <= 1.001 * (histogram * np.arange(1025)).sum() / 1024 + 1
    solution = packing.solve(np.where(np.arange(1025) < 1024, histogram, 0), 1024)
    assert all((u * np.arange(1025)).sum() <= 1024 for u, _ in solution)


def test_packing_is_as_dense_as_best_fit():
    import bisect

    r = np.random.default_rng(4)
    histogram = np.bincount(r.integers(1, 1025, 3000), minlength=1025)
    plan = packing.configurations(histogram, 1024)
    assert (sum(u * k for u, k in plan) == histogram).all() and all((u * np.arange(1025)).sum() <= 1024 for u, _ in plan)
    rooms, used = [], 0
    for length in range(1024, 0, -1):
        for _ in range(histogram[length]):
            i = bisect.bisect_left(rooms, length)
            left = rooms.pop(i) if i < len(rooms) else 1024
            used += left == 1024
            bisect.insort(rooms, left - length) if left > length else None
    assert sum(k for _, k in plan) <= used * 1.005


def fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none, monkeypatch):
    prints = [(i, fingerprint(t)) for i, t in texts()]
    root = {p: p for _, p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in root:
        for q in root:
            if (p ^ q).bit_count() <= 2:
                root[find(p)] = find(q)
    least = defaultdict(list)
    for i, p in prints:
        least[find(p)] += [] if i is None else [i]
    want = Counter((i, f"{p:016x}", min(least[find(p)], default=None)) for i, p in prints)
    for bucket in (256, 1):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [256, 1])
def test_simhash_links_all_close_prints(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(9)
    prints = set()
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            p ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(i, [p]) for i, p in enumerate(signed)], "node long, print array<bigint>")
    got = {r.node: r.root for r in components(simhash.close_links(classes)).collect()}
    root = list(range(len(prints)))
    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= 2:
                a, b = (min(k for k in range(len(root)) if root[k] == root[x]) for x in (i, j))
                old, new = root[i], root[j]
                root = [min(old, new) if x in (old, new) else x for x in root]
    assert all(got.get(i, i) == root[i] for i in range(len(prints)))


def test_wide_simhash_finds_near_copies(spark):
    rows = []
    for i in range(40):
        w = words(150, 1000 + i).split()
        v = w[:]
        v[random.Random(i).randrange(20, 130)] = "changed"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, words=5, similarity=0.8).collect()}
    assert all(got[2 * i] == 2 * i for i in range(40)) and sum(got[2 * i + 1] == 2 * i for i in range(40)) >= 39
    assert simhash.first_of_each(docs, words=5, similarity=0.8).count() <= 41


def test_similar_texts_are_found_like_by_brute_force(spark):
    """Pairs of Jaccard similarity 0.8 to 0.85 are all linked, pairs just below 0.8 are not."""
    rows, near = [], {}
    for i in range(300):
        w = words(300, 20_000 + i).split()
        v = w[:]
        for k in range(1, 4 + i % 6):
            v[k * 30] = "changed"
        a, b = ({tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in (w, v))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        near[i] = len(a & b) / len(a | b)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, similarity=0.8).collect()}
    assert sum(0.8 <= s <= 0.85 for s in near.values()) >= 50 and any(0.7 < s < 0.8 for s in near.values())
    assert all(got[2 * i] == 2 * i and (got[2 * i + 1] == 2 * i) == (s >= 0.8) for i, s in near.items())


def test_one_text_of_each_group_stays_with_null_and_repeated_ids(spark):
    a, b, c = words(80, 31), words(80, 32), words(80, 33)
    docs = spark.createDataFrame([(None, a), (None, b), (None, b), (1, b + " more"), (7, c), (7, a + " end"), (7, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.first_of_each(docs, words=5, similarity=0.8).collect())
    assert got == sorted([(1, b + " more"), (7, c), (7, a + " end")])
    apart = spark.createDataFrame([(None, a), (None, b), (7, c)], "doc_id long, text string")
    assert sorted(r.text for r in simhash.first_of_each(apart, words=5, similarity=0.8).collect()) == sorted([a, b, c])


def test_line_dedup(docs, none):
    out = line_dedup.line_dedup(docs, report="removed")
    assert out.columns == [*docs.columns, "removed"]
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(r)
    source = defaultdict(list)
    for i, t in texts():
        source[i].append(t)
    assert [r.text for r in got[1]] == [None] and [r.text for r in got[10]] == source[10] and [r.text for r in got[7]] == source[7]
    assert [r.text for r in got[9]] == ["", ""]
    assert [r.text for r in got[11]] == [f"{words(30, 5)}\n{words(30, 6)}"]
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_finds_every_long_repeat_and_removes_nothing_else(spark):
    r = random.Random(7)
    pool = ["\n".join(words(r.randint(3, 20), 10_000 + 50 * p + i) for i in range(r.randint(4, 9))) for p in range(12)]
    rows = [(d, "\n".join(r.choice(pool) if r.random() < 0.4 else words(r.randint(1, 25), 77 * d + i) for i in range(8))) for d in range(60)]
    out = {x.doc_id: set(x.removed or []) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), report="removed").collect()}
    lines = {d: line_dedup.lines_of(t) for d, t in rows}
    seen = defaultdict(list)
    for d, (_, h, _) in lines.items():
        for i, x in enumerate(h):
            seen[x].append((d, i))
    for d, (numbers, h, w) in lines.items():
        for i in range(len(h)):
            if numbers[i] in out[d]:
                assert any(p < (d, i) for p in seen[h[i]])
            for e, j in seen[h[i]]:
                if (e, j) < (d, i) and not (i and j and h[i - 1] == lines[e][1][j - 1]):
                    m = 0
                    while i + m < len(h) and j + m < len(lines[e][1]) and h[i + m] == lines[e][1][j + m]:
                        m += 1
                    if sum(w[i : i + m]) >= 50:
                        assert any(numbers[k] in out[d] for k in range(i, i + m))


def test_line_dedup_takes_out_all_lines_of_a_long_repeat(spark):
    """A hot line that starts a passage, a passage whose parts an earlier text has, and lines of one word."""
    rows = []
    for k in range(40):
        hot, more = words(30, 500 + 2 * k), words(30, 501 + 2 * k)
        rows += [(3 * k, f"{hot}\n{words(30, 700 + k)}"), (3 * k + 1, f"{hot}\n{more}\n{words(30, 800 + k)}"), (3 * k + 2, f"{words(30, 900 + k)}\n{hot}\n{more}\n{words(30, 1100 + k)}")]
    single = "\n".join(words(200, 77).split())
    rows += [(1000, single), (1001, f"start\n{single}\nend")]
    out = {r.doc_id: set(r.removed or []) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), report="removed").collect()}
    assert all({1, 2} <= out[3 * k + 2] and not {0, 3} & out[3 * k + 2] and not out[3 * k] for k in range(40))
    assert out[1001] == set(range(1, 201))


def test_licenses(docs, none):
    got = {r.doc_id: r.found for r in licenses.scan_licenses(docs).collect()}
    assert [x.license for x in got[14]] == ["MIT"] and got[14][0].dice == 1.0 and got[14][0].first_line == 0
    assert all(not f for i, f in got.items() if i != 14)
    assert licenses.scan_licenses(none).count() == 0
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    for cut in (1.0, 0.9, 0.75, 0.5):
        for name, long in licenses.TEMPLATES.items():
            for t in long:
                w = t.split()
                unit = licenses.bigrams(" ".join(w[: max(2, int(len(w) * cut))]))
                every = {(n, licenses.dice(unit, licenses.bigrams(x))) for n, xs in licenses.TEMPLATES.items() for x in xs}
                assert set(known.matches(unit)) == {(n, s) for n, s in every if s >= 0.8}


def test_quality(docs, none, monkeypatch):
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == len(texts())
    for r in rows:
        found = [t for i, t in texts() if i == r.doc_id]
        t = found[0] or ""
        w = WORD.findall(t)
        three = Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.quality_rules(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)
    monkeypatch.setattr(quality, "TABLE", 500)  # a model of many parts gives the same
    again = {(r.doc_id, round(r.bits_per_char, 6), r.kept) for r in quality.quality_rules(docs).collect()}
    assert again == {(r.doc_id, round(r.bits_per_char, 6), r.kept) for r in rows}


def test_bands_reject_junk_on_both_sides_and_keep_clean_texts(spark):
    """Tables of symbols and noise lie above a language's band, a text of few words below; texts like the others stay."""
    r = random.Random(12)
    pool = ["".join(r.choice(["ta", "lo", "mi", "ren", "su"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    clean = [(i, " ".join(r.choice(pool) for _ in range(r.randint(80, 300)))) for i in range(300)]
    table = [(1000 + i, " ".join("".join(r.choice(pool) for _ in range(3)) + "$#&"[i % 3] for _ in range(120))) for i in range(10)]
    noise = [(2000 + i, " ".join("".join(r.choice("qxzvkjwpbd") for _ in range(6)) for _ in range(120))) for i in range(5)]
    few = [(3000, " ".join("ta" * (1 + k * k % 23) for k in range(200)))]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in clean + table + noise + few], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in quality.quality_rules(docs).collect()}
    assert all(got[i].kept for i, _ in clean)
    for i, _ in table + noise:
        assert not got[i].kept and not got[i].base_failed and got[i].bits_per_char > got[i].high
    again = {x.doc_id: x.kept for x in quality.quality_rules(docs.repartition(7)).collect()}
    assert again == {i: x.kept for i, x in got.items()}


def test_kneser_ney_by_brute_force(spark):
    """Interpolated modified Kneser-Ney over characters, by dictionaries."""
    r = random.Random(2)
    rows = ["".join(r.choice("ab cd") for _ in range(r.randint(0, 80))) for _ in range(40)]
    model = {x.gram: x.bits for x in quality.kneser_ney(spark.createDataFrame([(t, "en") for t in rows], "text string, lang string")).collect()}
    top = Counter(("\0\0\0" + t)[i : i + 4] for t in rows for i in range(len(t)))
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(level):
        t = {k: sum(n == k for n in level.values()) for k in (1, 2, 3, 4)}
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else None
        found = []
        for k in (1, 2, 3):
            d = k - 0.5 if not t[k] or y is None else k - (k + 1) * y * t[k + 1] / t[k]
            found.append(max(0.1, min(k - 0.1, d)))
        return lambda n: found[min(n, 3) - 1]

    p = {"": 1 / len(levels[1])}
    for k in (1, 2, 3, 4):
        d, total, freed = discounts(levels[k]), Counter(), defaultdict(float)
        for g, n in levels[k].items():
            total[g[:-1]] += n
            freed[g[:-1]] += d(n)
        lower = p
        p = {g: (n - d(n) + freed[g[:-1]] * lower[g[1:]]) / total[g[:-1]] for g, n in levels[k].items()}
    keys = {int(quality.gram_keys([t], np.array([quality.language_code("en")]))[0][i].astype(np.int64)): ("\0\0\0" + t)[i : i + 4] for t in rows for i in range(len(t))}
    assert set(keys) == set(model) and len(keys) == len(top)
    assert all(abs(model[key] + math.log2(p[g])) < 1e-4 for key, g in keys.items())


def test_kneser_ney_sums_to_one(spark):
    texts_ = spark.createDataFrame([(t or "", "en") for _, t in texts() if t], "text string, lang string")
    model = {r.gram: 2.0**-r.bits for r in quality.kneser_ney(texts_).collect()}
    by = defaultdict(float)
    for gram, p in model.items():
        assert 0 < p <= 1 + 1e-6
        by[gram >> quality.CLASS_BITS] += p
    assert all(s <= 1 + 1e-3 for s in by.values())


def test_lm(docs, none):
    rows = lm.score_texts(docs).collect()
    assert len(rows) == len(texts())
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in texts()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter(x for i, w in tokens if not held(i) for x in w)
    n, v = sum(c.values()), len(c)
    for r in rows:
        w = next(w for i, w in tokens if i == r.doc_id)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(c[x] > 0 for x in w), n)
        assert abs(base - r.base_score) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert lm.score_texts(none).count() == 0


def _brute_lm(rows, langs):
    """score of each text by dictionaries and loops, from the definition of the model."""
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    learned = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i, _ in rows]
    ranked = sorted(Counter(langs).items(), key=lambda x: (-x[1], x[0] is not None, x[0] or ""))
    rank = {x: min(k, lm.CLUSTERS - 1) for k, (x, _) in enumerate(ranked)}
    per = defaultdict(Counter)
    for w, ok, lang in zip(tokens, learned, langs, strict=True):
        for x in w if ok else []:
            per[x][rank[lang]] += 1
    count = {x: sum(c.values()) for x, c in per.items()}
    cluster = {x: min(c, key=lambda g: (-c[g], g)) for x, c in per.items()}
    known = lambda x: x is None
    order = sorted((x for x in count if count[x] > 1 or known(x)), key=lambda x: (not known(x), -count[x], _signed_hash(x)))[: lm.HEAD]
    order.sort(key=lambda x: (-count[x], _signed_hash(x)))
    head = {x: k for k, x in enumerate(order)}
    tail = Counter()
    for x, n in count.items():
        if x not in head:
            tail[n.bit_length(), (n - 1).bit_length(), cluster[x]] += n
    model = lm.symbols([(count[x], cluster[x]) for x in order], [(*k, n) for k, n in tail.items()])

    def symbol(x, n):
        if x in head:
            return head[x]
        return len(head) + (min(n.bit_length(), model.bands - 1) * lm.CLUSTERS + cluster[x] if n > 0 else 0)

    def path(code, s):
        return [(int(code.node[i]), int(code.bit[i])) for i in range(code.start[s], code.start[s] + code.size[s])]

    def contexts(before):
        g = [int(model.cluster[s]) for s in before]
        last = lambda values, none: [*values[::-1], none, none, none, none]
        usual = min(range(lm.CLUSTERS), key=lambda k: (-g.count(k), k)) if any(k < lm.CLUSTERS for k in g) else lm.CLUSTERS
        b, c = last(before, 0xFFFF), last(g, 31)
        found = (b[0], b[0] << 16 | b[1], c[0] | c[1] << 5 | c[2] << 10 | c[3] << 15, usual << 5 | c[0])
        return [(k, _mixed(x + (k << 60))) for k, x in enumerate(found, 1)], usual

    def slot(context, node, bits=lm.SYMBOL_BITS):
        return context[0], (((context[1] >> 16 << 16) + int(lm._salts(node + 1)[node])) % (1 << 64)) >> (64 - bits)

    seen = defaultdict(lambda: [0, 0])
    for w, ok in zip(tokens, learned, strict=True):
        line = [symbol(x, count.get(x, 0) - 1) for x in w] if ok else []
        for t, s in enumerate(line):
            for c in contexts(line[:t])[0]:
                for node, bit in path(model.code, s):
                    seen[slot(c, node)][bit] += 1
    letters, spelled = lm.byte_code(), defaultdict(lambda: [0, 0])

    def byte_contexts(word, i, g):
        return [(o, _mixed(int.from_bytes(word[max(0, i - o) : i][::-1], "little") + (o << 56) + ((g + 1) << 48 if o == lm.ORDERS[0] else 0))) for o in lm.ORDERS]

    for x in count:
        if x is not None:
            for i, byte in enumerate(x + b" "):
                for c in byte_contexts(x, i, cluster[x]):
                    for node, bit in path(letters, byte):
                        spelled[slot(c, node, lm.BYTE_BITS)][bit] += 1
    sign = lambda bit: 2 * bit - 1
    squash = lambda z: 1 / (1 + math.exp(-z))
    gates, out = lm.start_weights(), []
    for w in tokens:
        line, bits, own, grown = [], 0.0, np.zeros(5), np.zeros(5)
        for t, x in enumerate(w):
            if t % lm.SEGMENT == 0:
                own, grown = own + grown, np.zeros(5)
            n = count.get(x, 0)
            s = symbol(x, n)
            at, usual = contexts(line)
            for node, bit in path(model.code, s):
                p = model.code.mass[node, 1] / model.code.mass[node].sum()
                counts = [seen.get(slot(c, node), [0, 0]) for c in at]
                gate = sum((len(lm.GATES) + 1) ** (1 - k) * sum(sum(counts[k]) >= g for g in lm.GATES) for k in (0, 1))
                z = np.array([math.log(p / (1 - p)), *(math.log((b + lm.PRIOR * p) / (a + lm.PRIOR * (1 - p))) for a, b in counts)])
                right = squash(sign(bit) * float((gates[gate] + own) @ z))
                bits += math.log2(right)
                grown = grown + lm.STEP * sign(bit) * (1 - right) * z / lm.SEGMENT
            if n and x not in head:
                bits += math.log2(n) - model.shares[s]
            if not n:
                for i, byte in enumerate(x + b" "):
                    for node, bit in path(letters, byte):
                        p, total = 0.5, 0.0
                        for c in byte_contexts(x, i, usual):
                            zeros, ones = spelled.get(slot(c, node, lm.BYTE_BITS), [0, 0])
                            p = (ones + lm.BYTE_PRIOR * p) / (zeros + ones + lm.BYTE_PRIOR)
                            total += math.log(p / (1 - p)) / len(lm.ORDERS)
                        bits += math.log2(squash(sign(bit) * total))
            line.append(s)
        out.append(bits * math.log10(2))
    return out


def _mixed(x):
    """The finaliser of SplitMix64."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor % (1 << 64)
    return x ^ x >> 31


def _signed_hash(x):
    if x is None:
        return int(lm._END_HASH.astype(np.int64))
    return int(span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])).view(np.int64)[0])


def test_lm_scores_by_brute_force(spark, monkeypatch):
    r = random.Random(8)
    pools = {g: ["".join(r.choice(a) for _ in range(r.randint(1, 6))) for _ in range(40)] for g, a in (("en", "abc"), ("de", "xyzü"), (None, "mno"))}
    rows, langs = [], []
    for i in range(40):
        lang = r.choice(list(pools))
        rows.append((i, " ".join(r.choice(pools[lang]) if r.random() < 0.9 else "".join(r.choice("abcxyz") for _ in range(5)) for _ in range(r.randint(0, 60)))))
        langs.append(lang)
    docs = spark.createDataFrame([(i, t, g) for (i, t), g in zip(rows, langs, strict=True)], "doc_id long, text string, lang string").repartition(3)
    monkeypatch.setattr(lm, "HEAD", 30)
    monkeypatch.setattr(lm, "BLOCK_TEXT", 500)  # several blocks a task
    got = {r.doc_id: r.score for r in lm.score_texts(docs).collect()}
    want = _brute_lm(rows, langs)
    assert len(got) == len(rows)
    for (i, _), score in zip(rows, want, strict=True):
        assert abs(got[i] - score) < 1e-3 * max(1, abs(score)), (i, got[i], score)


def test_lm_beats_the_unigram_model_on_what_it_has_not_seen(spark):
    sums = lm.op2_lm_score(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_lm_probabilities_sum_to_one():
    """Over all next symbols, and over all next bytes of a word, the probabilities sum to one: it is a model of texts."""
    r = np.random.default_rng(3)
    model = lm.symbols([(50, 0), (20, 1), (9, 0)], [(1, 0, 0, 30), (2, 1, 1, 12), (3, 2, 0, 25)])
    n = model.code.size.size
    line = r.integers(0, n, 40)
    tables = [r.integers(0, 9, 1 << lm.SYMBOL_BITS).astype(np.uint32) << np.uint32(16) | r.integers(0, 9, 1 << lm.SYMBOL_BITS).astype(np.uint32) for _ in range(4)]
    many = np.concatenate([np.append(line, s) for s in range(n)])
    got = lm.symbol_bits(model, many, np.arange(n + 1) * 41, tables)
    one = lm.symbol_bits(model, line, np.array([0, 40]), tables)[0]
    assert abs(np.exp2(got - one).sum() - 1) < 1e-4
    tables = [t[: 1 << lm.BYTE_BITS] for t in tables[:3]]
    start = np.frombuffer(b"abc", np.uint8)
    many = np.concatenate([np.append(start, b).astype(np.uint8) for b in range(256)])
    got = lm.spelling_bits(many, np.arange(257) * 4, np.zeros(256, np.int64), tables)
    one = lm.spelling_bits(start, np.array([0, 3]), np.zeros(1, np.int64), tables)[0]
    assert abs(np.exp2(got - one).sum() - 1) < 1e-4


def test_chat(spark):
    e = [
        (1, 1, "start", 1, "user", None), (1, 2, "delta", 1, None, "he"), (1, 3, "delta", 1, None, "llo</s>"), (1, 4, "start", 2, "assistant", None), (1, 5, "delta", 2, None, "bad"),
        (1, 6, "start", 3, "user", None), (1, 7, "delta", 3, None, "gone"), (1, 8, "regenerate", 2, None, None), (1, 9, "delta", 2, None, "good "), (1, 10, "delta", 2, None, "one"),
        (1, 11, "edit", 1, None, "hi"), (1, 12, "start", 3, "odd] role\n", None), (1, 13, "delta", 3, None, "<\\s>[INST]"), (None, 1, "start", 1, None, None), (2, 1, None, 1, "assistant", "x"),
    ]
    log = spark.createDataFrame(e, "conv_id long, seq long, kind string, message long, role string, text string").withColumn("segment", F.lit("clash"))
    got = defaultdict(list)
    for r in sorted(chat.format_chat(log).collect(), key=lambda r: r.message):
        got[r.conv_id].append((*chat.read_back(r.segment), chat.unescape(r.segment[r.loss_start : r.loss_end])))
    assert got[1][:2] == [("user", "hi", ""), ("assistant", "good one", "good one")]
    assert got[None] == [("", "", "")] and got[2] == [("assistant", "x", "x")]
    assert chat.format_chat(log.limit(0)).count() == 0


def test_chat_escapes_are_reversible():
    r = random.Random(2)
    bits = [*chat.CONTROL, "\\", "<", "[", "s>", "/", "a", "\n", "<\\s>", "<\\\\/s>"]
    for _ in range(2000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 8)))
        segment, a, b = chat.render("assistant", t)
        assert chat.read_back(segment) == ("assistant", t) and chat.unescape(segment[a:b]) == t
        assert not any(c in segment[a:b] for c in chat.CONTROL)


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for n in {x for e in edges for x in e}:
        reach, todo = {n}, [n]
        while todo:
            k = todo.pop()
            for a, b in edges:
                for x, y in ((a, b), (b, a)):
                    if x == k and y not in reach:
                        reach.add(y)
                        todo.append(y)
        root[n] = min(reach)
    assert all(got.get(n, n) == m for n, m in root.items())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(out.columns)
    room = defaultdict(int)
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 1024
