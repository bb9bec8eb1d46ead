"""Weights from held-out accuracy, partner features without pairs, and incremental scans."""

import math
import random
import uuid

from pyspark.sql import functions as F

from seatwise.operators import cohorts, scan, weighting
from seatwise.operators.lineage import shared_dir

MODELS = ["heuristic", "slot", "recent", "cooccur", "bundle"]


def weights(spark, rows):
    table = spark.createDataFrame([(c, m, float(w)) for c, per in rows.items() for m, w in per.items()], "course_code string, model string, weight double")
    out = {}
    for r in weighting.pinned(table).collect():
        out.setdefault(r.course_code, {})[r.model] = r.weight
    return out


def test_pinned_weights(spark):
    rows = {
        "flat": dict.fromkeys(MODELS, 0.2), "none": {"heuristic": 0.5, "slot": 0.5, "recent": 0, "cooccur": 0, "bundle": 0}, "alone": {"heuristic": 1, "slot": 0, "recent": 0, "cooccur": 0, "bundle": 0},
        "split": {"heuristic": 0.3, "slot": 0.1, "recent": 0, "cooccur": 0.45, "bundle": 0.15},
    }
    got = weights(spark, rows)
    assert all(math.isclose(sum(w.values()), 1) for w in got.values())
    assert math.isclose(got["flat"]["cooccur"] + got["flat"]["bundle"], 5 * got["flat"]["slot"])
    assert got["none"]["cooccur"] == got["none"]["bundle"] and math.isclose(got["none"]["cooccur"] * 2, 5 * got["none"]["slot"])
    assert got["alone"] == rows["alone"]
    assert math.isclose(got["split"]["cooccur"], 3 * got["split"]["bundle"]) and math.isclose(got["split"]["cooccur"] + got["split"]["bundle"], 2.5 * (got["split"]["heuristic"] + got["split"]["slot"]))


def test_derived_weights_square_accuracy_and_keep_the_heuristic(spark):
    ranked = spark.createDataFrame([("c", 1, s, p, m, r, "a") for s in "xyz" for m, first in (("heuristic", "b"), ("slot", "a" if s != "z" else "b")) for p, r in ((first, 1), ("ab".replace(first, ""), 2))], "course_code string, target int, section string, prof_key string, model string, rank int, truth string")
    seats = ranked.select("course_code", "target", "section").distinct()
    got = {r.model: (r.n, r.accuracy, r.weight) for r in weighting.derived(weighting.accuracies(ranked, seats, ["heuristic", "slot", "recent"])).collect()}
    raw = {"heuristic": 0.1, "slot": (2 / 3) ** 2, "recent": 0.0}
    assert all(got[m][0] == 3 and math.isclose(got[m][2], raw[m] / sum(raw.values())) for m in raw) and math.isclose(got["slot"][1], 2 / 3)


def test_partner_features_equal_all_pairs(spark):
    r, sections = random.Random(3), ["A", "A1", "A-1L", "B", "C2", "C"]
    history = [("c", 1261, t, s, s[0], r.choice("pqrst"), r.choice([0.5, 0.25, 1.0])) for t in range(1241, 1249) for s in sections if r.random() < 0.8]
    decay = {t: 2.0 ** -(1261 - t) for t in range(1241, 1249)}
    history = [(*h[:-1], decay[h[2]]) for h in history]
    ev = spark.createDataFrame(history, "course_code string, target int, term int, section string, family string, prof_key string, w double")
    guesses = [("c", 1261, s, s[0], p, r.choice([0.04, 0.3, 0.6])) for s in sections for p in r.sample("pqrstu", 2)]
    scored = [("c", 1261, s, s[0], p, 0.0, 0.0, 0.0) for s in sections for p in "pqrstu"]
    got = cohorts.partner_features(spark.createDataFrame(scored, "course_code string, target int, section string, family string, prof_key string, partner_cond double, partner_pair double, bundle_fit double"), spark.createDataFrame(guesses, "course_code string, target int, section string, family string, prof_key string, probability double"), ev)
    by_term = {}
    for _, _, t, s, f, p, w in history:
        by_term.setdefault(t, []).append((s, f, p, w))

    def given(key, other):
        base = hit = 0.0
        for rows in by_term.values():
            base += sum(w for *x, w in rows if key(x))
            hit += sum(w for *x, w in rows if key(x) for y in [q[:3] for q in rows] if other(x, y))
        return hit / base if base else 0.0

    def family(gf, gp, f, p):
        base = hit = 0.0
        for rows in by_term.values():
            one = {(x[1], x[2]): x[3] for x in rows}
            base += one.get((gf, gp), 0.0)
            hit += one.get((gf, gp), 0.0) * ((f, p) in one and (f, p) != (gf, gp))
        return hit / base if base else 0.0

    active = {p: sum(max((x[3] for x in rows if x[2] == p), default=0.0) for rows in by_term.values()) for p in "pqrstu"}
    together = lambda a, b: sum(max(x[3] for x in rows) for rows in by_term.values() if {a, b} <= {x[2] for x in rows})
    mean = lambda xs: sum(p * v for p, v in xs) / sum(p for p, _ in xs) if xs else 0.0
    for row in got.collect():
        others = [g for g in guesses if g[2] != row.section and g[5] >= 0.05]
        cond = []
        for _, _, gs, gf, gp, p in others:
            seat = given(lambda x, gs=gs, gp=gp: x[0] == gs and x[2] == gp, lambda x, y: y[0] == row.section and y[2] == row.prof_key and y[0] != x[0])
            cond.append((p, seat or family(gf, gp, row.family, row.prof_key)))
        pair = [(g[5], min(1.0, together(g[4], row.prof_key) / (min(active[g[4]], active[row.prof_key]) or 1))) for g in others if g[4] != row.prof_key]
        bundle = [(g[5], given(lambda x, g=g: x[1] == g[3] and x[2] == row.prof_key, lambda x, y: y[2] == row.prof_key and y[0] != x[0] and y[1] == row.family)) for g in others if g[4] == row.prof_key]
        assert math.isclose(row.partner_cond, mean(cond), abs_tol=1e-9) and math.isclose(row.partner_pair, mean(pair), abs_tol=1e-9) and math.isclose(row.bundle_fit, mean(bundle), abs_tol=1e-9)


ROW = "course_code string, term int, section string, instructor string, days string, time_start string, seq long"
OUTCOME = "course_code string, term int, ok boolean, pages int, exhausted boolean"


def test_scans(spark, monkeypatch):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    rows = lambda *r: spark.createDataFrame([(c, t, s, i, "M", "7:00 AM", k) for k, (c, t, s, i) in enumerate(r)], ROW)
    outcomes = lambda *r: spark.createDataFrame(list(r), OUTCOME)
    wanted = spark.createDataFrame([("c", 1261), ("c", 1262), ("c", 1263), ("d/ü", 1261), ("d/ü", 1271), ("c", 1261)], "course_code string, term int")
    dom = ("dom", outcomes(("c", 1261, True, 2, True), ("c", 1262, True, 2, True), ("c", 1263, True, 2, True), ("d/ü", 1261, False, None, None)), rows(("c", 1261, "a", "X, Y"), ("c", 1261, "a", "TBA"), ("c", 1262, "b", "X, Y"), ("c", 1263, "b", "X, Y")))
    api = ("api", outcomes(("d/ü", 1261, True, None, None)), rows(("d/ü", 1261, "z", "TBA")))
    run = lambda now, sources, forced=None: {(r.course_code, r.term): (r.status, r.source, r.total, r.revealed) for r in scan.scan(spark, path, wanted, sources, now, forced).collect()}
    held = lambda: {(r.course_code, r.term, r.section, r.prof_key) for r in scan.records(spark, path).collect()}
    first = run(0, [dom, api])
    assert first == {("c", 1261): ("done", "dom", 1, 1), ("c", 1262): ("done", "dom", 1, 1), ("c", 1263): ("done", "dom", 1, 1), ("d/ü", 1261): ("done", "api", 1, 0), ("d/ü", 1271): ("failed", None, None, None)}
    again = run(1000, [dom, api])
    assert {k for k, v in again.items() if v[0] == "done"} == set() and again["c", 1261][0] == "cached"  # the copied check saw no earlier rows at first
    assert run(2000, [dom, api], spark.createDataFrame([("c", 1263)], "course_code string, term int"))["c", 1263][0] == "done"
    assert {r.term for r in scan.scans(spark, path).filter("copied").collect()} == {1263}  # it repeats the term before, so it stays stale
    before = held()
    with monkeypatch.context() as m:  # the run breaks off before records are written
        calls = []
        m.setattr(scan, "_overwrite", lambda r, p, f=scan._overwrite: calls.append(p) or (f(r, p) if len(calls) < 2 else 1 / 0))
        try:
            run(3000, [dom, api])
        except ZeroDivisionError:
            pass
    assert held() == before - {x for x in before if x[1] == 1263 and x[0] == "c"}
    assert run(4000, [dom, api])["c", 1263][0] == "done" and held() == before
    gone = ("dom", dom[1], dom[2].filter("term <> 1263"))
    assert run(5000, [gone, api])["c", 1263][2] == 0 and held() == {x for x in before if x[1] != 1263}
