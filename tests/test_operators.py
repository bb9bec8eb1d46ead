"""Operators on small tables: a stable department end to end, the store, sources and invariants."""

import json

import numpy as np
from pyspark.sql import functions as F

from seatwise.operators import ensemble, history, learn, store
from seatwise.sources.html_tables import cells_of
from seatwise.sources.paged_json import PagedJson, pages
from seatwise.streaming.registry import current, merge_into

TERMS = [1231, 1232, 1233, 1241, 1242, 1243, 1251, 1252, 1253]
SEATS = [("S1", "T TH", "7:00 AM", "HALL A", "ROSA"), ("S2", "T TH", "8:00 AM", "HALL A", "QUIMBO"), ("S3", "W F", "10:00 AM", "RM 104", "TARDEN"), ("S4", "W F", "1:00 PM", "HALL B", None)]


def department(spark, target=1261):
    rows = [("ARTS 1", t, s, p or ("PALUGA" if t >= 1243 else "OSTREA"), d, a, r, i * 10 + k) for i, t in enumerate([*TERMS, target]) for k, (s, d, a, r, p) in enumerate(SEATS)]
    return spark.createDataFrame(rows, "course_code string, term int, section string, prof_key string, days string, time_start string, room string, seq long")


def predict(spark, rows, target):
    terms = spark.createDataFrame([(target,)], "target int")
    ev, seats = history.evidence(rows, terms), history.seats_of(rows, terms)
    scored = history.heuristic(history.features(seats, ev)).withColumn("score", F.col("heuristic"))
    return ensemble.posterior(scored, history.novelty_rate(rows, terms))


def test_stable_department(spark):
    post = predict(spark, department(spark), 1261).collect()
    first = {r.section: r for r in post if r["rank"] == 1}
    assert {s: r.prof_key for s, r in first.items()} == {"S1": "ROSA", "S2": "QUIMBO", "S3": "TARDEN", "S4": "PALUGA"} and first["S1"].prob > 0.5
    total = {}
    for r in post:
        total[r.section] = total.get(r.section, 0) + r.prob
    assert all(abs(t - 1) < 1e-9 for t in total.values())


def test_nothing_of_the_target_or_later_leaks(spark):
    rows = department(spark)
    other = rows.withColumn("prof_key", F.when(F.col("term") >= 1261, "STRANGER").otherwise(F.col("prof_key")))
    a, b = ({(r.section, r.prof_key, round(r.prob, 9)) for r in predict(spark, x, 1261).collect()} for x in (rows, other))
    assert a == b and not any(p == "STRANGER" for _, p, _ in b)


def test_pin_gives_five_times_a_typical_model():
    w = ensemble.pin({k: 1.0 for k in ["heuristic", *ensemble.SPECIALISTS]})
    others = [v for k, v in w.items() if k not in ensemble.CROSS]
    assert abs(sum(w.values()) - 1) < 1e-9 and abs(sum(w[k] for k in ensemble.CROSS) - 5 * sum(others) / len(others)) < 1e-9


def test_assignment():
    cost = np.array([[4.0, 1, 3], [2, 0, 5], [3, 2, 2]])
    assert cost[np.arange(3), learn.assign(cost)].sum() == 5
    from itertools import permutations

    r = np.random.default_rng(1)
    for _ in range(30):
        c = r.random((4, 6))
        assert abs(c[np.arange(4), learn.assign(c)].sum() - min(sum(c[i, p[i]] for i in range(4)) for p in permutations(range(6), 4))) < 1e-9


def test_learners_separate():
    i = np.arange(200)
    x = np.stack([(i % 20) / 20, ((i * 7) % 11) / 11, ((i * 3) % 5) / 5], 1)
    y = (x[:, 0] > 0.6).astype(float)
    forest, gains = learn.fit_forest(x, y, **learn.FOREST)
    for score in (forest(x), learn.fit_logistic(x, y, **learn.LOGISTIC)(x)):
        assert score[y == 1].min() > score[y == 0].max() - 0.35 and ((score > 0.5) == y).mean() > 0.95
    assert gains[0] > 0.3


def test_store(spark):
    rows = spark.createDataFrame([("A", 1251, "s1", "", 1), ("A", 1251, "S1", "QUIMBO, LENA AND TARDEN, IRIS", 2), ("A", 1251, "S2", "TBA", 3), ("A", 1251, "S2", "", 4), ("A", 1251, "", "X", 5), ("A", 1251, "S1", "QUIMBO, LENA", 6)], "course_code string, term int, section string, instructor string, seq long")
    got = {(r.section, r.prof_key, r.seq) for r in store.dedupe(store.canonical(rows)).collect()}
    assert got == {("S1", "QUIMBO|L", 2), ("S1", "TARDEN|I", 2), ("S2", "", 3)}


def test_latest_wins_keeps_the_earlier_of_equal_times(spark):
    log = spark.createDataFrame([("k", 5, 1, "a"), ("k", 5, 2, "b"), ("k", 3, 3, "c"), ("j", 1, 4, "d")], "key string, at long, arrival long, v string")
    assert {(r.key, r.v) for r in store.latest_wins(log, ["key"]).collect()} == {("k", "a"), ("j", "d")}
    assert {r.v for r in store.accepted(log, ["key"]).collect()} == {"a", "d"}


def test_pages_end_where_they_should(spark, tmp_path):
    def read(n):
        return {1: {"classes": {"data": [{"section": "A"}], "last_page": 3}}, 2: {"classes": {"data": [{"section": "B"}], "last_page": 3}}, 3: {"classes": {"data": [{"section": "A"}], "last_page": 3}}}[n]

    assert [(n, r) for n, r in pages(read)] == [(1, [{"section": "A"}]), (2, [{"section": "B"}])]
    assert len(list(pages(lambda n: {"data": [{"section": str(n)}]}))) == 1
    for n in (1, 2):
        (tmp_path / f"PI-1251-{n}.json").write_text(json.dumps({"data": [{"section": f"S{n}"}], "meta": {"last_page": 2}}))
    spark.dataSource.register(PagedJson)
    got = spark.read.format("paged_json").option("path", str(tmp_path) + "/{course}-{term}-{page}.json").option("pairs", json.dumps([["PI", 1251]])).load().collect()
    assert [(r.course_code, r.term, r.page, json.loads(r.row)) for r in got] == [("PI", 1251, 1, {"section": "S1"}), ("PI", 1251, 2, {"section": "S2"})]


def test_cells():
    html = "<table><tr><th>Code</th><th>Section</th></tr><tr><td>PI <b>10</b></td><td>A &amp; B</td></tr></table><p>x</p><script>var t='<td>';</script>"
    assert cells_of(html) == [(1, 0, ["Code", "Section"]), (1, 1, ["PI 10", "A & B"]), (1, 2, ["x"])]


def test_registry_stream(spark, tmp_path):
    merge = merge_into(str(tmp_path))
    kind = "course_code string, term int, section string, at long, prof_key string"
    merge(spark.createDataFrame([("A", 1251, "S1", 5, "x"), (None, 1251, "S1", 9, "z")], kind), 0)
    merge(spark.createDataFrame([("A", 1251, "S1", 5, "late"), ("A", 1251, "S2", 1, "y")], kind), 1)
    merge(spark.createDataFrame([("A", 1251, "S2", 2, "new")], kind), 2)
    assert {(r.section, r.prof_key) for r in current(spark, str(tmp_path)).collect()} == {("S1", "x"), ("S2", "new")}


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
