"""Small tables for what reviews found: ties of seq, names parsed once, offerings worked out once."""

import datetime
import re

from pyspark.sql import functions as F

from seatwise.functions import documents, names, text
from seatwise.operators import extraction, learn, store
from seatwise.plans import adapter, html, scans


def tables(spark, folder, lines, parts):
    """lineitem (orderkey, linenumber, partkey, suppkey, day), part (partkey, brand, size) and no pages, as files."""
    line = spark.createDataFrame([(o, p, s, n, datetime.datetime.combine(d, datetime.time())) for o, n, p, s, d in lines], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp")
    part = spark.createDataFrame([(k, "green bolt", b, "SMALL", z) for k, b, z in parts], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    line.write.parquet(f"{folder}/lineitem.parquet")
    part.write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_rows_of_one_seq_stand_by_section(spark, tmp_path):
    day = datetime.date(1992, 1, 5)  # term 1201: 1 modulo 3, so the holder's name stands before the section
    assert 1201 % 3 == 1
    folder = tables(spark, tmp_path, [(2, 1, 1, 9, day), (2, 1, 2, 1, day)], [(1, "B", 0), (2, "B", 1)])  # A1 by S9 and B1 by S1, both of seq 17
    got = {(r.row, r.section, r.instructor) for r in html.class_rows(spark, folder).collect()}
    assert got == {(1, "A1", "S9, ANA"), (2, "B1", "S1, ANA")}


def test_names_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "Dr. Juan dela Cruz Jr."), (2, "DE LA ROSA, Ana M."), (3, None), (4, "---"), (5, "Dr. Juan dela Cruz Jr.")], "id int, raw string")
    keyed = names.with_keys(rows, "raw")
    got = {r.id: (r.surname, r.given, r.key, r.display, r.variants) for r in keyed.collect()}
    assert len(got) == 5 and got[1] == got[5] == ("DELA CRUZ", "JUAN", "DELA CRUZ|J", "DELA CRUZ, JUAN", "DELACRUZ,DELA,DELACRUZJUAN,CRUZ,CRUZJUAN,JUAN")
    assert got[2][:4] == ("DE LA ROSA", "ANA M", "DE LA ROSA|A", "DE LA ROSA, ANA M.") and got[3] == ("", "", "", "", "") and got[4][0] == "---"
    for f in (names.canonical_key, names.display_name, names.surname_variants):  # names were cleaned again wherever a part was used, 180 to 252 times
        plan = rows.select(f(F.col("raw")))._jdf.queryExecution().analyzed().toString()
        assert plan.count("translate(") <= 12, (f, plan.count("translate("))


def test_offerings_read_the_line_items_once(spark, tmp_path):
    folder = tables(spark, tmp_path, [(2, 1, 1, 9, datetime.date(1992, 1, 5)), (3, 1, 1, 8, datetime.date(1992, 1, 6))], [(1, "B", 0)])
    rows = adapter.offerings(spark, folder)
    assert [(r.section, r.prof_key) for r in rows.collect()] == [("A1", "S9")]
    assert not any("lineitem" in f for f in rows.inputFiles())  # before, each place that used the rows read and grouped all line items again


def test_a_schedule_is_searched_once_for_its_clocks(spark):
    notes = spark.createDataFrame([(1, "TTh 7:00 AM - 8:30 AM, HALL A"), (2, "MWF"), (3, None)], "id int, note string")
    found = notes.select("id", text.schedule(F.col("note")).alias("s"))
    assert [tuple(r.s) if r.s else None for r in found.orderBy("id").collect()] == [("TTH", "7:00 AM", "8:30 AM", "HALL A"), ("MWF", "", "", ""), None]
    assert found._jdf.queryExecution().analyzed().toString().count("coalesce(note") == 1  # before, the text was tidied at each of its uses


def test_scans_read_the_line_items_once(spark, tmp_path):
    folder = tables(spark, tmp_path, [(2, 1, 1, 9, datetime.date(1992, 1, 5)), (3, 1, 1, 8, datetime.date(1992, 1, 6))], [(1, "B#1", 0)])
    wanted, sources = scans._sources(spark, folder)  # 1 + 1201 is 2 modulo 5 and 2 modulo 3
    assert [tuple(r) for r in wanted.collect()] == [("B#1", 1201)] and [rows.count() for _, _, rows in sources] == [2, 2]
    assert not any("lineitem" in f for _, outcomes, rows in sources for f in [*wanted.inputFiles(), *outcomes.inputFiles(), *rows.inputFiles()])


def test_each_instructor_of_a_scan_is_parsed_once(spark):
    said = [("a", "S1 AND TBA and Dr. Ana Cruz", 1), (" a ", "S1 AND TBA and Dr. Ana Cruz", 2), ("b", None, 3), ("", "S1", 4), (None, "S1", 5), ("c", "TBA", 6), ("c", "TBA", 7)]
    rows = store.canonical(spark.createDataFrame(said, "section string, instructor string, seq long"))
    assert rows.columns == ["section", "instructor", "seq", "prof_key"]
    got = sorted((r.section, r.instructor, r.prof_key, r.seq) for r in rows.collect())
    assert got == sorted([*(("A", n, k, q) for q in (1, 2) for n, k in (("S1", "S1"), ("Dr. Ana Cruz", "CRUZ|A"))), ("B", "", "", 3), ("C", "", "", 6), ("C", "", "", 7)])
    assert "split(" not in rows._jdf.queryExecution().analyzed().toString()  # before, each row's names were split and parsed


def test_what_holds_no_list_is_not_searched_for_one(spark):
    docs = spark.createDataFrame([('{"a":{"b":1},"c":[{"x":1},{"x":2}],"d":{"e":[{"section":"S1"}]},"f":[[1],2]}',), ("[]",), (None,), ('{"a":1}',)], "doc string")
    node = documents.entries(F.col("doc"), 1, "node")
    assert [[e.path for e in r.e if e.depth == 1] for r in docs.select(node.alias("e")).collect()] == [["d.e", "f.0", "f.1"], [], [], []]  # before, a.b and the elements of c too
    assert [r.l and tuple(r.l) for r in docs.select(documents.record_array(F.col("doc")).alias("l")).collect()] == [("d.e", '[{"section":"S1"}]'), ("", "[]"), None, None]


def test_parts_are_not_broadcast_and_the_first_row_of_a_seat_stays(spark, tmp_path):
    day = datetime.date(1995, 2, 5)
    folder = tables(spark, tmp_path, [(2, 4, 2, 9, day), (2, 4, 2, 10, day), (1, 7, 2, 7, day), (3, 2, 1, 5, day), (2, 2, 1, 6, day), (1, 2, 9, 1, day), (None, 4, 2, 1, day), (None, 5, 1, 8, day)], [(1, "B", 0), (2, "B", 8), (3, "C", 1)])
    got = sorted((r.course_code, r.term, r.section, r.prof_key, r.seq) for r in adapter.offerings(spark, folder).collect())
    assert got == [("B", 1231, "A-1L", "S6", 18), ("B", 1231, "A1", "S7", 15)]  # before, lines without an order stood first; its SQL has them last
    joined = spark.range(9).join(adapter.shuffled_parts(spark, folder, "p_brand"), F.col("id") == F.col("p_partkey"))
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 3  # before, all parts passed through the driver


def test_no_join_of_offerings_sends_the_parts_through_the_driver(spark, tmp_path):
    folder = tables(spark, tmp_path, [(2, 1, 1, 9, datetime.date(1992, 1, 5)), (3, 1, 1, 8, datetime.date(1992, 1, 6))], [(1, "B", 0)])
    ran, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def last():
        bus.waitUntilEmpty()
        few = ran.executionsList(max(0, ran.executionsCount() - 9), 9)
        return {e.executionId(): e.physicalPlanDescription() for e in map(few.apply, range(few.size()))}

    known = max(last(), default=-1)
    assert adapter.offerings(spark, folder).count() == 1
    plans = [p for i, p in last().items() if i > known]
    joins = [x for p in plans for x in re.findall(r"^\(\d+\) (\w+)[^\n]*\n((?:[^\n]+\n)*)", p, re.M) if "p_partkey" in x[1] and "Join" in x[0]]
    assert joins and {name for name, _ in joins} == {"ShuffledHashJoin"}  # before, BroadcastHashJoin: 143.8 MB on 60 times sf0.1, and more with each part


def test_a_search_asks_for_what_is_used_and_lowers_few_keys(spark):
    docs = spark.createDataFrame([('{"ID":1,"id":"7","course":{"code":"ARTS 1"},"SECTION":"S1","instructor":"CRUZ, ANA"}',), ('{"id":8,"claK":1}',), ('[1]',), (None,)], "doc string")
    found = extraction.records(docs, "doc", F.lit("ARTS 1"))
    assert [(r.class_id, r.section, r.instructor, r.days, r.paths) for r in found.collect()] == [("1", "S1", "CRUZ, ANA", "", ["section:SECTION", "instructor:instructor"])]
    plan = found.select("class_id", "section")._jdf.queryExecution().optimizedPlan().toString()
    assert "schedule_days" not in plan and "teaching_staff" not in plan  # before, instructor and schedule were searched though nobody asked for them
    entry = spark.createDataFrame([("section",), ("Section",), ("booK",), ("BOOK",), ("Über",), ("sections",)], "key string").select(F.struct("key").alias("e"))
    assert [r.k for r in entry.select(documents.keyed(F.col("e"), ["section", "book"]).alias("k")).collect()] == [True, True, True, True, False, False]
    responses = [('{"a":[{"x":1}],"b":{"c":[{"y":{"z":{"Section":"S"}}},{"x":2}]}}',), ('[{"section":{"id":1}}]',), ('[{"section":""},{"section":"S"}]',), ('{"a":[{"x":1},{"x":2}],"b":[{"x":1},{"x":2}]}',)]
    lists = spark.createDataFrame(responses, "doc string").select(documents.record_list(F.col("doc")).alias("l"))
    assert [r.l and (r.l.path, len(r.l.rows)) for r in lists.collect()] == [("b.c", 2), ("", 1), None, ("a", 2)]


def test_a_course_without_a_forest_has_no_importances(spark):
    own = lambda course, n, hits: [(course, 1, f"S{i}", f"P{i % 7}", i, f"P{i % 7}" if hits and i % 3 == 0 else "new", *(float(i * (k + 3) % 11) for k in range(len(learn.FEATURES)))) for i in range(n)]
    kinds = "course_code string, target int, section string, prof_key string, cand_seq long, truth string, " + ", ".join(f"{f} double" for f in learn.FEATURES)
    rows = spark.createDataFrame(own("whole", 60, True) + own("few rows", 10, True) + own("holders all new", 60, False), kinds)
    got = learn.importances(rows).collect()  # failed by TypeError before, wherever a course had no forest
    assert [r.feature for r in got] == learn.FEATURES and {r.course_code for r in got} == {"whole"} and abs(sum(r.importance for r in got) - 1) < 1e-9
    assert learn.importances(rows.filter("course_code <> 'whole'")).count() == 0
