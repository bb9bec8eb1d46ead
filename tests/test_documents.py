"""JSON of unknown shape: search, names, record lists, and what is left out."""

import json

import pytest
from pyspark.sql import functions as F

from seatwise.functions import documents as d
from seatwise.operators import extraction


def column(spark, values, build):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, doc string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("doc"))).collect()]


def test_entries_go_level_by_level_in_the_documents_order(spark):
    doc = '{"b":{"z":1,"a":[1,{"q":"x"},[{"w":2}]]},"a":"{\\"k\\":1}","n":null,"b2":true}'
    got = column(spark, [doc, "[]", "7", "no json", "", None], lambda c: d.entries(c, 4))
    assert [(e.path, e.kind) for e in got[0]] == [("b", "OBJECT"), ("a", "STRING"), ("n", "VOID"), ("b2", "BOOLEAN"), ("b.z", "BIGINT"), ("b.a", "ARRAY"), ("b.a[1].q", "STRING"), ("b.a[2].0", "OBJECT"), ("b.a[2].0.w", "BIGINT")]
    assert got[1:] == [[]] * 5


def test_a_list_is_followed_for_six_items_and_four_levels(spark):
    wide = json.dumps({"rows": [{"section": ""}] * 5 + [{"section": "S6"}, {"section": "S7"}]})
    beyond = json.dumps({"rows": [{"x": 1}] * 6 + [{"section": "S7"}]})
    deep = json.dumps({"a": {"b": {"c": {"d": {"section": "D"}}}}})
    deeper = json.dumps({"a": {"b": {"c": {"d": {"e": {"section": "D"}}}}}})
    got = column(spark, [wide, beyond, deep, deeper], lambda c: d.find(d.entries(c, 4), d.SECTION)["path"])
    assert got == ["rows[5].section", None, "a.b.c.d.section", None]


def test_names(spark):
    values = ['"A, B"', "[\"TBA\", \"A, B\", null, \"A, B\", [\"C\"]]", '{"surname": "A"}', '{"last_name": "A", "given_name": " B ", "mi": "C."}', '{"lastname": null, "surname": "A"}', '{"name": " ", "prof": {"label": "X"}}', "[]", "null", "{}", "12"]
    got = column(spark, [f'{{"v": {v}}}' for v in values], lambda c: d.let(F.get(d.entries(c, 0), F.lit(0)), lambda e: d.resolved_name(e["text"], e["kind"])))
    assert got == ["A, B", "A, B / C", "A", "A, B C.", "A", "X", "", "", "", "12"]


@pytest.mark.parametrize("rows", [2])
def test_record_arrays(spark, rows):
    row = [{"course": {"code": "PI 10"}, "n": k} for k in range(rows)]
    docs = [{"classes": {"data": row}}, {"longer": [{"x": 1}] * 5, "data": row}, row, [], [{"x": 1}], {"a": [{"x": 1}], "b": [{"y": 2}, {"y": 3}]}, {"a": [1, 2]}, {"pages": [[{"section": "S"}]]}]
    got = column(spark, [*map(json.dumps, docs), "nothing", None], lambda c: d.record_array(c)["path"])
    assert got == ["classes.data", "data", "", "", None, "b", None, "pages.0", None, None]
    info = column(spark, ['{"meta":{"last_page":0,"total":"9"},"x":{"total_pages":3,"page":2}}', "{}", "[]"], d.page_info)
    assert [tuple(i) for i in info] == [(3, 2, 9), (None, 1, None), (None, 1, None)]


def test_records_leave_out_other_courses_and_rows_without_a_section(spark):
    docs = [
        (1, '{"course_code":"ARTS 1","section":"S1","instructor":"A, B","class_status":"Open","id":7}'), (2, '{"course_code":"PHILARTS 1","section":"S1"}'), (3, '{"course":{"course_code":"arts 1"},"section":"S3"}'),
        (4, '{"course_code":"ARTS 1"}'), (5, "[1]"), (6, None), (7, "{}"), (8, '{"section":"S8","schedules":[{"note":"x"},{"days":["M","W"],"start":"7:00 AM"}],"days":"F"}'), (8, '{"section":"S8","time":"garbage"}'),
    ]
    table = spark.createDataFrame([(*r, "x") for r in docs], "section_id int, doc string, path string")
    got = {(r.section_id, r.section, r.instructor, r.days, r.time_start, r.class_id, r.status, r.path) for r in extraction.records(table, "doc", F.lit("ARTS 1")).collect()}
    assert got == {(1, "S1", "A, B", "", "", "7", "Open", "x"), (3, "S3", "", "", "", None, "", "x"), (8, "S8", "", "M W", "7:00 AM", None, "", "x"), (8, "S8", "", "", "", None, "", "x")}
    report = {(r.what, r.path, r.n) for r in extraction.field_report(extraction.located(table, "doc", F.lit("ARTS 1"))).collect()}
    assert report == {("section", "section", 4), ("instructor", "instructor", 1), ("missing", None, 5), ("schedule", "days:days", 1), ("schedule", "start:start", 1)}
    assert extraction.records(table.limit(0), "doc", F.lit("ARTS 1")).count() == 0
