"""Ingest over the provided tables: JSON rows, HTML cells, free text, and the store's document form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.html_tables import table_cells
from .adapter import OFFERINGS_SQL, offerings

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


@query("S02_term_guard", """SELECT user_id AS asked, count(*) AS n, CAST(sum(CASE WHEN event_id % 7 <> user_id % 7 THEN 1 ELSE 0 END) AS BIGINT) AS wrong, bool_and(event_id % 7 <> user_id % 7) AS refused FROM events GROUP BY user_id""")
def term_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a page whose own term differs from the asked one; a page is refused if all differ."""
    wrong = F.col("event_id") % 7 != F.col("user_id") % 7
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("asked")).agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong"), F.bool_and(wrong).alias("refused"))


@query("S03_S07_S08_json_fields", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string('{"course":{"code":"' || event_type || '"},"rows":[{"section":"' || user_id || '"}]}', '$.course.code') AS code FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    doc = F.concat(F.lit('{"course":{"code":"'), "event_type", F.lit('"},"rows":[{"section":"'), F.col("user_id").cast("string"), F.lit('"}]}'))
    v = F.try_parse_json(doc)
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"), F.coalesce(F.try_variant_get(v, "$.code", "string"), F.try_variant_get(v, "$.course.code", "string")).alias("code"))


@query("S08_S12_first_of_depth", """SELECT event_id, coalesce(nullif(event_type, 'view'), 'deep') AS section FROM events""")
def first_of_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key is looked for level by level; an empty value at one level leaves it to the next."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    v = F.try_parse_json(F.to_json(F.struct(top.alias("section"), F.struct(F.lit("deep").alias("section")).alias("details"))))
    return e.select("event_id", F.coalesce(F.nullif(F.try_variant_get(v, "$.section", "string"), F.lit("")), F.try_variant_get(v, "$.details.section", "string")).alias("section"))


@query("S13_S14_html_cells")
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_cells(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("S15_page_merge", "SELECT user_id AS section, event_id AS page, event_type AS instructor FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, event_id DESC) = 1")
def page_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per section over many pages: named rows before unnamed ones, later pages before earlier ones."""
    by = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "error", 1).otherwise(0), F.desc("event_id"))
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("n", F.row_number().over(by)).filter("n = 1")
    return e.select(F.col("user_id").alias("section"), F.col("event_id").alias("page"), F.col("event_type").alias("instructor"))


_NOTE = "'B' || (l_linenumber % 4) || ' - (' || lpad(CAST(7 + l_partkey % 5 AS VARCHAR), 2, '0') || ':30 AM - 11:00 AM)' || chr(10) || 'Faculty: S' || l_suppkey || ', ANA' || chr(10) || 'Location: HALL ' || (l_partkey % 9)"


@query("X12_X13_X14_X15_free_text", f"""WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_NOTE} AS note FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'B' || (l_linenumber % 4) AS section, 'S' || l_suppkey || ', ANA' AS person, 'HALL ' || (l_partkey % 9) AS room, lpad(CAST(7 + l_partkey % 5 AS VARCHAR), 2, '0') || ':30 AM' AS time_start, '11:00 AM' AS time_end FROM t""")
def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    s = lambda c: c.cast("string")
    note = F.concat(F.lit("B"), s(F.col("l_linenumber") % 4), F.lit(" - ("), F.lpad(s(7 + F.col("l_partkey") % 5), 2, "0"), F.lit(":30 AM - 11:00 AM)\nFaculty: S"), s(F.col("l_suppkey")), F.lit(", ANA\nLocation: HALL "), s(F.col("l_partkey") % 9))
    at = line.withColumn("note", note).withColumn("s", text.schedule(F.col("note")))
    n = F.col("note")
    return at.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.section(n).alias("section"), text.person(n).alias("person"), text.room(n).alias("room"), "s.time_start", "s.time_end")


#: Notes by line number, with the person, section, room and schedule that each holds.
_NOTES = [
    ("CMSC 12 - B%n (MWF) LECTURER: requires a laptop; CRUZ DE LEON, Ana B. C.", "CRUZ DE LEON, Ana B. C.", "B%n", "", "MWF", "", "", ""),
    ("Section: c%n | professors - REYES,  Bo | T TH 1:00 PM to 2:30 PM | RM %n", "REYES, Bo", "C%n", "", "T TH", "1:00 PM", "2:30 PM", "RM %n"),
    ("G%n - (07:30 AM - 09:00 AM) MAY, Open faculty TBA\nLocation:  HALL   %n ; next", "TBA", "G%n", "HALL %n", "", "07:30 AM", "09:00 AM", ") MAY, Open faculty TBA Location: HALL %n ; next"),
    ("SANTOS, Closed; OCT, Eva", "", "", "", "", "", "", ""),
    ("nothing here", "", "", "", "", "", "", ""),
]


def _noted(k: int) -> str:
    cases = " ".join(f"WHEN {i} THEN replace('{n[k]}', '%n', l_partkey)" for i, n in enumerate(_NOTES))
    return f"CASE l_linenumber % {len(_NOTES)} {cases} END"


_LINES = "(SELECT DISTINCT l_orderkey, l_linenumber, CAST(l_partkey % 90 AS VARCHAR) AS l_partkey FROM lineitem)"


@query("X12_X14_text_patterns", f"SELECT l_orderkey, l_linenumber, l_partkey, {', '.join(f'{_noted(k)} AS {n}' for k, n in enumerate(('person', 'section', 'room', 'days', 'time_start', 'time_end', 'behind'), 1))} FROM {_LINES}")
def text_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names behind a role, by comma, as TBA, and what only looks like one; sections in three places; schedules with and without a clock."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 90).cast("string").alias("l_partkey")).distinct()
    n = F.expr(_noted(0).replace("\n", "\\n"))
    at = line.select("*", n.alias("note"), text.schedule(n).alias("s"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return at.select("l_orderkey", "l_linenumber", "l_partkey", text.person(F.col("note")).alias("person"), text.section(F.col("note")).alias("section"), text.room(F.col("note")).alias("room"), blank(F.col("s.days")).alias("days"), blank(F.col("s.time_start")).alias("time_start"), blank(F.col("s.time_end")).alias("time_end"), blank(F.col("s.room")).alias("behind"))


@query("S19_export_import", f"WITH {OFFERINGS_SQL} SELECT course_code, term, section, prof_key, seq FROM offerings")
def export_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one JSON document per course and term, and back; another version than 2 is refused."""
    rows = offerings(spark, sf_dir)
    fields = ["section", "prof_key", "seq"]
    docs = rows.groupBy("course_code", "term").agg(F.to_json(F.struct(F.lit(2).alias("version"), F.collect_list(F.struct(*fields)).alias("records"))).alias("doc"))
    back = docs.withColumn("d", F.from_json("doc", "version int, records array<struct<section: string, prof_key: string, seq: bigint>>"))
    checked = F.when(F.col("d.version") == 2, F.col("d.records")).otherwise(F.raise_error(F.lit("unknown version")))
    return back.select("course_code", "term", F.explode(checked).alias("r")).select("course_code", "term", "r.*")


@query("S24_config_merge", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS VARCHAR), '80') AS k, 'dom' AS mode FROM events")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults under stored values."""
    stored = F.coalesce(F.from_json("props", "map<string, string>"), F.create_map().cast("map<string, string>"))
    defaults = F.create_map(F.lit("mode"), F.lit("dom"), F.lit("k"), F.lit("80"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(stored, k)), stored)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", merged["k"].alias("k"), merged["mode"].alias("mode"))
