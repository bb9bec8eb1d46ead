"""JSON of unknown shape, made from events: records, responses, names and the field report. What the oracle expects is written out for each shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import documents
from ..operators import extraction

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_COURSE = "CASE (event_id {div} 8) % 4 WHEN 2 THEN 'PHILARTS 1' WHEN 3 THEN 'ARTS 10' ELSE 'ARTS 1' END"
#: Shapes of one class row by event_id modulo 8; the last is the event's own props.
_SHAPES = [
    '{"id":%e,"course_code":"%c","section":"S%u","instructor":"FAM%u, ANA P.","days":"T TH","time_start":"7:00 AM","time_end":"8:00 AM","room":"HALL %u","class_status":"Open"}',
    '{"id":%e,"course":{"course_code":"%c","title":"Art"},"section":"S%u","faculty":{"last_name":"FAM%u","first_name":"ANA","middle_name":"M."},"schedules":[{"day":"W F","start_time":"10:00 AM","end_time":"11:00 AM","room":{"name":"RM %u"}}]}',
    '{"id":%e,"course_code":"%c","section":"S%u","instructors":[{"name":"TBA"},{"name":"FAM%u, EVA T."},{"name":"FAM%u, EVA T."}],"schedule":"TTh 1:00 PM - 2:00 PM HALL %u"}',
    '{"id":%e,"course_code":"%c","lecture_details":{"section":"S%u","days":["M","W"],"time_start":"8:00 AM","time_end":"9:00 AM","room":"HALL"},"faculty_name":"FAM%u, LEO"}',
    '{"class_nbr":%e,"course_code":"%c","class_name":"ARTS 1 - S%u","instructor_name":"FAM%u, ZOE","days":"T","time_start":"3:00 PM"}',
    '{"id":%e,"course_code":"%c","section":"S%u","instructor":"TBA","days":"F","time_start":"9:00 AM"}',
    '{"course_code":"%c","section":%u,"instructor":"","staff":{"info":{"handled_by":[{"surname":"FAM%u","given_name":"IDA"},{"teacher":{"full_name":"OTHER, BO"}}]}}}',
]


def class_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, doc."""
    filled = lambda s: f"replace(replace(replace('{s}', '%e', event_id), '%c', {_COURSE.format(div='DIV')}), '%u', user_id)"
    cases = " ".join(f"WHEN {i} THEN {filled(s)}" for i, s in enumerate(_SHAPES))
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"CASE event_id % 8 {cases} ELSE props END AS doc")


def _by_shape(*values: str) -> str:
    return "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_FOUND = f"""found AS (SELECT event_id, event_id % 8 AS shape,
  {_by_shape(*["'S' || user_id"] * 6, "CAST(user_id AS VARCHAR)")} AS section,
  {_by_shape("'FAM' || user_id || ', ANA P.'", "'FAM' || user_id || ', ANA M.'", "'FAM' || user_id || ', EVA T.'", "'FAM' || user_id || ', LEO'", "'FAM' || user_id || ', ZOE'", "'TBA'", "'FAM' || user_id || ', IDA / OTHER, BO'")} AS instructor,
  {_by_shape("'T TH'", "'W F'", "'TTH'", "'M W'", "'T'", "'F'", "''")} AS days, {_by_shape("'7:00 AM'", "'10:00 AM'", "'1:00 PM'", "'8:00 AM'", "'3:00 PM'", "'9:00 AM'", "''")} AS time_start,
  {_by_shape("'8:00 AM'", "'11:00 AM'", "'2:00 PM'", "'9:00 AM'", "''", "''", "''")} AS time_end, {_by_shape("'HALL ' || user_id", "'RM ' || user_id", "'HALL ' || user_id", "'HALL'", "''", "''", "''")} AS room,
  CASE WHEN event_id % 8 < 6 THEN CAST(event_id AS VARCHAR) END AS class_id, CASE WHEN event_id % 8 = 0 THEN 'Open' ELSE '' END AS status,
  {_by_shape(*["'section'"] * 3, "'lecture_details.section'", "'class_name (parsed)'", "'section'", "'section'")} AS section_path,
  {_by_shape("'instructor'", "'faculty'", "'instructors'", "'faculty_name'", "'instructor_name'", "'instructor'", "'staff.info.handled_by'")} AS instructor_path,
  {_by_shape("['days:days','start:time_start','end:time_end','room:room']", "['days:day','start:start_time','end:end_time','room:room']", "['text:schedule']", "['days:days','start:time_start','end:time_end','room:room']", *["['days:days','start:time_start']"] * 2, "CAST([] AS VARCHAR[])")} AS schedule_paths
  FROM events WHERE event_id % 8 < 7 AND (event_id // 8) % 4 <> 2)"""


@query("S07_S08_S09_S10_S12_X25_records", f"WITH {_FOUND} SELECT event_id, section, instructor, days, time_start, time_end, room, class_id, status FROM found")
def class_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of seven shapes as canonical rows of one course; PHILARTS 1 isn't ARTS 1, and ARTS 10 passes the prefix test."""
    return extraction.records(class_documents(spark, sf_dir), "doc", F.lit("ARTS 1")).drop("paths")


@query("A19_S07_field_report", f"""WITH {_FOUND}, paths AS (
  SELECT 'section' AS what, section_path AS path FROM found UNION ALL SELECT 'instructor', instructor_path FROM found
  UNION ALL SELECT 'schedule', unnest(schedule_paths) FROM found UNION ALL SELECT 'missing', NULL FROM events WHERE event_id % 8 = 7)
SELECT what, path, count(*) AS n FROM paths GROUP BY what, path""")
def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.field_report(extraction.located(class_documents(spark, sf_dir), "doc", F.lit("ARTS 1")))


#: Every path of each shape with its kind.
_PATHS = [
    "id BIGINT, course_code STRING, section STRING, instructor STRING, days STRING, time_start STRING, time_end STRING, room STRING, class_status STRING",
    "id BIGINT, course OBJECT, course.course_code STRING, course.title STRING, section STRING, faculty OBJECT, faculty.last_name STRING, faculty.first_name STRING, faculty.middle_name STRING, schedules ARRAY, schedules[0].day STRING, schedules[0].start_time STRING, schedules[0].end_time STRING, schedules[0].room OBJECT, schedules[0].room.name STRING",
    "id BIGINT, course_code STRING, section STRING, instructors ARRAY, instructors[0].name STRING, instructors[1].name STRING, instructors[2].name STRING, schedule STRING",
    "id BIGINT, course_code STRING, lecture_details OBJECT, lecture_details.section STRING, lecture_details.days ARRAY, lecture_details.time_start STRING, lecture_details.time_end STRING, lecture_details.room STRING, faculty_name STRING",
    "class_nbr BIGINT, course_code STRING, class_name STRING, instructor_name STRING, days STRING, time_start STRING",
    "id BIGINT, course_code STRING, section STRING, instructor STRING, days STRING, time_start STRING",
    "course_code STRING, section BIGINT, instructor STRING, staff OBJECT, staff.info OBJECT, staff.info.handled_by ARRAY, staff.info.handled_by[0].surname STRING, staff.info.handled_by[0].given_name STRING, staff.info.handled_by[1].teacher OBJECT, staff.info.handled_by[1].teacher.full_name STRING",
]
_EXPECTED = ", ".join(f"({i}, '{p.split()[0]}', '{p.split()[1]}')" for i, paths in enumerate(_PATHS) for p in paths.split(", "))


@query("A19_document_paths", f"""WITH e(shape, path, kind) AS (VALUES {_EXPECTED})
SELECT path, kind, count(*) AS n FROM (SELECT path, kind FROM events JOIN e ON event_id % 8 = shape UNION ALL SELECT unnest(json_keys(props)), 'BIGINT' FROM events WHERE event_id % 8 = 7) GROUP BY path, kind""")
def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.document_paths(class_documents(spark, sf_dir), "doc")


def response_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, block, doc: each user's events, 500 event ids to a response, in five envelopes; in the last no list looks like class rows."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id", "event_id DIV 500 AS block", "event_id AS id")
    row = F.struct("id", F.struct(F.lit("ARTS 1").alias("code")).alias("course"), F.concat(F.lit("S"), F.col("id") % 5).alias("section"))
    at = e.groupBy("user_id", "block").agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count("*").alias("n"))
    listed, plain = F.to_json("rows"), F.to_json(F.transform("rows", lambda r: F.struct(r["id"].alias("x"))))
    n = F.col("n").cast("string")
    shape = (F.col("user_id") + F.col("block")) % 5
    doc = (
        F.when(shape == 0, F.concat(F.lit('{"filters":[{"a":1},{"a":2}],"classes":{"data":'), listed, F.lit(',"last_page":'), (F.col("block") + 1).cast("string"), F.lit(',"current_page":2,"total":'), n, F.lit("}}")))
        .when(shape == 1, F.concat(F.lit('{"data":'), listed, F.lit(',"meta":{"last_page":3,"total":'), n, F.lit("}}")))
        .when(shape == 2, F.concat(F.lit('{"payload":{"list":{"items":'), listed, F.lit('}},"page_info":{"totalPages":"4","page":7,"total_count":'), n, F.lit("}}")))
        .when(shape == 3, listed)
        .otherwise(F.concat(F.lit('{"a":[{"x":1},{"x":2}],"b":{"c":'), plain, F.lit(',"total":0},"d":{"total":'), n, F.lit("}}")))
    )
    return at.select("user_id", "block", doc.alias("doc"))


@query("S03_S04_record_arrays", """WITH p AS (SELECT user_id, event_id // 500 AS block, count(*) AS n, sum(event_id) AS ids, (user_id + event_id // 500) % 5 AS shape FROM events GROUP BY ALL)
SELECT user_id, block, CASE shape WHEN 0 THEN 'classes.data' WHEN 1 THEN 'data' WHEN 2 THEN 'payload.list.items' WHEN 3 THEN '' ELSE CASE WHEN n > 2 THEN 'b.c' ELSE 'a' END END AS path,
  CASE WHEN shape = 4 THEN greatest(n, 2) ELSE n END AS n_rows, CAST(CASE WHEN shape = 4 THEN 0 ELSE ids END AS BIGINT) AS ids,
  CASE shape WHEN 0 THEN block + 1 WHEN 1 THEN 3 WHEN 2 THEN 4 END AS last_page, CASE shape WHEN 0 THEN 2 WHEN 2 THEN 7 ELSE 1 END AS page, CASE WHEN shape <> 3 THEN n END AS total FROM p""")
def record_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = extraction.responses(response_documents(spark, sf_dir), "doc")
    ids = F.aggregate(F.transform("rows", lambda r: F.coalesce(F.get_json_object(r, "$.id").cast("long"), F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    return at.select("user_id", "block", "path", F.size("rows").cast("long").alias("n_rows"), ids.alias("ids"), "last_page", "page", "total")


@query("S03_S07_response_records", "SELECT event_id, user_id, 'S' || (event_id % 5) AS section FROM events WHERE (user_id + event_id // 500) % 5 < 4")
def response_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From responses to rows: the list is found, and each of its elements searched."""
    at = extraction.responses(response_documents(spark, sf_dir), "doc").select("user_id", F.explode("rows").alias("doc"))
    return extraction.records(at, "doc", F.lit("ARTS 1")).select(F.col("class_id").cast("long").alias("event_id"), "user_id", "section")


#: Values that may hold a name, by event_id modulo 9, and the name that each holds.
_VALUES = ['" FAM%u, ANA "', '["TBA","FAM%u, ANA",null,"FAM%u, ANA",["X, Y"]]', '{"last_name":"FAM%u","first_name":" ANA ","mi":"Q."}', '{"surname":"FAM%u"}', '{"faculty":{"teacher":{"prof":"FAM%u, ANA"}}}', '%u', 'null', '{"name":" ","given_name":"ANA"}', '{"faculty":{"teacher":[{"prof":"TOO DEEP"}]}}']
_NAMES = ["'FAM' || user_id || ', ANA'", "'FAM' || user_id || ', ANA / X, Y'", "'FAM' || user_id || ', ANA Q.'", "'FAM' || user_id", "'FAM' || user_id || ', ANA'", "CAST(user_id AS VARCHAR)", "''", "'ANA'", "''"]


@query("S09_X25_names", "SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(_NAMES)) + " END AS name FROM events")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from scalars, lists with nobody among them, composed parts and nested objects; below the third level nothing is looked at."""
    cases = " ".join(f"WHEN {i} THEN replace('{v}', '%u', user_id)" for i, v in enumerate(_VALUES))
    at = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", f"CASE event_id % 9 {cases} END AS value")
    only = documents.items(F.concat(F.lit("["), F.col("value"), F.lit("]")))
    return at.select("event_id", documents.let(F.get(only, F.lit(0)), lambda v: documents.resolved_name(v["text"], v["kind"])).alias("name"))
