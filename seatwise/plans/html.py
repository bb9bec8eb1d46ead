"""Pages with tables made from offerings, beside the given pages: which table is chosen, and what its rows say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import elections
from ..sources.html_tables import page_tables
from .adapter import OFFERINGS_SQL, offerings

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_NAV = "<nav><ul><li>Code</li><li>Home</li></ul></nav><table><tr><th>Subject</th><th>Status/Action</th></tr><tr><td>{0}</td><td>FINALIZED</td></tr></table>"


def class_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """course_code, term, page_id, html of each course and term, and of the given pages (without a course).

    By term modulo 3: columns Code, Section, Instructor, Schedule; the same in another order, with a room; Code, Class Details, Action. Every
    third row is of a course whose code begins with the wanted one's. Rows stand by seq, those of one seq by section.
    """
    code = F.when(F.col("seq") % 3 == 0, F.concat("course_code", F.lit("0"))).otherwise(F.col("course_code"))
    td = lambda *cells: F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells), F.lit("</tr>"))
    th = lambda *cells: F.lit("<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in cells) + "</tr></thead>")
    name, when = F.concat("prof_key", F.lit(", ANA")), F.lit("TTh 7:00 AM to 8:00 AM")
    details = F.concat("section", F.lit(" - (07:00AM - 08:30AM)<br>Faculty: "), name, F.lit("<br>Location: HALL "), (F.col("seq") % 5).cast("string"))
    row = F.when(F.col("term") % 3 == 0, td(code, F.col("section"), name, when)).when(F.col("term") % 3 == 1, td(F.lit("RM &amp; 1"), name, F.concat(F.lit("Section "), "section"), when, code)).otherwise(td(code, details, F.lit("ADD")))
    head = F.when(F.col("term") % 3 == 0, th("Code", "Section", "Instructor", "Schedule")).when(F.col("term") % 3 == 1, th("Room", "Faculty", "Section", "Schedule", "Course code")).otherwise(th("Code", "Class Details", "Action"))
    made = offerings(spark, sf_dir).groupBy("course_code", "term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "section", row.alias("row")))), lambda r: r["row"]), "").alias("rows"))
    html = F.concat(F.lit(_NAV.split("{0}")[0]), "course_code", F.lit(_NAV.split("{0}")[1]), head, "rows", F.lit("<tr><td>No data available</td></tr></table>"))
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit(None).cast("string").alias("course_code"), F.lit(None).cast("int").alias("term"), "page_id", "html")
    return made.select("course_code", "term", F.lit(None).cast("bigint").alias("page_id"), html.alias("html")).unionByName(given)


_ROWS = f"""WITH {OFFERINGS_SQL}, r AS (
  SELECT *, row_number() OVER (PARTITION BY course_code, term ORDER BY seq, section) AS row, term % 3 AS layout FROM offerings)"""


@query("S13_S14_table_rows", f"""{_ROWS} SELECT course_code, term, CAST(row AS INT) AS row, section, prof_key || ', ANA' AS instructor, CASE WHEN layout < 2 THEN 'TTH' WHEN section IN ('F', 'F-1L') THEN 'F' ELSE '' END AS days, CASE layout WHEN 2 THEN '07:00AM' ELSE '7:00 AM' END AS time_start,
  CASE layout WHEN 2 THEN '08:30AM' ELSE '8:00 AM' END AS time_end, CASE layout WHEN 0 THEN '' WHEN 1 THEN 'RM & 1' ELSE 'HALL ' || (seq % 5) END AS room, '' AS status FROM r WHERE seq % 3 <> 0""")
def class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted course's rows of each page's chosen table; the given pages hold none."""
    found = elections.table_rows(elections.elected(page_tables(class_pages(spark, sf_dir))))
    return found.filter("fits").drop("fits", "page_id")


@query("S13_elected_tables", f"""{_ROWS} SELECT course_code, term, CAST(3 AS INT) AS block, CAST(CASE layout WHEN 0 THEN 11 WHEN 1 THEN 11 ELSE 14 END AS INT) AS points, count(*) AS n, count(*) FILTER (seq % 3 = 0) AS skipped FROM r GROUP BY ALL""")
def elected_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which block of each page is chosen, its points, its rows with a section, and how many of them are of other courses."""
    chosen = elections.elected(page_tables(class_pages(spark, sf_dir)))
    rows = elections.table_rows(chosen.withColumn("at", F.struct("block", "points")))
    return rows.groupBy("course_code", "term", "at.block", "at.points").agg(F.count("*").alias("n"), F.count_if(~F.col("fits")).alias("skipped"))
