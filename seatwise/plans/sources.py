"""Sources over the provided tables: pages of files by course and term, keyset pages of a registry, and seeded draws."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws
from ..operators import keyset
from ..operators.lineage import shared_dir
from ..sources import page_files
from .adapter import OFFERINGS_SQL, offerings

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


#: Rows of a page, and the terms that are asked for.
ROWS, ASKED = 9, (1261, 1262)


def page_folder(spark: SparkSession, sf_dir: str) -> str:
    """Each course's and term's seats as pages of ROWS rows, below the shared folder.

    By course and term modulo 4: 0 names the last page; 1 names none; 2 names one page too many, which repeats the first; 3 names the last, and the second is broken.
    """
    path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
    rows = offerings(spark, sf_dir).groupBy("course_code", "term").agg(F.sort_array(F.collect_list(F.struct("seq", "section"))).alias("all"))  # the seats of a course and term: the letters and suffixes there are
    kind, count = (F.regexp_extract("course_code", r"(\d+)$", 1).cast("int") + F.col("term")) % 4, F.ceil(F.size("all") / ROWS).cast("int")
    at = rows.select("*", kind.alias("kind"), count.alias("n"), F.explode(F.sequence(F.lit(1), F.when(kind == 2, count + 1).otherwise(count))).alias("page"))
    here = F.slice("all", F.when(F.col("page") > F.col("n"), 1).otherwise((F.col("page") - 1) * ROWS + 1), F.lit(ROWS))
    named = F.when(F.col("kind") == 2, F.col("n") + 1).when(F.col("kind") != 1, F.col("n"))
    body = F.to_json(F.struct(F.struct(F.transform(here, lambda r: F.struct(r["seq"].alias("id"), r["section"].alias("section"))).alias("data"), named.alias("last_page")).alias("classes")))
    page_files.write_pages(at.select("course_code", "term", "page", F.when((F.col("kind") == 3) & (F.col("page") == 2), "{broken").otherwise(body).alias("doc")), path)
    return path


@query("S01_S04_paged_source", f"""WITH {OFFERINGS_SQL}, p AS (SELECT *, (CAST(regexp_extract(course_code, '[0-9]+$') AS INT) + term) % 4 AS kind, row_number() OVER (PARTITION BY course_code, term ORDER BY seq, section) - 1 AS k FROM offerings WHERE term IN {ASKED})
SELECT course_code, term, CAST(k // {ROWS} + 1 AS INT) AS page, seq, section FROM p WHERE kind IN (0, 2) OR k < {ROWS}""")
def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asked terms' rows, page after page until each source's walk ends; folders of other terms aren't read."""
    asked = page_files.read_pages(spark, page_folder(spark, sf_dir)).filter(F.col("term").isin(*ASKED))
    taken = page_files.walked(asked).select("course_code", "term", "page", F.explode("rows").alias("row"))
    return taken.select("course_code", "term", "page", F.get_json_object("row", "$.id").cast("long").alias("seq"), F.get_json_object("row", "$.section").alias("section"))


_KEY = "'ver:' || course_code || '|' || term || '|' || section"


@query("S20_registry_pages", f"""WITH {OFFERINGS_SQL}, k AS (SELECT {_KEY} AS key, (row_number() OVER (ORDER BY {_KEY}) - 1) // 1000 AS page FROM offerings WHERE {_KEY} LIKE 'ver:Brand#1%'),
p AS (SELECT page, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM k GROUP BY page)
SELECT CAST(page AS BIGINT) AS page, n, first_key, CASE WHEN lead(page) OVER (ORDER BY page) IS NOT NULL THEN last_key END AS cursor, split_part(last_key[5:], '|', 1) AS last_course, CAST(split_part(last_key, '|', 2) AS INT) AS last_term, split_part(last_key, '|', 3) AS last_section FROM p""")
def registry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of the registry's keys by prefix, in pages of 1000: what each page has, where the next goes on, and the parts of its last key."""
    rows = offerings(spark, sf_dir).select(F.concat(F.lit("ver:"), F.concat_ws("|", "course_code", "term", "section")).alias("key"))
    one = keyset.pages(rows, "key", "ver:Brand#1").groupBy("page").agg(F.count("*").alias("n"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    after = one.select((F.col("page") - 1).alias("page"), F.lit(True).alias("more"))
    part = F.split(F.expr("substring(last_key, 5)"), r"\|")
    return one.join(after, "page", "left").select("page", "n", "first_key", F.when(F.col("more"), F.col("last_key")).alias("cursor"), part[0].alias("last_course"), part[1].cast("int").alias("last_term"), part[2].alias("last_section"))


@query("F09_draws", f"""WITH a AS (SELECT event_id, CAST((CAST(user_id AS HUGEINT) * 2654435 + CAST(event_id AS HUGEINT) * 1831565813) % 4294967296 AS BIGINT) AS a FROM events),
t AS (SELECT event_id, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * CAST(a | 1 AS HUGEINT)) % 4294967296 AS BIGINT) AS t FROM a),
u AS (SELECT event_id, xor(t, CAST((t + (CAST(xor(t, t >> 7) AS HUGEINT) * CAST(t | 61 AS HUGEINT)) % 4294967296) % 4294967296 AS BIGINT)) AS t FROM t)
SELECT event_id, xor(t, t >> 14) / 4294967296 AS u, CAST(floor(xor(t, t >> 14) / 4294967296 * 1000) AS BIGINT) AS pick FROM u""")
def seeded_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each event: its user's seed, at the event's own place in the sequence."""
    seed = F.col("user_id") * 2654435
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", draws.draw(seed, F.col("event_id")).alias("u"), draws.pick(seed, F.col("event_id"), F.lit(1000)).alias("pick"))
