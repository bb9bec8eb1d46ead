"""Store, summaries and set operations over the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.calendar import decay_weight
from ..functions.sections import section_family, section_kind
from ..operators import graph, store
from .adapter import OFFERINGS_SQL, RAW_SQL, TARGET, offerings, raw_offerings
from .scalars import _TBA
from .sql import ORD, evidence_sql

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


_PEOPLE = f"""{RAW_SQL}, parts AS (SELECT *, list_filter(list_transform(string_split_regex(instructor, '(?i)\\s+AND\\s+'), lambda x: trim(x)), lambda x: NOT {_TBA.format('x')}) AS named FROM raw),
people AS (SELECT course_code, term, upper(section) AS section, trim(unnest(CASE WHEN len(named) > 0 THEN list_distinct(named) ELSE [instructor] END)) AS person, seq FROM parts),
canon AS (SELECT course_code, term, section, CASE WHEN {_TBA.format('person')} THEN '' ELSE person END AS instructor, seq FROM people)"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.canonical(raw_offerings(spark, sf_dir))


@query("S17_P01_canonical", f"WITH {_PEOPLE} SELECT course_code, term, section, instructor, seq FROM canon")
def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).select("course_code", "term", "section", "instructor", "seq")


@query("D01_J02_P02_dedupe", f"""WITH {_PEOPLE}, one AS (SELECT *, row_number() OVER (PARTITION BY course_code, term, section, instructor ORDER BY seq) AS n, max(CASE WHEN instructor <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY course_code, term, section) AS named FROM canon)
SELECT course_code, term, section, instructor, seq FROM one WHERE n = 1 AND (instructor <> '' OR named = 0)""")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _canonical(spark, sf_dir).withColumn("prof_key", F.col("instructor"))
    return store.dedupe(rows).select("course_code", "term", "section", "instructor", "seq")


@query("S18_W04_W05_term_rows", f"WITH {RAW_SQL} SELECT course_code, term, section, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM raw WHERE term = 1271 GROUP BY ALL")
def term_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_offerings(spark, sf_dir).filter("term = 1271")
    return rows.groupBy("course_code", "term", "section").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


_VERIFIED = "verified AS (SELECT course_code, term, section, 'V' || (seq % 50) AS prof_key, seq AS at FROM offerings WHERE time_start = '12:00 PM')"


def _verified(rows: DataFrame) -> DataFrame:
    return rows.filter("time_start = '12:00 PM'").select("course_code", "term", "section", F.concat(F.lit("V"), (F.col("seq") % 50).cast("string")).alias("prof_key"), F.col("seq").alias("at"))


@query("J01_S20_override", f"WITH {OFFERINGS_SQL}, {_VERIFIED} SELECT o.course_code, o.term, o.section, coalesce(v.prof_key, o.prof_key) AS prof_key, CASE WHEN v.prof_key IS NULL THEN 'scan' ELSE 'verified' END AS source FROM offerings o LEFT JOIN verified v USING (course_code, term, section)")
def override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offerings(spark, sf_dir)
    return store.override(rows, _verified(rows)).select("course_code", "term", "section", "prof_key", "source")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("user_id", "event_type", (F.col("event_id") * 7919 % 1000).alias("at"), F.col("event_id").alias("arrival"), "value")


_LOG = "log AS (SELECT user_id, event_type, event_id * 7919 % 1000 AS \"at\", event_id AS arrival, value FROM events)"


@query("M05_S21_M04_latest_wins", f"WITH {_LOG} SELECT user_id, event_type, \"at\", arrival, value FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY \"at\" DESC, arrival) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.latest_wins(_log(spark, sf_dir), ["user_id", "event_type"])


@query("M05_accepted_rows", f"WITH {_LOG} SELECT user_id, event_type, \"at\", arrival, value FROM log QUALIFY coalesce(\"at\" > max(\"at\") OVER (PARTITION BY user_id, event_type ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE)")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.accepted(_log(spark, sf_dir), ["user_id", "event_type"])


_SCANS = """scans AS (SELECT o_orderkey AS scan_id, CAST(o_custkey % 12 AS BIGINT) AS total, CAST(greatest(0, o_custkey % 12 - 6) AS BIGINT) AS revealed, CASE WHEN o_orderkey % 2 = 0 THEN 'dom' ELSE 'api' END AS source,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS pages, o_orderkey % 3 = 0 AS exhausted, 1000000000 - o_orderkey * 1000 AS scanned_at, o_orderkey % 11 = 0 AS copied FROM orders)"""


@query("M01_M02_C10_J03_fresh", f"WITH {_SCANS} SELECT scan_id, NOT (total = 0 OR (source = 'dom' AND NOT exhausted AND (pages IS NULL OR (pages = 1 AND total <= 5)))) AND NOT copied AND (revealed > 0 OR 1000000000 - scanned_at < 21600000) AS fresh FROM scans")
def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey"), F.col("o_custkey") % 12
    scans = o.select(k.alias("scan_id"), c.alias("total"), F.greatest(F.lit(0), c - 6).alias("revealed"), F.when(k % 2 == 0, "dom").otherwise("api").alias("source"), F.when(k % 5 != 0, (k % 4).cast("int")).alias("pages"), (k % 3 == 0).alias("exhausted"), (1_000_000_000 - k * 1000).alias("scanned_at"), (k % 11 == 0).alias("copied"))
    return store.fresh(scans, 1_000_000_000).select("scan_id", "fresh")


@query("M03_U07_copied_terms", f"""WITH {OFFERINGS_SQL}, w AS (SELECT course_code, term, list(upper(section) || '|' || prof_key || '|' || days || '|' || time_start ORDER BY upper(section) || '|' || prof_key || '|' || days || '|' || time_start) AS sig FROM offerings GROUP BY ALL)
SELECT a.course_code, a.term, a.sig = b.sig AS copied FROM w a JOIN w b ON a.course_code = b.course_code AND a.term = b.term + 1 WHERE a.term % 10 = 3""")
def copied_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.copied_terms(offerings(spark, sf_dir))


@query("J17_U02_inherit_sections", f"""WITH {OFFERINGS_SQL}, own AS (SELECT course_code, section, prof_key, CAST(NULL AS INT) AS inherited_from FROM offerings WHERE term = {TARGET})
SELECT * FROM own UNION ALL SELECT course_code, section, '', max(term) FROM offerings o WHERE term < {TARGET} AND NOT EXISTS (SELECT 1 FROM own w WHERE w.course_code = o.course_code AND w.section = o.section) GROUP BY course_code, section""")
def inherit_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.inherit_sections(offerings(spark, sf_dir), TARGET).select("course_code", "section", "prof_key", "inherited_from")


@query("A08_Q06_rollup", f"WITH {OFFERINGS_SQL} SELECT course_code, term, count(*) AS n, count(DISTINCT prof_key) AS people, count(DISTINCT section) AS sections FROM offerings GROUP BY ROLLUP (course_code, term)")
def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offerings(spark, sf_dir).rollup("course_code", "term").agg(F.count("*").alias("n"), F.count_distinct("prof_key").alias("people"), F.count_distinct("section").alias("sections"))


@query("S22_A19_counts", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query("A16_O02_U01_terms", f"WITH {OFFERINGS_SQL} SELECT course_code, string_agg(CAST(term AS VARCHAR), ',' ORDER BY term) AS terms FROM (SELECT DISTINCT course_code, term FROM offerings) GROUP BY course_code")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offerings(spark, sf_dir).groupBy("course_code").agg(F.array_join(F.transform(F.array_sort(F.collect_set("term")), lambda t: t.cast("string")), ",").alias("terms"))


@query("U04_missing_terms", f"WITH {OFFERINGS_SQL}, h AS (SELECT range AS term FROM range(1231, {TARGET}) WHERE range % 10 BETWEEN 1 AND 3) SELECT course_code, section, CAST(term AS INT) AS term FROM (SELECT DISTINCT course_code, section FROM offerings), h EXCEPT SELECT course_code, section, term FROM offerings")
def missing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.calendar import history

    rows = offerings(spark, sf_dir).groupBy("course_code", "section").agg(F.collect_set("term").alias("have"))
    return rows.select("course_code", "section", F.explode(F.array_except(history(F.lit(TARGET)), F.col("have"))).alias("term"))


@query("A06_A07_Q05_O06_families", f"""WITH {evidence_sql((TARGET,))}, f AS (SELECT course_code, family, prof_key, count(*) AS n, sum(w) AS weight, min(seq) AS s FROM ev GROUP BY ALL)
SELECT course_code, family, prof_key, n, round(CAST(weight AS DOUBLE), 6) AS weight, round(CAST(100.0 * n / total AS DOUBLE), 4) AS share, CAST(rank AS INT) AS rank FROM (
  SELECT *, sum(n) OVER (PARTITION BY course_code, family) AS total, row_number() OVER (PARTITION BY course_code, family ORDER BY n DESC, s, prof_key) AS rank FROM f) WHERE rank <= 5""")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offerings(spark, sf_dir).filter(F.col("term") < TARGET).withColumn("family", section_family(F.col("section"))).withColumn("w", decay_weight(F.col("term"), F.lit(TARGET)))
    g = rows.groupBy("course_code", "family", "prof_key").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.min("seq").alias("s"))
    whole = Window.partitionBy("course_code", "family")
    g = g.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(whole), 4)).withColumn("rank", F.row_number().over(whole.orderBy(F.desc("n"), "s", "prof_key")))
    return g.filter("rank <= 5").select("course_code", "family", "prof_key", "n", F.round("weight", 6).alias("weight"), "share", "rank")


@query("A07_components", f"""WITH {evidence_sql((TARGET,))}, k AS (SELECT course_code, kind, prof_key, sum(w) AS weight FROM ev GROUP BY ALL)
SELECT course_code, kind, prof_key, round(CAST(weight AS DOUBLE), 6) AS weight FROM k WHERE course_code IN (SELECT course_code FROM k GROUP BY course_code HAVING count(DISTINCT kind) = 2)""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offerings(spark, sf_dir).filter(F.col("term") < TARGET).withColumn("kind", section_kind(F.col("section")))
    k = rows.groupBy("course_code", "kind", "prof_key").agg(F.sum(decay_weight(F.col("term"), F.lit(TARGET))).alias("weight"))
    both = k.groupBy("course_code").agg(F.count_distinct("kind").alias("kinds")).filter("kinds = 2").select("course_code")
    return k.join(both, "course_code", "left_semi").withColumn("weight", F.round("weight", 6))


@query("A17_capacity", f"""WITH {evidence_sql((TARGET,))}, t AS (SELECT course_code, prof_key, term, count(*) AS n FROM ev GROUP BY ALL)
SELECT course_code, prof_key, CAST(greatest(1, least(4, floor(greatest(avg(n), max(n)) + 0.5))) AS BIGINT) AS capacity FROM t GROUP BY ALL""")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = offerings(spark, sf_dir).filter(F.col("term") < TARGET)
    t = rows.groupBy("course_code", "prof_key", "term").agg(F.count("*").alias("n"))
    most = F.floor(F.greatest(F.avg("n"), F.max("n").cast("double")) + 0.5)
    return t.groupBy("course_code", "prof_key").agg(F.greatest(F.lit(1).cast("long"), F.least(F.lit(4).cast("long"), most)).alias("capacity"))


_CONFLICT = f"""{evidence_sql((TARGET,))}, edges AS (SELECT a.course_code, a.section AS a, b.section AS b FROM seats a JOIN seats b ON a.course_code = b.course_code AND a.section < b.section
  AND len(list_intersect(a.seat_days, b.seat_days)) > 0 AND a.seat_start < b.seat_start + 60 AND b.seat_start < a.seat_start + 60)"""


@query("J12_conflicts", f"WITH {_CONFLICT} SELECT course_code, a, b FROM edges")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.conflicts(_target_seats(spark, sf_dir)).select("course_code", "a", "b")


@query("R02_conflict_groups", f"""WITH RECURSIVE {_CONFLICT}, both_ways AS (SELECT course_code, a, b FROM edges UNION ALL SELECT course_code, b, a FROM edges), reach AS (
  SELECT course_code, section AS a, section AS b FROM seats UNION SELECT r.course_code, r.a, e.b FROM reach r JOIN both_ways e ON r.course_code = e.course_code AND r.b = e.a)
SELECT course_code, a AS section, min(b) AS grp FROM reach GROUP BY course_code, a""")
def conflict_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    seats = _target_seats(spark, sf_dir)
    return graph.conflict_groups(seats)


def _target_seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.calendar import parse_days, parse_time

    rows = offerings(spark, sf_dir).filter(F.col("term") == TARGET)
    return rows.select("course_code", "section", parse_days(F.col("days")).alias("days"), parse_time(F.col("time_start")).alias("start"))


@query("Q04_J19_A09_O03_identify")
def identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names against the known names of the same course (brand)."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", "p_name", "p_partkey")
    known = part.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    typed = part.select("p_brand", F.concat(F.expr("substring(p_name, 2)"), F.lit(" jr")).alias("typed")).distinct()
    return names.best_matches(typed, known, "typed", "p_name", ["p_brand"])
