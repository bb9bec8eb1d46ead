"""Scalar functions over the provided tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import names, sections
from ..operators import vectors
from .adapter import offerings
from .sql import ORD

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code for each event, from all numbers between two terms; most are none."""
    return _events(spark, sf_dir).select("event_id", (1200 + F.col("event_id") % 130).cast("int").alias("term"))


_CODES = "(SELECT event_id, CAST(1200 + event_id % 130 AS INT) AS term FROM events)"


_VALID = "regexp_matches(CAST(term AS VARCHAR), '^[0-9]{3}[123]$')"
_YEAR = "((term // 10) % 10 + CASE WHEN (term // 10) % 10 >= 3 THEN 2020 ELSE 2030 END)"


@query("C01_term_parse", f"""SELECT event_id, term, {_VALID} AS valid, CASE WHEN {_VALID} THEN CAST(term // 100 AS INT) END AS prefix, CASE WHEN {_VALID} THEN CAST((term // 10) % 10 AS INT) END AS year_digit,
CASE WHEN {_VALID} THEN CAST(term % 10 AS INT) END AS semester, CASE WHEN {_VALID} THEN CAST({_YEAR} AS INT) END AS start_year, CASE WHEN {_VALID} THEN {_YEAR} || '-' || ({_YEAR} + 1) END AS academic_year,
CASE WHEN {_VALID} THEN CASE term % 10 WHEN 1 THEN 'First Semester' WHEN 2 THEN 'Second Semester' ELSE 'Midyear' END END AS semester_label FROM {_CODES}""")
def term_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cal.parsed(F.col("term"))
    return _codes(spark, sf_dir).select("event_id", "term", cal.is_term(F.col("term")).alias("valid"), *(p[c].alias(c) for c in ("prefix", "year_digit", "semester", "start_year", "academic_year", "semester_label")))


@query("C02_term_labels", f"""SELECT event_id, term, CASE WHEN {_VALID} THEN term || ' - ' || CASE term % 10 WHEN 1 THEN 'First Semester' WHEN 2 THEN 'Second Semester' ELSE 'Midyear' END || ' (' || {_YEAR} || '-' || ({_YEAR} + 1) || ')' ELSE CAST(term AS VARCHAR) END AS label,
CASE WHEN {_VALID} THEN term || ' ' || CASE term % 10 WHEN 3 THEN 'MY' ELSE 'S' || (term % 10) END || ' ' || ({_YEAR} % 100) || '-' || (({_YEAR} + 1) % 100) ELSE CAST(term AS VARCHAR) END AS short_label FROM {_CODES}""")
def term_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _codes(spark, sf_dir).select("event_id", "term", cal.label(F.col("term")).alias("label"), cal.short_label(F.col("term")).alias("short_label"))


@query("C03_term_distance", f"""SELECT event_id, a, b, CAST(CASE WHEN a % 10 BETWEEN 1 AND 3 AND b % 10 BETWEEN 1 AND 3 THEN {ORD.format('b')} - {ORD.format('a')} ELSE 0 END AS INT) AS distance
FROM (SELECT event_id, CAST(1240 + event_id % 30 AS INT) AS a, CAST(1250 + (event_id // 30) % 30 AS INT) AS b FROM events)""")
def term_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("event_id", (1240 + F.col("event_id") % 30).cast("int").alias("a"), (1250 + F.floor(F.col("event_id") / 30) % 30).cast("int").alias("b"))
    return e.select("event_id", "a", "b", cal.distance(F.col("a"), F.col("b")).alias("distance"))


@query("C04_C05_U05_history", """SELECT c_custkey, t AS target, CAST(h AS INT) AS term, h % 10 = t % 10 AS same_semester FROM (SELECT c_custkey, CAST(1200 + c_custkey % 130 AS INT) AS t FROM customer WHERE (1200 + c_custkey % 130) % 10 BETWEEN 1 AND 3), range(1231, 1330) r(h)
WHERE h < t AND h % 10 BETWEEN 1 AND 3""")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", (1200 + F.col("c_custkey") % 130).cast("int").alias("target"))
    long = t.select("c_custkey", "target", F.explode(cal.history(F.col("target"))).alias("term"), cal.same_semester_history(F.col("target")).alias("same"))
    return long.select("c_custkey", "target", "term", F.array_contains("same", F.col("term")).alias("same_semester"))


@query("C06_F08_U03_days", """WITH d AS (SELECT l_linenumber AS n, CASE l_linenumber % 7 WHEN 0 THEN 'M W' WHEN 1 THEN 'T TH' WHEN 2 THEN 'W-F' WHEN 3 THEN 'm th' WHEN 4 THEN 'MWF' WHEN 5 THEN 'S SU' ELSE 'TTh' END AS days FROM lineitem),
p AS (SELECT DISTINCT n, days, list_distinct(regexp_extract_all(regexp_replace(upper(days), '[^A-Z]', '', 'g'), 'TH|SA|SU|M|T|W|F|S')) AS l FROM d)
SELECT a.days AS days_a, b.days AS days_b, array_to_string(list_sort(a.l), ',') AS tokens, round(CAST(len(list_intersect(a.l, b.l)) / len(list_distinct(list_concat(a.l, b.l))) AS DOUBLE), 6) AS jaccard FROM p a, p b""")
def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = F.array(*(F.lit(x) for x in ["M W", "T TH", "W-F", "m th", "MWF", "S SU", "TTh"]))
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.element_at(patterns, F.col("l_linenumber") % 7 + 1).alias("days")).distinct()
    p = d.select("l_linenumber", "days", cal.parse_days(F.col("days")).alias("l"))
    a, b = p.select(F.col("days").alias("days_a"), F.col("l").alias("a")), p.select(F.col("days").alias("days_b"), F.col("l").alias("b"))
    return a.crossJoin(b).select("days_a", "days_b", F.array_join(F.array_sort("a"), ",").alias("tokens"), F.round(cal.day_jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_CLOCK = """CASE (id // 60) % 4 WHEN 0 THEN (id % 15) || ':30 AM' WHEN 1 THEN (id % 15) || ':05 PM' WHEN 2 THEN CAST(id % 27 AS VARCHAR) ELSE '0830' END"""


@query("C07_C08_times", f"""WITH t AS (SELECT o_orderkey AS id, {_CLOCK.replace('id', 'o_orderkey')} AS text FROM orders), m AS (
  SELECT *, TRY_CAST(regexp_extract(text, '^(\\d{{1,2}})[:.]?(\\d{{2}})?\\s*(AM|PM)?', 1) AS INT) AS h, coalesce(TRY_CAST(nullif(regexp_extract(text, '^(\\d{{1,2}})[:.]?(\\d{{2}})?\\s*(AM|PM)?', 2), '') AS INT), 0) AS mi,
    regexp_extract(text, '^(\\d{{1,2}})[:.]?(\\d{{2}})?\\s*(AM|PM)?', 3) AS half FROM t
), c AS (SELECT *, CASE WHEN half = 'PM' AND h < 12 THEN h + 12 WHEN half = 'AM' AND h = 12 THEN 0 WHEN half = '' AND h BETWEEN 1 AND 6 THEN h + 12 ELSE h END AS hour FROM m),
d AS (SELECT id, text, CASE WHEN hour <= 23 AND mi <= 59 THEN hour * 60 + mi END AS minutes FROM c)
SELECT id AS o_orderkey, text, CAST(minutes AS INT) AS minutes, round(CAST(coalesce(greatest(0, 1 - abs(minutes - 600) / 180.0), 0) AS DOUBLE), 6) AS near_ten FROM d""")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), F.col("o_orderkey")
    kind = F.floor(k / 60) % 4
    text = F.when(kind == 0, F.concat((k % 15).cast("string"), F.lit(":30 AM"))).when(kind == 1, F.concat((k % 15).cast("string"), F.lit(":05 PM"))).when(kind == 2, (k % 27).cast("string")).otherwise("0830")
    t = o.withColumn("text", text).withColumn("minutes", cal.parse_time(F.col("text")))
    return t.withColumn("near_ten", F.round(F.when(F.col("minutes").isNull(), 0.0).otherwise(cal.time_similarity(F.col("minutes"), F.lit(600))), 6))


@query("C09_decay", f"""SELECT event_id, term, round(CAST(pow(0.5, abs({ORD.format('1291')} - {ORD.format('term')}) / 4.0) AS DOUBLE), 6) AS w4, round(CAST(pow(0.5, abs({ORD.format('1291')} - {ORD.format('term')}) / 8.0) AS DOUBLE), 6) AS w8
FROM (SELECT event_id, CAST(1231 + event_id % 69 AS INT) AS term FROM events) WHERE term % 10 BETWEEN 1 AND 3""")
def decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _events(spark, sf_dir).select("event_id", (1231 + F.col("event_id") % 69).cast("int").alias("term")).filter("term % 10 BETWEEN 1 AND 3")
    return t.select("event_id", "term", F.round(cal.decay_weight(F.col("term"), F.lit(1291)), 6).alias("w4"), F.round(cal.decay_weight(F.col("term"), F.lit(1291), 8.0), 6).alias("w8"))


#: Raw names made of part names: titles, suffixes, accents, punctuation, nobody, several people.
_RAW = """CASE p_partkey % 9 WHEN 0 THEN 'Dr. ' || p_name || ' Jr.' WHEN 1 THEN p_name || ', Ana M.' WHEN 2 THEN 'T.B.A.' WHEN 3 THEN upper(p_name) || ' and Juan dela Cruz' WHEN 4 THEN 'José ' || p_name || '-Núñez' WHEN 5 THEN '  ' || p_name || '   (prof)'
WHEN 6 THEN 'to be announced' WHEN 7 THEN p_name || '/' || p_brand ELSE '---' END"""
_NORM = """trim(regexp_replace(regexp_replace(regexp_replace(upper(strip_accents(raw)), '[.,_/\\\\|;:()\\[\\]{}<>"''`*]+', ' ', 'g'), '[^A-Z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"""
_TBA = """regexp_matches(regexp_replace(trim(regexp_replace(upper(strip_accents({0})), '[^A-Z0-9/\\s.-]', '', 'g')), '\\s+', ' ', 'g'), '^(T\\.?B\\.?A\\.?|TO\\s*BE\\s*A(NNOUNCED|SSIGNED)|N/?A|NONE|-+|STAFF|FACULTY|TBD|UNASSIGNED|NULL)?$')"""
_DROPPED = ", ".join(f"'{x}'" for x in [*(t.replace("'", "''") for t in names.TITLES), *names.SUFFIXES, ""])
_TOKENS = f"list_filter(string_split({_NORM}, ' '), lambda t: NOT list_contains([{_DROPPED}], t))"


def _raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.expr(_RAW).alias("raw"))


@query("X01_X02_X03_X04_names", f"SELECT p_partkey, raw, {_NORM} AS norm, {_TBA.format('raw')} AS tba, array_to_string({_TOKENS}, '+') AS tokens FROM (SELECT p_partkey, {_RAW} AS raw FROM part)")
def name_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.col("raw")
    return _raw_names(spark, sf_dir).select("p_partkey", "raw", names.normalize(raw).alias("norm"), names.is_tba(raw).alias("tba"), F.array_join(names.tokens(raw), "+").alias("tokens"))


@query("X21_P07_split_people", f"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part), s AS (SELECT p_partkey, raw, unnest(list_transform(string_split_regex(raw, '(?i)\\s+AND\\s+'), lambda x: trim(x))) AS person FROM r)
SELECT DISTINCT p_partkey, person FROM s WHERE NOT {_TBA.format('person')} UNION ALL SELECT p_partkey, raw FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM s WHERE NOT {_TBA.format('person')})""")
def split_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw_names(spark, sf_dir).select("p_partkey", F.explode(names.split_people(F.col("raw"))).alias("person"))


@query("X05_X06_X07_X17_name_keys")
def name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.with_keys(_raw_names(spark, sf_dir), "raw")


@query("X08_X09_X16_edit_similarity", f"""WITH n AS (SELECT DISTINCT p_brand, p_name AS raw FROM part), a AS (SELECT p_brand, raw, {_TOKENS} AS tk FROM n), b AS (SELECT p_brand, raw AS other, tk AS tk_b FROM a)
SELECT p_brand, raw AS name, other, CAST(levenshtein(raw, other) AS INT) AS distance, round(CAST(1 - levenshtein(raw, other) / greatest(length(raw), length(other)) AS DOUBLE), 6) AS ratio,
  round(CAST(CASE WHEN len(tk) = 0 OR len(tk_b) = 0 THEN 0 ELSE 2.0 * len(list_intersect(list_distinct(tk), list_distinct(tk_b))) / (len(list_distinct(tk)) + len(list_distinct(tk_b))) END AS DOUBLE), 6) AS dice FROM a JOIN b USING (p_brand)""")
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the distinct names of a brand."""
    a = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.col("p_name").alias("name")).distinct()
    b = a.withColumnRenamed("name", "other")
    x, y = F.col("name"), F.col("other")
    return a.join(b, "p_brand").select("p_brand", "name", "other", F.levenshtein(x, y).alias("distance"), F.round(names.levenshtein_ratio(x, y), 6).alias("ratio"), F.round(names.token_set_ratio(x, y), 6).alias("dice"))


@query("X10_X11_X18_name_similarity")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct raw names of a brand with its distinct part names."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    a = part.select("p_brand", F.expr(_RAW).alias("query")).distinct()
    b = part.select("p_brand", F.col("p_name").alias("known")).distinct()
    q, k = F.col("query"), F.col("known")
    pairs = a.join(b, "p_brand").withColumn("jaro_winkler", names.jaro_winkler(q, k)).withColumn("sound", names.name_soundex(q))
    return names.with_similarity(pairs, "query", "known")


@query("X19_X20_keys_hashes", r"SELECT p_partkey, trim(regexp_replace(upper(' ' || p_brand || '   ' || p_size || ' '), '\s+', ' ', 'g')) AS course_key, sha256(p_name) AS sha FROM part")
def keys_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit(" "), F.col("p_brand"), F.lit("   "), F.col("p_size").cast("string"), F.lit(" "))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", sections.course_key(code).alias("course_key"), F.sha2("p_name", 256).alias("sha"))


_SECTION = "chr(CAST(65 + p_size % 8 AS INT)) || CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '-1L' WHEN 3 THEN '2L' WHEN 4 THEN ' LAB' WHEN 5 THEN '-12' ELSE '-recit' END"
_TIGHT = "regexp_replace(regexp_replace(upper(s), '[^A-Z0-9-]', ' ', 'g'), '\\s+', '', 'g')"


@query("X22_X23_P04_P05_O01_sections", f"""WITH x AS (SELECT p_partkey, {_SECTION} AS s FROM part), y AS (SELECT *, {_TIGHT} AS t FROM x)
SELECT p_partkey, s AS section, regexp_extract(t, '^([A-Z]+)', 1) AS family, CASE WHEN regexp_matches(t, '(LAB|RECIT|RECI)$|-[0-9]*L$|[A-Z]+[0-9]+L$') THEN 'lab' ELSE 'lecture' END AS kind,
  CAST(coalesce(TRY_CAST(nullif(regexp_extract(upper(s), '([0-9]+)', 1), '') AS BIGINT), 0) AS BIGINT) AS number, list_contains(['A', 'C'], regexp_extract(t, '^([A-Z]+)', 1)) AS allowed FROM y""")
def section_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, s = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("section")
    suffix = F.element_at(F.array(*(F.lit(x) for x in ["", "1", "-1L", "2L", " LAB", "-12", "-recit"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    x = part.select("p_partkey", F.concat(F.char(65 + F.col("p_size") % 8), suffix).alias("section"))
    wanted = sections.section_filter(F.lit("a, c"))
    return x.select("p_partkey", "section", sections.section_family(s).alias("family"), sections.section_kind(s).alias("kind"), sections.section_number(s).alias("number"), sections.section_allowed(s, wanted).alias("allowed"))


@query("X24_F10_percent", """SELECT l_orderkey, l_linenumber, l_tax, CASE WHEN p >= 99.95 THEN '>99.9%' WHEN p >= 10 THEN CAST(CAST(round(p) AS INT) AS VARCHAR) || '%' WHEN p >= 0.1 THEN printf('%.1f', round(p, 1)) || '%' WHEN p > 0 THEN '<0.1%' ELSE '0%' END AS text
FROM (SELECT l_orderkey, l_linenumber, l_tax, round(l_tax * l_discount * 100, 7) AS p FROM lineitem)""")
def percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", "l_tax", sections.format_percent(F.col("l_tax") * F.col("l_discount")).alias("text"))


@query("P10_P11_P12_code_matches", """WITH c AS (SELECT p_partkey, p_brand || (p_partkey % 3) AS row_code, regexp_replace(upper(p_brand || (p_partkey % 3)), '\\s+', '', 'g') AS a FROM part)
SELECT p_partkey, a = 'BRAND#1' OR (starts_with(a, 'BRAND#1') AND NOT regexp_matches(substr(a, 8, 1), '^[0-9]')) AS dom, starts_with(a, 'BRAND#1') AS api, strpos(upper(row_code), 'D#1') > 0 AND NOT regexp_matches(substr(upper(row_code), strpos(upper(row_code), 'D#1') - 1, 1), '[A-Z]') AS in_text FROM c""")
def code_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.col("p_brand"), (F.col("p_partkey") % 3).cast("string")).alias("code"))
    tight = F.regexp_replace(F.upper("code"), r"\s+", "")
    return part.select("p_partkey", sections.code_matches(F.col("code"), F.lit("Brand#1")).alias("dom"), F.startswith(tight, F.lit("BRAND#1")).alias("api"), sections.code_in_text(F.col("code"), F.lit("D#1")).alias("in_text"))


@query("F01_F02_F06_math", """SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-greatest(-30, least(30, l_quantity - 25)))), 6) AS sigmoid, round(ln(greatest(1e-6, least(1 - 1e-6, l_discount)) / (1 - greatest(1e-6, least(1 - 1e-6, l_discount)))), 6) AS logit,
round(CAST(1 - pow(l_discount, 2) - pow(1 - l_discount, 2) AS DOUBLE), 6) AS gini FROM lineitem""")
def math(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", F.round(vectors.sigmoid(F.col("l_quantity") - 25), 6).alias("sigmoid"), F.round(vectors.logit(F.col("l_discount")), 6).alias("logit"), F.round(vectors.gini(F.col("l_discount"), 1 - F.col("l_discount")), 6).alias("gini"))


@query("F04_G07_prototype_cosine", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), m AS (
  SELECT label, list(avg_x ORDER BY i) AS mean FROM (SELECT label, i, avg(v[i]) AS avg_x FROM e, range(1, 4097) r(i) WHERE i <= len(v) GROUP BY label, i) GROUP BY label
)
SELECT vec_id, m.label AS prototype, round(coalesce((list_sum(list_transform(list_zip(v, mean), lambda z: z[1] * z[2])) / nullif(sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(mean, lambda x: x * x))), 0) + 1) / 2, 0.5), 6) AS cosine FROM e, m""")
def prototype_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    means = vectors.label_means(e, "label", "v")
    return e.select("vec_id", "v").crossJoin(F.broadcast(means)).select("vec_id", F.col("label").alias("prototype"), F.round(vectors.cosine01(F.col("v"), F.col("mean")), 6).alias("cosine"))
