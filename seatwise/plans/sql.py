"""Building blocks of the oracle SQL: common table expressions over the provided tables."""

from __future__ import annotations

from .adapter import OFFERINGS_SQL

ORD = "(({0} // 10) * 3 + {0} % 10 - 1)"


def evidence_sql(targets: tuple[int, ...]) -> str:
    listed = ", ".join(f"({t})" for t in targets)
    return f"""{OFFERINGS_SQL}, targets(target) AS (VALUES {listed}), parsed AS (
  SELECT *, list_distinct(regexp_extract_all(replace(days, ' ', ''), 'TH|SA|SU|M|T|W|F|S')) AS dlist,
    CASE WHEN time_start LIKE '%AM' THEN CAST(split_part(time_start, ':', 1) AS INT) * 60 WHEN time_start LIKE '%PM' THEN 720 ELSE (CAST(split_part(time_start, ':', 1) AS INT) + 12) * 60 + 30 END AS start,
    regexp_extract(section, '^([A-Z]+)', 1) AS family, CASE WHEN regexp_matches(section, '(-[0-9]*L|[A-Z]+[0-9]+L)$') THEN 'lab' ELSE 'lecture' END AS kind, term % 10 AS sem
  FROM offerings
), ev AS (
  SELECT p.*, target, pow(0.5, ({ORD.format('target')} - {ORD.format('term')}) / 4.0) AS w FROM parsed p JOIN targets ON term < target
), own AS (
  SELECT course_code, target, prof_key, sum(w) AS weight, count(*) AS n_rows, count(DISTINCT term) AS n_terms, min(term) AS first_term, max(term) AS last_term, min(seq) AS cand_seq,
    list(DISTINCT term) AS terms, list(DISTINCT {{'d': list_sort(dlist), 's': start}}) AS slots, sum(CASE WHEN sem = target % 10 THEN w ELSE 0 END) AS w_sem,
    sum(CASE WHEN kind = 'lab' THEN w ELSE 0 END) AS w_lab, sum(CASE WHEN kind = 'lab' THEN 0 ELSE w END) AS w_lecture
  FROM ev GROUP BY ALL
), whole AS (
  SELECT course_code, target, sum(w) AS total_weight, count(DISTINCT term) AS n_history, list_sort(list(DISTINCT term)) AS history FROM ev GROUP BY ALL
), prof AS (
  SELECT own.*, total_weight, n_history, history[greatest(1, n_history - 3):] AS recent, n_rows / n_terms AS avg_load, n_terms / n_history AS tenure,
    {ORD.format('target')} - {ORD.format('last_term')} AS gap FROM own JOIN whole USING (course_code, target)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY course_code, target, section ORDER BY term DESC, seq DESC) AS rn FROM ev
), memory0 AS (
  SELECT course_code, target, section, max(CASE WHEN rn = 1 THEN prof_key END) AS last_prof, max(term) AS last_seat_term, max(CASE WHEN rn = 2 THEN prof_key END) AS prev_prof,
    arg_max(prof_key, term) FILTER (sem = target % 10) AS last_same_prof, max(term) FILTER (sem = target % 10) AS last_same_term, count(DISTINCT prof_key) / count(DISTINCT term) AS turnover
  FROM ranked GROUP BY ALL
), memory AS (
  SELECT m.*, coalesce(gap, 99) >= 4 AS vacant FROM memory0 m LEFT JOIN prof p ON p.course_code = m.course_code AND p.target = m.target AND p.prof_key = last_prof
), novelty AS (
  SELECT course_code, target, coalesce(greatest(0.02, least(0.6, avg(CASE WHEN term > opening THEN CAST(debut = term AS INT) END))), 0.15) AS novelty
  FROM (SELECT *, min(term) OVER (PARTITION BY course_code, target) AS opening, min(term) OVER (PARTITION BY course_code, target, prof_key) AS debut FROM ev) GROUP BY ALL
), seats AS (
  SELECT course_code, target, section, dlist AS seat_days, start AS seat_start, room AS seat_room, family, kind, prof_key AS truth, seq AS seat_seq FROM parsed JOIN targets ON term = target
)"""


FEATURES_SQL = """by_section AS (SELECT course_code, target, prof_key, section, sum(w) AS w_section, min(term) AS section_first FROM ev GROUP BY ALL),
by_family AS (SELECT course_code, target, prof_key, family, sum(w) AS w_family, min(term) AS family_first FROM ev GROUP BY ALL),
by_room AS (SELECT course_code, target, prof_key, room AS seat_room, sum(w) AS w_room FROM ev GROUP BY ALL),
pairing AS (
  SELECT s.*, p.* EXCLUDE (course_code, target), w_section, section_first, w_family, family_first, w_room, last_prof, last_seat_term, last_same_prof, turnover, vacant,
    list_transform(slots, lambda x: CASE WHEN len(seat_days) = 0 OR len(x.d) = 0 THEN 0.0 ELSE len(list_intersect(seat_days, x.d)) / len(list_distinct(list_concat(seat_days, x.d))) END) AS dj,
    list_transform(slots, lambda x: greatest(0.0, 1 - abs(seat_start - x.s) / 180.0)) AS tj
  FROM seats s JOIN prof p USING (course_code, target) LEFT JOIN by_section USING (course_code, target, prof_key, section) LEFT JOIN by_family USING (course_code, target, prof_key, family)
    LEFT JOIN by_room USING (course_code, target, prof_key, seat_room) LEFT JOIN memory USING (course_code, target, section)
), features AS (
  SELECT course_code, target, section, family, kind, prof_key, cand_seq, truth,
    least(1, weight / total_weight) AS freq_decay, w_sem / weight AS same_sem_share, least(1, coalesce(w_section, 0) / weight) AS section_exact, least(1, coalesce(w_family, 0) / weight) AS section_family,
    list_max(list_transform(list_zip(dj, tj), lambda z: z[1] * z[2])) AS slot_affinity, list_max(dj) AS day_affinity, list_max(tj) AS time_affinity, least(1, coalesce(w_room, 0) / weight) AS room_affinity,
    pow(0.5, gap / 4.0) AS recency, len(list_intersect(recent, terms)) / len(recent) AS streak, least(1, avg_load / 4) AS load_share, least(1, tenure) AS tenure, 0.0 AS verified,
    CASE WHEN last_same_prof = prof_key AND gap < 4 THEN 1.0 ELSE 0.0 END AS last_same_sem,
    CASE WHEN last_prof IS NOT NULL AND n_terms <= 2 AND gap <= 2 THEN least(1, 0.35 + CASE WHEN vacant THEN 0.45 ELSE 0 END + CASE WHEN turnover >= 0.45 THEN 0.2 ELSE 0 END) ELSE 0.0 END AS newcomer_fit,
    CASE WHEN last_prof IS NOT NULL AND vacant AND last_prof <> prof_key AND n_terms <= 2 AND gap <= 2 THEN CASE WHEN coalesce(section_first, family_first) > last_seat_term THEN 0.9 ELSE 0.45 END ELSE 0.0 END AS successor_fit,
    CASE WHEN kind = 'lab' THEN w_lab ELSE w_lecture END / weight AS component_fit
  FROM pairing
)"""

HEURISTIC_SQL = """scored AS (
  SELECT *, 1.6 * freq_decay + 1.1 * same_sem_share + 2.2 * section_exact + 0.7 * section_family + 2.6 * slot_affinity + 0.5 * day_affinity + 0.5 * time_affinity + 0.6 * room_affinity + 1.4 * recency
    + 0.9 * streak + 0.3 * load_share + 0.4 * tenure + 6.0 * verified + 2.8 * last_same_sem + 1.7 * newcomer_fit + 1.5 * successor_fit + 1.8 * component_fit AS heuristic
  FROM features
)"""

PAIRS_SQL = """one AS (SELECT DISTINCT course_code, target, term, prof_key, w FROM ev),
active AS (SELECT course_code, target, prof_key, sum(w) AS active FROM one GROUP BY ALL),
pairs AS (SELECT x.course_code, x.target, x.prof_key AS a, y.prof_key AS b, sum(x.w) AS together FROM one x JOIN one y ON x.course_code = y.course_code AND x.target = y.target AND x.term = y.term AND x.prof_key < y.prof_key GROUP BY ALL),
seat_seat AS (SELECT course_code, target, g_section, g_prof, section, prof_key, hit / base AS p_seat FROM (
  SELECT o.course_code, o.target, o.section AS g_section, o.prof_key AS g_prof, s.section, s.prof_key, sum(o.w) AS hit FROM ev o JOIN ev s ON o.course_code = s.course_code AND o.target = s.target AND o.term = s.term AND o.section <> s.section GROUP BY ALL)
  JOIN (SELECT course_code, target, section AS g_section, prof_key AS g_prof, sum(w) AS base FROM ev GROUP BY ALL) USING (course_code, target, g_section, g_prof)),
fam AS (SELECT DISTINCT course_code, target, term, family, prof_key, w FROM ev),
fam_fam AS (SELECT course_code, target, g_family, g_prof, family, prof_key, hit / base AS p_family FROM (
  SELECT o.course_code, o.target, o.family AS g_family, o.prof_key AS g_prof, s.family, s.prof_key, sum(o.w) AS hit FROM fam o JOIN fam s ON o.course_code = s.course_code AND o.target = s.target AND o.term = s.term AND NOT (o.family = s.family AND o.prof_key = s.prof_key) GROUP BY ALL)
  JOIN (SELECT course_code, target, family AS g_family, prof_key AS g_prof, sum(w) AS base FROM fam GROUP BY ALL) USING (course_code, target, g_family, g_prof)),
bundle AS (SELECT course_code, target, prof_key, g_family, family, hit / base AS p_bundle FROM (
  SELECT o.course_code, o.target, o.prof_key, o.family AS g_family, s.family, sum(o.w) AS hit FROM ev o JOIN ev s ON o.course_code = s.course_code AND o.target = s.target AND o.term = s.term AND o.prof_key = s.prof_key AND o.section <> s.section GROUP BY ALL)
  JOIN (SELECT course_code, target, prof_key, family AS g_family, sum(w) AS base FROM ev GROUP BY ALL) USING (course_code, target, prof_key, g_family))"""

GUESSES_SQL = """few AS (SELECT *, row_number() OVER (PARTITION BY course_code, target, section ORDER BY heuristic DESC, cand_seq, prof_key) AS rn FROM scored QUALIFY rn <= 5),
guesses AS (SELECT course_code, target, section, family, prof_key, cand_seq, e / sum(e) OVER (PARTITION BY course_code, target, section) AS probability
  FROM (SELECT *, exp((heuristic - max(heuristic) OVER (PARTITION BY course_code, target, section)) / 1.5) AS e FROM few))"""
