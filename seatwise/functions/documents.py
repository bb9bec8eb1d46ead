"""Searching JSON documents of unknown shape, as columns: nothing is exploded, so a search costs no shuffle.

A document's entries (key and value of everything in it) are listed level by level, in the document's own order, and
searched by key and by an acceptance test. Values keep their JSON text; their kind is told by VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as free_text
from .binding import let
from .names import is_tba, normalize

#: The keys, in any case, under which documents hold what is looked for.
INSTRUCTOR = "instructor instructors faculty facultys faculties professor professors prof profs teacher teachers lecturer lecturers assigned_faculty assigned_facultys faculty_name faculty_names instructor_name instructor_names handled_by handled_bys teaching_staff teaching_staffs".split()
NAME = "name full_name fullname complete_name display_name faculty_name instructor_name employee_name text label".split()
DAYS = "day days day_code day_codes schedule_days meeting_days".split()
START = "time_start start_time from_time begin_time time_from start".split()
END = "time_end end_time to_time finish_time time_to end".split()
ROOM = "room room_name room_code venue location room_no".split()
SECTION = "section section_name class_section section_code".split()
SCHEDULES = "schedule schedules class_schedule class_schedules meetingtime meetingtimes meeting_time meeting_times timeslot timeslots lecture_details laboratory_details details".split()
SCHEDULE_TEXT = "schedule sched time class_schedule meeting".split()
LABEL = "class_name name title label code".split()
COURSE = "course_code subject_code course_number code course".split()
STATUS = "class_status status availability".split()
ROW_COURSE, ROW_SECTION = [*COURSE, "course_no"], [*SECTION, "class_code"]
LAST_NAME, FIRST_NAME, MIDDLE_NAME = "last_name lastname surname family_name".split(), "first_name firstname given_name".split(), "middle_name middlename middle_initial mi".split()
#: Fixed values, in this case only: the keys of numbers about pages.
LAST_PAGE, PAGE, TOTAL = "last_page lastPage total_pages totalPages pageCount".split(), "current_page currentPage page".split(), "total total_count totalCount totalRecords".split()
#: Items of a list that a search follows.
ITEMS = 6

_ENTRY = "array<struct<key: string, text: string, kind: string, path: string, depth: int>>"
_NODE = "array<struct<text: string, kind: string, path: string>>"


def _kind(variant: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def items(text: Column) -> Column:
    """The elements of a JSON list: array of (text, kind); null if it is none."""
    return F.arrays_zip(F.from_json(text, "array<string>").alias("text"), F.transform(F.from_json(text, "array<variant>"), _kind).alias("kind"))


def _fields(text: Column) -> Column:
    return F.arrays_zip(F.map_entries(F.from_json(text, "map<string, string>")).alias("e"), F.transform(F.map_values(F.from_json(text, "map<string, variant>")), _kind).alias("kind"))


def _joined(path: Column, key: Column) -> Column:
    return F.when(path == "", key).otherwise(F.concat(path, F.lit("."), key))


def _entries_of(node: Column, depth: int) -> Column:
    entry = lambda key, text, kind: F.struct(key.alias("key"), text.alias("text"), kind.alias("kind"), _joined(node["path"], key).alias("path"), F.lit(depth).alias("depth"))
    fields = F.transform(_fields(node["text"]), lambda f: entry(f["e"]["key"], f["e"]["value"], f["kind"]))
    listed = F.transform(items(node["text"]), lambda v, i: entry(i.cast("string"), v["text"], v["kind"]))
    return F.coalesce(F.when(node["kind"] == "OBJECT", fields).otherwise(listed), F.array().cast(_ENTRY)).cast(_ENTRY)


def _node(text: Column, kind: Column, path: Column) -> Column:
    return F.struct(text.alias("text"), kind.alias("kind"), path.alias("path"))


def _below(entry: Column, lists: str) -> Column:
    """The nodes that an entry leads to. lists: of lists the first ITEMS that are no scalars (head), the list as a node, where a list is in it (node), or none (skip)."""
    none = F.array().cast(_NODE)
    own = F.array(_node(entry["text"], entry["kind"], entry["path"])).cast(_NODE)
    if lists == "node":
        return F.when(entry["kind"].isin("OBJECT", "ARRAY") & (F.locate("[", entry["text"], 2) > 0), own).otherwise(none)
    out = F.when(entry["kind"] == "OBJECT", own)
    if lists == "head":
        head = F.slice(items(entry["text"]), 1, ITEMS)
        at = F.transform(head, lambda v, i: _node(v["text"], v["kind"], F.concat(entry["path"], F.lit("["), i.cast("string"), F.lit("]"))))
        out = out.when(entry["kind"] == "ARRAY", F.filter(at, lambda n: n["kind"].isin("OBJECT", "ARRAY")).cast(_NODE))
    return out.otherwise(none)


def kind_of(text: Column) -> Column:
    return _kind(F.try_parse_json(text))


def entries(text: Column, depth: int, lists: str = "head", kind: Column | None = None) -> Column:
    """Entries (key, text, kind, path, depth) of a document down to depth, level by level; all of a node's before those below it. Empty for what is no JSON list or object. kind: the document's, if known."""

    def level(nodes: Column, d: int) -> Column:
        found = F.flatten(F.transform(nodes, lambda n: _entries_of(n, d)))
        if d == depth:
            return found
        return let(found, lambda here: F.concat(here, level(F.flatten(F.transform(here, lambda e: _below(e, lists))), d + 1)))

    return F.coalesce(level(F.array(_node(text, kind_of(text) if kind is None else kind, F.lit(""))).cast(_NODE), 0), F.array().cast(_ENTRY))


def filled(e: Column) -> Column:
    """The plain acceptance test: neither null nor the empty string."""
    return e["text"].isNotNull() & (e["kind"] != "VOID") & (e["text"] != "")


def scalar(e: Column) -> Column:
    return e["text"].isNotNull() & e["kind"].isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def keyed(e: Column, keys: list[str]) -> Column:
    """Whether an entry's key in lower case is one of keys, which are ASCII: only A to Z and the Kelvin sign become ASCII letters, so lower(), which took most of a search's time, isn't called for keys without any."""
    return e["key"].isin(keys) | (e["key"].rlike("[A-Z\u212a]") & F.lower(e["key"]).isin(keys))


def matching(listed: Column, keys: list[str], accept: Callable[[Column], Column] = filled, depth: int | None = None) -> Column:
    near = lambda e: F.lit(True) if depth is None else e["depth"] <= depth
    return F.filter(listed, lambda e: keyed(e, keys) & near(e) & accept(e))


def find(listed: Column, keys: list[str], accept: Callable[[Column], Column] = filled, depth: int | None = None) -> Column:
    """The first entry under one of the keys that is accepted, nearest to the root; null if there is none."""
    return F.get(matching(listed, keys, accept, depth), F.lit(0))


def composed_name(listed: Column) -> Column:
    """LAST, FIRST MIDDLE of an object's own entries; one of the first two alone if the other is missing, and nothing without both."""
    told = lambda keys: F.filter(listed, lambda e: e["key"].isin(keys) & e["text"].isNotNull() & (e["kind"] != "VOID"))
    order = lambda keys, e: F.array_position(F.array(*(F.lit(k) for k in keys)), e["key"])
    given = lambda keys: F.coalesce(F.array_min(F.transform(told(keys), lambda e: F.struct(order(keys, e).alias("order"), F.trim(e["text"]).alias("text"))))["text"], F.lit(""))
    return let(F.struct(given(LAST_NAME).alias("l"), given(FIRST_NAME).alias("f"), given(MIDDLE_NAME).alias("m")), lambda n: (
        F.when((n["l"] != "") & (n["f"] != ""), F.trim(F.concat(n["l"], F.lit(", "), n["f"], F.when(n["m"] != "", F.concat(F.lit(" "), n["m"])).otherwise("")))).otherwise(F.concat(n["l"], n["f"]))))


def resolved_name(text: Column, kind: Column, depth: int = 3) -> Column:
    """A person's name from a value of any shape; empty if it holds none.

    A scalar is the name. Of a list, the distinct names of its elements joined by " / ", those that name nobody left out. Of an
    object its first name-like text, else what its parts compose, else the first instructor-like entry that resolves.
    """
    plain = F.when(kind.isin("STRING", "BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), F.trim(text))
    none = F.array().cast("array<struct<text: string, kind: string>>")

    def named(own: Column) -> Column:
        inner = F.transform(matching(own, INSTRUCTOR), lambda e: F.struct(e["text"].alias("text"), e["kind"].alias("kind")))
        parts = F.when(kind == "ARRAY", items(text)).otherwise(inner) if depth else none
        below = F.transform(parts, lambda v: resolved_name(v["text"], v["kind"], depth - 1)) if depth else F.array().cast("array<string>")
        said = F.trim(find(own, NAME, lambda e: (e["kind"] == "STRING") & (F.trim(e["text"]) != ""))["text"])
        return let(below, lambda names: F.when(kind == "ARRAY", F.array_join(F.array_distinct(F.filter(names, lambda n: (n != "") & ~is_tba(n))), " / ")).otherwise(
            F.coalesce(said, F.nullif(composed_name(own), F.lit("")), F.get(F.filter(names, lambda n: n != ""), F.lit(0)))))

    own = F.when(kind == "OBJECT", _entries_of(_node(text, kind, F.lit("")), 0)).otherwise(F.array().cast(_ENTRY))
    return F.coalesce(plain.when(kind.isin("ARRAY", "OBJECT"), let(own, named)), F.lit(""))


def looks_like_row(text: Column, kind: Column | None = None) -> Column:
    """Whether an object has, within two levels of objects, a course or a section: a filled scalar, or an object with a code, name, label or id.

    Level by level, scalars first: once one tells, nothing below is parsed. kind: the document's, if known.
    """
    inner = lambda e: F.exists(_entries_of(_node(e["text"], e["kind"], F.lit("")), 0), lambda x: x["key"].isin("code", "name", "label", "id") & filled(x))
    row = lambda e: keyed(e, ROW_COURSE + ROW_SECTION)
    tells = lambda listed: F.exists(listed, lambda e: row(e) & scalar(e) & (F.trim(e["text"]) != "")) | F.exists(listed, lambda e: row(e) & (e["kind"] == "OBJECT") & inner(e))

    def level(nodes: Column, d: int) -> Column:
        found = F.flatten(F.transform(nodes, lambda n: _entries_of(n, d)))
        return let(found, lambda here: tells(here) if d == 2 else tells(here) | level(F.flatten(F.transform(here, lambda e: _below(e, "skip"))), d + 1))

    return F.coalesce(level(F.array(_node(text, kind_of(text) if kind is None else kind, F.lit(""))).cast(_NODE), 0), F.lit(False))


def record_list(text: Column) -> Column:
    """Where a response holds its rows: struct path, text, rows (the list's elements as JSON). The root, if it is a list whose head looks like a row
    (or is empty); else the list nearest to the root whose head does; else the longest list of objects, the nearest of equals; else null."""
    texts = lambda t: F.from_json(t, "array<string>")
    of_objects = lambda t: _kind(F.get(F.from_json(t, "array<variant>"), F.lit(0))) == "OBJECT"
    row = lambda r: looks_like_row(F.get(r, F.lit(0)), F.lit("OBJECT"))
    out = lambda e: F.struct(e["path"].alias("path"), e["text"].alias("text"), e["rows"].alias("rows"))

    def inside(kind: Column) -> Column:
        lists = F.filter(entries(text, 5, "node", kind), lambda e: (e["kind"] == "ARRAY") & of_objects(e["text"]))
        rated = F.transform(lists, lambda e, i: let(texts(e["text"]), lambda r: F.struct(F.size(r).alias("n"), (-i).alias("order"), e["path"].alias("path"), e["text"].alias("text"), r.alias("rows"))))
        best = let(rated, lambda found: F.coalesce(F.get(F.filter(found, lambda e: row(e["rows"])), F.lit(0)), F.array_max(found)))
        return let(best, lambda e: F.when(e.isNotNull(), out(e)))

    root = let(F.struct(F.lit("").alias("path"), text.alias("text"), texts(text).alias("rows")), lambda e: F.when((F.size(e["rows"]) == 0) | (of_objects(text) & row(e["rows"])), e))
    return let(kind_of(text), lambda kind: F.coalesce(F.when(kind == "ARRAY", root), inside(kind)))


def record_array(text: Column) -> Column:
    """record_list without the rows."""
    return let(record_list(text), lambda e: F.when(e.isNotNull(), F.struct(e["path"].alias("path"), e["text"].alias("text"))))


def page_info(text: Column) -> Column:
    """Struct last_page, page, total: the first last page and total that aren't zero, and the deepest current page, within four levels of objects; null where missing (page: 1)."""
    number = lambda e: e["text"].try_cast("double")
    pick = lambda listed, keys, zero: F.transform(F.filter(listed, lambda e: e["key"].isin(keys) & number(e).isNotNull() & (F.lit(zero) | (number(e) != 0))), lambda e: number(e).cast("long"))
    return let(entries(text, 4, "skip"), lambda all_: F.struct(
        F.get(pick(all_, LAST_PAGE, False), F.lit(0)).alias("last_page"), F.coalesce(F.try_element_at(pick(all_, PAGE, True), F.lit(-1)), F.lit(1)).alias("page"), F.get(pick(all_, TOTAL, False), F.lit(0)).alias("total")))


def section_of(listed: Column) -> Column:
    """Struct value, path: a section's own key, else what stands behind the last dash of a label; null without either."""
    behind = lambda e: F.regexp_extract(e["text"], "[-–]\\s*([A-Za-z0-9][A-Za-z0-9-]*)\\s*$", 1)
    own = let(find(listed, SECTION, scalar, 3), lambda e: F.when(e.isNotNull(), F.struct(F.trim(e["text"]).alias("value"), e["path"].alias("path"))))
    parsed = let(find(listed, LABEL, lambda e: (e["kind"] == "STRING") & e["text"].rlike("[-–]"), 2), lambda e: F.when(behind(e) != "", F.struct(behind(e).alias("value"), F.concat(e["path"], F.lit(" (parsed)")).alias("path"))))
    return F.coalesce(own, parsed)


def instructor_of(listed: Column) -> Column:
    """Struct value, path of the first instructor-like entry that resolves to a name; null without one."""
    told = F.transform(matching(listed, INSTRUCTOR, lambda e: e["text"].isNotNull(), 4), lambda e: F.struct(resolved_name(e["text"], e["kind"]).alias("value"), e["path"].alias("path")))
    return F.get(F.filter(told, lambda t: t["value"] != ""), F.lit(0))


def schedule_of(listed: Column) -> Column:
    """Struct days, time_start, time_end, room, paths (what:path): from the first part of a schedule, or the document itself, that has
    days or a start; else from a schedule as text; all empty without either."""
    word = lambda e: F.coalesce(F.trim(e["text"]), F.lit(""))
    days = lambda e: F.when(e["kind"] == "ARRAY", F.array_join(F.from_json(e["text"], "array<string>"), " ")).otherwise(word(e))
    place = lambda e: F.when(e["kind"].isin("OBJECT", "ARRAY"), resolved_name(e["text"], e["kind"])).otherwise(word(e))

    def read(part: Column) -> Column:
        at = F.struct(*(find(part, keys, depth=2).alias(n) for n, keys in (("days", DAYS), ("start", START), ("end", END), ("room", ROOM))))
        paths = lambda f: F.array_compact(F.array(*(F.concat(F.lit(f"{n}:"), f[n]["path"]) for n in ("days", "start", "end", "room"))))
        return let(at, lambda f: F.struct(F.coalesce(days(f["days"]), F.lit("")).alias("days"), word(f["start"]).alias("time_start"), word(f["end"]).alias("time_end"), place(f["room"]).alias("room"), paths(f).alias("paths")))

    some = lambda s: F.when((s["days"] != "") | (s["time_start"] != ""), s)
    parts = lambda held: F.when(held["kind"] == "ARRAY", F.transform(F.filter(items(held["text"]), lambda v: v["kind"] == "OBJECT"), lambda v: v["text"])).when(held["kind"] == "OBJECT", F.array(held["text"]))
    told = let(find(listed, SCHEDULES, lambda e: filled(e) & ~e["text"].isin("false", "0"), 2), lambda held: F.get(F.filter(F.transform(parts(held), lambda p: some(let(entries(p, 2), read))), lambda s: s.isNotNull()), F.lit(0)))
    said = find(listed, SCHEDULE_TEXT, lambda e: (e["kind"] == "STRING") & (F.length(F.trim(e["text"])) > 3), 3)
    blank = F.struct(*(F.lit("").alias(n) for n in ("days", "time_start", "time_end", "room")), F.array().cast("array<string>").alias("paths"))
    in_words = let(said, lambda e: let(F.struct(free_text.schedule(e["text"]).alias("s"), e["path"].alias("path")), lambda t: F.when(t["s"].isNotNull(), F.struct(
        t["s"]["days"].alias("days"), t["s"]["time_start"].alias("time_start"), t["s"]["time_end"].alias("time_end"), t["s"]["room"].alias("room"), F.array(F.concat(F.lit("text:"), t["path"])).alias("paths")))))
    return F.coalesce(told, let(read(listed), some), in_words, blank)


def course_fits(listed: Column, course: Column) -> Column:
    """Whether a document's course, if it names one, starts like the wanted one."""
    code = normalize(F.coalesce(find(listed, COURSE, lambda e: (e["kind"] == "STRING") & (F.trim(e["text"]) != ""), 3)["text"], F.lit("")))
    return (code == "") | code.startswith(normalize(course))
