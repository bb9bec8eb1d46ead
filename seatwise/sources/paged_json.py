"""Paged JSON responses as a data source: one partition for each course and term, pages read in turn.

Options: path with {course}, {term} and {page} in it, pairs as a JSON list of [course, term], pages (the most pages).
A course and term ends with an empty page, a page that starts like the first one, the last page that the response names
(one if it names none), or the most pages. The first page must be there; a later one that fails ends the reading.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_PAGES = 25
#: How a class row, and numbers about pages, are known by their keys.
ROW_KEY = re.compile(r"^(course_?code|code|section|section_name|class_section)$", re.I)
LAST_PAGE, TOTAL = re.compile(r"^(last_?page|total_?pages|page_?count)$", re.I), re.compile(r"^(total|total_?count)$", re.I)


def walk(node, depth: int) -> Iterator[tuple[str, object]]:
    """Key and value of everything below node, level by level, down to depth."""
    level = [node]
    for _ in range(depth + 1):
        below = []
        for one in level:
            pairs = list(one.items()) if isinstance(one, dict) else [("", v) for v in one[:6]] if isinstance(one, list) else []
            yield from pairs
            below += [v for _, v in pairs if isinstance(v, dict | list)]
        level = below


def looks_like_rows(value) -> bool:
    return isinstance(value, list) and bool(value) and isinstance(value[0], dict) and any(ROW_KEY.match(k) for k, _ in walk(value[0], 2))


def record_array(data) -> list[dict]:
    """The rows of a response: the root, or the first list whose head looks like a row, or else the longest list of objects."""
    if looks_like_rows(data):
        return data
    lists = [v for _, v in walk(data, 5) if isinstance(v, list) and v and isinstance(v[0], dict)]
    return next((v for v in lists if looks_like_rows(v)), max(lists, key=len, default=data if isinstance(data, list) else []))


def page_info(data) -> tuple[int | None, int | None]:
    """Last page and total, as far as the response names them."""
    number = lambda p: next((v for k, v in walk(data, 4) if p.match(k) and isinstance(v, int)), None)
    return number(LAST_PAGE), number(TOTAL)


def pages(read, most: int = MOST_PAGES) -> Iterator[tuple[int, list[dict]]]:
    """Rows page by page. read: gives a page's response by number."""
    first = None
    for page in range(1, most + 1):
        try:
            data = read(page)
        except (OSError, ValueError):
            if page == 1:
                raise
            return
        rows = record_array(data)
        if not rows or (page > 1 and rows[0] == first):
            return
        first = rows[0] if page == 1 else first
        yield page, rows
        if page >= (page_info(data)[0] or 1):
            return


class Pair(InputPartition):
    def __init__(self, course: str, term: int):
        self.course, self.term = course, term


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "course_code string, term int, page int, row string"

    def reader(self, schema):
        return PagedJsonReader(self.options)


class PagedJsonReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [Pair(c, t) for c, t in json.loads(self.options["pairs"])]

    def read(self, partition):
        def load(page: int):
            with open(self.options["path"].format(course=partition.course, term=partition.term, page=page)) as f:
                return json.load(f)

        for page, rows in pages(load, int(self.options.get("pages", MOST_PAGES))):
            for row in rows:
                yield partition.course, int(partition.term), page, json.dumps(row)
