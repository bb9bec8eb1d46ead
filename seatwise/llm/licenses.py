"""Licence scans: Dice coefficient over word bigrams between text units and templates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

THRESHOLD = 0.8

#: Short notices and opening paragraphs of public licences.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_WORD = re.compile(r"[0-9a-z]+")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words of the normalised text: lower case, words of ASCII letters and digits."""
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Templates:
    """Templates by size, so that a unit meets only those whose size allows the threshold."""

    def __init__(self, templates: dict[str, tuple[str, ...]], threshold: float):
        listed = sorted((len(g), name, k, g) for name, texts in templates.items() for k, text in enumerate(texts) if (g := bigrams(text)))
        self.sizes, self.names, self.grams = [x[0] for x in listed], [x[1] for x in listed], [x[3] for x in listed]
        self.threshold = threshold
        self.least = threshold / (2 - threshold)  # 2 min(a, b) / (a + b) >= threshold
        # No unit matches that has fewer bigrams than any template allows, nor one with fewer characters than such bigrams have words.
        self.fewest = int(self.sizes[0] * self.least) if listed else 1

    def matches(self, unit: frozenset) -> Iterator[tuple[str, float]]:
        n = len(unit)
        for i in range(bisect.bisect_left(self.sizes, n * self.least - 1e-9), bisect.bisect_right(self.sizes, n / self.least + 1e-9)):
            if (score := dice(unit, self.grams[i])) >= self.threshold:
                yield self.names[i], score


def units(text: str) -> Iterator[tuple[int, int, str]]:
    """First and last line and text of each line, each paragraph of several lines, and the whole text if that is neither."""
    lines = text.split("\n")
    yield from ((i, i, x) for i, x in enumerate(lines))
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if i - start > 1:
                yield start, i - 1, "\n".join(lines[start:i])
            start = i + 1
    if any(not x.strip() for x in lines):
        yield 0, len(lines) - 1, text


def scan_text(text: str, templates: Templates) -> list[tuple[str, float, int, int]]:
    """Licence, best score and its lines, for each licence found; the best first, then by name."""
    most = templates.sizes[-1] / templates.least if templates.sizes else 0
    best: dict[str, tuple[float, int, int]] = {}
    for first, last, unit in units(text):
        if len(unit) <= templates.fewest:
            continue
        own = bigrams(unit)
        if not templates.fewest <= len(own) <= most:
            continue
        for name, score in templates.matches(own):
            if name not in best or score > best[name][0]:
                best[name] = (score, first, last)
    return sorted(((name, *x) for name, x in best.items()), key=lambda x: (-x[1], x[0]))


def _scan(templates: dict, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("last_line", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("license", "dice", "first_line", "last_line"), x, strict=True)) for x in scan_text(text.as_py() or "", known)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "found"])

    return scan


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, found (license, dice, first_line, last_line of each licence found, best first).

    A unit (line, paragraph or whole text) and a template match if the Dice coefficient of their distinct word bigrams is
    threshold or more. Templates whose number of bigrams can't reach it are never compared. Of equal scores of a licence
    the first unit counts. Null and empty texts find nothing. No shuffle: the templates go with the tasks, and are as many
    as the caller gives.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, found array<struct<license: string, dice: double, first_line: int, last_line: int>>"
    return texts.mapInArrow(_scan(templates or TEMPLATES, threshold), schema).withColumnRenamed("id", id_col)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.try_element_at("found", F.lit(1))
    return found.select("doc_id", best["license"].alias("license"), F.round(best["dice"], 6).alias("dice"), best["first_line"].alias("first_line"), best["last_line"].alias("last_line"), F.size("found").alias("n_licenses"))
