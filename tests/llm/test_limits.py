"""Cases at former limits: units without spaces, runs of many short lines, few pieces, models of several parts."""

import numpy as np
import pytest

from seatwise.llm import licenses, line_dedup, packing, quality


@pytest.mark.parametrize("gap", [" ", "\t", "\u00a0", "-", "\r", " \t "])
def test_a_licence_is_found_whatever_parts_its_words(gap):
    text = gap.join("Released under the MIT License.".split())
    found = licenses.scan_text(f"Some notes\n\n{text}\n", licenses.Templates(licenses.TEMPLATES, 0.8))
    assert [x[0] for x in found] == ["MIT"] and found[0][1] == 1.0


def test_short_units_find_nothing():
    known = licenses.Templates(licenses.TEMPLATES, 0.8)
    assert licenses.scan_text("", known) == [] and licenses.scan_text("\n\t\nMIT\n", known) == []


def test_a_run_of_many_short_lines_is_removed_to_both_ends(spark):
    """48 lines of a word each, fewer words than a window: whatever gram is chosen, its match is extended to the mismatch."""
    run = [f"w{i}" for i in range(48)]
    frame = [f"common{i} line of three more words" for i in range(20)]
    first = "\n".join([*(f"a{x}" for x in frame), *run, *(f"b{x}" for x in frame)])
    second = "\n".join([*(f"c{x}" for x in frame), *run, *(f"d{x}" for x in frame)])
    docs = spark.createDataFrame([(1, first), (2, second)], "doc_id long, text string")
    out = {r.doc_id: r.removed for r in line_dedup.line_dedup(docs, report="removed").collect()}
    assert out[1] is None and (out[2] is None or out[2] == list(range(20, 68)))
    chosen = [p for p, _ in line_dedup.fingerprints(*line_dedup.lines_of(first)[1:])]
    if any(20 <= p <= 20 + 48 - line_dedup.GRAM_WORDS for p in chosen):
        assert out[2] == list(range(20, 68))


@pytest.mark.parametrize("pieces", [0, 1, 7, 60, 500])
def test_few_pieces_are_packed_whole(pieces):
    r = np.random.default_rng(pieces)
    histogram = np.bincount(np.minimum(1024, (r.exponential(300, pieces) + 1).astype(int)), minlength=1025)
    plan = packing.configurations(histogram, 1024)
    ids = (histogram * np.arange(1025)).sum()
    assert (sum((u * k for u, k in plan), np.zeros(1025, int)) == histogram).all()
    assert all(k > 0 and (u * np.arange(1025)).sum() <= 1024 for u, k in plan)
    assert sum(k for _, k in plan) <= sum(k for _, k in packing.best_fit(histogram.astype(np.int64).copy(), 1024))
    assert sum(k for _, k in plan) >= -(-ids // 1024)


def test_few_pieces_are_packed_by_the_linear_program(monkeypatch):
    """The plan's first configurations are the LP's, not best-fit's."""
    histogram = np.bincount([700, 300, 324, 700, 324, 512, 512], minlength=1025)
    monkeypatch.setattr(packing, "solve", lambda left, capacity, rounds: [(np.bincount([700, 324], minlength=1025), 1.5)])
    plan = packing.configurations(histogram, 1024)
    assert (plan[0][0] == np.bincount([700, 324], minlength=1025)).all() and sum(k for u, k in plan if u[700] and u[324]) == 2


def test_a_model_of_several_parts_keeps_the_same_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sorted(r.doc_id for r in quality.keep_good(docs).select("doc_id").collect())
    grams = quality.kneser_ney(quality._texts(docs, "doc_id", "text", "lang")).count()
    monkeypatch.setattr(quality, "TABLE", grams // 2)
    parted = quality.keep_good(docs)
    assert parted.columns == docs.columns
    assert sorted(r.doc_id for r in parted.select("doc_id").collect()) == whole and 0 < len(whole) < docs.count()
