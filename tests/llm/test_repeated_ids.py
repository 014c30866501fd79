"""Ids that occur with more than one content."""

from __future__ import annotations

import corpus_pipeline as P
from vitrail.llm import warc


def test_only_the_shared_payload_of_a_page_id_is_a_revisit(make):
    rows = [(1, "u", "A"), (5, "u", "A"), (5, "u", "B")]
    got = warc.archive_pages(make(rows, "page_id long, url string, html string"))
    kinds = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got.collect())
    assert kinds == [(1, "response", 0), (5, "response", 0), (5, "revisit", 1)]


def test_exact_copies_by_id_and_text(make):
    rows = [(1, "x"), (1, "own"), (9, "x"), (4, "twice"), (4, "twice")]
    kept = P.exact_copies(None, make(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, kept.collect())) == [(1, "own"), (4, "twice"), (9, "x")]
