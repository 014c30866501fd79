"""WARC bundles and main-text extraction."""

from __future__ import annotations

import hashlib
import base64
import html as H
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from vitrail.llm import warc
from vitrail.llm.dom import blocks
from vitrail.llm.html_extraction import Crf, default_model, extract_main_text, main_text, path_features, text_features, train_crf
from vitrail.llm.html_training import labelled_page

DDL = "page_id long, url string, html string, bundle string, text string"


def test_archive_equals_brute_force(make):
    rows = [(3, "http://a", "x<y>é"), (1, None, "x<y>é"), (2, "u", None), (9, "u v\r\nw", ""), (4, "u", "big" * 200_000), (7, "u", "\r\n\r\nWARC/1.1\r\n"), (-5, "u", "n")]
    df = make([(*r, "clash", "c") for r in rows], DDL)
    got = {r.page_id: tuple(r)[1:5] for r in warc.archive_pages(df).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: r[0]):
        b = (h or "").encode()
        f = first.setdefault(b, i)
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        assert got[i] == (len(b), digest, "response" if f == i else "revisit", None if f == i else f)
    assert len(got) == 7
    assert warc.archive_pages(make([], DDL)).collect() == []


def test_repeated_and_missing_ids(make):
    pages = [(1, "a"), (1, "a"), (None, "a"), (2, "a"), (None, "alone"), (None, "both"), (None, "both"), (None, None)]
    df = make([(i, "u", h, "", "") for i, h in pages], DDL)
    got = sorted((str(r.page_id), r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.archive_pages(df).collect())
    want = [("1", "response", 0, 1), ("1", "response", 0, 1), ("2", "revisit", 1, 1), ("None", "response", 0, 0), ("None", "response", 0, 4)]
    assert got == [*want, ("None", "response", 0, 4), ("None", "response", 0, 5), ("None", "revisit", 1, 1)]


def test_bundles_seek_and_decompress_as_a_stream(make, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i % 40} " * 400, "", "") for i in range(300)]
    bundles = warc.write_bundles(make(rows, DDL).coalesce(1))
    index = warc.record_index(bundles)
    assert {(r.page_id, r.frame, r.offset) for r in index.collect()} == {(r.page_id, r.frame, r.offset) for r in warc.read_bundles(bundles).collect()}
    got = {r.page_id: bytes(r.payload) for r in warc.read_payloads(bundles, index.where("page_id % 7 = 0")).collect()}
    assert sorted(got) == list(range(0, 300, 7)) and all(v.decode() == rows[k][2] for k, v in got.items())
    data = bytes(bundles.first().bytes)
    assert len(warc.Bundle(data).sizes) > 1
    path = tmp_path / "x.warc.zst"
    warc.export_bundle(data, str(path))
    with path.open("rb") as f:  # a plain reader skips the footer
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain == b"".join(warc.Bundle(data).frame(i) for i in range(len(warc.Bundle(data).sizes)))


def test_damage_is_noticed():
    w = warc.BundleWriter()
    w.add(warc.record(1, "u", b"payload", None))
    data = w.finish()
    with pytest.raises(ValueError):
        warc.Bundle(data[:-3])


@pytest.mark.parametrize("n", [0, 1, 2**62, 2**63 - 1, -1, -(2**63), None])
def test_record_ids_hold_the_page(n):
    assert warc.page_of(warc.record_id(n)) == n


def test_blocks_of_untidy_html():
    page = "<head><title>no</title></head><nav><a href='/x?a>b'>Home</a></nav><script>var t='<p>x</p>';</script><p>one<b>two<br>three&amp;&eacute;<p>4 < 5<!-- <p>no --><div id=side>s</div tail"
    assert [b.text for b in blocks(page)] == ["Home", "onetwo", "three&é", "4 < 5", "s"]
    assert blocks(None) == [] and blocks("") == [] and blocks("<p") == [] and [b.text for b in blocks("plain \n text")] == ["plain text"]
    assert blocks("<div>" * 3000 + "x")[0].text == "x"


def test_model_on_unseen_labelled_pages():
    m = default_model()
    right = total = 0
    for seed in range(200):
        html, labels = labelled_page(seed)
        found = blocks(html)
        assert len(found) == len(labels)
        scores = [sum(m.weights.get(f, 0) for f in path_features(b.node) + text_features(b)) for b in found]
        right += sum(a == b for a, b in zip(m.decode(scores), labels))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_is_the_best_path_and_marginals_sum():
    import itertools
    import math

    m = Crf({}, [[0.3, -1.0], [-0.5, 0.8]], 0.2)
    s = [0.5, -1.2, 0.1, 2.0, -0.3]

    def score(y):
        return m.start * y[0] + sum(a * b for a, b in zip(s, y)) + sum(m.trans[a][b] for a, b in zip(y, y[1:]))

    paths = list(itertools.product((0, 1), repeat=5))
    assert tuple(m.decode(s)) == max(paths, key=score)
    z = sum(math.exp(score(y)) for y in paths)
    p, counts = m.marginals(s)
    for i in range(5):
        assert p[i] == pytest.approx(sum(math.exp(score(y)) for y in paths if y[i]) / z)
    assert counts[1][1] == pytest.approx(sum(math.exp(score(y)) * sum(a and b for a, b in zip(y, y[1:])) for y in paths) / z)
    assert m.decode([]) == []


def test_training_on_given_pages():
    pages = [(blocks(h), y) for h, y in map(labelled_page, range(40))]
    assert train_crf(pages).weights and train_crf([]).weights == {}


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = " ".join(H.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", article))).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_extraction_edges(make):
    rows = [(1, "u", None, "", "clash"), (2, None, "", "", ""), (None, "u", "<nav><a href=x>m</a></nav>", "", ""), (1, "u", None, "", ""),
            (5, "u", "<article><p>" + "long text, with words. " * 50_000 + "</p></article>", "", "")]
    got = extract_main_text(make(rows, DDL))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5
    assert got.where("page_id = 1").agg(F.max("n_chars")).first()[0] == 0
    assert got.where("page_id = 5").first().n_chars == len("long text, with words. " * 50_000) - 1
    assert extract_main_text(make([], DDL)).collect() == []


@pytest.mark.parametrize(
    "part",
    [
        '<div id="comments"><div class="comment"><p>I disagree with all of this.</p></div></div>',
        '<aside class="sidebar"><h3>More</h3><p>Other things to read on this site.</p></aside>',
        '<div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div>',
        '<form class="newsletter"><p>Sign up for our letter.</p><input></form>',
        "<footer><p>All rights reserved.</p></footer>",
    ],
)
def test_parts_that_are_no_article(part):
    body = "<h1>A title of the story</h1><p>The first paragraph, which is long enough to be told apart. It goes on.</p><p>Second one.</p>"
    want = "A title of the story The first paragraph, which is long enough to be told apart. It goes on. Second one."
    m = default_model()
    for page in (f"<html><body>{part}<article>{body}</article></body></html>", f"<body><article>{body}</article>{part}</body>"):
        assert main_text(page, m) == want


@pytest.mark.parametrize("page", ["<div>x" * 200_000, "<div><b>x" * 50_000 + "</b>" * 100_000, "<span>" * 100_000 + "<hr>x" * 50_000, "<head>x" * 100_000, "<ul><li>x" * 50_000 + "</i>" * 50_000])
def test_deep_and_untidy_pages_take_linear_time(page):
    import time

    began = time.time()
    main_text(page, default_model(20))
    assert time.time() - began < 20


@pytest.mark.parametrize("tag", ["noscript", "object"])
def test_article_text_for_readers_without_scripts_stays(tag):
    story = "The first paragraph, which is long enough to be told apart. It goes on."
    page = f"<body><nav><a href=/>Home</a></nav><article><h1>A title of the story</h1><p>{story}</p><{tag}><p>{story}</p></{tag}><p>{story}</p></article></body>"
    assert main_text(page, default_model()) == f"A title of the story {story} {story} {story}"
