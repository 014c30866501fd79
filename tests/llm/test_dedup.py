"""Exact dedup, n-gram join and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from vitrail.llm.components import components, local_stars
from vitrail.llm.exact_dedup import exact_dedup
from vitrail.llm.ngram_join import RTree, SizeClasses, cell_links, ngram_join
from vitrail.llm.suffix_dedup import suffix_dedup, without_repeats

DDL = "doc_id long, text string, spans string, runs int"


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def word_soup(r, n):
    return " ".join("".join(r.choice("abcdéß") for _ in range(r.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    base, passage = word_soup(r, 80), word_soup(r, 60)
    texts = [None, "", "", " \n\t", "one", "One", "two words", "a" * 700, "ab" * 400, base, base]
    for _ in range(30):
        w = base.split()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word_soup(r, 1)
        texts.append(" ".join(w))
    for _ in range(8):
        texts.append(word_soup(r, r.randint(0, 40)) + " " + passage + " " + word_soup(r, 20))
    texts.append(word_soup(r, 9000) + passage)
    texts += [word_soup(r, r.randint(3, 90)) for _ in range(25)]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i * 3, texts[k], "clash", 1) for i, k in enumerate(order)]


def brute_suffix(rows, width=100):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for s in range(len(b) - width + 1):
            w = b[s : s + width]
            if w in seen:
                mark[s : s + width] = b"\1" * width
            seen.add(w)
        kept = bytes(x for x, m in zip(b, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def shingles(t, k=3):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_join(rows, num=90, den=100):
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_suffix_dedup_equals_brute_force(make, corpus):
    assert rows_of(suffix_dedup(make(corpus, DDL))) == brute_suffix(corpus)


@pytest.mark.parametrize("width", [64, 128])
def test_suffix_dedup_other_widths(make, corpus, width):
    assert rows_of(suffix_dedup(make(corpus, DDL), width=width)) == brute_suffix(corpus, width)


def test_suffix_dedup_is_independent_of_partitions(make, corpus):
    df = make(corpus, DDL)
    assert rows_of(suffix_dedup(df.repartition(7))) == rows_of(suffix_dedup(df.coalesce(1)))


def test_suffix_dedup_long_text_in_tiles(make, monkeypatch):
    monkeypatch.setattr("vitrail.llm.suffix_dedup.LONG", 4096)
    monkeypatch.setattr("vitrail.llm.suffix_dedup.TILE", 1024)
    from vitrail.llm import suffix_dedup as module

    r = random.Random(1)
    text = word_soup(r, 4000)
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2]), pa.array([text, text[:5000]])], names=["doc_id", "text"])
    seen = []
    for data, starts, ends, ids, bases in module._tiles(batch, 100):
        found = module.runs(data, starts, ends, 100)
        seg = np.searchsorted(starts, found[2], side="right") - 1
        for d, lo, more in zip(ids[seg], found[2] - starts[seg] + bases[seg], found[3]):
            seen += [(int(d), s) for s in range(lo, lo + more + 1)]
    want = [(1, s) for s in range(len(text.encode()) - 99)] + [(2, s) for s in range(len(text[:5000].encode()) - 99)]
    assert sorted(seen) == sorted(want)


def test_suffix_dedup_edges(make):
    x = "0123456789" * 11
    rows = [(1, x, "", 0), (1, x, "", 0), (2, x, "", 0), (None, x, "", 0), (3, None, "", 0)]
    got = sorted(tuple(r) for r in suffix_dedup(make(rows, DDL)).select("doc_id", "n_bytes", "n_removed", "n_spans").na.fill(-1).collect())
    # x repeats itself: its windows from byte 10 on start earlier too
    assert got == [(-1, 110, 0, 0), (1, 110, 100, 1), (1, 110, 100, 1), (2, 110, 110, 1), (3, 0, 0, 0)]
    assert suffix_dedup(make([], DDL)).collect() == []


def test_without_repeats_keeps_characters_whole(make):
    x = "é" * 10 + "abcdefghij" * 10 + "ß"
    rows = [(1, "12" + x + "34", "s", 1), (2, "5ö" + x + "é", "s", 2), (4, None, "s", 3)]
    got = {r.doc_id: r for r in without_repeats(make(rows, DDL)).collect()}
    assert got[2].text == "5öé" and got[2].spans == "s" and got[2].runs == 2
    assert got[4].text is None and "�" not in got[1].text


def test_ngram_join_equals_brute_force(make, corpus):
    assert rows_of(ngram_join(make(corpus, DDL))) == brute_join(corpus)


@pytest.mark.parametrize("pivots", [1, 4])
def test_ngram_join_of_a_large_component(make, corpus, monkeypatch, pivots):
    for name, value in {"CHUNK_SETS": 3, "PIVOTS": pivots, "OUTLIER_TILE": 2, "TILE_SETS": 5}.items():
        monkeypatch.setattr(f"vitrail.llm.ngram_join.{name}", value)
    assert rows_of(ngram_join(make(corpus, DDL))) == brute_join(corpus)


def test_ngram_join_edges(make):
    rows = [(5, "a b c d", "", 0), (5, "a b c d", "", 0), (9, "A B c D", "", 0), (None, "a b c d", "", 0), (7, "", "", 0), (8, "", "", 0)]
    got = sorted(map(str, ngram_join(make(rows, DDL)).collect()))
    assert len(got) == 6
    by = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(make(rows, DDL)).collect()}
    assert by == {(5, 2, 5), (9, 2, 5), (None, None, None), (7, 0, 7), (8, 0, 8)}
    assert ngram_join(make([], DDL)).collect() == []


def test_size_classes_lose_no_pair():
    c = SizeClasses(90, 100)
    r = random.Random(3)
    for _ in range(300):
        n = r.choice((1, 2, 5, 9, 10, 11, 40, 300))
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        drop, add = r.randint(0, n // 9 + 1), r.randint(0, n // 9 + 1)
        b = np.unique(np.r_[a[r.sample(range(len(a)), len(a) - min(drop, len(a)))], np.array([r.getrandbits(64) for _ in range(add)], np.uint64)])
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= 90 * (len(a) + len(b) - o):
            ka, kb = (set(np.concatenate(list(c.keys(x))).tolist()) for x in (a, b))
            assert ka & kb


def test_rtree_bound_never_excludes_a_link():
    r = random.Random(4)
    base = [np.array([r.getrandbits(64) for _ in range(200)], np.uint64) for _ in range(6)]
    sets = []
    for _ in range(120):
        s = base[r.randrange(6)].copy()
        for _ in range(r.randint(0, 20)):
            s[r.randrange(len(s))] = r.getrandbits(63)
        sets.append(np.unique(s))
    links = cell_links(sets, np.full(len(sets), 2), 90, 100)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[find(i)] = find(j)
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 90 * (len(sets[i]) + len(sets[j]) - o):
                assert find(i) == find(j)
    assert isinstance(RTree(np.zeros((1, 4), np.int32), np.array([1])).levels, list)


def test_components_of_chains_and_stars(make):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(7, 7), (300, 200)]
    got = dict(tuple(x) for x in components(make(edges, "a long, b long")).collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 150)} == {100} and got[300] == got[200] == 200
    assert components(make([], "a long, b long")).collect() == []
    a, b = local_stars(np.array([5, 9, 1, 20]), np.array([9, 1, 7, 21]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 5), (1, 7), (1, 9), (20, 21)] and local_stars(a[:0], b[:0])[0].size == 0


def test_exact_dedup(make):
    rows = [(1, "x", "", 0), (4, "x", "", 0), (2, None, "", 0), (3, "", "", 0), (5, "y" * 100_000, "", 0), (6, "X", "", 0)]
    got = rows_of(exact_dedup(make(rows, DDL)))
    assert {k: v[:3] for k, v in got.items()} == {
        1: (4, 2, False), 4: (4, 2, True), 2: (3, 2, False), 3: (3, 2, True), 5: (5, 1, True), 6: (6, 1, True),
    }
    assert got[2][3] == hashlib.sha256(b"").hexdigest()
    assert exact_dedup(make([], DDL)).collect() == []


def test_exact_dedup_with_a_full_filter(make):
    rows = [(i, f"t{i // 2}", "", 0) for i in range(600)]
    got = rows_of(exact_dedup(make(rows, DDL), log2_bits=6))
    assert all(v[:3] == (i | 1, 2, i % 2 == 1) for i, v in got.items()) and len(got) == 600


def test_exact_dedup_repeated_ids(make):
    rows = [(1, "x", "", 0), (1, "x", "", 0), (None, "x", "", 0)]
    got = sorted(str(tuple(r)[:4]) for r in exact_dedup(make(rows, DDL)).collect())
    assert len(got) == 3 and got.count("(1, 1, 3, True)") == 2


def test_exact_dedup_runs_no_python(spark, sf_dir):
    df = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_an_anchor_in_many_documents_is_many_tasks_work(make):
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common = "~" + word(38) + "~"  # shorter than a window: an anchor, no repeat by itself
    rows = [(i, word(150) + common + word(150)) for i in range(80)]
    rows += [(100 + i, word(40) + rows[i][1][90:260] + word(40)) for i in range(0, 80, 9)]
    got = suffix_dedup(make([(i, t, "", 0) for i, t in rows], DDL).repartition(9))
    assert {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()} == brute_suffix(rows)
