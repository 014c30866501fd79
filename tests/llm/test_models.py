"""Language ID, toxicity, quality rules: held-out quality and exact counts."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrail.llm.chargrams import grams, letters_of, summed
from vitrail.llm.language_id import Ftrl, fit_temperature, language_id, softmax, train_language_model
from vitrail.llm.quality_rules import fit_votes, quality_rules, text_statistics
from vitrail.llm.toxicity import best_cut, toxicity

DDL = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_language_id_held_out_accuracy(docs):
    out = language_id(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    got = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    r = got.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert r[0] > 150 and r[1] >= 0.97 and r[2] >= 0 and r[3] <= 1
    assert out.count() == docs.count()


def test_language_id_edges(make):
    rows = [(i, "le chat noir dort" if i % 2 else "the black cat sleeps", "fr" if i % 2 else "en", "c") for i in range(60)]
    rows += [(100, None, "en", ""), (101, "", None, ""), (102, "123 !!! ***", "fr", ""), (None, "the cat", "en", ""), (1, rows[1][1], "fr", "")]
    got = language_id(make(rows, DDL)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102))
    assert by[None].held_out and by[None].lang_pred == "en"
    assert by[1].lang_pred == "fr" and by[2].lang_pred == "en"
    assert language_id(make([], DDL)).collect() == []
    assert [r.lang_pred for r in language_id(make([(1, "abc", None, "")], DDL)).collect()] == ["und"]


def test_language_model_ignores_held_out_labels(make):
    rows = [(i, "aaa bbb", "x", "") for i in range(40)]
    base = make(rows, DDL)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    spoiled = base.withColumn("lang", F.when(held, F.lit("wrong")).otherwise(F.col("lang")))
    assert train_language_model(spoiled).languages == ["x"]


def test_ftrl_learns_and_is_sparse():
    rng = np.random.default_rng(0)
    m = Ftrl(50, 2, 1.0, 1.0, 0.5, 0.01)
    for _ in range(400):
        y = int(rng.integers(2))
        m.update(np.array([y, 2 + int(rng.integers(48))]), np.array([1.0, 0.1]), y)
    w = m.weights()
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 and (w[2:] == 0).mean() > 0.9


def test_temperature_softens_overconfident_logits():
    y = np.array([0, 1] * 50)
    logits = np.where(np.arange(100)[:, None] % 5 == 0, -1, 1) * np.stack([1 - y, y], 1) * 20.0
    t = fit_temperature(logits, y)
    assert t > 3 and abs(softmax(logits / t).max(1).mean() - 0.8) < 0.05
    assert fit_temperature(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def test_letters_and_grams():
    assert "".join(map(chr, letters_of("Été, 12 É!"))) == " été é "
    assert len(letters_of("12")) == 0 and len(letters_of(None)) == 0
    assert len(grams(letters_of("ab"), range(1, 4), 10)) == 4 + 3 + 2


def test_summed_adds_all_rows(spark):
    def add(batch, v):
        for x in batch.column(0).to_pylist():
            v[x % 5] += 1

    assert summed(spark.range(1003, numPartitions=7), 5, add).tolist() == [201, 201, 201, 200, 200]


def test_toxicity_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("toxic", "score", "predicted").collect()
    s = np.array([(r.toxic, r.score, r.predicted) for r in got])
    p, q = s[s[:, 0] == 1], s[s[:, 0] == 0]
    assert (p[:, 1][:, None] > q[:, 1][None]).mean() > 0.93
    assert q[:, 2].mean() < 0.02 and p[:, 2].mean() > 0.6
    assert ((s[:, 1] >= 0.5) == (s[:, 2] == 1)).all()


def test_toxicity_edges(make):
    rows = [(i, f"good words number {i}" if i % 3 else "you awful blockhead", None, "") for i in range(90)]
    rows += [(200, None, None, ""), (201, "", None, ""), (None, "awful blockhead", None, "")]
    labels = [(i, int(i % 3 == 0)) for i in range(90)] + [(999, 1), (5, None), (None, 1), (3, 1)]
    got = {r.doc_id: r for r in toxicity(make(rows, DDL), make(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == 93 and got[3].predicted == 1 and got[4].predicted == 0 and got[None].predicted == 1
    assert 0 <= got[200].score <= 1 and got[200].score == got[201].score
    none = toxicity(make(rows, DDL), make([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    assert toxicity(make([], DDL), make(labels, "doc_id long, toxic int")).collect() == []


def test_best_cut():
    z, y = np.array([3.0, 2.0, 1.0, -1.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert best_cut(z, y, 0.5) == 1.5


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    g = list(zip(w, w[1:], w[2:]))
    n = Counter(g)
    covered = {k + j for k, x in enumerate(g) if n[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_statistics_equal_brute_force(make):
    texts = [None, "", " \n\n ", "a", "a b c a b c", "x\nx\n x\nx", "é# ß|\r\né# ß|\r\n", "w " * 500, "a b\nc a\tb c\x0ba b c", "l\n" * 60]
    got = {r.doc_id: tuple(r)[1:6] for r in text_statistics(make([(i, t, "", "") for i, t in enumerate(texts)], DDL)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_statistics_on_documents(docs):
    got = {r.doc_id: tuple(r)[1:6] for r in text_statistics(docs).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_quality_keeps_clean_texts(make):
    clean = "\n".join(" ".join(f"word{i * 7 + j * 13}x" for j in range(12)) + "." for i in range(12))
    junk = " ".join(f"w{i}###" for i in range(90))
    rows = [(i, clean.replace("word", f"w{i}o"), "", "") for i in range(60)] + [(100 + i, junk.replace("w", f"v{i}"), "", "") for i in range(15)]
    rows += [(200, "short text", "", ""), (201, None, "", ""), (202, "a b c " * 100, "", "")]
    got = {r.doc_id: r for r in quality_rules(make(rows, DDL)).collect()}
    assert all(got[i].kept for i in range(60)) and all(got[i].base_failed and not got[i].kept for i in (200, 201, 202))
    assert quality_rules(make([], DDL)).collect() == []


def test_em_finds_the_two_groups():
    patterns = np.array([[2, 2, 2], [0, 0, 1], [2, 1, 2], [0, 2, 0], [1, 1, 1]])
    p = fit_votes(patterns, np.array([900.0, 80, 300, 30, 5]))
    assert p[0] > 0.99 and p[1] < 0.01 and p[2] > 0.9 and p[3] < 0.5


def brute_votes(t):
    """The six rules, in plain Python."""
    n, chars, symbols, dup, repeat = brute(t)
    t = t or ""
    lines = sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in t.split("\n"))
    upper = sum("A" <= c <= "Z" for c in t)
    w = max(n, 1)
    vote = lambda bad, good: 0 if bad else 2 if good else 1
    mean, share = chars / w, upper / max(chars, 1)
    return (
        vote(n < 50, n >= 80), vote(symbols / w > 0.4, symbols / w < 0.1), vote(dup / max(lines, 1) > 0.3, dup / max(lines, 1) <= 0.1),
        vote(repeat / w > 0.4, repeat / w <= 0.15), vote(mean < 2.5 or mean > 15, 3.5 <= mean <= 11), vote(share > 0.4, share < 0.15),
    )


def brute_posteriors(votes):
    """EM over every row by itself, not over patterns."""
    import math

    p = [min(max(0.5 + sum(v - 1 for v in row) / (2 * len(row)), 0.05), 0.95) for row in votes]
    for _ in range(100):
        total, good = len(votes), sum(p)
        new = []
        tables = []
        for r in range(len(votes[0])):
            bad_n, good_n = [1.0] * 3, [1.0] * 3
            for row, q in zip(votes, p):
                bad_n[row[r]] += 1 - q
                good_n[row[r]] += q
            tables.append(([x / sum(bad_n) for x in bad_n], [x / sum(good_n) for x in good_n]))
        for row in votes:
            log = math.log((total - good + 1) / (total + 2)) - math.log((good + 1) / (total + 2))
            log += sum(math.log(b[v]) - math.log(g[v]) for v, (b, g) in zip(row, tables))
            new.append(1 / (1 + math.exp(min(max(log, -500), 500))))
        moved = max(abs(a - b) for a, b in zip(new, p))
        if moved < 1e-9:
            break
        p = new
    return p


def test_whole_result_equals_brute_force(docs):
    rows = docs.collect()
    p = brute_posteriors([brute_votes(r.text) for r in rows])
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    assert len(got) == len(rows)
    for r, q in zip(rows, p):
        n, _, _, _, repeat = brute(r.text)
        failed = n < 50 or 100 * repeat > 50 * n
        assert tuple(got[r.doc_id])[1:6] == brute(r.text) and got[r.doc_id].base_failed == failed
        assert abs(got[r.doc_id].p_good - q) < 1e-6 and got[r.doc_id].kept == (not failed and q >= 0.5)


def test_samples_are_bounded_by_rows(make):
    ddl = "doc_id long, text string, lang string, source string"
    again = [(8, "le chat et le chien dorment ici", "fr", "")] * 300 + [(i, "the cat and the dog sleep here", "en", "") for i in range(10, 40)]
    got = {r.doc_id: r.lang_pred for r in language_id(make(again, ddl)).collect()}
    assert set(got) == {8, *range(10, 40)} and got[11] == "en"
