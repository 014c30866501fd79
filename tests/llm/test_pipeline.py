"""The pipeline against plain versions of its stages, and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_dedup import brute_join, brute_suffix
from vitrail.llm.language_id import identify_language, train_language_model
from vitrail.llm.queries import ORACLE_SQL, QUERIES


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = P.language(spark, docs, sf_dir)
    told = identify_language(docs, train_language_model(docs)).where("lang_pred <> 'und' and score >= 0.5")
    rows = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(rows) == {r.doc_id for r in told.select("doc_id").collect()}
    assert len(rows) > 0.95 * docs.count()

    exact = P.exact_copies(spark, kept, sf_dir)
    last = {}
    for r in rows.values():
        last[r.text] = max(last.get(r.text, r.doc_id), r.doc_id)
    ids = {r.doc_id for r in exact.collect()}
    assert exact.columns == columns and ids == set(last.values())

    near = P.near_copies(spark, exact, sf_dir)
    links = brute_join([(i, rows[i].text) for i in ids])
    ids = {r.doc_id for r in near.collect()}
    assert near.columns == columns and ids == {i for i, (_, c) in links.items() if i == c}

    cut = P.repeated_passages(spark, near, sf_dir)
    want = brute_suffix([(i, rows[i].text) for i in ids])
    for r in cut.collect():
        n_bytes, removed, _, _ = want.pop(r.doc_id)
        size = len(r.text.encode())
        assert n_bytes - removed <= size <= n_bytes - removed + 6 * 50 and r.n_chars == len(r.text)
    assert cut.columns == columns and all(n == gone for n, gone, *_ in want.values())

    packed = P.packing(spark, cut, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in cut.select("doc_id").collect()}


def test_run_and_empty_table(spark, sf_dir, tmp_path):
    out = P.run(spark, sf_dir)
    assert out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.collect() == []


def test_ten_queries_are_registered():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_with_repeated_rows_and_nulls(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = "one two three four five six seven eight nine ten " * 12
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    rows = [(1, text), (1, text), (2, text + "x"), (3, None), (None, text + " none"), (4, "a short one"), (4, "a short one"), (5, "a short one")]
    d = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(kinds[c]).alias(c) for c in docs.columns[2:]))
    exact = P.exact_copies(spark, d, sf_dir)
    ids = lambda x: sorted((str(r.doc_id), len(r.text or "")) for r in x.collect())
    assert ids(exact) == sorted([("1", len(text)), ("2", len(text) + 1), ("3", 0), ("None", len(text) + 5), ("5", 11)])
    near = P.near_copies(spark, exact, sf_dir)
    assert ids(near) == sorted([("1", len(text)), ("3", 0), ("None", len(text) + 5), ("5", 11)])
    cut = P.repeated_passages(spark, near, sf_dir)
    assert {r.doc_id for r in cut.collect()} == {1, None, 5}
    packed = P.packing(spark, cut, sf_dir).collect()
    assert sorted(str(r.doc_id) for r in packed) == ["1", "5", "None"]


def test_scratch_tables_can_be_removed(spark, make, monkeypatch, tmp_path):
    from vitrail.llm import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: f"file://{tmp_path}")
    assert scratch.written(make([(1,)], "a int"), "x").collect()[0].a == 1
    assert list(tmp_path.iterdir())
    scratch.clean(spark)
    assert not list(tmp_path.iterdir())


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b c d e", 7, "x", b"y"), (2, "a b c d e", 8, "x", b"z"), (3, "f g h i j", 9, "x", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, maybe int, _sha string, _id binary")
    for stage in (P.exact_copies, P.near_copies):
        out = stage(spark, d, "")
        assert out.columns == d.columns
        d = out
    assert sorted((r.doc_id, r.maybe) for r in d.collect()) == [(2, 8), (3, 9)]
