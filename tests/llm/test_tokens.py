"""Packing and the BPE codec against the tokenizer libraries."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from vitrail.llm import bpe_codec as codec
from vitrail.llm.packing import best_fit, pack_documents, pieces
from vitrail.llm.tokens import default_path, encode, encode_words

DDL = "doc_id long, text string, ids string, seq int"
ODD = [
    None, "", " ", "\n\n \t x", "it's we'll DON'T", "naïve Straße 漢字 🙂‍🙂", "a" * 3000, "!?" * 400, "<|endoftext|> x<|endoftext|>",
    " nbsp thin line\x1cfs\x85nel", "１２ ² ٣", "word " * 5000,
]


@pytest.fixture(scope="module")
def reference():
    path = default_path("byte_bpe_50k.tiktoken")
    e = tiktoken.Encoding("t", pat_str=codec.pattern(), mergeable_ranks=codec.load_ranks(path), special_tokens={})
    return e.encode_ordinary


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    for text in ODD:
        assert encode(default_path(), text or "").tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_huge_white_space_takes_the_other_engine(reference):
    x = "a" + " " * 300_000 + "b"
    assert encode_words(default_path(), x).tolist() == reference(x)
    assert encode(default_path(), " " * 2_000_000).size


def test_fold_equals_tiktoken(make, reference):
    words = ["a", " the", "Straße", "🙂", "zzzzqqqq", " 漢字", "..." * 20, "abcabcabcabc", "\n"]
    df = codec.encode_words(make([(w,) for w in words], "w string"), "w", default_path("byte_bpe_50k.tiktoken"))
    assert {r.w: list(r.ids) for r in df.collect()} == {w: reference(w) for w in words}


def test_native_codec_round_trip(make, reference):
    texts = [t[:120] if t else t for t in ODD]
    got = {r.doc_id: r for r in codec.bpe_native(make([(i, t, "", 0) for i, t in enumerate(texts)], DDL)).collect()}
    for i, t in enumerate(texts):
        assert list(got[i].ids) == reference(t or "") and bytes(got[i].decoded) == (t or "").encode()


def test_codec_ids_and_digests(make, reference):
    df = make([(i, t, "clash", 1) for i, t in enumerate(ODD)] + [(None, "x", "", 0), (3, ODD[3], "", 0)], DDL)
    full = {r.doc_id: r for r in codec.bpe_codec(df, chunk_bytes=500).collect()}
    short = {r.doc_id: r for r in codec.bpe_codec(df, digests=True).collect()}
    for i, t in enumerate(ODD):
        ids = reference(t or "")
        assert list(full[i].ids) == ids and bytes(full[i].decoded) == (t or "").encode()
        assert short[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert (short[i].n_tokens, short[i].decoded_sha256) == (len(ids), hashlib.sha256((t or "").encode()).hexdigest())
    assert codec.bpe_codec(make([], DDL)).collect() == []


def test_best_fit_fills_and_never_overflows():
    r = random.Random(2)
    sizes = np.array([r.randint(1, 2048) for _ in range(3000)])
    bins = best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sizes[b].sum() for b in bins) <= 2048
    assert len(bins) <= 1.01 * max(-(-sizes.sum() // 2048), (sizes > 1024).sum())
    assert best_fit(np.array([], int), 10) == []


def test_pieces_cut_only_long_documents():
    assert [p[:3] for p in pieces(np.arange(9, dtype=np.uint32), 4, 0)] == [(0, 0, 2), (1, 2, 4), (2, 6, 4)]
    assert [p[:3] for p in pieces(np.arange(3, dtype=np.uint32), 4, 0)] == [(0, 0, 4)]
    assert pieces(np.zeros(0, np.uint32), 4, 0) == [(0, 0, 1, zlib.crc32(b"\0" * 4))]


def test_packing_whole_and_gapless(make, reference):
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(("alpha", "beta", "gam", "ß")) for _ in range(r.randint(0, 900))), "", 0) for i in range(200)]
    rows += [(500, None, "", 0), (501, "", "", 0), (502, "word " * 9000, "", 0), (None, "no id", "", 0), (7, "again", "", 0)]
    out = pack_documents(make(rows, DDL).repartition(9)).collect()
    want = sum(len(reference(t or "")) + 1 for _, t, _, _ in rows)
    assert sum(p.length for p in out) == want
    ids = [*reference("word " * 9000), 0]
    for p in (p for p in out if p.doc_id == 502):
        part = ids[p.start : p.start + p.length]
        assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == p.ids_crc32
    assert sum(p.doc_id is None for p in out) == 1
    seqs = {}
    for p in out:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert len(seqs) <= 1.03 * -(-want // 2048) + 1
    assert pack_documents(make([], DDL)).collect() == []


def test_packing_ends_where_bins_cannot_be_joined(make, monkeypatch):
    monkeypatch.setattr("vitrail.llm.packing.NODE_ITEMS", 4)
    rows = [(i, "x " * 700, "", 0) for i in range(60)]
    out = pack_documents(make(rows, DDL).repartition(12))
    assert out.count() == 60 and out.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_long_words_and_whole_corpus_equal_tiktoken(spark, sf_dir, make, reference):
    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    long = ["".join(r.choice(letters) for _ in range(2_000)), "漢字かな" * 700, "=" * 5_000, "ab" * 2_500, "й" * 1_001, "\0" * 70]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(make([(-1 - i, t) for i, t in enumerate(long)], "doc_id long, text string"))
    want = {d: reference(t or "") for d, t in docs.collect()}
    got = codec.bpe_codec(docs, digests=True).collect()
    assert len(got) == len(want)
    for row in got:
        ids = want[row.doc_id]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())


def test_a_vocabulary_that_merges_cannot_make_is_refused():
    with pytest.raises(ValueError):
        codec.merges({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_bounded_nodes_keep_merging(make, monkeypatch):
    monkeypatch.setattr("vitrail.llm.packing.NODE_ITEMS", 16)
    r = random.Random(11)
    rows = [(i, "x " * r.randint(30, 900), "", 0) for i in range(400)]
    out = pack_documents(make(rows, DDL).repartition(40)).collect()
    assert len({p.doc_id for p in out}) == 400
    assert len({p.sequence_id for p in out}) <= 1.12 * -(-sum(p.length for p in out) // 2048)
