"""op4's ids are those of `tokenizers`, added tokens in a text included."""

from __future__ import annotations

import struct
import zlib

import pytest

from vitrail.llm.packing import pack_documents
from vitrail.llm.tokens import default_path, encode_with_added

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y", "<|endoftext|", "plain", ""]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_ids_of_added_tokens(ids):
    assert ids(TEXTS[0]) == [64, 220, 50256, 275]
    for text in TEXTS:
        assert encode_with_added(default_path(), text).tolist() == ids(text)


def test_packing_takes_them(make, ids):
    out = pack_documents(make(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    for r in out:
        want = [*ids(TEXTS[r.doc_id]), 0]
        assert (r.length, r.ids_crc32) == (len(want), zlib.crc32(struct.pack(f"<{len(want)}I", *want)))
