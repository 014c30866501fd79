"""Byte-level BPE vocabularies of /opt/tokenizers-style files; the path is a parameter.

`tokenizers` and `tiktoken` give the same ids for one vocabulary; the latter
is some five times as fast here, so the JSON file's vocabulary is loaded into
it after a check that its merges are in rank order.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for:
    printable Latin-1 for itself, the others from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of, vocab = byte_of_char(), spec["model"]["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", []) if t.get("special")}
    for i, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        if vocab[a + b] != 256 + i:
            raise ValueError("the merges of this vocabulary are not in rank order")
    ranks = {bytes(of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_NONE: frozenset[str] = frozenset()


def encode(path: str, text: str) -> np.ndarray:
    """Ids of a text as unsigned 32-bit; special tokens' strings are ordinary text."""
    try:
        return encoding(path).encode_to_numpy(text, allowed_special=_NONE, disallowed_special=_NONE)
    except ValueError:  # its regex engine gives up on huge runs of white space
        return encode_words(path, text)


def encode_words(path: str, text: str) -> np.ndarray:
    """The same, the words being cut by another regex engine."""
    import public_tokenizers
    import regex

    one = encoding(path)._encode_single_piece
    ids = [i for w in regex.findall(public_tokenizers.PATTERN, text) for i in one(w.encode())]
    return np.array(ids, np.uint32)


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []))


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_with_added(path: str, text: str) -> np.ndarray:
    """Ids as `tokenizers` gives them without special tokens: it still finds the
    file's added tokens in a text, so texts with one are left to it."""
    if any(t in text for t in _added(path)):
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return encode(path, text)
