"""Byte-level BPE encoding and decoding.

A word's state is a string with one character per piece: a byte is the
character of its own code point, the token of rank r the character PIECE + r.
Spark higher-order functions fold the merges over it: each step looks up every
neighbouring pair in a literal rank map, takes the least rank, and replaces that pair wherever it
stands, left to right.  (In a vocabulary made by merges, a merge never makes a
pair of lower rank than its own, so doing all places of a pair at once gives
what one place at a time would; `merges` checks that the vocabulary is one.)

A word is folded once in the whole corpus, whatever its length and frequency:

1. Texts are cut into words in chunks of bounded size; a chunk becomes the word
   numbers of its documents, and its distinct words go, as blobs, to buckets
   by their hash.  Both kinds of rows are one exchange.
2. A bucket's task folds its distinct words and answers each chunk with the
   words' ids.
3. A chunk's documents are their word numbers looked up in the answers;
   decoding concatenates the ids' binary pieces.

What shuffles is distinct words per chunk, their ids, and compressed word numbers,
each once, and no text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from vitrail.llm import arrays as A
from vitrail.llm.scratch import spread
from vitrail.llm.tokens import default_path

BUCKETS = 1 << 15  # of the rank map
PIECE = 0x100
MARK = "\U0010fffd"  # no piece
CHUNK_BYTES = 32 << 20
CUT = 64  # characters; longer words are folded in parts, cut where no merge can cross


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def merges(ranks: dict[bytes, int]) -> dict[int, tuple[bytes, bytes]]:
    """The pair that each token of two or more bytes is merged from: what
    its bytes become under the lower ranks alone."""
    out = {}
    for token, own in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            rank, i = min((ranks.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= own:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) > 2:
            raise ValueError(f"{token!r} is not made by merges of lower rank")
        if len(parts) == 2:
            out[own] = (parts[0], parts[1])
    return out


def _char(code: int) -> str:
    return chr(code if code < 0xD800 else code + 0x800)  # no surrogates


def _piece(token: bytes, ranks: dict[bytes, int]) -> str:
    return chr(token[0]) if len(token) == 1 else _char(PIECE + ranks[token])


@lru_cache(maxsize=2)
def _rank_json(path: str) -> str:
    """The map's buckets: entries MARK, a pair's two characters, the merged one.
    (A Spark map is searched entry by entry, and costs an object for each.)"""
    ranks = load_ranks(path)
    buckets = [""] * BUCKETS
    for r, (a, b) in merges(ranks).items():
        pair = _piece(a, ranks) + _piece(b, ranks)
        buckets[zlib.crc32(pair.encode()) % BUCKETS] += MARK + pair + _char(PIECE + r)
    return json.dumps(buckets, separators=(",", ":"), ensure_ascii=False)


def rank_map(path: str) -> Column:
    """A literal; from_json of a literal is folded by the optimiser."""
    return F.from_json(F.lit(_rank_json(path)), "array<string>")


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_word(word: Column, ranks: Column) -> Column:
    """The pieces (string, a character each) of one word given as binary."""

    def step(state: Column, _: Column) -> Column:
        s = state["s"]

        def least(chars: Column) -> Column:
            def merged(c: Column, i: Column) -> Column:
                pair = F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit("")))
                return _let(pair, lambda p: found(F.element_at(ranks, (F.crc32(p) % BUCKETS + 1).cast("int")), p))

            return F.array_min(F.transform(chars, merged))

        def found(bucket: Column, pair: Column) -> Column:
            """The merged character and the pair, or null."""
            at = F.call_function("instr", bucket, F.concat(F.lit(MARK), pair))
            return F.when((at > 0) & (F.length(pair) == 2), F.concat(F.call_function("substring", bucket, at + 3, F.lit(1)), pair))

        def replaced(m: Column) -> Column:
            ended = F.struct(s.alias("s"), F.lit(True).alias("done"))
            changed = F.replace(s, F.substring(m, 2, 2), F.substring(m, 1, 1))
            return F.when(m.isNull(), ended).otherwise(F.struct(changed.alias("s"), F.lit(False).alias("done")))

        return F.when(state["done"], state).otherwise(_let(_let(F.split(s, ""), least), replaced))

    start = F.decode(word, "ISO-8859-1")
    n = F.length(word)
    steps = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(start.alias("s"), F.lit(False).alias("done")), step, lambda state: state["s"])


def _byte_ranks(path: str) -> list[int]:
    ranks = load_ranks(path)
    return [ranks[bytes([b])] for b in range(256)]


def _ids_of(pieces: Column, of_byte: Column) -> Column:
    def one(c: Column) -> Column:
        code = F.ascii(c)
        code = F.when(code < 0xD800, code).otherwise(code - 0x800)
        return F.when(code < PIECE, F.element_at(of_byte, code + 1)).otherwise(code - PIECE).cast("int")

    return F.when(F.length(pieces) > 0, F.transform(F.split(pieces, ""), one)).otherwise(F.array().cast("array<int>"))


def encode_words(words: DataFrame, word_col: str, path: str) -> DataFrame:
    """`words` with ids array<int>, by the fold."""
    of_byte = F.array(*map(F.lit, _byte_ranks(path)))
    # bound to a variable, the literal is in the plan once
    folded = _let(rank_map(path), lambda ranks: fold_word(F.encode(F.col(word_col), "UTF-8"), ranks))
    return words.withColumn("_pieces", folded).withColumn("ids", _let(of_byte, lambda t: _ids_of(F.col("_pieces"), t))).drop("_pieces")


def words_of(text: Column) -> Column:
    """The pattern's matches; (?U) makes Java's \\s the Unicode one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + pattern()), F.lit(0))


def native_ids(text: Column, path: str) -> Column:
    """A text's ids (array<int>) in the plan alone: each distinct word is folded once."""
    words = words_of(text)

    def of_words(w: Column, ranks: Column) -> Column:
        def of_distinct(d: Column) -> Column:
            def gather(e: Column) -> Column:
                return F.array_join(F.transform(w, lambda x: F.element_at(e, F.array_position(d, x).cast("int"))), "")

            return _let(F.transform(d, lambda x: fold_word(F.encode(x, "UTF-8"), ranks)), gather)

        return _let(F.array_distinct(w), of_distinct)

    pieces = _let(rank_map(path), lambda ranks: _let(words, lambda w: of_words(w, ranks)))
    return _let(F.array(*map(F.lit, _byte_ranks(path))), lambda t: _let(pieces, lambda p: _ids_of(p, t)))


def native_bytes(ids: Column, path: str) -> Column:
    """Decoding in the plan: the ids' pieces concatenated."""
    pieces = [b.hex() for b, _ in sorted(load_ranks(path).items(), key=lambda x: x[1])]
    table = F.from_json(F.lit(json.dumps(pieces)), "array<string>")
    return F.unhex(_let(table, lambda t: F.array_join(F.transform(ids, lambda i: F.element_at(t, i + 1)), "")))


def bpe_native(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) by higher-order functions only."""
    path = tokenizer or default_path("byte_bpe_50k.tiktoken")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), native_ids(F.col(text_col), path).alias("ids"))
    return out.withColumn("decoded", native_bytes(F.col("ids"), path))


def _joined(path: str) -> np.ndarray:
    """joined[a, b]: some token has byte b after byte a, so a merge can cross there."""
    out = np.zeros((256, 256), bool)
    for token in load_ranks(path):
        out[list(token[:-1]), list(token[1:])] = True
    return out


def _parts(word: bytes, joined: np.ndarray) -> list[bytes]:
    """A word cut where no token has the two neighbouring bytes: its ids are its parts' ids."""
    x = np.frombuffer(word, np.uint8)
    cuts = np.flatnonzero(~joined[x[:-1], x[1:]]) + 1
    return [word[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(word)])]


def _strings(items: list[bytes]) -> bytes:
    sizes = np.array([len(x) for x in items], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(items).to_bytes(4, "little") + sizes + b"".join(items))


def _unstrings(blob: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    ends = np.r_[0, np.cumsum(np.frombuffer(raw, "<u4", n, 4))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[4 + 4 * n :])])


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    flat = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(flat)


def _unplanes(blob: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


#: A chunk (route < 0): its documents (doc_id, is null, number of codes), codes, and each distinct
#: word's bucket.  A bucket (route >= 0): a chunk's words, by code.  Nothing is null in
#: these rows, and their kinds are told in Python, so that no filter gets under the exchange that both uses share.
_CHUNKS = StructType([StructField(c, k, False) for c, k in (("route", LongType()), ("chunk", LongType()), ("docs", BinaryType()), ("codes", BinaryType()), ("words", BinaryType()))])


class _Codes(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _chunk_task(path: str, n_buckets: int, chunk_bytes: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, joined = regex.compile(pattern()).findall, _joined(path)
        chunk = TaskContext.get().partitionId() << 32

        def done(number: int, docs: list, found: list[np.ndarray], code_of: _Codes) -> pa.RecordBatch:
            words = [w if isinstance(w, bytes) else w.encode() for w in code_of]
            row = np.array([(0 if d is None else d, d is None, len(x)) for d, x in zip(docs, found)], np.int64)
            bucket = np.array([zlib.crc32(w) % n_buckets for w in words], "<u4")
            rows = [(-1 - number, number, A.pack(*row.T), _planes(np.concatenate(found)), _planes(bucket))]
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                rows.append((b, number, b"", b"", _strings([words[i] for i in order[ends[b] : ends[b + 1]].tolist()])))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_CHUNKS.names)

        docs, found, code_of, size = [], [], _Codes(), 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = t.as_py() or ""
                words = find(text)
                if max(map(len, words), default=0) > CUT:
                    words = [p for w in words for p in (_parts(w.encode(), joined) if len(w) > CUT else (w,))]
                docs.append(d)
                found.append(np.array(list(map(code_of.__getitem__, words)), "<u4"))
                size += len(text) + 64
                if size >= chunk_bytes:
                    yield done(chunk, docs, found, code_of)
                    chunk += 1
                    docs, found, code_of, size = [], [], _Codes(), 0
        if docs:
            yield done(chunk, docs, found, code_of)
        docs, found, code_of = [], [], _Codes()
        A.release()  # the worker lives on beside those of the next stage

    return task


#: kind 0: a distinct word of a bucket; kind 1: a chunk's words of the bucket, as numbers among those.
_ASKED = "bucket long, kind int, chunk long, word binary, numbers binary"


def _distinct_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each bucket, then what its chunks asked for."""

    def settle(bucket: int, asked: list[tuple[int, pa.Array]]) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([w for _, w in asked]).dictionary_encode()
        words, number, at = coded.dictionary, coded.indices.to_numpy().astype("<u4"), 0
        empty = lambda n, kind: pa.nulls(n, kind)
        for s in range(0, len(words), 5_000):
            w = words[s : s + 5_000]
            n = len(w)
            yield pa.record_batch([pa.array([bucket] * n, pa.int64()), pa.array([0] * n, pa.int32()), empty(n, pa.int64()), w, empty(n, pa.binary())], names=names)
        chunks, numbers = [], []
        for chunk, w in asked:
            chunks.append(chunk)
            numbers.append(_planes(number[at : at + len(w)]))
            at += len(w)
        n = len(chunks)
        yield pa.record_batch(
            [pa.array([bucket] * n, pa.int64()), pa.array([1] * n, pa.int32()), pa.array(chunks, pa.int64()), empty(n, pa.binary()), pa.array(numbers, pa.binary())],
            names=names,
        )

    names = [x.split()[0] for x in _ASKED.split(", ")]
    asked: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for b, c, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)):
            if b >= 0:
                asked.setdefault(b, []).append((c, w.as_py()))
    for b in sorted(asked):
        yield from settle(b, [(c, _unstrings(w)) for c, w in asked.pop(b)])
    A.release()


def _answer_task(path: str):
    """Rows (chunk, bucket, sizes, ids) of folded buckets: the ids of the chunk's words."""
    names = ["chunk", "bucket", "sizes", "ids"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_byte = np.array(_byte_ranks(path), np.uint32)
        now, codes, sizes, ready = None, [], [], None
        for batch in batches:
            kinds, buckets = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            # rows come by bucket, words first, whatever the cut into batches
            cuts = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (buckets[1:] != buckets[:-1])])
            for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(kinds)]):
                if buckets[s] != now:
                    now, codes, sizes, ready = buckets[s], [], [], None
                if kinds[s] == 0:
                    data, off = A.utf8(batch.column(3)[s:e])
                    code = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4").astype(np.int64)
                    first = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                    sizes.append(np.diff(first[off]))
                    code = np.where(code < 0xD800, code, code - 0x800)
                    codes.append(np.where(code < PIECE, of_byte[np.minimum(code, 255)], code - PIECE).astype("<u4"))
                    continue
                if ready is None:
                    n = np.concatenate(sizes)
                    ready = np.concatenate(codes), np.r_[0, np.cumsum(n)], n
                ids, start, n = ready
                rows = []
                for chunk, numbers in zip(batch.column(2)[s:e].to_pylist(), batch.column(4)[s:e].to_pylist()):
                    k = _unplanes(numbers, "<u4")
                    rows.append((chunk, int(now), _planes(n[k].astype("<u4")), _planes(A.taken(ids, start[k], n[k]))))
                columns = list(zip(*rows))
                yield pa.record_batch(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())],
                    names=names,
                )
        codes, sizes, ready = [], [], None
        A.release()

    return task


def _document_task(path: str, digests: bool):
    """The documents of each chunk, from its codes and its answers."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["doc_id", "ids", "decoded"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [b for b, _ in sorted(load_ranks(path).items(), key=lambda x: x[1])]
        plen = np.array([len(p) for p in pieces])
        pdata, pstart = np.frombuffer(b"".join(pieces), np.uint8), np.r_[0, np.cumsum(plen)[:-1]]

        def out(rows) -> pa.RecordBatch:
            doc, null, count, ids, plain = zip(*rows)
            mask = np.array(null, bool)
            columns = [pa.array(np.array(doc, np.int64), pa.int64(), mask=mask)]
            if digests:
                columns += [pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())]
            else:
                columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(plain, pa.binary())]
            return pa.record_batch(columns, names=names)

        def documents(docs: bytes, codes: bytes, buckets: bytes, answers: list[tuple[int, bytes, bytes]]):
            doc, null, number = A.unpack(docs, 3)
            code = _unplanes(codes, "<u4")
            order = np.argsort(_unplanes(buckets, "<u4"), kind="stable")
            answers.sort(key=lambda a: a[0])
            none = np.zeros(0, np.uint32)
            given = np.concatenate([none] + [_unplanes(a[1], "<u4") for a in answers]).astype(np.int64)
            ids = np.concatenate([none] + [_unplanes(a[2], "<u4") for a in answers])
            if len(given) != len(order):
                raise ValueError("a chunk lacks answers")
            start, size = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            start[order], size[order] = np.cumsum(given) - given, given
            rows, held, at = [], 0, 0
            for d, z, n in zip(doc.tolist(), null.tolist(), number.tolist()):
                c = code[at : at + n]
                at += n
                mine = A.taken(ids, start[c], size[c])
                plain = A.taken(pdata, pstart[mine], plen[mine]).tobytes()
                if digests:
                    rows.append((d, z, len(mine), hashlib.sha256(mine.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(plain).hexdigest()))
                else:
                    rows.append((d, z, len(mine), mine.astype(np.int64), plain))
                    held += len(plain) + 8 * len(mine)
                if len(rows) >= 10_000 or held > CHUNK_BYTES:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

        for batch in batches:
            for i in np.flatnonzero(batch.column(0).to_numpy() < 0).tolist():
                body = (batch.column(c)[i].as_py() for c in (2, 3, 4))
                answers = [(a["bucket"], a["sizes"], a["ids"]) for a in batch.column(5)[i].as_py() or ()]
                yield from documents(*body, answers)
            A.release()

    return task


def bpe_codec(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    digests: bool = False,
) -> DataFrame:
    """Per row: doc_id, ids array<long>, decoded binary; or, with `digests`,
    doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty and has no ids; special tokens' strings are
    ordinary text; texts are read whole, words of any length; repeated rows and null ids
    come back as they are.  Other columns are not read.  An empty table gives
    an empty result."""
    path = tokenizer or default_path("byte_bpe_50k.tiktoken")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = spread(base)
    chunks = base.mapInArrow(_chunk_task(path, 4 * n, chunk_bytes), _CHUNKS).repartition(n, "route")
    asked = chunks.mapInArrow(_distinct_task, _ASKED)
    folded = F.when(F.col("kind") == 0, _let(rank_map(path), lambda ranks: fold_word(F.col("word"), ranks)))
    answers = asked.select("bucket", "kind", "chunk", folded.alias("pieces"), "numbers").mapInArrow(
        _answer_task(path), "chunk long, bucket long, sizes binary, ids binary"
    )
    # a chunk has at most one answer per bucket
    answers = answers.groupBy((-1 - F.col("chunk")).alias("asker")).agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("answers"))
    joined = chunks.join(answers.hint("shuffle_hash"), F.col("route") == F.col("asker"), "left")
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<long>, decoded binary"
    return joined.select(*_CHUNKS.names, "answers").mapInArrow(_document_task(path, digests), ddl)
