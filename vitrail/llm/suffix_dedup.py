"""Removal of long repeated byte strings by suffix bucket-pointer refinement.

A byte goes when some `width`-byte string over it also starts earlier (smaller
id, or same document and smaller start).  To say so, suffixes must be put in
buckets of equal first `width` bytes, and all but the first member of a bucket
marked.  The buckets come from bucket-pointer refinement: the initial bucket
of a suffix is its first 8 bytes; a bucket is refined by the bucket
identifiers at later offsets (8, then 16, then 32 and width - 64 on), each
round reusing the identifiers that the last one updated.  An identifier is a
64-bit mix of the pair of identifiers it came from, so that tasks agree on it
without a global renaming pass; buckets are then sorted on it.

Sorting every suffix would shuffle the corpus many times over, so refinement is
sparse first and dense only where it must be:

1. *Anchors.*  Of the 32-byte buckets in every `width`-byte window, the least
   identifier (rightmost if tied) is the window's anchor: equal windows have
   equal anchors, at the same place.  Windows with one anchor form a run.  A
   run has the anchor's bucket and a refined bucket (the identifiers at
   both ends, hence of all its bytes).  About one suffix in 35 is an anchor.
2. *Sparse buckets.*  Runs are sorted on both identifiers, and dealt by both, so
   that an anchor in very many documents is many tasks' work.  Runs equal to an
   earlier one are repeats whole.  An anchor bucket with one run is done, as in
   the algorithm's singleton rule: a task that has several runs of an anchor knows that it is
   shared, and all tasks tell one about it, by a record each.  What is left are
   first runs that share an anchor bucket but not the refined one.
3. *Dense buckets.*  Only for those, every window's own identifier is refined
   and sorted, and all windows but the first of a bucket are marked.

Each task settles what it can before it sends: of equal runs or windows it
keeps the first, so a passage in a third of all rows costs one record a task.
Records travel as blobs by a hash of their bucket; texts shuffle by id, and only
those with something to settle.
64-bit identifiers make a false match about n*n/2**65 likely for n runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm import arrays as A
from vitrail.llm import bloom
from vitrail.llm.scratch import spread, written

Q = 32
TILE = 1 << 19
LONG = 1 << 21
FLUSH = 1_500_000
_POS_BITS = A.U64((1 << 22) - 1)


def bucket_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the 32-byte bucket at every offset that has 32 bytes."""
    n = len(data) - 7
    if n < Q - 7:
        return np.zeros(0, np.uint64)
    raw, first = data.tobytes(), np.empty(n, np.uint64)
    for s in range(min(8, n)):  # initial buckets: the 8 bytes themselves
        first[s::8] = np.frombuffer(raw, "<u8", (n - s + 7) // 8, s)
    ids = first
    for h in (8, 16):  # bucket pointers h further on
        ids = A.mix(ids[:-h], ids[h:])
    return ids


def window_ids(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Refined identifiers of the width-byte windows at some offsets."""
    return A.mix(A.mix(ids[at], ids[at + Q]), A.mix(ids[at + width - 2 * Q], ids[at + width - Q]))


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int):
    """(anchor bucket, refined bucket, first window, windows - 1) of each run."""
    span = width - Q + 1
    n = len(data) - width + 1
    if n <= 0:
        return None
    ids = bucket_ids(data)
    m = (ids & ~_POS_BITS) | (_POS_BITS - np.arange(len(ids), dtype=np.uint64))
    done = 1
    while done < span:  # least of each window, by doubling
        step = min(done, span - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    anchor = (_POS_BITS - (m & _POS_BITS)).astype(np.int64)
    valid = np.ones(n, bool)
    for s, e in zip(starts.tolist(), ends.tolist()):
        valid[max(s, e - width + 1) : e] = False
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
    last = np.r_[new[1:] - 1, n - 1]
    ok = valid[new]
    lo, hi = new[ok], last[ok]
    a = anchor[lo]
    shape = ((a - lo) * 256 + (hi - lo)).astype(np.uint64)
    refined = A.mix(A.mix(window_ids(ids, lo, width), window_ids(ids, hi, width)), shape)
    return ids[a], refined, lo, hi - lo


def later(bucket: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Mask of members that are not the first, by (doc, pos), of their bucket.

    The same (doc, pos) twice is one occurrence (a repeated row)."""
    out = np.zeros(len(bucket), bool)
    if not len(bucket):
        return out
    order = np.argsort(bucket, kind="stable")
    same = bucket[order][1:] == bucket[order][:-1]
    sel = order[np.r_[False, same] | np.r_[same, False]]
    sel = sel[np.lexsort((pos[sel], doc[sel], bucket[sel]))]
    b = bucket[sel]
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    head = np.repeat(first, np.diff(np.r_[first, len(b)]))
    out[sel] = (doc[sel] != doc[sel][head]) | (pos[sel] != pos[sel][head])
    return out


_PART = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
_MARK = pa.schema([("doc_id", pa.int64()), ("runs", pa.binary()), ("spans", pa.binary())])
_PART_DDL, _MARK_DDL = "bucket int, kind int, blob binary", "doc_id long, runs binary, spans binary"


def _parts(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=_PART)


def _spans_out(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_buckets: int) -> list[tuple[int, int, bytes]]:
    doc, lo, hi = A.merged_by(doc, lo, hi)
    bucket = (A.mix(doc.view(np.uint64)) % A.U64(n_buckets)).astype(np.int64)
    return [(b, 1, x) for b, x in A.dealt(bucket, n_buckets, doc, lo, hi)]


def _runs_out(doc: np.ndarray, packed: np.ndarray, n_buckets: int) -> list[tuple[int, int, bytes]]:
    bucket = (A.mix(doc.view(np.uint64)) % A.U64(n_buckets)).astype(np.int64)
    return [(b, 0, x) for b, x in A.dealt(bucket, n_buckets, doc, packed)]


def _by_doc(docs: np.ndarray, *values: np.ndarray) -> dict[int, bytes]:
    order = np.argsort(docs, kind="stable")
    ids, first = np.unique(docs[order], return_index=True)
    ends = np.r_[first[1:], len(docs)]
    table = np.stack([v[order] for v in values], axis=1) if len(docs) else np.zeros((0, len(values)), np.int64)
    return {int(d): table[s:e].tobytes() for d, s, e in zip(ids, first, ends)}


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs and disjoint spans of each document of the partition's buckets."""
    found, spans, _ = _gathered(batches)
    runs_of = _by_doc(*A.unpack_all(found, 2))
    span_of = _by_doc(*A.merged_by(*A.unpack_all(spans, 3)))
    ids = sorted(runs_of.keys() | span_of.keys())
    for s in range(0, len(ids), 10_000):
        part = ids[s : s + 10_000]
        yield pa.record_batch(
            [
                pa.array(part, pa.int64()),
                pa.array([runs_of.get(d) for d in part], pa.binary()),
                pa.array([span_of.get(d) for d in part], pa.binary()),
            ],
            schema=_MARK,
        )


def _tiles(batch: pa.RecordBatch, width: int):
    """(data, starts, ends, ids, bases) of groups of documents and of the
    overlapping tiles of long documents; each window is in exactly one."""
    data, off = A.utf8(batch.column(1))
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for i, j in A.groups_of(off, TILE):
        if j == i + 1 and off[j] - off[i] > LONG:
            for s in range(int(off[i]), int(off[j]) - width + 1, LONG):
                part = data[s : min(s + LONG + width - 1, int(off[j]))]
                yield part, np.array([0]), np.array([len(part)]), ids[i:j], np.array([s - off[i]])
        else:
            o = off[i : j + 1] - off[i]
            yield data[off[i] : off[j]], o[:-1], o[1:], ids[i:j], np.zeros(j - i, np.int64)


def _anchor_task(width: int, n_buckets: int):
    def flush(parts):
        key, refined, doc, pos, more = (np.concatenate(x) for x in zip(*parts))
        again = later(refined, doc, pos)
        rows = _spans_out(doc[again], pos[again], pos[again] + more[again] + width, n_buckets)
        k, r, d, p, m = (x[~again] for x in (key, refined, doc, pos, more))
        bucket = ((A.mix(k, r) >> A.U64(20)) % A.U64(n_buckets)).astype(np.int64)
        rows += [(b, 0, x) for b, x in A.dealt(bucket, n_buckets, k.view(np.int64), r.view(np.int64), d, p * 256 + m)]
        return _parts(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for data, starts, ends, ids, bases in _tiles(batch, width):
                found = runs(data, starts, ends, width)
                if found is None:
                    continue
                key, refined, lo, more = found
                seg = np.searchsorted(starts, lo, side="right") - 1
                parts.append((key, refined, ids[seg], lo - starts[seg] + bases[seg], more))
                n += len(lo)
                if n >= FLUSH:
                    yield flush(parts)
                    parts, n = [], 0
        if n:
            yield flush(parts)

    return task


def _gathered(batches) -> tuple[list[bytes], list[bytes], list[bytes]]:
    kinds: tuple[list[bytes], list[bytes], list[bytes]] = ([], [], [])
    for batch in batches:
        for k, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            kinds[k].append(x)
    return kinds


def _sparse_task(width: int, n_buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, spans, _ = _gathered(batches)
        key, refined, doc, packed = A.unpack_all(found, 4)
        pos, more = packed >> 8, packed & 255
        again = later(refined.view(np.uint64), doc, pos)
        sdoc, slo, shi = A.unpack_all(spans, 3)
        sdoc, slo, shi = A.merged_by(
            np.r_[sdoc, doc[again]], np.r_[slo, pos[again]], np.r_[shi, pos[again] + more[again] + width]
        )
        key, doc, packed = (x[~again] for x in (key, doc, packed))
        several = _several(key)
        # one record of each anchor goes on: the run itself, or that there are more
        lone, shared = ~several, np.unique(key[several])
        k = np.r_[key[lone], shared]
        bucket = ((k.view(np.uint64) >> A.U64(20)) % A.U64(n_buckets)).astype(np.int64)
        told = A.dealt(bucket, n_buckets, k, np.r_[doc[lone], np.zeros_like(shared)], np.r_[packed[lone], np.full_like(shared, MORE)])
        rows = _runs_out(doc[several], packed[several], n_buckets) + _spans_out(sdoc, slo, shi, n_buckets)
        yield _parts(rows + [(b, 2, x) for b, x in told])

    return task


MORE = -1  # in place of a run


def _several(key: np.ndarray) -> np.ndarray:
    """Mask of keys that occur more than once."""
    out = np.zeros(len(key), bool)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if len(key):
        out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def _shared_task(n_buckets: int):
    """Runs of anchors that several tasks told about; what is dealt by document passes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            asked += [x.as_py() for x in batch.column(2).filter(pa.array(kind == 2))]
            if (kind != 2).any():
                yield batch.filter(pa.array(kind != 2))
        key, doc, packed = A.unpack_all(asked, 3)
        left = _several(key) & (packed != MORE)
        yield _parts(_runs_out(doc[left], packed[left], n_buckets))

    return task


def _dense_task(width: int, n_buckets: int, columns: list[str]):
    at_id, at_text, n_columns = columns.index("doc_id"), columns.index("text"), len(columns)

    def flush(parts, spans):
        rows = []
        if parts:
            wid, doc, pos = (np.concatenate(x) for x in zip(*parts))
            again = later(wid, doc, pos)
            spans = [*spans, (doc[again], pos[again], pos[again] + width)]
            wid, doc, pos = wid[~again], doc[~again], pos[~again]
            bucket = ((wid >> A.U64(20)) % A.U64(n_buckets)).astype(np.int64)
            rows += [(b, 0, x) for b, x in A.dealt(bucket, n_buckets, wid.view(np.int64), doc, pos)]
        if spans:
            rows += _spans_out(*(np.concatenate(x) for x in zip(*spans)), n_buckets)
        return _parts(rows)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, spans, n = [], [], 0
        for batch in batches:
            data, off = A.utf8(batch.column(at_text))
            for i, d in enumerate(batch.column(at_id).to_pylist()):
                s = np.frombuffer(batch.column(n_columns + 1)[i].as_py() or b"", np.int64).reshape(-1, 2)
                if len(s):
                    spans.append((np.full(len(s), d), s[:, 0], s[:, 1]))
                r = np.frombuffer(batch.column(n_columns)[i].as_py() or b"", np.int64)
                if len(r):
                    r = np.unique(r)
                    pos, more = r >> 8, r & 255
                    at = np.repeat(pos - np.r_[0, np.cumsum(more + 1)[:-1]], more + 1) + np.arange((more + 1).sum())
                    parts.append((window_ids(bucket_ids(data[off[i] : off[i + 1]]), at, width), np.full(len(at), d), at))
                    n += len(at)
                n += len(s)
                if n >= FLUSH:
                    yield flush(parts, spans)
                    parts, spans, n = [], [], 0
        if n:
            yield flush(parts, spans)

    return task


def _settle_task(width: int, n_buckets: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, spans, _ = _gathered(batches)
        wid, doc, pos = A.unpack_all(found, 3)
        again = later(wid.view(np.uint64), doc, pos)
        sdoc, slo, shi = A.unpack_all(spans, 3)
        merged = A.merged_by(np.r_[sdoc, doc[again]], np.r_[slo, pos[again]], np.r_[shi, pos[again] + width])
        yield _parts(_spans_out(*merged, n_buckets))

    return task


def with_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """`docs` (doc_id long, text, any others) and `_spans` binary: the byte
    ranges to remove, as little-endian int64 pairs, disjoint and ascending;
    null if there are none.  `width` is 64 to 128 bytes.  Rows without id have none.
    """
    if not 2 * Q <= width <= 4 * Q:
        raise ValueError("width must be 64 to 128")
    n = n_buckets = spread(docs)
    named = docs.where("doc_id is not null")
    marks = (
        named.select("doc_id", "text")
        .mapInArrow(_anchor_task(width, n_buckets), _PART_DDL)
        .repartition(n, "bucket")
        .mapInArrow(_sparse_task(width, n_buckets), _PART_DDL)
        .repartition(n, "bucket")
        .mapInArrow(_shared_task(n_buckets), _PART_DDL)
        .repartition(n, "bucket")
        .mapInArrow(_per_document, _MARK_DDL)
    )
    marks = written(marks, "suffix-marks")
    # A document without runs or spans stays as it is, where it is.  The row is one
    # column meanwhile, so that its own may have any names.
    told = named.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("_doc"))
    told = bloom.flagged(told, F.xxhash64("_doc"), marks, F.xxhash64("doc_id"), "suffix-filter")
    # Renamed, both joins read one exchange: a plain self-join would be
    # given an alias on one side only, and the texts would shuffle twice.
    inner = [f"_c{i}" for i in range(len(docs.columns))]
    key = inner[docs.columns.index("doc_id")]

    def texts() -> DataFrame:
        return told.where("maybe").select(*(F.col("row").getField(c).alias(x) for c, x in zip(docs.columns, inner))).repartition(n, key)

    spans = (
        texts()
        .join(marks.hint("shuffle_hash"), F.col(key) == F.col("doc_id"))
        .select(*inner, "runs", "spans")
        .mapInArrow(_dense_task(width, n_buckets, docs.columns), _PART_DDL)
        .repartition(n, "bucket")
        .mapInArrow(_settle_task(width, n_buckets), _PART_DDL)
        .repartition(n, "bucket")
        .mapInArrow(_per_document, _MARK_DDL)
        .select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    )
    out = (
        texts()
        .join(spans.hint("shuffle_hash"), F.col(key) == F.col("_id"), "left")
        .select(*(F.col(x).alias(c) for c, x in zip(docs.columns, inner)), "_spans")
    )
    none = F.lit(None).cast("binary").alias("_spans")
    apart = told.where(~F.col("maybe")).select("row.*", none)
    return out.unionByName(apart).unionByName(docs.where("doc_id is null").select("*", none))


def spans_of(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    s = np.frombuffer(blob or b"", np.int64).reshape(-1, 2)
    return s[:, 0], s[:, 1]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text counts as empty; texts below `width` bytes lose nothing; an empty
    table gives an empty result.  Rows that repeat an id with the same text
    are one document and get equal results; a row without id loses nothing.
    Columns other than id and text are not read.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.utf8(batch.column(1))
            removed, spans, digest = [], [], []
            for i in range(batch.num_rows):
                lo, hi = spans_of(batch.column(2)[i].as_py())
                text = data[off[i] : off[i + 1]].tobytes()
                h, at = hashlib.sha256(), 0
                for s, e in zip(lo.tolist(), hi.tolist()):
                    h.update(text[at:s])
                    at = e
                h.update(text[at:])
                removed.append(int((hi - lo).sum()))
                spans.append(len(lo))
                digest.append(h.hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_spans(base, width).mapInArrow(
        task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """`docs` (doc_id, text and any other columns) with repeated strings cut.

    A character goes if all of its bytes do, so that texts stay valid UTF-8.
    """

    def cut(text: bytes, blob: bytes) -> str:
        lo, hi = spans_of(blob)
        keep, at = [], 0
        for s, e in zip(lo.tolist(), hi.tolist()):
            while s < e and text[s] & 0xC0 == 0x80:
                s += 1
            while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                e -= 1
            keep.append(text[at:s])
            at = e
        return b"".join([*keep, text[at:]]).decode("utf-8", "replace")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, k = batch.schema.get_field_index("text"), batch.schema.get_field_index("_spans")
            texts = batch.column(i).cast(pa.binary()).to_pylist()
            out = [t if t is None or not s else cut(t, s) for t, s in zip(texts, batch.column(k).to_pylist())]
            out = [t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in out]
            columns = [pa.array(out, pa.string()) if c == i else batch.column(c) for c in range(k)]
            yield pa.record_batch(columns, names=batch.schema.names[:k])

    base = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    return with_spans(base, width).mapInArrow(task, base.schema)
