"""Hierarchical residual packing of tokenised documents into sequences.

Every partition packs its own pieces by best fit (largest first).  Nearly full
bins are final; the others become items, of their fill, for the next level, where fewer
nodes pack what several nodes below left over, and so on up the tree.  A node
takes a bounded number of items, so no node gathers what grows with the corpus: where the bound
keeps the tree from narrowing, the items are dealt anew to as many nodes, round
after round, until there is one node or a round leaves nearly as many underfull bins as it got.

Levels are stored in the shared folder; texts are tokenised once and only
(id, piece, start, length, checksum) records move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.scratch import written
from vitrail.llm.tokens import default_path, encode_with_added

CAPACITY = 2048
NEARLY_FULL = 2040
FANOUT = 8
NODE_ITEMS = 200_000
LEAST_GAIN = 64  # a round dealt anew that saves less than one bin in so many is the last
MOST_ROUNDS = 120  # levels are numbered in seven bits
_NO_ID = np.iinfo(np.int64).min
_BINS = "seq long, full boolean, fill int, items binary"
_COLUMNS = 6  # doc_id, piece, start, length, crc32, offset


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item indices.

    Open bins are stacked by free space; a bit per free space finds the
    tightest bin that takes an item."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits, bins = 0, []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = bits >> s
        if fits:
            free = s + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                bits ^= 1 << free
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        free -= s
        if free:
            stacks[free].append(b)
            bits |= 1 << free
    return bins


def pieces(ids: np.ndarray, capacity: int, end_id: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids and the end id; only
    longer ones are cut, and then the first piece takes the remainder."""
    ids = np.append(ids.astype("<u4"), np.uint32(end_id))
    n, out, at = len(ids), [], 0
    size = (n - 1) % capacity + 1
    while at < n:
        out.append((len(out), at, size, zlib.crc32(ids[at : at + size].tobytes())))
        at, size = at + size, capacity
    return out


def _bins_out(level: int, made: list[tuple[int, bytes]], count: int, capacity: int, near: int):
    base = (level << 56) | (TaskContext.get().partitionId() << 32) | count
    fill = [f for f, _ in made]
    return pa.record_batch(
        [
            pa.array(range(base, base + len(made)), pa.int64()),
            pa.array([f >= min(near, capacity) for f in fill], pa.bool_()),
            pa.array(fill, pa.int32()),
            pa.array([x for _, x in made], pa.binary()),
        ],
        names=["seq", "full", "fill", "items"],
    )


def _leaf_task(path: str, capacity: int, near: int, end_id: int):
    def pack(rows):
        table = np.array(rows, np.int64)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        made = []
        for b in best_fit(table[:, 3], capacity):
            t = np.empty((len(b), _COLUMNS), np.int64)
            t[:, :5] = table[b]
            t[:, 5] = np.cumsum(t[:, 3]) - t[:, 3]
            made.append((int(t[:, 3].sum()), t.tobytes()))
        return made

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count = [], 0
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode_with_added(path, t.as_py() or "")
                d = _NO_ID if d is None else d
                rows += [(d, *p) for p in pieces(ids, capacity, end_id)]
            if len(rows) >= NODE_ITEMS:
                made = pack(rows)
                yield _bins_out(0, made, count, capacity, near)
                count, rows = count + len(made), []
        if rows:
            yield _bins_out(0, pack(rows), count, capacity, near)

    return task


def _merge_task(level: int, capacity: int, near: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, list[tuple[int, int, bytes]]] = {}
        for batch in batches:
            for node, seq, fill, items in zip(*(batch.column(i).to_pylist() for i in range(4))):
                nodes.setdefault(node, []).append((seq, fill, items))
        count = 0
        for node in sorted(nodes):
            rows = sorted(nodes[node])
            made = []
            for b in best_fit(np.array([r[1] for r in rows]), capacity):
                t = np.concatenate([np.frombuffer(rows[i][2], np.int64).reshape(-1, _COLUMNS) for i in b])
                t = t.copy()
                t[:, 5] = np.cumsum(t[:, 3]) - t[:, 3]
                made.append((int(t[:, 3].sum()), t.tobytes()))
            yield _bins_out(level, made, count, capacity, near)
            count += len(made)

    return task


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tables = [np.frombuffer(x, np.int64).reshape(-1, _COLUMNS) for x in batch.column(1).to_pylist()]
        if not tables:
            continue
        t = np.concatenate(tables)
        seq = np.repeat(batch.column(0).to_numpy(), [len(x) for x in tables])
        yield pa.record_batch(
            [
                pa.array(t[:, 0], pa.int64(), mask=t[:, 0] == _NO_ID),
                pa.array(t[:, 1].astype(np.int32)),
                pa.array(t[:, 2]),
                pa.array(t[:, 3]),
                pa.array(t[:, 4]),
                pa.array(seq),
                pa.array(t[:, 5]),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        )


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    near: int = NEARLY_FULL,
    end_id: int = 0,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end_id`; null or empty text is the end id
    alone.  Repeated rows are packed as often as they come; a null id stays null.
    Other columns are not read.  An empty table gives no sequences.
    """
    path = tokenizer or default_path()
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cur = written(base.mapInArrow(_leaf_task(path, capacity, near, end_id), _BINS), "packing")
    done, level = [cur.where("full")], 0
    left = cur.where("not full")
    nodes, n = left.select(F.expr("seq >> 32").alias("p")).distinct().count(), left.count()
    while n:
        fewer = max(-(-nodes // FANOUT), -(-n // NODE_ITEMS))
        level += 1
        cur = written(
            left.select(F.pmod(F.xxhash64("seq", F.lit(level)), F.lit(fewer)).cast("int").alias("node"), "seq", "fill", "items")
            .repartition(fewer, "node")
            .mapInArrow(_merge_task(level, capacity, near), _BINS),
            "packing",
        )
        done.append(cur.where("full"))
        left, before = cur.where("not full"), n
        n = left.count()
        if fewer == 1 or fewer >= nodes and n > before - before // LEAST_GAIN or level == MOST_ROUNDS:
            break
        nodes = fewer
    done.append(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("seq", "items").mapInArrow(
        _unfold, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
