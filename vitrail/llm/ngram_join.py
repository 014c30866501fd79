"""Self-join of documents on the Jaccard similarity of word n-grams.

Sets are compared as points: tokens are hashed into groups, and a set's
coordinates are its token counts by group.  The summed minima of two points'
coordinates bound their overlap from above, and so do those of a point and a
tree node's upper corner.  Points lie in R-trees, built in bulk; what survives
the bounds is verified on the sets themselves.

An R-tree over the whole corpus would prune little (counts of unrelated texts
concentrate), and a single one does not distribute.  So the points are first
split in a way that loses no link:

1. Two sets with sizes a <= b and similarity >= t differ in at most
   a * (1 - t) / t tokens.  Cut token space into one group more than that: some group
   then holds the same tokens in both.  Sets of close sizes that agree in a
   group (equal coordinates, told by an order-free hash) are candidates.
2. Components of candidates are dealt into chunks, each a cell with an R-tree of
   its own.  Most components are one chunk, and done.  The chunks of others are
   held against some pivots of the component; that links most of it.  What is not in its largest part
   then meets all of it, tile by tile.  Pairs within that part are connected already, so no
   component is lost, cells are bounded, and the work grows with the
   outliers and not with the square of the component.
3. Verified links, kept as a spanning forest per cell, give the components.

Equal sets are one point.  Group records travel as blobs by key, and each task
sends a set once, so hot copies cost little.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm import arrays as A
from vitrail.llm import bloom
from vitrail.llm.components import components, local_stars
from vitrail.llm.scratch import spread, written
from vitrail.llm.textscan import Scan

TILE = 1 << 19
FLUSH = 1_500_000
GROUPS = 128
FANOUT = 16
CHUNK_SETS, CELL_TOKENS = 1024, 2_000_000  # of a chunk
PIVOTS, PIVOT_TOKENS = 48, 1_000_000  # of a component of several
OUTLIER_TILE, TILE_SETS = 256, 1024


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles (A-Z lower-cased) of each text."""
    words, woff = Scan(data, off, fold=True).words()
    sh = words[: max(len(words) - k + 1, 0)]
    for i in range(1, k):
        sh = A.mix(sh, words[i : len(words) - k + 1 + i])
    out = []
    for s, e in zip(woff[:-1].tolist(), woff[1:].tolist()):
        if e - s >= k:
            x = np.sort(sh[s : e - k + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif e > s:  # the whole sequence as one, apart from longer shingles
            x = words[s : s + 1]
            for i in range(s + 1, e):
                x = A.mix(x, words[i : i + 1])
            out.append(A.mix(x, e - s))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class SizeClasses:
    """Classes of set sizes such that linked sets are in one or in adjacent
    classes; of each class the most tokens that linked sets may differ in."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.low = num, den, [1, 2]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * self.den // self.num)))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def groups(self, c: int) -> int:
        top = self.low[c + 1] - 1
        return (self.den - self.num) * top // self.num + 1

    def keys(self, s: np.ndarray) -> Iterator[np.ndarray]:
        """Keys of a set's token groups, for its class and the one below."""
        n, c = len(s), self.of(len(s))
        with np.errstate(over="ignore"):
            total = np.r_[A.U64(0), np.cumsum(A.mix(s, 3))]
            for k in (c, c - 1):
                if k < 0 or k < c and n * self.num > (self.low[c] - 1) * self.den:
                    continue
                g = self.groups(k)
                cuts = (np.arange(1, g, dtype=np.uint64) << A.U64(32)) // A.U64(g) << A.U64(32)
                at = np.r_[0, np.searchsorted(s, cuts), n]
                yield A.mix(A.mix(total[at[1:]] - total[at[:-1]], np.arange(g, dtype=np.uint64)), k)


_DDL = "bucket int, kind int, blob binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def set_id(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return A.mix(np.array([A.mix(s, 5).sum()], np.uint64), len(s))[0]


def _group_task(k: int, num: int, den: int, n_buckets: int):
    def flush(docs, keys, sids):
        rows = []
        if keys:
            key, sid = np.concatenate(keys), np.concatenate(sids)
            bucket = ((key >> A.U64(20)) % A.U64(n_buckets)).astype(np.int64)
            rows += [(b, 0, x) for b, x in A.dealt(bucket, n_buckets, key.view(np.int64), sid.view(np.int64))]
        doc, sid, n = (np.array(x) for x in zip(*docs))
        bucket = (A.mix(doc.view(np.uint64)) % A.U64(n_buckets)).astype(np.int64)
        rows += [(b, 1, x) for b, x in A.dealt(bucket, n_buckets, doc, sid.view(np.int64), n)]
        b, kind, x = zip(*rows)
        return pa.record_batch([pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(x, pa.binary())], schema=_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = SizeClasses(num, den)
        docs, keys, sids, seen, n = [], [], [], set(), 0
        for batch in batches:
            data, off = A.utf8(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in A.groups_of(off, TILE):
                sets = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                for d, s in zip(ids[i:j].tolist(), sets):
                    sid = set_id(s)
                    docs.append((d, sid, len(s)))
                    if len(s) and sid not in seen:
                        seen.add(sid)
                        for x in classes.keys(s):
                            keys.append(x)
                            sids.append(np.full(len(x), sid))
                            n += len(x)
                if n >= FLUSH or len(docs) >= FLUSH:
                    yield flush(docs, keys, sids)
                    docs, keys, sids, seen, n = [], [], [], set(), 0
        if docs:
            yield flush(docs, keys, sids)

    return task


def _candidate_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0: two set ids; kind 1: document id, set id, size)."""
    found: tuple[list[bytes], list[bytes]] = ([], [])
    for batch in batches:
        for kind, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found[kind].append(x)
    key, sid = A.unpack_all(found[0], 2)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    order = order[np.lexsort((sid[order], key[order]))]
    key, sid = key[order], sid[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    lead = np.repeat(sid[first], np.diff(np.r_[first, len(key)]))
    pairs = np.stack(local_stars(lead[lead != sid], sid[lead != sid]), 1)
    doc, dsid, n = A.unpack_all(found[1], 3)
    kind = np.r_[np.zeros(len(pairs), np.int32), np.ones(len(doc), np.int32)]
    columns = [np.r_[pairs[:, 0], doc], np.r_[pairs[:, 1], dsid], np.r_[np.zeros(len(pairs), np.int64), n]]
    for s in range(0, len(kind), 50_000):
        yield pa.record_batch(
            [pa.array(kind[s : s + 50_000], pa.int32()), *(pa.array(c[s : s + 50_000], pa.int64()) for c in columns)],
            names=["kind", "x", "y", "n"],
        )


class RTree:
    """Bulk-loaded R-tree over count vectors; nodes keep their upper corner
    and their least size, which is all that the overlap bound needs."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        spread = np.argsort(-points.var(axis=0))[:3]
        self.order = np.lexsort((*(points[:, d] for d in spread), sizes))
        top, least = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while len(top) > 1 or not self.levels:
            cuts = np.arange(0, len(top), FANOUT)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            self.levels.append((top, least))

    def search(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int):
        """(query, member, bound) of pairs that the bounds don't exclude, by
        descending bound; queries are taken in blocks of bounded memory."""
        for q0 in range(0, len(points), 256):
            q = np.arange(q0, min(q0 + 256, len(points)))
            node = np.zeros(len(q), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                top, least = self.levels[depth]
                ok = [
                    np.minimum(points[q[s : s + 20_000]], top[node[s : s + 20_000]]).sum(1, dtype=np.int64) * den
                    >= num * np.maximum(sizes[q[s : s + 20_000]], least[node[s : s + 20_000]])
                    for s in range(0, len(q), 20_000)
                ]
                ok = np.concatenate(ok) if ok else np.zeros(0, bool)
                q, node = q[ok], node[ok]
                below = len(self.levels[depth - 1][0]) if depth else len(self.order)
                q = np.repeat(q, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q, node = q[node < below], node[node < below]
            member = self.order[node]
            bound = np.concatenate(
                [np.zeros(0, np.int64)]
                + [
                    np.minimum(points[q[s : s + 20_000]], self.points[member[s : s + 20_000]]).sum(1, dtype=np.int64)
                    for s in range(0, len(q), 20_000)
                ]
            )
            ok = bound * (num + den) >= num * (sizes[q] + self.sizes[member])
            q, member, bound = q[ok], member[ok], bound[ok]
            by = np.argsort(-bound, kind="stable")
            yield q[by], member[by]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def cell_links(
    sets: list[np.ndarray], side: np.ndarray, num: int, den: int, group: np.ndarray | None = None
) -> list[tuple[int, int]]:
    """A spanning forest of the links in a cell.  side: 2 for all, or 0 and 1
    for two parts of which only links across count.  Sets of one group are connected."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.stack([np.bincount((s & A.U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS) for s in sets])
    points = points.astype(np.int32)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    if group is not None:
        _, first, place = np.unique(group, return_index=True, return_inverse=True)
        parent = first[place].tolist()
    probe = np.flatnonzero(side != 1)
    indexed = np.flatnonzero(side != 0)
    out = []
    if not len(probe) or not len(indexed):
        return out
    tree = RTree(points[indexed], sizes[indexed])
    for q, m in tree.search(points[probe], sizes[probe], num, den):
        for i, j in zip(probe[q].tolist(), indexed[m].tolist()):
            if i == j or side[i] == 2 and i > j:
                continue
            ri, rj = root(i), root(j)
            if ri != rj:
                o = _overlap(sets[i], sets[j])
                if den * o >= num * (sizes[i] + sizes[j] - o):
                    parent[ri] = rj
                    out.append((i, j))
    return out


def _cell_task(k: int, num: int, den: int):
    def links(rows):
        texts = pa.array([r[4] for r in rows], pa.string())
        data, off = A.utf8(texts)
        sets = [s for i, j in A.groups_of(off, TILE) for s in shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)]
        found = cell_links(sets, np.array([r[2] for r in rows]), num, den, np.array([r[3] for r in rows]))
        # sets of one group are connected: the group stands for them
        ends = np.array([(rows[i][3], rows[j][3]) for i, j in found], np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(x, pa.int64()) for x in local_stars(ends[:, 0], ends[:, 1])], names=["a", "b"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if rows and r[0] != rows[0][0]:
                    yield links(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield links(rows)

    return task


def _tile_of(salt: int, tiles: Column) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(salt)), tiles)


def _tiles_for(sets: Column, tokens: Column, most: int) -> Column:
    return F.greatest(F.ceil(sets / most), F.ceil(tokens / CELL_TOKENS), F.lit(1))


def _copies(tiles: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), tiles - 1))


def _first_cells(texts: DataFrame) -> DataFrame:
    """Cells (cell, sid, side, grp, text): whole small components; of large ones,
    chunks and in each of them the component's pivots.

    texts: sid, root, m, tokens, large, text."""
    whole = texts.where("not large").select(F.col("root").alias("cell"), "sid", F.lit(2).alias("side"), F.col("sid").alias("grp"), "text")
    large = texts.where("large")
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(4), F.floor(PIVOT_TOKENS * F.col("m") / F.col("tokens"))))
    chunks = _tiles_for(F.col("m"), F.col("tokens"), CHUNK_SETS)
    chunked = large.select(F.xxhash64("root", _tile_of(1, chunks)).alias("cell"), "sid", F.lit(1).alias("side"), F.col("sid").alias("grp"), "text")
    pivots = large.where(_tile_of(2, F.ceil(F.col("m") / wanted)) == 0).withColumn("c", _copies(chunks))
    pivots = pivots.select(F.xxhash64("root", "c").alias("cell"), "sid", F.lit(0).alias("side"), F.col("sid").alias("grp"), "text")
    return whole.unionByName(chunked).unionByName(pivots)


def _outlier_cells(texts: DataFrame, part: DataFrame) -> DataFrame:
    """Cells of what the pivots left outside the largest part of a large
    component, against all of it.  part: node, root, by the links so far."""
    large = texts.where("large")
    parts = large.select("sid", "root").join(part.select(F.col("node").alias("k"), F.col("root").alias("p")), F.col("sid") == F.col("k"), "left")
    parts = written(parts.select("sid", "root", F.coalesce("p", "sid").alias("grp")), "ngram-parts")
    sizes = parts.groupBy(F.col("root").alias("r"), F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("s"))
    main = sizes.groupBy("r").agg(F.max_by("g", F.struct("s", "g")).alias("main"), (F.sum("s") - F.max("s")).alias("out"))
    both = large.join(parts.select(F.col("sid").alias("k"), "grp"), F.col("sid") == F.col("k")).join(main, F.col("root") == F.col("r")).where("out > 0")
    inner = _tiles_for(F.col("m"), F.col("tokens"), TILE_SETS)
    outer = _tiles_for(F.col("out"), F.col("out") * F.col("tokens") / F.col("m"), OUTLIER_TILE)
    every = both.withColumn("o", _copies(outer)).select(F.xxhash64("root", "o", _tile_of(3, inner)).alias("cell"), "sid", F.lit(1).alias("side"), "grp", "text")
    stray = both.where("grp <> main").withColumn("t", _copies(inner))
    return every.unionByName(stray.select(F.xxhash64("root", _tile_of(4, outer), "t").alias("cell"), "sid", F.lit(0).alias("side"), "grp", "text"))


def ngram_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, num: int = 90, den: int = 100
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least id reachable by links).

    Sets of k-word shingles link when den * intersection >= num * union.  Words are runs of bytes other than ASCII
    white space, with A-Z lower-cased.  A null, empty or blank text has no shingle and is
    linked with nothing, not even with another empty text.  Equal texts under
    different ids are linked; a repeated id is one document.  Rows without id
    come back with a null component.  Other columns are not read.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = spread(base)
    named = base.where("doc_id is not null")
    found = written(
        named.mapInArrow(_group_task(k, num, den, 4 * n), _DDL)
        .repartition(n, "bucket")
        .mapInArrow(_candidate_task, "kind int, x long, y long, n long"),
        "ngram-candidates",
    )
    sets = found.where("kind = 1").select(F.col("x").alias("doc_id"), F.col("y").alias("sid"), "n")
    first = sets.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"))
    candidates = components(found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")))

    member = candidates.join(first, candidates["node"] == first["sid"]).select("sid", "root", "first_id", "n")
    shape = member.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("tokens"))
    shape = shape.withColumn("large", (F.col("m") > CHUNK_SETS) | (F.col("tokens") > CELL_TOKENS))
    placed = written(member.join(shape, F.col("root") == F.col("r")).drop("r"), "ngram-placed")
    # `placed` grows with the corpus, so it is never broadcast; only texts that may be in it move
    near = bloom.flagged(named, F.xxhash64("doc_id"), placed, F.xxhash64("first_id"), "ngram-filter").where("maybe")
    texts = written(
        near.join(placed.hint("shuffle_hash"), F.col("doc_id") == F.col("first_id")).select("sid", "root", "m", "tokens", "large", "text"),
        "ngram-texts",
    )

    def verified(cells: DataFrame) -> DataFrame:
        """cells: cell, sid, side, grp, text."""
        rows = cells.select("cell", "sid", "side", "grp", "text").repartition(n, "cell").sortWithinPartitions("cell")
        return rows.mapInArrow(_cell_task(k, num, den), "a long, b long")

    found_links = written(verified(_first_cells(texts)), "ngram-links")
    part = components(found_links)
    if texts.where("large").limit(1).count():
        more = written(verified(_outlier_cells(texts, part)), "ngram-outlier-links")
        if more.limit(1).count():
            stars = part.select(F.col("node").alias("a"), F.col("root").alias("b"))
            part = components(stars.unionByName(more))
    linked = part.join(first, F.col("node") == F.col("sid"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = linked.select("root", F.col("node").alias("k")).join(least, "root").select("k", "component_id")
    alone = first.join(joined, F.col("sid") == F.col("k"), "left").select(
        F.col("sid").alias("k"), F.coalesce("component_id", "first_id").alias("component_id")
    )
    alone = written(alone, "ngram-components")
    out = sets.join(alone, F.col("sid") == F.col("k"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    nameless = base.where("doc_id is null").select(
        "doc_id", F.lit(None).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")
    )
    return out.unionByName(nameless)
