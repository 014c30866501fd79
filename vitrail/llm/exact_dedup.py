"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Texts are read once, for their SHA-256; the table of digests is stored.  Pass 1
keeps, in a Bloom filter sized from the number of rows, the slots that at least
two rows hit.  Pass 2 tests every row: a row with a slot that only it hits
cannot have a copy and passes straight through; only possible repeats shuffle,
and of those only (id, digest).

Scale: the parts of the filter meet in an exchange of slot numbers (8 bytes,
counted before they are sent, so a hot text costs one number a task): that is what a sparse bitmap
per task would hold, where dense ones would cost each task the whole filter.
The broadcast filter is at most 32 MB (see `bloom`); from some 10**8 rows on
more rows than need be shuffle as (id, digest), 40 bytes each, with the same result.  The
possible repeats are joined with their per-digest summary, never gathered
per group; an oversized digest is one that AQE splits, since the summary side
has one row per digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm import bloom
from vitrail.llm.scratch import written


def digest_of(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 as binary; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def repeat_filter(digests: DataFrame, digest: Column, log2_bits: int) -> DataFrame:
    """The stored filter of the slots hit by two or more rows."""
    hits = bloom.all_slots(digests, F.xxhash64(digest), log2_bits).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    return bloom.frames(hits.where("n > 1"), "exact-filter")


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): the stored digests (doc_id, sha) with boolean `maybe`, and the rows
    of each digest and id that `maybe` rows have: sha, doc_id, n."""
    base = docs.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("sha"))
    base = written(base, "exact-digests")
    bits = bloom.log2_bits_for(base.count()) if log2_bits is None else log2_bits
    rows = bloom.tested(base, F.xxhash64("sha"), repeat_filter(base, F.col("sha"), bits), bits)
    return rows, rows.where("maybe").groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))


def _summary(counts: DataFrame) -> DataFrame:
    """(_sha in hex, keep_id, group_size).  The join key is not the grouping key: the
    summary then gets an exchange of its own, and AQE can split a hot digest on the side of the rows."""
    summary = counts.groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return summary.select(F.hex("sha").alias("_sha"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", log2_bits: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null ids are less than
    any.  A null text counts as empty, so nulls and empty texts form one group.
    Rows that repeat an id with the same text are copies too: all of them carry
    that id as keep_id and are marked kept (`without_copies` leaves one of them).
    An empty table gives an empty result; other columns are not read.
    """
    rows, counts = digest_groups(docs, id_col, text_col, log2_bits)
    summary = _summary(counts)
    text_sha256 = F.lower(F.hex("sha")).alias("text_sha256")
    single = rows.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256
    )
    several = rows.where("maybe").join(summary, F.hex("sha") == F.col("_sha")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), text_sha256
    )
    return single.unionByName(several)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of every text: the one `exact_dedup` keeps, once.

    Digests are shuffled, texts are not, but for those few that the filters can't settle."""
    rows, counts = digest_groups(docs, id_col, text_col)
    fates = counts.join(_summary(counts), F.hex("sha") == F.col("_sha"))
    gone = ~F.col("doc_id").eqNullSafe(F.col("keep_id"))
    fates = fates.where(gone | (F.col("n") > 1)).select(F.col("doc_id").alias("_id"), F.col("sha").alias("_digest"), gone.alias("_gone"))
    fates = written(fates, "exact-fates")
    gone, again = written(fates.where("_gone"), "exact-gone"), fates.where("not _gone")
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest"))
    key, their_key = F.xxhash64("_doc", "_sha"), F.xxhash64("_id", "_digest")
    # the row as one column: its own may have any names
    told = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_doc"), digest_of(F.col(text_col)).alias("_sha"))
    narrow = rows.select(F.col("doc_id").alias("_doc"), F.col("sha").alias("_sha"))
    kept, open_ = bloom.settled(told, narrow, key, gone, their_key, same, "exact-filter")
    left = kept.unionByName(open_.join(gone, same, "left_anti"))
    # rows that repeat: mostly there are none
    if again.limit(1).count():
        marked = bloom.flagged(left, key, written(again, "exact-again"), their_key, "exact-again-filter")
        left = marked.where(~F.col("maybe")).drop("maybe").unionByName(marked.where("maybe").drop("maybe").dropDuplicates(["_doc", "_sha"]))
    return left.select("row.*")
