"""Bloom filters as small tables of bitmaps, by SQL functions only.

A filter has K ranges of 2**log2_bits bits; a key (a 64-bit hash) has a slot in
each.  Ranges are cut into frames of 32,768 bits: a filter is stored as rows (frame, bits), so it
is built by map-side bitmap aggregation and tested by broadcast joins of rows
of 4 KB.  It is sized from the number of keys, eight bits a range and key, up
to MOST_BITS: what is broadcast is at most K * 2**MOST_BITS / 8 bytes (32 MB)
and is checked by construction.  Beyond that a filter lets more rows through;
its callers' results don't depend on how many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm.scratch import written

K = 2
LEAST_BITS, MOST_BITS = 15, 27


def log2_bits_for(keys: int) -> int:
    return min(max((8 * max(keys, 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)


def _frames_a_range(log2_bits: int) -> int:
    return max(1, (1 << log2_bits) >> 15)


def slots(key: Column, log2_bits: int) -> list[Column]:
    """The key's slot in each range."""
    mask = F.lit((1 << log2_bits) - 1)
    return [F.shiftright(key, 32 * i).bitwiseAND(mask) for i in range(K)]


def all_slots(keys: DataFrame, key: Column, log2_bits: int) -> DataFrame:
    """A row (slot) per key and range; ranges start at whole frames."""
    starts = [F.lit(i * _frames_a_range(log2_bits) << 15) for i in range(K)]
    return keys.select(F.explode(F.array(*[s + start for s, start in zip(slots(key, log2_bits), starts)])).alias("slot"))


def frames(hits: DataFrame, name: str) -> DataFrame:
    """The stored filter of the slots hit."""
    made = hits.groupBy(F.expr("bitmap_bucket_number(slot + 1)").alias("frame")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(slot + 1))").alias("bits")
    )
    return written(made, name)


def tested(rows: DataFrame, key: Column, stored: DataFrame, log2_bits: int) -> DataFrame:
    """Adds boolean `maybe`: all of the key's slots are in the filter."""
    out, maybe = rows.withColumn("_key", key), F.lit(True)
    per_range = _frames_a_range(log2_bits)
    for i, s in enumerate(slots(F.col("_key"), log2_bits)):
        # the bitmap functions count from 1
        part = stored.where((F.col("frame") > i * per_range) & (F.col("frame") <= (i + 1) * per_range))
        part = part.select(F.col("frame").alias(f"_f{i}"), F.col("bits").alias(f"_bits{i}"))
        frame = F.shiftright(s, 15) + F.lit(1 + i * per_range)
        out = out.join(F.broadcast(part), frame == F.col(f"_f{i}"), "left")
        place = s.bitwiseAND(F.lit(32767)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))).bitwiseAND(F.lit(1))
        maybe = maybe & (F.coalesce(bit, F.lit(0)) == 1)
    return out.withColumn("maybe", maybe).drop("_key", *[f"{c}{i}" for c in ("_f", "_bits") for i in range(K)])


def flagged(rows: DataFrame, key: Column, stored_keys: DataFrame, their_key: Column, name: str) -> DataFrame:
    """`rows` and boolean `maybe`, false only where the key is surely not among
    those of `stored_keys`, a stored table."""
    bits = log2_bits_for(stored_keys.count())
    return tested(rows, key, frames(all_slots(stored_keys, their_key, bits), name), bits)


def settled(rows: DataFrame, narrow: DataFrame, key: Column, drop: DataFrame, their_key: Column, same: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, open) of `rows`: those surely not in `drop`, and the few that must be
    joined with it; all others are in it.  Only keys are shuffled for that.

    A second filter holds what the first one flags by mistake: a flagged row that is
    not in it is to be dropped.  narrow: the key columns of `rows`; drop: a stored table;
    `same` joins narrow (or rows) with drop."""
    bits = log2_bits_for(drop.count())
    first = frames(all_slots(drop, their_key, bits), f"{name}-1")
    mistaken = tested(narrow, key, first, bits).where("maybe").join(drop, same, "left_anti").select(key.alias("k")).distinct()
    mistaken = written(mistaken, f"{name}-mistaken")
    fewer = log2_bits_for(mistaken.count())
    second = frames(all_slots(mistaken, F.col("k"), fewer), f"{name}-2")
    flagged_ = tested(rows, key, first, bits).withColumnRenamed("maybe", "_first")
    told = tested(flagged_, key, second, fewer)
    columns = rows.columns
    return told.where(~F.col("_first")).select(*columns), told.where(F.col("_first") & F.col("maybe")).select(*columns)
