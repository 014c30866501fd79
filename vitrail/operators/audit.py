"""Tamper-evident audit chains, lockouts and sessions.

Chains and lockouts depend on every earlier entry: each log or user is one
sorted stream through one task, of which only the last state is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

GENESIS = "GENESIS"


def entry_hash(prev: Column, ts: Column, actor: Column, event: Column, payload: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("|", prev, ts, actor, event, payload), "UTF-8"), 256)


def _in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key, *order)


def _folded(df: DataFrame, schema: StructType, start: Callable, step: Callable) -> DataFrame:
    """`df` with the columns that `schema` has more, as step(state, row) gives
    them; its first column is the key, and rows come by key and in order."""
    more = schema.names[len(df.columns) :]
    kinds = {f.name: pa.int64() if f.dataType == LongType() else pa.string() for f in schema.fields}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[0] != key:
                    key, state = row[0], start(row)
                state, made = step(state, row)
                out.append(made)
            columns = [pa.array(c, kinds[n]) for n, c in zip(more, zip(*out))] if out else [pa.array([], kinds[n]) for n in more]
            yield pa.record_batch([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(task, schema)


def chain(events: DataFrame, log: str = "log", order: str = "id", heads: DataFrame | None = None) -> DataFrame:
    """Hash-chains each log's events in order: adds prev_hash, entry_hash and n, the place in the log.

    events: log, id, ts, actor, event, payload.  `heads` (log, entry_hash, n) are
    the last entries of logs that go on; others begin at GENESIS.  Any number of entries of a log
    takes the room of one."""
    cols = [log, order, "ts", "actor", "event", "payload"]
    rows = events.select(*cols, F.concat_ws("|", "ts", "actor", "event", "payload").alias("_body"))
    if heads is None:
        rows = rows.withColumn("_head", F.lit(None).cast("string")).withColumn("_n", F.lit(0).cast("long"))
    else:
        last = heads.select(F.col(log).alias("_log"), F.col("entry_hash").alias("_head"), F.col("n").alias("_n"))
        rows = rows.join(last, F.col(log).eqNullSafe(F.col("_log")), "left").drop("_log").withColumn("_n", F.coalesce("_n", F.lit(0).cast("long")))
    rows = _in_order(rows, log, [order])
    schema = StructType([*rows.schema.fields, *(StructField(c, StringType()) for c in ("prev_hash", "entry_hash")), StructField("n", LongType())])

    def start(row: tuple) -> tuple[str, int]:
        return row[-2] or GENESIS, row[-1]

    def step(state: tuple[str, int], row: tuple):
        prev, n = state
        said = [x for x in row[2:6] if x is not None]  # as concat_ws leaves nulls out
        digest = hashlib.sha256("|".join([prev, row[6]] if said else [prev]).encode()).hexdigest()
        return (digest, n + 1), (prev, digest, n + 1)

    return _folded(rows, schema, start, step).drop("_body", "_head", "_n")


def heads(chained: DataFrame, log: str = "log") -> DataFrame:
    """(log, entry_hash, n) of each log's last entry."""
    return chained.groupBy(log).agg(F.max_by("entry_hash", "n").alias("entry_hash"), F.max("n").alias("n"))


def verify(chained: DataFrame, log: str = "log", order: str = "id", last: DataFrame | None = None) -> DataFrame:
    """(log, valid): each entry's stored predecessor is the entry before, and its
    hash is right; with `last` (as `heads` gives), the log also ends where it did."""
    w = Window.partitionBy(log).orderBy(order)
    want = entry_hash(F.col("prev_hash"), F.col("ts"), F.col("actor"), F.col("event"), F.col("payload"))
    ok = (F.col("prev_hash") == F.lag("entry_hash", 1, GENESIS).over(w)) & (F.col("entry_hash") == want)
    checked = chained.withColumn("_ok", ok).groupBy(log).agg(F.bool_and("_ok").alias("valid"), F.max_by("entry_hash", order).alias("_end"))
    if last is None:
        return checked.drop("_end")
    known = last.select(F.col(log).alias("_log"), F.col("entry_hash").alias("_last"))
    both = checked.join(known, F.col(log) == F.col("_log"), "full")
    return both.select(F.coalesce(log, "_log").alias(log), F.coalesce(F.col("valid") & (F.col("_end") == F.col("_last")), F.lit(False)).alias("valid"))


def latest(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


def failure_runs(attempts: DataFrame, user: str = "user_id", ts: str = "ts", ok: str = "ok", limit: int = 5, lock_minutes: int = 15) -> DataFrame:
    """(user, locked_at, locked_until) of each failure that locks an account.

    Failures are counted until a success; from the `limit`th on, each one locks.
    While a lock lasts, attempts are turned away: they neither count nor succeed, and
    the count is still there when it ends."""
    rows = attempts.select(F.col(user), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(ok).cast("int").cast("long").alias("_ok"))
    rows = _in_order(rows, user, ["_at"])
    schema = StructType([*rows.schema.fields, StructField("_until", LongType())])
    lasts = lock_minutes * 60_000_000

    def step(state: tuple[int, int], row: tuple):
        failures, until = state
        if until > row[1]:
            return state, (None,)
        if row[2]:
            return (0, 0), (None,)
        until = row[1] + lasts if failures + 1 >= limit else 0
        return (failures + 1, until), (until or None,)

    kind = attempts.schema[ts].dataType
    locks = _folded(rows, schema, lambda row: (0, 0), step).where("_until is not null")
    return locks.select(
        user, F.timestamp_micros("_at").cast(kind).alias("locked_at"), F.timestamp_micros("_until").cast(kind).alias("locked_until")
    )


def job_verdicts(events: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds `accepte` to job events (key, job_id, ts, status): a document has one job at
    a time, so a job that starts (status processing) while another runs is
    refused, and so is whatever is said of a refused job."""
    rows = _in_order(events.select(key, "job_id", "ts", "status"), key, ["ts", "job_id"])
    schema = StructType([*rows.schema.fields, StructField("_ok", LongType())])

    def step(running: str, row: tuple):
        _, job, _, status = row
        if status == "processing":
            return (running or job), (int(running in ("", job)),)
        return ("" if running == job else running), (int(running == job),)

    return _folded(rows, schema, lambda row: "", step).withColumn("accepte", F.col("_ok") == 1).drop("_ok")


def listed_jobs(verdicts: DataFrame, now: Column, key: str = "document_id", minutes: int = 60) -> DataFrame:
    """The last state of each accepted job; finished ones are listed for `minutes` only."""
    last = verdicts.where("accepte").groupBy(key, "job_id").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("updated"))
    return last.where((F.col("status") == "processing") | (F.col("updated") >= now - F.expr(f"interval {minutes} minutes")))


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", minutes: int = 15) -> DataFrame:
    """Sliding inactivity sessions: a gap of `minutes` or more ends one."""
    w = Window.partitionBy(user).orderBy(ts)
    gap = F.coalesce(F.col(ts) >= F.lag(ts).over(w) + F.expr(f"interval {minutes} minutes"), F.lit(True))
    s = events.withColumn("_s", F.sum(gap.cast("int")).over(w))
    return s.groupBy(user, "_s").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n")).drop("_s")


def breaker_open(segments: DataFrame, key: str = "document_id", order: str = "seg", failed: str = "failed", limit: int = 15) -> DataFrame:
    """Adds `open`: `limit` failures came before this segment, in total."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("open", F.coalesce(F.sum(F.col(failed).cast("int")).over(w), F.lit(0)) >= limit)
