"""Structured Streaming front ends: an addition beside the batch operators.

The same transformations run on a stream of files; sessions use event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from vitrail.operators.pii import anonymize
from vitrail.operators.audit import chain, heads, verify

_HEADS = "log string, entry_hash string, n long"


def document_stream(spark: SparkSession, path: str, schema: str = "document_id string, text string", files_per_trigger: int = 20) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def anonymized_stream(docs: DataFrame, out: str, checkpoint: str, mode: str = "strict") -> StreamingQuery:
    """Writes anonymised documents; ends when what is there has been read."""
    return (
        anonymize(docs, mode).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def active_sessions(events: DataFrame, minutes: int = 15, late: str = "1 hour", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Inactivity sessions in event time, late events within the watermark."""
    w = F.session_window(ts, f"{minutes} minutes")
    return events.withWatermark(ts, late).groupBy(w, user).agg(F.count(F.lit(1)).alias("n"))


def audited(events: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch to hash-chained logs that go on from batch to
    batch: the last entry of every log is kept beside them.  A batch that is replayed
    starts from the heads before it and overwrites its own files, so the chain
    never holds an entry twice."""

    def append(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(_HEADS).parquet(f"{table}/heads/epoch={epoch - 1}") if epoch else spark.createDataFrame([], _HEADS)
        chain(batch, heads=before).write.mode("overwrite").parquet(f"{table}/entries/epoch={epoch}")
        made = heads(spark.read.parquet(f"{table}/entries/epoch={epoch}")).select("log", "entry_hash", "n")
        kept = before.join(made.select("log"), "log", "left_anti").select("log", "entry_hash", "n")
        kept.unionByName(made).write.mode("overwrite").parquet(f"{table}/heads/epoch={epoch}")

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_is_valid(spark: SparkSession, table: str) -> bool:
    """No entry of any log was changed, moved or deleted, the last ones included."""
    epoch = spark.read.parquet(f"{table}/heads").agg(F.max("epoch")).first()[0]
    last = spark.read.schema(_HEADS).parquet(f"{table}/heads/epoch={epoch}")
    return verify(spark.read.parquet(f"{table}/entries"), order="n", last=last).agg(F.bool_and("valid")).first()[0]


JOB = "document_id string, job_id string, ts timestamp, status string, accepte boolean"


def job_stream(events: DataFrame, late: str = "1 hour", minutes: int = 60) -> DataFrame:
    """Verdicts on a stream of job events (document_id, job_id, ts, status): one job
    a document at a time.  What is known of a document is forgotten once its job has been
    over, or has not been heard of, for `minutes` of event time."""

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        running = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(["ts", "job_id"])
        told = []
        for job, status in zip(rows["job_id"], rows["status"]):
            told.append(running == job or status == "processing" and not running)
            if told[-1]:
                running = job if status == "processing" else ""
        state.update((running,))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + minutes * 60_000)
        yield rows.assign(accepte=told)[["document_id", "job_id", "ts", "status", "accepte"]]

    keyed = events.withWatermark("ts", late).groupBy("document_id")
    return keyed.applyInPandasWithState(judge, JOB, "running string", "append", "EventTimeTimeout")
