"""Toxicity scores: a character n-gram linear classifier on naive Bayes features.

A text's features are the hashed n-grams (3 to 5 characters, case-folded) it
has at all.  Each is scaled by its log-count ratio: how much more
often toxic than clean training texts have it.  A logistic regression with an L2
penalty weighs the scaled features.  A fifth of the sample is kept from the
weights and places the intercept, such that a score of one half cuts best (by F1,
with the share of toxic rows among all labelled rows).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrail.llm.chargrams import grams, held_out, letters_of, summed
from vitrail.llm.scratch import written

BITS = 18
SIZES = range(3, 6)


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight times log-count ratio, by feature
    bias: float

    def score(self, text: str | None) -> float:
        ids = grams(letters_of(text), SIZES, BITS)
        ids = np.unique(ids[self.table[ids] != 0]) if len(ids) else ids
        return float(1 / (1 + np.exp(-np.clip(self.table[ids].sum(dtype=np.float64) + self.bias, -60, 60))))


def features(text: str | None) -> np.ndarray:
    return np.unique(grams(letters_of(text), SIZES, BITS))


def fit_logistic(ids: np.ndarray, starts: np.ndarray, r: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of scaled features by full-batch Adam; ids index r, rows start at `starts`."""
    rows = np.repeat(np.arange(len(y)), np.diff(starts))
    x = r[ids]
    w, b = np.ones(len(r)), 0.0
    m1, m2, b1, b2 = np.zeros(len(r)), np.zeros(len(r)), 0.0, 0.0
    scale = 1 / max(float(np.sqrt(np.bincount(rows, x * x, len(y)).mean())), 1e-9)
    x = x * scale
    for t in range(1, steps + 1):
        z = np.bincount(rows, x * w[ids], len(y)) + b
        e = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.bincount(ids, x * e[rows], len(r)) / len(y) + l2 * w
        gb = e.mean()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
        rate = 0.3 / (1 + t / 40)
        w = w - rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        b = b - rate * (b1 / (1 - 0.9**t)) / (np.sqrt(b2 / (1 - 0.99**t)) + 1e-8)
    return w * scale, b


def best_cut(z: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The cut of largest F1, in the middle of the gap it lies in."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    tp = np.cumsum(y) / y.sum() * prior
    fp = np.cumsum(1 - y) / (1 - y).sum() * (1 - prior)
    f1 = 2 * tp / (tp + fp + prior)
    f1[:-1][z[1:] == z[:-1]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)


def fit_with_cut(per: list[np.ndarray], y: np.ndarray, r: np.ndarray, prior: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    def fit(rows):
        part = [per[i] for i in rows]
        return fit_logistic(np.concatenate(part), np.r_[0, np.cumsum([len(x) for x in part])], r, y[rows], l2, steps)

    n = np.arange(len(y))
    fitted, probe = n[n % 5 != 0], n[n % 5 == 0]
    w, b = fit(fitted) if 0 < y[fitted].mean() < 1 else fit(n)
    if len(probe) and 0 < y[probe].mean() < 1:
        b = -best_cut(np.array([(w * r)[per[i]].sum() for i in probe]), y[probe], prior)
    return w, b


def train_toxicity_model(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = 6000,
    kept_features: int = 1 << 14,
    l2: float = 1e-4,
    steps: int = 150,
) -> ToxicityModel | None:
    """Learns from labelled rows that are not held out: at most about
    `sample_rows` of them, chosen by a hash of the id, half of either label where
    there are enough.  `kept_features` bounds the features with the largest
    ratios that get a weight.  None without rows of both labels."""
    lab = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("_y")
    )
    lab = written(lab, "toxicity-labels")
    sizes = {r[0]: r[1] for r in lab.groupBy("_y").count().collect()}
    if len(sizes) < 2:
        return None
    pos = min(sizes[1], max(sample_rows // 2, sample_rows - sizes[0]))
    quota = {1: pos, 0: min(sizes[0], sample_rows - pos)}
    share = F.when(F.col("_y") == 1, F.lit(quota[1] / sizes[1])).otherwise(F.lit(quota[0] / sizes[0]))
    chosen = lab.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_003)) < share * 1_000_003)
    # at most about sample_rows ids: a broadcast with a proven bound
    sample = written(
        docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id"))
        .select(F.col(id_col).cast("long").alias("id"), F.col("_y").alias("y"), F.col(text_col).alias("text"))
        .where("text is not null")
        .groupBy("id")  # an id counts once, however often it comes
        .agg(F.max("y").alias("y"), F.min("text").alias("text")),
        "toxicity-sample",
    ).coalesce(8)  # a bounded sample, however many files it came from
    size = 1 << BITS

    def count(batch: pa.RecordBatch, v: np.ndarray) -> None:
        for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            v[y * size + features(t)] += 1

    total = summed(sample.select("y", "text"), 2 * size, count).reshape(2, size)
    p, q = total[1] + 1.0, total[0] + 1.0
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    strength = np.abs(r) * np.sqrt(total.sum(0)) * (total.sum(0) >= 3)
    kept = np.sort(np.argsort(-strength, kind="stable")[:kept_features])
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(2).to_pylist():
                f = place[features(t)]
                out.append(f[f >= 0].astype(np.int32).tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "y", "f"])

    rows = sample.mapInArrow(reduced, "id long, y int, f binary").collect()
    rows.sort(key=lambda x: (x[0], x[1]))
    per = [np.frombuffer(bytes(x[2]), np.int32) for x in rows]
    y = np.array([x[1] for x in rows], float)
    if not len(y) or y.min() == y.max():
        return None
    prior = sizes[1] / (sizes[0] + sizes[1])
    w, b = fit_with_cut(per, y, r[kept], prior, l2, steps)
    table = np.zeros(size, np.float32)
    table[kept] = w * r[kept]
    return ToxicityModel(table, float(b))


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text") -> DataFrame:
    """`docs` with score and predicted, from the text alone.  A null or empty
    text gets the score of no features, every text 0 if there is no model."""
    at, names = docs.columns.index(text_col), [*docs.columns, "score", "predicted"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = [m.score(t) if m else 0.0 for t in batch.column(at).to_pylist()]
            flag = pa.array([int(x >= 0.5) for x in s], pa.int32())
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64()), flag], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(task, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 if score >= 0.5).

    Labels of one id count once (toxic if any row says so); null labels and
    labels of unknown documents are left out.  Other columns are not read."""
    model = train_toxicity_model(docs, labels, id_col, text_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return score_toxicity(base, model).drop("text")
