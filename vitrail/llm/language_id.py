"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

N-grams (1 to 3 letters, case-folded) are hashed into a fixed number of features.
Document frequencies come from every training row; the weights from a bounded
sample of them, by follow-the-regularised-leader (FTRL-proximal), whose L1 and L2
penalties keep the model sparse; a softmax temperature, fitted on sample rows
that the weights did not see, calibrates the scores.
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

BITS = 15
SIZES = range(1, 4)
UNDETERMINED = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights + self.bias


def term_counts(text: str | None) -> np.ndarray | None:
    cp = letters_of(text)
    return np.bincount(grams(cp, SIZES, BITS), minlength=1 << BITS) if len(cp) else None


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit-length TF-IDF values of a text's features."""
    ids = np.flatnonzero(counts)
    v = (1 + np.log(counts[ids])) * idf[ids]
    return ids, (v / max(np.sqrt((v * v).sum()), 1e-12)).astype(np.float32)


class Ftrl:
    """FTRL-proximal for a softmax; weights are read lazily from z and n."""

    def __init__(self, features: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros((features, classes))
        self.n = np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids=slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, ids: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        p = softmax((x @ w)[None])[0]
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[ids]
        grown = n + g * g
        self.z[ids] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = grown


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    a, b, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train_language_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = 4000,
    epochs: int = 3,
    l1: float = 2e-3,
    l2: float = 1e-3,
) -> LanguageModel | None:
    """Learns from rows with a language that are not held out (crc32 of the id
    mod 5 is not 0).  At most about `sample_rows` of them, chosen by a hash of the id and
    shared out evenly over the languages, fit the weights; document frequencies
    are of all.  None if there is nothing to learn from."""
    train = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return None

    features = 1 << BITS

    def frequencies(batch: pa.RecordBatch, v: np.ndarray) -> None:
        for t in batch.column(0).to_pylist():
            c = term_counts(t)
            if c is not None:
                v[:features] += c > 0
                v[features] += 1

    total = summed(train.select("text"), features + 1, frequencies)
    idf = np.log((1 + total[features]) / (1 + total[:features])) + 1

    quota = max(sample_rows // len(languages), 1)
    share = F.lit(0.0)
    for x in languages:
        share = F.when(F.col("lang") == x, F.lit(min(1.0, quota / sizes[x]))).otherwise(share)
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # an id counts once, however often it comes: the bound is one of rows
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("r")).select("doc_id", "r.text", "r.lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, t, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                c = term_counts(t)
                if c is not None:
                    ids, v = weighted(c, idf)
                    rows.append((d, languages.index(x), ids.astype(np.uint16).tobytes(), v.tobytes()))
            if rows:
                d, x, i, v = zip(*rows)
                yield pa.record_batch([pa.array(d), pa.array(x, pa.int32()), pa.array(i), pa.array(v)], names=["d", "x", "i", "v"])

    rows = sample.mapInArrow(vectors, "d long, x int, i binary, v binary").collect()
    rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0]))
    data = [
        (np.frombuffer(bytes(i), np.uint16).astype(np.int64), np.frombuffer(bytes(v), np.float32), x) for _, x, i, v in rows
    ]
    cut = len(data) // 5
    model = Ftrl(features + 1, len(languages), alpha=1.0, beta=1.0, l1=l1, l2=l2)
    one = np.float32(1)
    for _ in range(epochs):
        for ids, v, x in data[cut:]:
            model.update(np.append(ids, features), np.append(v, one), x)
    w = model.weights()
    out = LanguageModel(languages, idf, w[:features].astype(np.float32), w[features].astype(np.float32), 1.0)
    if cut:
        logits = np.stack([v @ out.weights[ids] + out.bias for ids, v, _ in data[:cut]])
        out.temperature = fit_temperature(logits, np.array([x for _, _, x in data[:cut]]))
    return out


def identify_language(
    docs: DataFrame, model: LanguageModel | None, text_col: str = "text", prefix: str = "", block: int = 64
) -> DataFrame:
    """`docs` with lang_pred and score (names after `prefix`), from the text alone.

    A null text or one without letters is `und` with score 0, and so is every
    text if there is no model.  Long texts are read whole, in constant memory
    beside the text."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features x languages: bounded
    names = [*docs.columns, f"{prefix}lang_pred", f"{prefix}score"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        x = np.zeros((block, 1 << BITS), np.float32)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for s in range(0, len(texts) if m else 0, block):
                used = []
                for k, t in enumerate(texts[s : s + block]):
                    x[k] = 0
                    c = term_counts(t)
                    if c is not None:
                        ids, v = weighted(c, m.idf)
                        x[k, ids] = v
                        used.append(k)
                p = softmax(m.logits(x[: len(texts[s : s + block])]) / m.temperature)
                for k in used:
                    best = int(p[k].argmax())
                    pred[s + k], score[s + k] = m.languages[best], float(min(max(p[k, best], 0.0), 1.0))
            yield pa.record_batch([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[-2], T.StringType()), T.StructField(names[-1], T.DoubleType())])
    return docs.mapInArrow(task, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    Trains on `docs` and predicts each of its rows; repeated rows each get
    theirs.  An empty table gives an empty result; other columns are not read."""
    model = train_language_model(docs, id_col, text_col, lang_col, **options)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify_language(base, model).drop("text")
