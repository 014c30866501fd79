"""Quality filtering by weak supervision.

Rules over exact text statistics vote good, vote bad or abstain.  Expectation
maximisation over the votes, without any label, estimates each rule's vote
distribution in good and in bad texts and the share of good texts; a text stays
if its posterior probability of being good is at least one half.  EM needs
only the count of each vote pattern (3**rules at most), summed over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrail.llm import arrays as A
from vitrail.llm.scratch import written
from vitrail.llm.textscan import Scan

TILE = 1 << 19
SYMBOLS = b"#*$%&|<>"

_DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long"
)


def statistics(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The columns after doc_id, for each text."""
    s = Scan(data, off, fold=False)
    text = s.text
    words, woff = s.words()
    n_words = np.diff(woff)
    chars = s.sums(~s.space & ((text & 0xC0) != 0x80))
    symbols = s.sums(np.isin(text, np.frombuffer(SYMBOLS, np.uint8)))
    upper = s.sums((text >= 65) & (text <= 90))

    line, doc, filled = s.lines()
    n_lines = np.bincount(doc[filled], minlength=s.n)
    key = A.mix(line[filled], doc[filled].astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    dup_lines = n_lines - np.bincount(doc[filled][first], minlength=s.n)

    # words in a three-word window that occurs twice or more in the text
    repeat = np.zeros(s.n, np.int64)
    if len(words) >= 3:
        owner = np.repeat(np.arange(s.n), n_words)
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        w = A.mix(A.mix(A.mix(words[inside], words[inside + 1]), words[inside + 2]), owner[inside].astype(np.uint64))
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        twice = inside[order[np.r_[False, same] | np.r_[same, False]]] if len(w) else inside
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[twice + i] = True
        repeat = np.bincount(owner[covered], minlength=s.n)
    return [n_words, chars, symbols, dup_lines, repeat, n_lines, upper]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts per row; words are runs of bytes other than ASCII white space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = A.utf8(batch.column(1))
            for i, j in A.groups_of(off, TILE):
                out = statistics(data[off[i] : off[j]], off[i : j + 1] - off[i])
                names = [c.split()[0] for c in _DDL.split(", ")]
                yield pa.record_batch(
                    [batch.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in out)], names=names
                )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(task, _DDL)


def votes() -> list[Column]:
    """Each rule as a column: 0 bad, 1 abstains, 2 good."""
    words, c = F.greatest(F.col("n_words"), F.lit(1)), F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, 0).when(good, 2).otherwise(1)

    per_word = c("n_symbols") / words
    dup = c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    repeat = c("n_repeat_words") / words
    mean = c("word_chars") / words
    upper = c("n_upper") / F.greatest(c("word_chars"), F.lit(1))
    return [
        vote(c("n_words") < 50, c("n_words") >= 80),
        vote(per_word > 0.4, per_word < 0.1),
        vote(dup > 0.3, dup <= 0.1),
        vote(repeat > 0.4, repeat <= 0.15),
        vote((mean < 2.5) | (mean > 15), (mean >= 3.5) & (mean <= 11)),
        vote(upper > 0.4, upper < 0.15),
    ]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of good for each vote pattern, by EM from the majority vote.

    Laplace smoothing keeps it defined for tables of any size; no votes at
    all give the prior."""
    m = patterns.shape[1]
    p = np.clip(0.5 + (patterns - 1).sum(1) / (2 * m), 0.05, 0.95)
    for _ in range(rounds):
        w = np.stack([counts * (1 - p), counts * p])  # class x pattern
        prior = (w.sum(1) + 1) / (counts.sum() + 2)
        log = np.log(prior)[:, None].repeat(len(p), 1)
        for r in range(m):
            given = np.stack([w[:, patterns[:, r] == v].sum(1) for v in range(3)], 1) + 1
            log += np.log(given / given.sum(1, keepdims=True))[:, patterns[:, r]]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, p_good.

    base_failed: under 50 words, or over half of the words repeat.  kept is
    false for those, else the posterior is held against the threshold.  Null text
    has no words, so it fails; repeated rows count as often as they come; an
    empty table gives an empty result.  Other columns are not read.
    """
    rules = votes()
    code = sum((v * F.lit(3**i) for i, v in enumerate(rules)), F.lit(0)).cast("int")
    stats = written(text_statistics(docs, id_col, text_col).withColumn("code", code), "quality-statistics")
    seen = sorted((r[0], r[1]) for r in stats.groupBy("code").count().collect())  # at most 3**rules rows
    codes = np.array([c for c, _ in seen], np.int64)
    patterns = (codes[:, None] // 3 ** np.arange(len(rules))) % 3
    p = fit_votes(patterns, np.array([n for _, n in seen], float)) if seen else np.zeros(0)
    table = docs.sparkSession.createDataFrame(list(zip(codes.tolist(), p.tolist())), "code int, p_good double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        stats.join(F.broadcast(table), "code")
        .withColumn("base_failed", failed)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"), "p_good",
        )
    )
