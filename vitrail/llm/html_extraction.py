"""Main text of web pages: a linear-chain CRF over DOM leaf blocks.

A block's features are its tag, its ancestors' tags and name words, and the
shape of its text; two labels, article or not, with transition weights between
neighbours.  Weights maximise the likelihood of labelled pages (forward-backward
gradients, AdaGrad, L2); pages are decoded by Viterbi.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrail.llm.dom import Block, Node, blocks
from vitrail.llm.html_training import labelled_page

_END = re.compile(r"[.!?;:…\"”»)]$")


def path_features(node: Node | None) -> list[str]:
    """Of a block's innermost element and its ancestors (shared by all blocks at the same place)."""
    out = ["bias"] + (["tag=" + node.lead] if node else [])
    while node:
        out += node.fresh
        node = node.parent
    return sorted(out)


def path_score(node: Node | None, weights: dict[str, float]) -> float:
    """Summed weights of `path_features`; every element adds to its parent's sum once."""
    chain, at = [], node
    while at and at.score is None:
        chain.append(at)
        at = at.parent
    total = at.score if at else weights.get("bias", 0.0)
    for x in reversed(chain):
        total += sum(weights.get(f, 0.0) for f in x.fresh)
        x.score = total
    return total + (weights.get("tag=" + node.lead, 0.0) if node else 0.0)


def text_features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    size = 0 if words < 2 else 1 if words < 4 else 2 if words < 8 else 3 if words < 16 else 4 if words < 40 else 5
    share = 4 * b.linked // max(len(b.text), 1)
    out = [f"words={size}", f"linked={share}", "ends" if _END.search(b.text) else "open"]
    if "©" in b.text:
        out.append("copyright")
    if words > 3 and "," in b.text:
        out.append("comma")
    return out


@dataclass
class Crf:
    """weights: of label 1 against 0, by feature; trans[i][j]: i before j."""

    weights: dict[str, float] = field(default_factory=dict)
    trans: list[list[float]] = field(default_factory=lambda: [[0.0, 0.0], [0.0, 0.0]])
    start: float = 0.0

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the likeliest labels for the blocks' scores of label 1."""
        if not scores:
            return []
        t = self.trans
        a, b = 0.0, scores[0] + self.start
        back = []
        for s in scores[1:]:
            x0, y0, x1, y1 = a + t[0][0], b + t[1][0], a + t[0][1], b + t[1][1]
            back.append((y0 > x0, y1 > x1))
            a, b = max(x0, y0), max(x1, y1) + s
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]

    def marginals(self, scores: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block, and expected counts of the transitions."""
        n, t = len(scores), self.trans
        e = [[math.exp(x) for x in row] for row in t]
        fwd, norm = [], []
        for i, s in enumerate(scores):
            m = math.exp(min(max(s + (self.start if i == 0 else 0), -50), 50))
            a, b = (1.0, m) if i == 0 else (
                fwd[-1][0] * e[0][0] + fwd[-1][1] * e[1][0], (fwd[-1][0] * e[0][1] + fwd[-1][1] * e[1][1]) * m
            )
            z = a + b
            fwd.append((a / z, b / z))
            norm.append(z)
        back = [(1.0, 1.0)] * n
        counts = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n - 2, -1, -1):
            m = math.exp(min(max(scores[i + 1], -50), 50))
            nxt = (back[i + 1][0] / norm[i + 1], back[i + 1][1] * m / norm[i + 1])
            back[i] = (e[0][0] * nxt[0] + e[0][1] * nxt[1], e[1][0] * nxt[0] + e[1][1] * nxt[1])
            for x in (0, 1):
                for y in (0, 1):
                    counts[x][y] += fwd[i][x] * e[x][y] * nxt[y]
        return [f[1] * b[1] for f, b in zip(fwd, back)], counts


def train_crf(pages: Iterable[tuple[list[Block], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-4) -> Crf:
    """Fits a CRF to (blocks, labels) of whole pages."""
    data = [([path_features(b.node) + text_features(b) for b in bs], labels) for bs, labels in pages if bs]
    model, seen = Crf(), {}

    def step(key, value, g):
        seen[key] = seen.get(key, 0.0) + g * g
        return value + rate * g / math.sqrt(seen[key] + 1e-8)

    for _ in range(epochs):
        for feats, labels in data:
            w = model.weights
            p, counts = model.marginals([sum(w.get(f, 0.0) for f in fs) for fs in feats])
            grad: dict[str, float] = {}
            for fs, y, q in zip(feats, labels, p):
                if abs(y - q) > 1e-4:
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + y - q
            for f, g in grad.items():
                w[f] = step(f, w.get(f, 0.0), g - l2 * w.get(f, 0.0))
            model.start = step("<s>", model.start, labels[0] - p[0])
            for a, b in zip(labels, labels[1:]):
                counts[a][b] -= 1
            for a in (0, 1):
                for b in (0, 1):
                    model.trans[a][b] = step((a, b), model.trans[a][b], -counts[a][b] - l2 * model.trans[a][b])
    return model


def default_model(pages: int = 600, seed: int = 7) -> Crf:
    """Trained on `pages` made pages with known labels; the same every time."""
    made = (labelled_page(seed * 100_003 + i) for i in range(pages))
    return train_crf((blocks(html), labels) for html, labels in made)


def main_text(html: str | None, model: Crf) -> str:
    found, w = blocks(html), model.weights
    scores = [path_score(b.node, w) + sum(w.get(f, 0.0) for f in text_features(b)) for b in found]
    return " ".join(b.text for b, y in zip(found, model.decode(scores)) if y)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: Crf | None = None
) -> DataFrame:
    """Per row: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text, as does a page without an article; the whole
    html is read; repeated rows each get their text; ids may be null.  Other columns are not read."""
    crf = model or default_model()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, crf) for h in batch.column(2).to_pylist()]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"]
            )

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return base.mapInArrow(task, "page_id long, url string, text string, n_chars long")
