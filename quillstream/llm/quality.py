"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in cycles over the features, each see one feature's bins
(then one pair's grid) and are added to that feature's lookup table, so a fitted
model is a list of tables and scoring is a sum of looked-up numbers per row.

Fitted on at most `limit` labelled rows of the training fold (FIT_ROWS); every
document is scored over its whole text. Null text scores as empty text; equal texts
score alike, and rows that repeat an id are rows of their own. An empty table gives
no rows. Without labels of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import NAMES, features
from .folds import fold, sample_ids
from .textkit import chunks, crc32_mod, text_buffer
from .tables import keep_rows, table, texts

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
BINS, GRID, ROUNDS, PAIRS, PAIR_ROUNDS, RATE = 32, 8, 60, 6, 30, 0.15


@dataclass
class PairwiseGam:
    """Additive tables over binned features and over pairs of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseGam:
        n, p = len(y), int(y.sum())
        prior = (p + 1) / (n + 2)
        self.base = float(np.log(prior / (1 - prior)))
        if p == 0 or p == n:
            return self
        cuts = lambda col, k: np.unique(np.quantile(col, np.linspace(0, 1, k + 1)[1:-1]))
        self.edges = [cuts(c, BINS) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        score = np.full(n, self.base)
        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                step = RATE * _tree(b, len(self.tables[j]), y, score)
                self.tables[j] += step
                score += step[b]
        self.coarse = [cuts(c, GRID) for c in x.T]
        small = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        dims = [len(e) + 1 for e in self.coarse]
        gains = []
        for i in range(len(dims)):
            for j in range(i + 1, len(dims)):
                gains.append((_grid_tree(small[i], small[j], dims[i], dims[j], y, score)[1], i, j))
        for gain, i, j in sorted(gains, reverse=True)[:PAIRS]:
            if gain > 0:
                self.pairs.append((i, j))
                self.grids.append(np.zeros((dims[i], dims[j])))
        for _ in range(PAIR_ROUNDS):
            for k, (i, j) in enumerate(self.pairs):
                step = RATE * _grid_tree(small[i], small[j], dims[i], dims[j], y, score)[0]
                self.grids[k] += step
                score += step[small[i], small[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            small = {j: np.searchsorted(self.coarse[j], x[:, j], "right") for pair in self.pairs for j in pair}
            for (i, j), g in zip(self.pairs, self.grids, strict=True):
                total += g[small[i], small[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))


def _sums(cell: np.ndarray, n: int, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prob = 1.0 / (1.0 + np.exp(-score))
    return np.bincount(cell, y - prob, n), np.bincount(cell, prob * (1 - prob), n) + 1e-3


def _tree(cell: np.ndarray, n: int, y: np.ndarray, score: np.ndarray) -> np.ndarray:
    """A tree of up to four leaves over ordered bins: Newton steps per bin."""
    g, h = _sums(cell, n, y, score)
    out = np.zeros(n)

    def split(a: int, b: int) -> int:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        if b - a < 2:
            return 0
        left = cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1)
        return a + 1 + int(np.argmax(left))

    spans = [(0, n)]
    for _ in range(2):
        nxt = []
        for a, b in spans:
            m = split(a, b)
            nxt += [(a, m), (m, b)] if m else [(a, b)]
        spans = nxt
    for a, b in spans:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _grid_tree(ci: np.ndarray, cj: np.ndarray, ni: int, nj: int, y: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree that cuts both axes of a pair's grid once; its steps and gain over no cut."""
    g, h = (s.reshape(ni, nj) for s in _sums(ci * nj + cj, ni * nj, y, score))
    if ni < 2 or nj < 2:
        return np.zeros((ni, nj)), 0.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    quads = [(a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b)]
    quads.append((tg - sum(q[0] for q in quads), th - sum(q[1] for q in quads)))
    gain = sum(q[0] ** 2 / (q[1] + 1) for q in quads) - tg**2 / (th + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros((ni, nj))
    for (qg, qh), rows, cols in zip(quads, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        out[rows, cols] = qg[i, j] / (qh[i, j] + 1)
    return out, float(gain[i, j])


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(text, label) of at most `limit` labelled documents outside fold 0."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = sample_ids(known, limit, seed=9)
    # at most `limit` rows of 12 bytes: a proven bound for the broadcast
    return docs.join(F.broadcast(picked), "doc_id")


def _feature_rows(batches):
    for batch in chunks(batches):
        x = features(*text_buffer(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float32()))], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", limit: int = FIT_ROWS) -> PairwiseGam:
    rows = training_rows(docs, labels, target, limit).select("text", "label").mapInArrow(_feature_rows, "label int, x array<float>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").to_pylist(), np.float32).reshape(len(y), len(NAMES))
    order = np.lexsort((*x.T, y))
    return PairwiseGam().fit(x[order], y[order])


def score_quality(docs: DataFrame, model: PairwiseGam, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def run(batches):
        for batch in chunks(batches):
            s = model.score(features(*text_buffer(batch.column("text"))))
            held = crc32_mod(batch.column("doc_id").to_pylist(), 5) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(held), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: PairwiseGam, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold."""
    return keep_rows(docs, lambda texts: model.score(features(*text_buffer(texts))) >= threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(table(spark, sf_dir, "documents"))
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
