"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the words present in a text is trained on confirmed
toxic examples and on unlabelled text. The risk of the negative class is the
unlabelled risk less the class prior times the positive risk, held at or above
zero: where a step would make it negative, the step climbs back instead.

Labels of the training fold only give the positives and the class prior. The
penalty is picked by the same risk on a part of the sample that the candidates
are not fitted on; rows outside the training fold have no say in it. Bounds of
the fit: POSITIVES and UNLABELLED rows, of whose words the driver gets only those
that tell the two apart.

Every document is scored over its whole text; a null or empty text has no words
and scores the intercept. Equal texts score alike, and rows that repeat an id are
rows of their own. An empty table gives no rows; without positives or without
unlabelled rows every text scores the class prior.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch

from .folds import fold, sample_ids
from .textkit import chunks, crc32_mod, mix, range_hashes, text_buffer, words

POSITIVES, UNLABELLED = 4_000, 12_000
DIM_BITS, EPOCHS, BATCH, RATE = 22, 30, 512, 0.05
#: Penalties to pick from, one of PARTS parts of the sample that judges them, and its least number of positives and other rows (else the first penalty is taken).
L1S, PARTS, MIN_JUDGES = (2e-4, 5e-5, 1e-3, 4e-3), 5, 20
#: A feature is learnt if it is in this many positives and its rate there differs from the unlabelled rate by so many standard errors.
MIN_POSITIVES, MIN_Z = 3, 4.0
PREFIXES = (4, 5)
_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_LETTERS[128:] = True


def word_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words (runs of letters, A-Z folded) and word beginnings of each text, and offsets."""
    starts, ends, at = words(buf, offsets, _LETTERS)
    cut = np.uint64(64 - DIM_BITS)
    ids = [(range_hashes(buf, starts, ends) >> cut).astype(np.int32)]
    for n in PREFIXES:
        ids.append((mix(range_hashes(buf, starts, np.minimum(ends, starts + n)) ^ np.uint64(n)) >> cut).astype(np.int32))
    ids = np.stack(ids, axis=1).reshape(-1)
    at = at * (1 + len(PREFIXES))
    parts = [np.unique(ids[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    out_at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else ids[:0]), out_at


def _judges(text: pa.Array) -> np.ndarray:
    """Whether each text belongs to the part of the sample that judges penalties; equal texts fall alike."""
    return np.array([zlib.crc32((t or "").encode()) % PARTS == 0 for t in text.to_pylist()], bool)


def _counts(batches):
    """(feature, rows that have it: all positives, all unlabelled, those of each that are no judges); feature -1 is had by all."""
    for batch in chunks(batches):
        ids, at = word_features(*text_buffer(batch.column("text")))
        positive, judge = batch.column("positive").to_numpy(zero_copy_only=False), _judges(batch.column("text"))
        rows = np.stack([positive, ~positive, positive & ~judge, ~positive & ~judge], axis=1).astype(np.int64)
        feature, place = np.unique(np.concatenate([ids, np.full(len(rows), -1, ids.dtype)]), return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(rows)), np.diff(at)), np.arange(len(rows))])
        sums = [pa.array(np.bincount(place, rows[row, k], len(feature)).astype(np.int64)) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), *sums], names=["feature", *"abcd"])


def _telling(pos: Column, unl: Column, n_pos: int, n_unl: int) -> Column:
    """What NonNegativePU.fit learns of these counts, and a little more."""
    if not n_pos or not n_unl:
        return F.lit(False)
    rate = (unl + 1) / (n_unl + 2)
    z = (pos / n_pos - rate) / F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl))
    return ((pos >= MIN_POSITIVES) & (z >= MIN_Z - 1e-3)) | (z <= 1e-3 - MIN_Z)


class NonNegativePU:
    """Linear model; fit(positive rows, unlabelled rows, class prior)."""

    def __init__(self):
        self.weight = np.zeros(1 << DIM_BITS, np.float32)
        self.bias = 0.0

    def fit(self, pos: list[np.ndarray], unl: list[np.ndarray], prior: float, l1: float = L1S[0]) -> NonNegativePU:
        prior = float(np.clip(prior, 1e-4, 0.9))
        self.bias = float(np.log(prior / (1 - prior)))
        if not pos or not unl:
            return self
        in_pos, in_unl = (np.bincount(np.concatenate(rows), minlength=1 << DIM_BITS) for rows in (pos, unl))
        rate = (in_unl + 1) / (len(unl) + 2)
        z = (in_pos / len(pos) - rate) / np.sqrt(rate * (1 - rate) * (1 / len(pos) + 1 / len(unl)))
        known = np.flatnonzero(((in_pos >= MIN_POSITIVES) & (z >= MIN_Z)) | (z <= -MIN_Z))
        place = np.full(1 << DIM_BITS, -1, np.int32)
        place[known] = np.arange(len(known))
        short = lambda rows: [p[p >= 0] for p in (place[r] for r in rows)]
        pos, unl = short(pos), short(unl)
        w, m, v = np.zeros(len(known)), np.zeros(len(known)), np.zeros(len(known))
        b, mb, vb, t = self.bias, 0.0, 0.0, 0
        rng = np.random.default_rng(4)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        for _ in range(EPOCHS):
            order_u, order_p = rng.permutation(len(unl)), rng.permutation(len(pos))
            steps = max(1, len(unl) // BATCH)
            for s in range(steps):
                iu = order_u[s::steps]
                ip = order_p[(np.arange(BATCH) + s * BATCH) % len(pos)] if len(pos) > BATCH else order_p
                xu, au = _stack([unl[i] for i in iu])
                xp, ap = _stack([pos[i] for i in ip])
                zu, zp = _dot(w, xu, au) + b, _dot(w, xp, ap) + b
                # logistic loss: l(z, +1) = log(1+exp(-z)), l(z, -1) = log(1+exp(z))
                neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                gu_neg, gp_neg, gp_pos = sigmoid(zu) / len(zu), sigmoid(zp) / len(zp), -sigmoid(-zp) / len(zp)
                if neg >= 0:
                    cu, cp = gu_neg, prior * (gp_pos - gp_neg)
                else:
                    cu, cp = -gu_neg, prior * gp_neg
                g = np.bincount(xu, np.repeat(cu, np.diff(au)), len(w)) + np.bincount(xp, np.repeat(cp, np.diff(ap)), len(w))
                gb = cu.sum() + cp.sum()
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                fix1, fix2 = 1 - 0.9**t, 1 - 0.99**t
                scale = np.sqrt(v / fix2) + 1e-4
                w -= RATE * (m / fix1) / scale
                w = np.sign(w) * np.maximum(0, np.abs(w) - RATE * l1 / scale * prior)
                b -= RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-4)
        self.weight[known] = w
        self.bias = float(b)
        return self

    def risk(self, pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> float:
        """The non-negative risk of rows, by the loss that is trained on."""
        zp, zu = (_dot(self.weight, *_stack(rows)) + self.bias for rows in (pos, unl))
        return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_dot(self.weight, ids, at) + self.bias, -30, 30)))


def _stack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.concatenate(rows), at


def _dot(w: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(w[ids], dtype=np.float64)])
    return sums[at[1:]] - sums[at[:-1]]


def pick_penalty(pos: list[np.ndarray], unl: list[np.ndarray], pos_judges: list[np.ndarray], unl_judges: list[np.ndarray], prior: float) -> float:
    """The penalty whose model, fitted on the first two, has the least risk on the judges."""
    if min(len(pos), len(unl), len(pos_judges), len(unl_judges)) < MIN_JUDGES:
        return L1S[0]
    return min(L1S, key=lambda l1: NonNegativePU().fit(pos, unl, prior, l1).risk(pos_judges, unl_judges, prior))


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic") -> NonNegativePU:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = known.agg(F.avg("label")).first()[0] or 0.0
    pos = sample_ids(known.filter("label = 1").select("doc_id"), POSITIVES, seed=4).withColumn("positive", F.lit(True))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).distinct()
    unl = sample_ids(ids, UNLABELLED, seed=14).withColumn("positive", F.lit(False))
    # at most POSITIVES + UNLABELLED rows of 9 bytes: a proven bound for the broadcast
    sample = docs.join(F.broadcast(pos.unionByName(unl)), "doc_id").select("text", "positive")
    counts = sample.mapInArrow(_counts, "feature int, a long, b long, c long, d long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in "abcd"])
    counts = Scratch(docs.sparkSession, "toxicity").save("counts", counts)
    total = counts.filter("feature = -1").first()
    if total is None:
        return NonNegativePU().fit([], [], float(share))
    telling = _telling(F.col("a"), F.col("b"), total["a"], total["b"]) | _telling(F.col("c"), F.col("d"), total["c"], total["d"])
    kept = np.sort(counts.filter((F.col("feature") >= 0) & telling).select("feature").toArrow().column(0).to_numpy())

    def short(batches):
        for batch in chunks(batches):
            ids, at = word_features(*text_buffer(batch.column("text")))
            stay = np.isin(ids, kept)
            at = np.concatenate([[0], np.cumsum(stay)])[at]
            x = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids[stay], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(_judges(batch.column("text"))), x], names=["positive", "judge", "x"])

    rows = sample.mapInArrow(short, "positive boolean, judge boolean, x array<int>").toArrow()
    flag, judge = (rows.column(c).to_numpy() for c in ("positive", "judge"))
    x = rows.column("x").combine_chunks()
    at, ids_ = x.offsets.to_numpy(), x.values.to_numpy()
    every = [ids_[at[i] : at[i + 1]] for i in range(len(flag))]
    order = sorted(range(len(flag)), key=lambda i: (len(every[i]), every[i].tobytes(), judge[i]))
    part = lambda positive, *judges: [every[i] for i in order if flag[i] == positive and judge[i] in judges]
    prior = float(np.clip(share, 1e-4, 0.9))
    l1 = pick_penalty(part(True, False), part(False, False), part(True, True), part(False, True), prior)
    return NonNegativePU().fit(part(True, False, True), part(False, False, True), prior, l1)


def score_toxicity(docs: DataFrame, model: NonNegativePU) -> DataFrame:
    used = np.flatnonzero(model.weight)
    held = (used, model.weight[used], model.bias)

    def run(batches):
        own = NonNegativePU()
        own.weight[held[0]], own.bias = held[1], held[2]
        for batch in chunks(batches):
            s = own.score(*word_features(*text_buffer(batch.column("text"))))
            out = crc32_mod(batch.column("doc_id").to_pylist(), 5) == 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    docs = texts(table(spark, sf_dir, "documents"))
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
