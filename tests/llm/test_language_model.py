"""Scores of the language model against a plain version, with every n-gram that occurs twice."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import language_model as lm


def brute_scores(texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [[*(t or "").translate(fold).split(), None] for t in texts]
    train = [w for i, w in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    c1 = Counter((w,) for ws in train for w in ws)
    total, distinct = sum(c1.values()), len(c1)
    kept, left, spare, count = {}, {}, {}, dict(c1)
    for k in (2, 3):
        c = Counter(tuple(ws[i : i + k]) for ws in train for i in range(len(ws) - k + 1))
        n1, n2 = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        spare[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        kept[k] = {g for g, n in c.items() if n >= 2}
        count.update({g: c[g] for g in kept[k]})
        seen = defaultdict(float)
        for g in kept[k]:
            seen[g[:-1]] += (c[g] - spare[k]) / count[g[:-1]]
        left.update({h: max(1 - x, 1e-12) for h, x in seen.items()})

    def p(history, w):
        if not history:
            return (c1[(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
        lower, g = p(history[1:], w), (*history, w)
        return left.get(history, 1.0) * lower + ((count[g] - spare[len(g)]) / count[history] if g in kept[len(g)] else 0.0)

    return [sum(math.log10(p(tuple(ws[max(0, i - 2) : i]), w)) for i, w in enumerate(ws)) for ws in tokens]


def scores(spark, docs):
    return {r["doc_id"]: r["score"] for r in lm.score(spark, docs).collect()}


@pytest.mark.parametrize("bucket", [lm.BUCKET, 700])
def test_scores_hold_every_repeated_ngram(spark, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET", bucket)
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    texts = [None, "", "one", "É two THREE"]
    for _ in range(60):
        ws = [words[int(i)] for i in np.minimum(rng.zipf(1.4, int(rng.integers(1, 120))) - 1, 299)]
        texts += [" ".join(ws)] + ([" ".join(ws[5:] + ["once" + str(len(texts))])] if rng.random() < 0.3 else [])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = scores(spark, docs)
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts))


def test_scores_hold_more_words_than_were_ever_broadcast(spark):
    rng = np.random.default_rng(12)
    rows = [" ".join(f"w{i}" for i in part) for part in np.array_split(rng.permutation(40_000), 60)]
    texts = [t for t in rows for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = scores(spark, docs)
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts))


def piece_answers(texts, orders=lm.ORDER):
    """The automaton of texts that are all in training, in one bucket."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    piece, train, answers, discount = lm.Piece(batch), np.ones(len(texts), bool), {}, {}
    for k in range(1, orders + 1):
        n = piece.counts(k, train)
        if k == 1:
            answers[1] = (n,)
            continue
        own = piece.of[k]
        kept = n >= 2
        size = len(piece.hist[k])
        sums = [np.bincount(own, n, size), np.bincount(own[kept], n[kept], size), np.bincount(own[kept], minlength=size)]
        answers[k] = (np.where(kept, n, 0), *(x.astype(np.int64) for x in sums))
        discount[k] = 0.5
    return piece, lm.Automaton(piece, answers, discount, len(piece.hashes), len(piece.words))


def test_automaton_is_normalised():
    # every word follows every history of this text, so the piece holds all arcs of its states
    piece, model = piece_answers(["a b a a b b a a a b b b a b a b a a", "b a b"] * 3, 2)
    unknown = math.log10(0.5 / (len(piece.hashes) + 0.5 * (len(piece.words) + 1)))
    token = {(int(piece.ids[i - 1]), int(piece.ids[i])): i for i in range(1, len(piece.ids)) if piece.place[i]}
    word_of = {s: w for w, s in enumerate(model.target[: len(piece.words)].tolist()) if s}
    assert len(word_of) == 2 == len(model.fail) - 1
    for state, h in word_of.items():
        follow = [i for (a, _), i in token.items() if a == h]
        assert len(follow) == len(piece.words)
        got, _ = model.step(np.full(len(follow), state), np.array(follow))
        assert sum(10.0**got) + 10 ** (model.log_left[state] + unknown) == pytest.approx(1)


@pytest.mark.parametrize("lanes", [1, 3, 4096])
def test_walk_does_not_depend_on_segments(monkeypatch, lanes):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 300, 30)]
    piece, model = piece_answers(texts)
    monkeypatch.setattr(lm, "LANES", lanes)
    state, want = np.zeros(1, np.int64), []
    for i, place in enumerate(piece.place):
        got, state = model.step(state if place else np.zeros(1, np.int64), np.array([i]))
        want.append(got[0])
    assert model.walk() == pytest.approx(want)
    assert model.fail.max() > 0 and (model.target > 0).any()


def test_words_that_collide_under_a_plain_polynomial(spark):
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [f"x {word} y"] * 4 + [f"x {other} z"] * 4
    got = scores(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [got[i] for i in range(len(texts))] == pytest.approx(brute_scores(texts))
