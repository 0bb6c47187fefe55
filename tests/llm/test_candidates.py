"""The candidate search of decontamination: windows at the edit limit are found, unrelated ones seldom looked at."""

import numpy as np
import pytest

from quillstream.llm.decontamination import RECALL, Items, candidates, edits_allowed, search

KINDS = ("change", "insert", "delete", "mix")


def edited(rng, item, k, kind, vocabulary):
    out = list(item)
    for _ in range(k):
        what = KINDS[int(rng.integers(3))] if kind == "mix" else kind
        at = int(rng.integers(len(out)))
        if what == "insert":
            out.insert(at, rng.choice(vocabulary))
        elif what == "delete":
            out.pop(at)
        else:
            out[at] = rng.choice(vocabulary)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("n", [5, 6, 11, 16, 30, 59, 200])
@pytest.mark.parametrize("kind", KINDS)
def test_recall_at_the_limit(n, kind):
    rng = np.random.default_rng(n)
    vocabulary = rng.integers(1, 2**62, 3000).astype(np.uint64)
    seqs = [rng.choice(vocabulary, n) for _ in range(150)]
    held, k, hit, looked, size = Items(list(range(len(seqs))), seqs), int(edits_allowed(np.array([n]))[0]), 0, 0, 0
    for i, s in enumerate(seqs):
        doc = np.concatenate([rng.choice(vocabulary, 25), edited(rng, s, k, kind, vocabulary), rng.choice(vocabulary, 25)])
        at = np.array([0, len(doc)])
        hit += any(m[1] == i for m in search(held, doc, at))
        rows = candidates(held, doc, at)
        looked, size = looked + int((rows[:, 2] != i).sum()), size + len(doc)
    assert hit >= RECALL * len(seqs)
    assert looked <= 0.01 * size * len(seqs)


def distance(item, text):
    """Least edit distance of an item to any passage of a text."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        cur = [i + 1]
        for j, y in enumerate(text):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_against_all_passages():
    rng = np.random.default_rng(8)
    vocabulary = rng.integers(1, 2**62, 60).astype(np.uint64)
    seqs = [rng.choice(vocabulary, n) for n in (1, 2, 3, 4, 5, 7, 9, 12, 20, 33) for _ in range(3)]
    held, wanted, found = Items(list(range(len(seqs))), seqs), set(), {}
    texts = [np.zeros(0, np.uint64)]
    for i in range(60):
        s = seqs[int(rng.integers(len(seqs)))]
        k = int(rng.integers(0, 2 + edits_allowed(np.array([len(s)]))[0]))
        texts.append(np.concatenate([rng.choice(vocabulary, int(rng.integers(0, 30))), edited(rng, s, min(k, len(s) - 1), "mix", vocabulary), rng.choice(vocabulary, int(rng.integers(0, 30)))]))
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    for t, text in enumerate(texts):
        for i, s in enumerate(seqs):
            d = distance(s.tolist(), text.tolist())
            if d <= held.k[i]:
                wanted.add((t, i))
                found[(t, i)] = d
    got = {(t, i): d for t, i, _, d in search(held, np.concatenate(texts), at)}
    assert set(got) <= wanted and len(got) >= RECALL * len(wanted)
    assert {x for x, d in found.items() if d == 0} <= set(got)
    assert all(d >= found[x] for x, d in got.items())


def test_no_items_and_no_words():
    none = np.zeros(0, np.uint64)
    assert search(Items([], []), np.arange(5).astype(np.uint64), np.array([0, 5])) == []
    assert search(Items([1], [np.arange(9).astype(np.uint64)]), none, np.zeros(3, np.int64)) == []
