"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items are sequences of words (runs of letters and digits, A-Z folded).
A document is searched for windows within word edit distance floor(MAX_EDITS * n)
of an item of n words.

1. CGK. Every item and the window of its size at every word of a text are embedded by
   WALKS random walks: a walk copies the current word and moves on if the word's random
   bit of that step says so. Few word edits leave most places of the embedding alike.
   Every other walk reads from the window's end to its start, so edits that crowd
   at one end do not spoil all walks. A walk from a word is the same for windows of
   all sizes, so it is taken once, for all items.
2. LSH. TABLES names the places that are sampled of each embedding, two for a table.
   A window and an item that agree in all places of a table are a candidate. Tables
   that would sample one word of an item twice, or a place beyond its end, leave that
   item out. Only places early in the walk are sampled, so that the walks are short; the
   tables were repeated until items at the edit limit are found with probability RECALL
   or more (the tests measure it for substitutions, insertions, deletions and mixes).
3. A candidate of which fewer than n less the limit words occur in the item cannot be
   one and goes. Of the rest the word edit distance is computed exactly, as the least
   over the passages of the text that begin and end within k words of the window.

Null or empty texts and items match nothing; items of fewer than 5 words must occur
exactly and are found by the hash of all their words. Repeated rows each count; of
several windows for one (document, item) the nearest, then the first, is returned. Items
of any length are handled in blocks of ITEM_BLOCK and ITEM_BYTES, so what is broadcast
is bounded. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import keep_rows, table, texts
from .textkit import _COMBINE, chunks, mix, range_hashes, text_buffer, words

MAX_EDITS, WALKS, TABLES, RECALL = 0.2, 4, ((0, 4), (1, 7), (2, 6), (3, 9), (4, 8)), 0.95
#: Steps of a walk that are taken, and words walked from at a time.
STEPS, BLOCK = max(max(t) for t in TABLES), 1 << 15
#: Items, and bytes of their texts, in one broadcast block, about.
ITEM_BLOCK, ITEM_BYTES = 20_000, 16 << 20
#: Numbers held at a time while windows are embedded or compared.
CELLS = 1 << 22
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
U64 = np.uint64


def word_sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = words(buf, offsets, _WORD)
    return range_hashes(buf, starts, ends), at


def edits_allowed(n: np.ndarray) -> np.ndarray:
    return np.where(n < 5, 0, np.floor(MAX_EDITS * n)).astype(np.int64)


def _grams(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each position (fewer positions than words by q-1)."""
    n = len(hashes) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    for j in range(q):
        total += hashes[j : j + n] * _COMBINE[j]
    return mix(total + U64(q))


def cgk(hashes: np.ndarray, walk: int, n: int) -> dict[int, np.ndarray]:
    """By sampled step the place of the word in the embeddings that start at the first n words; STEPS more words follow.

    The place moves on by the bit that the walk gives the word there and the step.
    """
    bits = mix(hashes + mix(np.array([walk + 1], U64)))
    at = np.arange(n)
    out = {0: at}
    for j in range(STEPS):
        at = at + ((bits >> U64(j)) & U64(1)).astype(np.uint8)[at]
        out[j + 1] = at
    return {j: out[j] for t in TABLES for j in t}


def lsh_keys(hashes: np.ndarray, walk: int, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each table (key, first place, last place) of the windows that start at the first n words."""
    places = cgk(hashes, walk, n)
    words_at = {j: hashes[p] for j, p in places.items()}
    return [(words_at[a] * _COMBINE[2 * t] + words_at[b] * _COMBINE[2 * t + 1], places[a], places[b]) for t, (a, b) in enumerate(TABLES)]


def _directed(hashes: np.ndarray, walk: int) -> np.ndarray:
    """The words as a walk reads them, and words beyond the end."""
    return np.concatenate([hashes[::-1] if walk % 2 else hashes, np.zeros(STEPS, U64)])


def passage_distance(item: np.ndarray, region: np.ndarray) -> np.ndarray:
    """Row by row least Levenshtein distance of an item (n, la) to any passage of its region (n, lb)."""
    n, la = item.shape
    lb = region.shape[1]
    prev = np.zeros((n, lb + 1), np.int64)
    steps = np.arange(lb + 1)
    for i in range(la):
        cur = np.empty_like(prev)
        cur[:, 0] = i + 1
        cur[:, 1:] = np.minimum(prev[:, :-1] + (item[:, i : i + 1] != region), prev[:, 1:] + 1)
        # insertions: running minimum of the value less its place
        prev = np.minimum.accumulate(cur - steps, 1) + steps
    return prev.min(1)


class Items:
    """Searchable benchmark items: arrays only, of bounded size."""

    def __init__(self, ids: list, seqs: list[np.ndarray]):
        self.ids, self.seqs = ids, seqs
        n = np.array([len(s) for s in seqs], np.int64)
        self.n, self.k = n, edits_allowed(n)
        bits = max(16, len(seqs).bit_length() + 9)
        self.shift = U64(64 - bits)
        self.tables = []
        for walk in range(WALKS):
            found: list[list[tuple[int, int]]] = [[] for _ in TABLES]
            for i in np.flatnonzero(n >= 5).tolist():
                for table, (key, a, b) in zip(found, lsh_keys(_directed(seqs[i], walk), walk, 1), strict=True):
                    if a[0] < b[0] < n[i]:
                        table.append((int(key[0]), i))
            own = []
            for table in found:
                table.sort()
                keys = np.array([k for k, _ in table], U64)
                flags = np.zeros(1 << bits, bool)
                flags[(keys >> self.shift).astype(np.int64)] = True
                own.append((flags, keys, np.array([i for _, i in table], np.int64)))
            self.tables.append(own)
        # items that must occur exactly, by length
        self.short = {}
        for q in range(1, 5):
            own = np.flatnonzero(n == q)
            if len(own):
                keys = np.concatenate([_grams(seqs[i], q) for i in own])
                order = np.argsort(keys)
                self.short[q] = (keys[order], own[order])
        # the words of each item of a length, as keys of (item, word)
        self.bags = {w: np.sort(np.concatenate([_tagged(np.unique(seqs[i]), np.full(1, i)) for i in np.flatnonzero(n == w)])) for w in np.unique(n).tolist()}


def _tagged(words_: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(words_ + mix(item.astype(U64) + U64(1)))


def _among(keys: np.ndarray, owner: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in wanted, owner) of every wanted key among the sorted keys."""
    lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
    m = hi - lo
    row = np.repeat(np.arange(len(wanted)), m)
    return row, owner[np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(len(row))]


def candidates(items: Items, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distinct rows (text, first word, item) of windows that agree with an item in some table; first words may lie before their text."""
    size = len(hashes)
    found = []
    for walk in range(WALKS):
        read = _directed(hashes, walk)
        for x in range(0, size, BLOCK):
            for (key, _, _), (flags, keys, owner) in zip(lsh_keys(read[x : x + BLOCK + STEPS], walk, min(BLOCK, size - x)), items.tables[walk], strict=True):
                some = np.flatnonzero(flags[(key >> items.shift).astype(np.int64)])
                row, item = _among(keys, owner, key[some])
                word = x + some[row]
                first = word
                if walk % 2:
                    word = size - 1 - word
                    first = word - items.n[item] + 1
                found.append(np.stack([np.searchsorted(at, word, "right") - 1, first, item], 1))
    for q, (keys, owner) in items.short.items():
        row, item = _among(keys, owner, _grams(hashes, q))
        text = np.searchsorted(at, row, "right") - 1
        found.append(np.stack([text, row, item], 1)[row + q <= at[text + 1]])
    if not found:
        return np.zeros((0, 3), np.int64)
    text, first, item = np.concatenate(found).T
    span, before = size + int(items.n.max(initial=0)), int(items.n.max(initial=0))
    code = np.unique((text * len(items.n) + item) * span + first + before)  # one number of a row
    text, item = np.divmod(code // span, len(items.n))
    return np.stack([text, code % span - before, item], 1)


def _slice(hashes: np.ndarray, first: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """Rows of n words from each first, 0 from stop on."""
    at = first[:, None] + np.arange(n)
    return np.where(at < stop[:, None], hashes[np.minimum(at, len(hashes) - 1)], U64(0))


def search(items: Items, hashes: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first word of the window, distance) of the nearest window of each text and item within the limit."""
    rows = candidates(items, hashes, at)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    width = items.n[rows[:, 2]]
    for n in np.unique(width).tolist():
        pairs = rows[width == n]
        k = int(items.k[pairs[0, 2]])
        some = max(1, CELLS // (2 * n))
        for a in range(0, len(pairs), some):
            text, first, item = pairs[a : a + some].T
            low = np.maximum(first - k, at[text])
            region = _slice(hashes, low, at[text + 1], n + 2 * k)
            bag = items.bags[n]
            key = _tagged(region, item[:, None])
            shared = bag[np.minimum(np.searchsorted(bag, key), len(bag) - 1)] == key
            live = np.flatnonzero(shared.sum(1) >= n - k)
            if len(live) == 0:
                continue
            far = passage_distance(np.stack([items.seqs[i] for i in item[live]]), region[live])
            for r, d in zip(live.tolist(), far.tolist(), strict=True):
                if d <= k:
                    spot = (int(text[r]), int(item[r]))
                    best[spot] = min(best.get(spot, (1 << 30, 0)), (d, int(max(first[r] - at[text[r]], 0))))
    return [(t, i, s, d) for (t, i), (d, s) in best.items()]


def _item_blocks(benchmark: DataFrame):
    """Items of the benchmark in blocks of about ITEM_BLOCK and ITEM_BYTES."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    row = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-row[0] // ITEM_BLOCK), -(-(row[1] or 0) // ITEM_BYTES))
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = part.toArrow()
        hashes, at = word_sequence(*text_buffer(rows.column("text")))
        seqs = [hashes[at[i] : at[i + 1]] for i in range(len(at) - 1)]
        ids = rows.column("item_id").to_pylist()
        use = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: (ids[i] is None, ids[i] or 0))
        yield Items([ids[i] for i in use], [seqs[i] for i in use])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, distance): every (document, item) match."""
    out = None
    for held in _item_blocks(benchmark):

        def run(batches, held=held):
            for batch in chunks(batches):
                hashes, at = word_sequence(*text_buffer(batch.column("text")))
                found = sorted(search(held, hashes, at))
                names = batch.column("doc_id").to_pylist()
                columns = [[names[t] for t, *_ in found], [held.ids[i] for _, i, _, _ in found], [s for _, _, s, _ in found], [int(held.n[i]) for _, i, _, _ in found], [d for *_, d in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "first_word", "n_words", "distance"])

        one = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, distance long")
        out = one if out is None else out.unionByName(one)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item is found."""
    for held in _item_blocks(benchmark):

        def clean(texts, held=held):
            out = np.ones(len(texts), bool)
            out[[t for t, *_ in search(held, *word_sequence(*text_buffer(texts)))]] = False
            return out

        docs = keep_rows(docs, clean)
    return docs


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
