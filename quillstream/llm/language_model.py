"""Language-model scoring with a weighted backoff automaton over all n-grams that occur twice.

Counts cover every training document, and every n-gram of up to ORDER words that
occurs twice is kept; no number bounds how many are.

    p(w | h) = (c(hw) - D) / c(h)  [kept]  +  left(h) * p(w | shorter h)
    left(h)  = 1 - sum over kept w of (c(hw) - D) / c(h)
    p(w)     = (c(w) + 0.5) / (N + 0.5 * (V + 1))

so the probabilities of all words and one unknown word sum to 1 after every history.
D of an order is n1 / (n1 + 2 n2) over its n-grams (0.5 where that is not between 0 and 1).

The automaton's states are the histories that a kept n-gram continues; its arcs are the
kept n-grams with log10 p(w | h); the failure arc of a history leads to its longest
proper suffix that is a state and weighs log10 left(h). A text is read from left to
right: the state is carried on, an arc taken if there is one, else failure arcs first.

The whole automaton need not fit anywhere. Documents are read in pieces of PIECE bytes.
Each piece sends the n-grams it holds, once each and with their counts in training
documents, to buckets by the hash of the history (exchange.py). A bucket sees all that
follows its histories, so it settles which n-grams are kept, c(h) and left(h), and
answers each piece for just the n-grams asked. With the answers a piece has the part of
the automaton that its texts can reach, and walks it. Memory is bounded by PIECE and
BUCKET, whatever the corpus; a text longer than PIECE is a piece of its own.

Words are 64-bit hashes. Null text counts as empty: its only token is the end. Repeated
rows are counted and scored each; rows without an id are training documents. Ties cannot
matter, as no n-gram is ranked. With no training documents N = V = 0 and every token is
unknown; an empty table gives an empty result. Documents must be read alike each time (as
tables are): the answers carry a checksum of what was asked, and a difference raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from .exchange import U64, blob, bucket_of, by_bucket, pack, rows_of, runs, unpack
from .textkit import _COMBINE, chunks, crc32_mod, mix, text_buffer, trim, word_hashes

ORDER = 3
#: Bytes of text in a piece, and of the text whose n-grams meet in one bucket, about.
PIECE, BUCKET = 6 << 20, 6 << 20
#: Segments of a piece that are walked side by side.
LANES = 4096
#: Bits of a word's hash that travel beside its whole history.
WORD_BITS = 48
#: The hash that stands for the end of a text.
END = mix(np.array([0x656E64], np.uint64))[0]
TRAIN_NOT = 1
_ASKED = "b int, piece long, ord int, body binary"
_ANSWER = _ASKED + ", s1 long, s2 long"
_LOW = U64((1 << WORD_BITS) - 1)


def _gram(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its history and its last word."""
    return mix(prefix * _COMBINE[50] + mix(word + _COMBINE[51]))


class Piece:
    """The distinct n-grams of some texts by order, sorted by the history's hash, and which n-gram ends at each token.

    Of order k: hist (hash of each distinct history; for words: the word itself),
    of (the history of each n-gram, by place in hist), word (its last word), and for
    tokens at[k] the n-gram that ends there, or -1 where its text has too few before.
    """

    def __init__(self, batch: pa.RecordBatch, upto: int = ORDER):
        hashes, at = word_hashes(*text_buffer(batch.column("text")))
        self.hashes = np.insert(hashes, at[1:], END)
        self.offsets = at + np.arange(len(at))
        n = len(self.hashes)
        self.place = np.arange(n) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        words, ids = np.unique(self.hashes, return_inverse=True)
        self.words, self.ids = words, ids.reshape(-1)
        self.hist, self.of, self.word, self.at = {1: words}, {1: np.arange(len(words))}, {1: words}, {1: self.ids}
        rank, key = np.arange(len(words)), words  # of each n-gram of the order before: place of its hash among theirs
        for k in range(2, upto + 1):
            full = np.flatnonzero(self.place >= k - 1)
            before = rank[self.at[k - 1][full - 1]]
            pairs, which = np.unique((before << 32) | self.ids[full], return_inverse=True)
            first = np.ones(len(pairs), bool)
            first[1:] = pairs[1:] >> 32 != pairs[:-1] >> 32
            self.hist[k], self.of[k], self.word[k] = key[pairs[first] >> 32], np.cumsum(first) - 1, words[pairs & 0xFFFFFFFF]
            self.at[k] = np.full(n, -1, np.int64)
            self.at[k][full] = which.reshape(-1)
            if k < upto:
                grams = _gram(self.hist[k][self.of[k]], self.word[k])
                order = np.argsort(grams, kind="stable")
                rank = np.empty(len(grams), np.int64)
                rank[order] = np.arange(len(grams))
                key = grams[order]

    def cuts(self, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each bucket's histories and of its n-grams."""
        edge = np.searchsorted(bucket_of(self.hist[k], buckets), np.arange(buckets + 1))
        return edge, np.searchsorted(self.of[k], edge)

    def counts(self, k: int, train: np.ndarray) -> np.ndarray:
        """How often each n-gram ends at a token of a training text."""
        mark = np.repeat(train, np.diff(self.offsets)) & (self.at[k] >= 0)
        return np.bincount(self.at[k][mark], minlength=len(self.word[k]))


def _check(words: np.ndarray) -> int:
    """Of n-grams, that an answer belongs to the question."""
    return int((mix(words & _LOW) >> U64(32)).sum(dtype=U64)) + len(words)


def _asked(orders: tuple[int, ...], buckets: int):
    def run(batches):
        nth = TaskContext.get().partitionId() << 32
        for batch in chunks(batches, limit=PIECE):
            piece = Piece(batch, max(orders))
            train = crc32_mod(batch.column("doc_id").to_pylist(), 5) != TRAIN_NOT
            for k in orders:
                hist, of, word, n = piece.hist[k], piece.of[k], piece.word[k], piece.counts(k, train)
                edge, cut = piece.cuts(k, buckets)
                size = np.bincount(of, minlength=len(hist))
                out: tuple[list, list] = ([], [])
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    h, g = slice(edge[b], edge[b + 1]), slice(cut[b], cut[b + 1])
                    out[0].append(b)
                    out[1].append(pack(hist[h], size[h], word[g] & _LOW, n[g]) if k > 1 else pack(hist[h], n[g]))
                m = len(out[0])
                yield rows_of({"b": (out[0], pa.int32()), "piece": ([nth] * m, pa.int64()), "ord": ([k] * m, pa.int32()), "body": (out[1], pa.binary())})
            nth += 1
        trim()

    return run


def _answer_words(parts: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """Each word's count; and of the bucket the tokens and the distinct words."""
    words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(which.reshape(-1), np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
    out, a = [], 0
    for p in parts:
        out.append(pack(np.array([_check(p[0])], U64), n[which[a : a + len(p[0])]]))
        a += len(p[0])
    return out, [int(n.sum()), int((n > 0).sum())]


def _answer_grams(parts: list[list[np.ndarray]]) -> tuple[list[bytes], list[int]]:
    """Which n-grams are kept and their counts, what left(h) is made of; and of the bucket n1 and n2."""
    hist, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    own = np.repeat(which.reshape(-1), np.concatenate([p[1] for p in parts]).astype(np.int64))
    word = np.concatenate([p[2] for p in parts])
    order = np.lexsort((word, own))
    first = np.ones(len(order), bool)
    first[1:] = (own[order][1:] != own[order][:-1]) | (word[order][1:] != word[order][:-1])
    gram = np.empty(len(order), np.int64)
    gram[order] = np.cumsum(first) - 1
    n = np.bincount(gram, np.concatenate([p[3] for p in parts])).astype(np.int64)
    of = own[order[first]]
    del order, first, word, own
    keep = n >= 2
    total = np.bincount(of, n, len(hist)).astype(np.int64)
    seen = np.bincount(of[keep], n[keep], len(hist)).astype(np.int64)
    kinds = np.bincount(of[keep], minlength=len(hist))
    out, a, g = [], 0, 0
    for p in parts:
        mine, grams = which[a : a + len(p[0])], gram[g : g + len(p[2])]
        live, kept = kinds[mine] > 0, keep[grams]
        mine = mine[live]
        out.append(pack(np.array([_check(p[2])], U64), np.packbits(live), total[mine], seen[mine], kinds[mine], np.packbits(kept), n[grams[kept]]))
        a, g = a + len(p[0]), g + len(p[2])
    return out, [int((n == 1).sum()), int((n == 2).sum())]


def _answer(batches):
    """Rows sorted by (b, ord): answers to each piece, and a row of two sums for each order of a bucket (piece -1)."""
    for bucket in runs(batches, "b"):
        b = bucket[0]["b"].as_py()
        for k in range(1, ORDER + 1):
            rows = [r for r in bucket if r["ord"].as_py() == k]
            if rows:
                out, sums = (_answer_words if k == 1 else _answer_grams)([unpack(blob(r)) for r in rows])
                pieces = [r["piece"].as_py() for r in rows]
                m, none = len(out) + 1, [None] * len(out)
                yield rows_of(
                    {
                        "b": ([b] * m, pa.int32()), "piece": ([*pieces, -1], pa.int64()), "ord": ([k] * m, pa.int32()), "body": ([*out, None], pa.binary()),
                        "s1": ([*none, sums[0]], pa.int64()), "s2": ([*none, sums[1]], pa.int64()),
                    }
                )
    trim()


class Automaton:
    """The part of the automaton that a piece can reach.

    answers[k]: counts of its words (k = 1), or of its n-grams (0: not kept) and (total,
    seen, kinds) of its histories. States: 0 is empty, then the histories that kept
    n-grams continue; order, fail, log_left: of each state. Arcs: of each n-gram, words
    first and then by order, whether it is one, log_p and the next state.
    """

    def __init__(self, piece: Piece, answers: dict[int, tuple], discount: dict[int, float], tokens: int, distinct: int):
        self.piece, self.counts = piece, answers[1][0]
        p = (self.counts + 0.5) / (tokens + 0.5 * (distinct + 1))  # of each n-gram of an order
        arc, log_p, target = [np.ones(len(p), bool)], [np.log10(p)], []
        fail, log_left, order = [np.zeros(1, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        states = 1
        longest = np.zeros(len(p), np.int64)  # the longest state that is a proper suffix of each n-gram
        for k in range(2, max(answers) + 1):
            n, total, seen, kinds = answers[k]
            d, live = discount[k], kinds > 0
            left = np.where(live, np.maximum(1 - (seen - d * kinds) / np.maximum(total, 1), 1e-12), 1.0)
            # the n-gram of the order below that each history is, and that each n-gram ends with
            at = np.flatnonzero(piece.at[k] >= 0)
            gram = piece.at[k][at]
            history, suffix = np.zeros(len(total), np.int64), np.zeros(len(n), np.int64)
            history[piece.of[k][gram]] = piece.at[k - 1][at - 1]
            suffix[gram] = piece.at[k - 1][at]
            fail.append(longest[history[live]])
            log_left.append(np.log10(left[live]))
            order.append(np.full(int(live.sum()), k - 1))
            longest[history[live]] = states + np.arange(int(live.sum()))  # those n-grams are states themselves
            target.append(longest)
            p = np.where(n > 0, (n - d) / np.maximum(total, 1)[piece.of[k]], 0.0) + left[piece.of[k]] * p[suffix]
            arc.append(n > 0)
            log_p.append(np.log10(p))
            longest = longest[suffix]
            states += int(live.sum())
        target.append(longest)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in arc])])[:-1]  # by order: place of its n-grams
        self.arc, self.log_p, self.target = np.concatenate(arc), np.concatenate(log_p), np.concatenate(target)
        self.order, self.fail, self.log_left = np.concatenate(order), np.concatenate(fail), np.concatenate(log_left)
        self.ends = np.stack([f + piece.at[k + 1] for k, f in enumerate(self.first)])  # by order and token

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 p of the words at tokens of the piece after each state, and the next states."""
        out, total = np.empty(len(token), np.int64), np.zeros(len(token))
        todo = np.arange(len(token))
        while len(todo):
            gram = self.ends[self.order[state], token]
            hit = self.arc[gram]
            done, gram = todo[hit], gram[hit]
            total[done] += self.log_p[gram]
            out[done] = self.target[gram]
            todo, state, token = todo[~hit], state[~hit], token[~hit]
            total[todo] += self.log_left[state]
            state = self.fail[state]
        return total, out

    def walk(self) -> np.ndarray:
        """log10 p of each token of the piece.

        Segments of the tokens are walked side by side; each begins ORDER - 1 tokens early, which settles its state.
        """
        place = self.piece.place
        n = len(place)
        step = max(64, -(-n // LANES))
        begin = np.arange(0, n, step)
        out = np.zeros(n)
        state = np.zeros(len(begin), np.int64)
        for j in range(1 - ORDER, step):
            at = begin + j
            live = slice(int(np.searchsorted(at, 0)), int(np.searchsorted(at, n)))
            at = at[live]
            got, state[live] = self.step(np.where(place[at] == 0, 0, state[live]), at)
            if j >= 0:
                out[at] = got
        return out


def _score(buckets: int, discount: dict[int, float], tokens: int, distinct: int):
    """Rows sorted by (piece, ord, b): the texts of a piece (ord 0), then the answers to it."""

    def run(batches):
        for rows in runs(batches, "piece"):
            if rows[0]["ord"].as_py() != 0:
                raise ValueError("the documents were not read alike each time")
            batch = pa.RecordBatch.from_arrays([rows[0]["ids"].values, rows[0]["texts"].values], names=["doc_id", "text"])
            piece = Piece(batch)
            answers = {}
            for k in range(1, ORDER + 1):
                got = {r["b"].as_py(): unpack(blob(r)) for r in rows if r["ord"].as_py() == k}
                edge, cut = piece.cuts(k, buckets)
                n = np.zeros(len(piece.word[k]), np.int64)
                sums = np.zeros((3, len(piece.hist[k])), np.int64)
                for b in np.flatnonzero(np.diff(edge)).tolist():
                    h, g = slice(edge[b], edge[b + 1]), slice(cut[b], cut[b + 1])
                    if b not in got or int(got[b][0][0]) != _check(piece.word[k][g] if k > 1 else piece.hist[k][h]):
                        raise ValueError("the documents were not read alike each time")
                    if k == 1:
                        n[g] = got[b][1]
                        continue
                    _, live, total, seen, kinds, kept, counts = got[b]
                    live = edge[b] + np.flatnonzero(np.unpackbits(live.astype(np.uint8), count=h.stop - h.start))
                    sums[:, live] = total, seen, kinds
                    n[cut[b] + np.flatnonzero(np.unpackbits(kept.astype(np.uint8), count=g.stop - g.start))] = counts
                answers[k] = (n, *sums) if k > 1 else (n,)
            del rows, got
            model = Automaton(piece, answers, discount, tokens, distinct)
            del answers
            each = model.walk()
            size = np.diff(piece.offsets)
            text = np.repeat(np.arange(len(size)), size)
            known = np.bincount(text, model.counts[piece.ids] > 0, len(size)).astype(np.int64)
            base, total = (np.bincount(text, x, len(size)) for x in (model.log_p[piece.ids], each))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(crc32_mod(batch.column("doc_id").to_pylist(), 5) == TRAIN_NOT), pa.array(size), pa.array(known), pa.array(np.full(len(size), tokens)), pa.array(base), pa.array(total)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            del model, piece, batch, each
            trim()

    return run


def _pieces(batches):
    nth = TaskContext.get().partitionId() << 32
    for batch in chunks(batches, limit=PIECE):
        one = [np.array([0, batch.num_rows], np.int32)]
        columns = [pa.ListArray.from_arrays(pa.array(one[0]), batch.column(c)) for c in ("doc_id", "text")]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([nth], pa.int64()), pa.array([0], pa.int32()), pa.nulls(1, pa.binary()), *columns], names=["b", "piece", "ord", "body", "ids", "texts"])
        nth += 1


def score(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id long, text)."""
    scratch = scratch or Scratch(spark, "lm")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    found, sums = [], {k: (0, 0) for k in range(1, ORDER + 1)}
    for orders in ((1, 2), *((k,) for k in range(3, ORDER + 1))):
        asked = by_bucket(docs.mapInArrow(_asked(orders, buckets), _ASKED), buckets, "ord", "piece")
        found.append(scratch.save(f"answers{orders[-1]}", asked.mapInArrow(_answer, _ANSWER)))
        sums |= {r["ord"]: (r["s1"], r["s2"]) for r in found[-1].filter("piece < 0").groupBy("ord").agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2")).collect()}
        scratch.release()
    tokens, distinct = sums[1]
    discount = {}
    for k in range(2, ORDER + 1):
        n1, n2 = sums[k]
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    rows = docs.mapInArrow(_pieces, _ASKED + ", ids array<long>, texts array<string>")
    for f in found:
        rows = rows.unionByName(f.filter("piece >= 0").drop("s1", "s2"), allowMissingColumns=True)
    rows = rows.repartition(max(1, -(-size // (2 * PIECE))), "piece").sortWithinPartitions("piece", "ord", "b")
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.mapInArrow(_score(buckets, discount, tokens, distinct), fields)


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    return score(spark, texts(table(spark, sf_dir, "documents")))
