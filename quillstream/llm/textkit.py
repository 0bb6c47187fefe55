"""Vectorised byte, word and shingle primitives over Arrow string batches.

Words are maximal runs of bytes outside {0x20, 0x09-0x0D}; A-Z is folded to a-z
before hashing. A word's 64-bit hash is the sum of one random number for each of its
(place, byte), finished by a bijective mixer: a tabulation hash, for which no pair of
words is known to collide by construction. Its tables are fixed, so who knows them
could construct words that do; unequal words collide by chance with about 2**-64.
Where equal bytes must be certain (token ids, removed spans) bytes are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ..runtime import trim  # noqa: F401

U64 = np.uint64
#: Bytes of text handled at once: bounds the numpy temporaries of a Python worker.
CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_NONSPACE = ~_SPACE
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_R = U64(0x9E3779B97F4A7C15)
_RINV = U64(pow(int(_R), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}
_COMBINE = _RNG.integers(1, 2**63, 64, dtype=np.int64).astype(U64) * U64(2) + U64(1)
#: Random numbers by place and byte; places from len(_PLACES) on are mixed as they come.
_PLACES = _RNG.integers(0, 2**64, (64, 256), dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand."""
    key = "inv" if inverse else "fwd"
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _RINV if inverse else _R, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= CHUNK_BYTES + (1 << 20):
            _POWERS[key] = have
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column laid end to end, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text each; a longer text stands alone."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, batch.num_rows
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield batch.slice(a, b - a)
        a = b


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pieces(batch, column, limit)


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _NONSPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of bytes of a kind (words), and for n texts n+1 offsets into the runs."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][offsets[1:] > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _FOLD[data]


def _far(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number of each byte at a place beyond the table."""
    return mix(place.astype(U64) * _COMBINE[61] + _BYTE[data])


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """One 64-bit hash for each byte range of buf."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    length = ends - starts
    near = len(_PLACES)
    # longest first, so that the ranges which have a byte at a place come first
    order = np.argsort(near - np.minimum(length, near).astype(np.int16), kind="stable")
    at = starts[order]
    some = len(at) - np.cumsum(np.bincount(np.minimum(length, near), minlength=near + 1))[:near]  # by place: ranges that are longer
    raw = np.zeros(len(at), U64)
    for j in range(near):
        m = int(some[j])
        if m == 0:
            break
        data = buf[at[:m] + j]
        raw[:m] += _PLACES[j][_FOLD[data] if fold else data]
    for i in range(int((length > near).sum())):
        a, b = int(at[i]), int(ends[order[i]])
        for x in range(a + near, b, CHUNK_BYTES):
            data = buf[x : min(x + CHUNK_BYTES, b)]
            raw[i : i + 1] += _far(_FOLD[data] if fold else data, np.arange(x - a, x - a + len(data))).sum(dtype=U64)
    out = np.empty(len(at), U64)
    out[order] = raw
    return mix(out + length.astype(U64) * _COMBINE[63])


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-item array within each text's range of items."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64 if flags.dtype.kind in "bui" else np.float64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and offsets of each text's words."""
    starts, ends, at = words(buf, offsets)
    return range_hashes(buf, starts, ends), at


def shingle_hashes(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order (not distinct) and each text's offsets.

    A text of 1 to k-1 words has one shingle, its whole sequence; an empty one none.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    if out_at[-1] == 0:
        return np.zeros(0, U64), out_at
    text = np.repeat(np.arange(len(n)), count)
    first = at[text] + (np.arange(out_at[-1]) - out_at[text])
    left = at[text + 1] - first
    total = np.zeros(len(first), U64)
    for j in range(k):
        ok = left > j
        total += np.where(ok, hashes[np.where(ok, first + j, 0)] * _COMBINE[j], U64(0))
    return mix(total + np.minimum(left, k).astype(U64) * _COMBINE[62]), out_at


def crc32_mod(ids, m: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo m; -1 for null."""
    import zlib

    return np.fromiter((-1 if i is None else zlib.crc32(str(i).encode()) % m for i in ids), np.int64, len(ids))


class KeyIndex:
    """Open-addressing index of distinct 64-bit keys: find() gives each query's position or -1."""

    def __init__(self, keys: np.ndarray):
        keys = np.ascontiguousarray(keys).view(U64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift = U64(64 - bits)
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, U64)
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = (mix(keys) >> self.shift).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            placed = self.slots[at] == left
            self.keys[at[placed]] = keys[left[placed]]
            left, at = left[~placed], (at[~placed] + 1) & self.mask

    def __getstate__(self):
        """Only the keys travel; the table is built again where it is used."""
        return self.in_order()

    def __setstate__(self, keys):
        self.__init__(keys)

    def in_order(self) -> np.ndarray:
        used = self.slots >= 0
        out = np.zeros(int(used.sum()), U64)
        out[self.slots[used]] = self.keys[used]
        return out

    def find(self, queries: np.ndarray) -> np.ndarray:
        queries = np.ascontiguousarray(queries).view(U64)
        at = (mix(queries) >> self.shift).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != queries))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            got = self.slots[at]
            out[todo] = got
            more = (got >= 0) & (self.keys[at] != queries[todo])
            todo, at = todo[more], at[more]
        return out


class Tally:
    """Counts of 64-bit keys, merged in memory and handed out when there are more than `limit` of them."""

    def __init__(self, limit: int = 800_000):
        self.limit, self.held, self.size = limit, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        keys, n = _count(keys, counts)
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size > 2 * self.limit:
            self._merge()
            if self.size > self.limit:
                yield from self.flush()

    def _merge(self) -> None:
        if len(self.held) > 1:
            self.held = [_count(np.concatenate([k for k, _ in self.held]), np.concatenate([n for _, n in self.held]))]
            self.size = len(self.held[0][0])

    def flush(self):
        self._merge()
        for keys, n in self.held:
            for a in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 200_000].view(np.int64)), pa.array(n[a : a + 200_000])], names=["h", "n"])
        self.held, self.size = [], 0


def _count(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if len(keys) == 0:
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def ragged(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices offsets[i] .. offsets[i]+lengths[i]-1 of every i, end to end."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(offsets - before, lengths) + np.arange(total)
