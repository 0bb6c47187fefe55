"""Exact removal of repeated substrings with a grouping suffix array.

A byte goes if a WINDOW-byte string that covers it also starts earlier: in a smaller
doc_id, or further left in the same document. Documents are UTF-8 bytes.

1. Anchors. Every window has a content-defined anchor, the KGRAM-byte string of least
   hash in it, so equal windows have equal anchors at equal places. The consecutive
   windows of one anchor form a context. Two windows can only be equal if their
   contexts have the same anchor: anchors that occur once are done.
2. Equal contexts collapse: all but the earliest lose all their windows' bytes.
3. Distinct contexts of one anchor are cut to the windows whose hash occurs in
   another of them; equal cuts collapse by their bytes. Anchors with more than GROUP
   contexts, which no task should hold, do so by shuffles (see _hot_groups).
4. What is left of each anchor goes into one suffix array, built by the linear
   grouping construction below; neighbours that share WINDOW bytes are one string,
   and all its windows but the earliest lose their bytes.

Null texts are empty. Documents without an id count as the smallest. Rows of one id
are ordered by a hash of their texts; rows that repeat id and text are one document,
and each returns its result. An empty table gives an empty result. Hashes have 64 bits;
contexts count as equal by the hash of their anchor and their own, cuts and windows by
their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from .exchange import blob, bucket_of, by_bucket, pack, rows_of, runs, unpack
from .jaccard import bitmap, in_bitmap
from .textkit import _BYTE, _COMBINE, Tally, chunks, mix, powers, ragged, text_buffer

WINDOW, KGRAM, GROUP = 100, 40, 256
#: Bits of the bitmaps of repeated anchors and wanted contexts (8 MB each): false hits only cost work.
BITS = 26
#: Bytes of text held at a time (a task needs about 80 bytes for each); longer texts are searched in parts of so many window starts.
PART = 1 << 19
_POS = np.uint64((1 << 22) - 1)
U64 = np.uint64

# ---------------------------------------------------------------- suffix array


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of non-negative integers, in linear time.

    First phase: suffixes start grouped by first symbol. Groups are processed in
    descending order; each member's previous-smaller pointer leads to the last
    earlier suffix of a lower group, and the suffixes so reached move up into new
    groups behind their old ones, those reached most often highest. In the end
    each group holds the suffixes with one Lyndon prefix. Second phase: from the
    least suffix on, each suffix emitted places its left neighbour and the chain of
    previous-smaller pointers from there at the front of their groups.
    """
    n = len(text) + 1
    t = [x + 1 for x in text]
    t.append(0)
    order = sorted(range(n), key=t.__getitem__)
    place = [0] * n
    group = [0] * n  # first index of each suffix's group
    end = [0] * (n + 1)  # by first index: one past the group's last
    start, last = 0, -1
    for i, s in enumerate(order):
        if t[s] != last:
            start, last = i, t[s]
        place[s] = i
        group[s] = start
        end[start] = i + 1
    prev = [-1] * n
    hi = n
    while hi > 0:
        lo = group[order[hi - 1]]
        reached: dict[int, int] = {}
        members = order[lo:hi]
        if hi - lo > 1:
            members.sort()
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= lo:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            if len(reached) == 1 or max(reached.values()) == 1:
                levels = [list(reached)]
            else:
                by: dict[int, list[int]] = {}
                for p, c in reached.items():
                    by.setdefault(c, []).append(p)
                levels = [by[c] for c in sorted(by, reverse=True)]
            for level in levels:
                moved: dict[int, int] = {}
                for p in level:
                    g = group[p]
                    k = moved.get(g, 0) + 1
                    moved[g] = k
                    a, b = place[p], end[g] - k
                    q = order[b]
                    order[a], order[b] = q, p
                    place[q], place[p] = a, b
                for g, k in moved.items():
                    b = end[g]
                    if b - k == g:
                        continue  # the whole group moved: it keeps its place
                    end[g] = b - k
                    end[b - k] = b
                    for i in range(b - k, b):
                        group[order[i]] = b - k
        hi = lo
    out = [-1] * n
    out[0] = n - 1
    group[n - 1] = -1
    front = list(range(n + 1))
    for i in range(n):
        s = out[i] - 1
        while s >= 0:
            g = group[s]
            if g < 0:
                break
            out[front[g]] = s
            front[g] += 1
            group[s] = -1
            s = prev[s]
    return out[1:]


def repeated_windows(strings: list[bytes], rank: list[int], width: int = WINDOW) -> list[tuple[int, int]]:
    """(string, offset) of every width-byte window that also starts in a string of lower rank, or further left in the same."""
    text: list[int] = []
    where: list[tuple[int, int]] = []  # first index and length
    for s in strings:
        where.append((len(text), len(s)))
        text.extend([b + 1 for b in s])
        text.append(0)
    joined = b"\0".join(strings) + b"\0"
    owner = np.repeat(np.arange(len(strings)), [n + 1 for _, n in where])
    found = []
    run: list[int] = []
    last = None

    def close() -> None:
        if len(run) > 1:
            spots = sorted((rank[owner[i]], i - where[owner[i]][0], int(owner[i])) for i in run)
            found.extend((o, at) for _, at, o in spots[1:])

    for i in suffix_array(text):
        a, n = where[owner[i]]
        if i + width > a + n:
            continue
        here = joined[i : i + width]
        if here != last:
            close()
            run, last = [], here
        run.append(i)
    close()
    return found


# ---------------------------------------------------------------- anchors


def contexts(buf: np.ndarray, offsets: np.ndarray):
    """(anchor hash, context hash, text, first window, windows) of each context of a batch, as arrays."""
    empty = (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    found = []
    for a in range(0, max(len(buf) - WINDOW + 1, 0), PART):
        b = min(len(buf), a + PART + WINDOW - 1)
        found.append(_contexts(buf[a:b], offsets, a))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else empty


def _contexts(buf: np.ndarray, offsets: np.ndarray, base: int):
    n = len(buf)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[buf] * powers(n), out=sums[1:])
    back = powers(n, inverse=True)
    anchor = mix((sums[KGRAM:] - sums[: n - KGRAM + 1]) * back[: n - KGRAM + 1])
    least = (anchor & ~_POS) | np.arange(len(anchor), dtype=U64)
    have, want = 1, WINDOW - KGRAM + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    # windows that cross the end of a text do not exist
    inner = offsets[(offsets > base) & (offsets < base + n)] - base
    crossing = np.zeros(len(least) + 1, np.int32)
    np.add.at(crossing, np.clip(inner - WINDOW + 1, 0, len(least)), 1)
    np.add.at(crossing, np.minimum(inner, len(least)), -1)
    at = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
    if len(at) == 0:
        return anchor[:0], anchor[:0], at, at, at
    spot = (least[at] & _POS).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (spot[1:] != spot[:-1]) | (at[1:] != at[:-1] + 1)]))
    i0, i1 = at[first], at[np.concatenate([first[1:], [len(at)]]) - 1]
    ctx = mix((sums[i1 + WINDOW] - sums[i0]) * back[i0] + (i1 - i0).astype(U64) * _COMBINE[5])
    text = np.searchsorted(offsets, base + i0, "right") - 1
    return anchor[spot[first]], ctx, text, base + i0, i1 - i0 + 1


def _window_hashes(buf: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(buf)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[buf] * powers(n), out=sums[1:])
    at = ragged(starts, counts)
    return mix((sums[at + WINDOW] - sums[at]) * powers(n, inverse=True)[at])


# ---------------------------------------------------------------- operator


def _resolve(batches):
    """Rows (g, d, th, i0, bytes), sorted by g, to windows (d, th, i0, n) that occur earlier."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        g = table.column("g").to_numpy()
        cut = int(np.searchsorted(g, g[-1], "left")) if len(g) and np.all(g[1:] >= g[:-1]) else 0
        held = table.slice(cut)
        if cut:
            yield _resolve_groups(table.slice(0, cut))
    if held is not None and held.num_rows:
        yield _resolve_groups(held)


def _resolve_groups(table: pa.Table) -> pa.RecordBatch:
    table = table.combine_chunks()
    out: list[tuple[int, int, int, int]] = []
    size = np.cumsum([len(b) for b in table.column("bytes").to_pylist()]) if table.num_rows else np.zeros(0)
    g_all = table.column("g").to_numpy()
    a = 0
    while a < table.num_rows:  # whole groups, a few MB at a time
        b = int(np.searchsorted(size, (size[a - 1] if a else 0) + (2 << 20), "right"))
        b = max(b, a + 1)
        b = int(np.searchsorted(g_all, g_all[b - 1], "right"))
        _resolve_some(table.slice(a, b - a), out)
        a = b
    columns = list(zip(*out, strict=True)) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["d", "th", "i0", "n"])


def _resolve_some(table: pa.Table, out: list) -> None:
    buf, offsets = text_buffer(table.column("bytes"))
    g, d, th, i0 = (table.column(c).to_numpy() for c in ("g", "d", "th", "i0"))
    counts = np.diff(offsets) - WINDOW + 1
    hashes = _window_hashes(buf, offsets[:-1], counts)
    group = np.repeat(np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])), counts)
    _, inverse, times = np.unique(mix(hashes + group.astype(U64) * _COMBINE[7]), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[inverse] > 1)
    row = np.searchsorted(np.cumsum(counts), shared, "right")
    if len(row) == 0:
        return
    rows, first = np.unique(row, return_index=True)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    base = np.cumsum(counts) - counts
    lo, hi = shared[first] - base[rows], shared[last] - base[rows]
    raw = buf.tobytes()
    groups: dict[int, dict[bytes, list]] = {}
    for r, x, y in zip(rows.tolist(), lo.tolist(), hi.tolist(), strict=True):
        piece = raw[offsets[r] + x : offsets[r] + y + WINDOW]
        spot = (int(d[r]), int(th[r]), int(i0[r]) + x)
        groups.setdefault(int(g[r]), {}).setdefault(piece, []).append(spot)
    for pieces_ in groups.values():
        strings, spots = [], []
        for piece, at in pieces_.items():
            at.sort()
            strings.append(piece)
            spots.append(at[0])
            out.extend((x, y, z, len(piece) - WINDOW + 1) for x, y, z in at[1:])
        if len(strings) > 1:
            rank = [0] * len(strings)
            for k, i in enumerate(sorted(range(len(strings)), key=spots.__getitem__)):
                rank[i] = k
            for s, at in _runs(repeated_windows(strings, rank)):
                x, y, z = spots[s]
                out.append((x, y, z + at[0], at[1]))


def _runs(found: list[tuple[int, int]]):
    """Consecutive offsets of one string as (string, (first, count))."""
    found.sort()
    i = 0
    while i < len(found):
        j = i
        while j + 1 < len(found) and found[j + 1] == (found[i][0], found[j][1] + 1):
            j += 1
        yield found[i][0], (found[i][1], j - i + 1)
        i = j + 1


def _window_pieces(buckets: int):
    """The distinct window hashes of rows' bytes with their counts, packed by bucket."""

    def run(batches):
        for batch in chunks(batches, "bytes", PART):
            buf, offsets = text_buffer(batch.column("bytes"))
            h, n = np.unique(_window_hashes(buf, offsets[:-1], np.diff(offsets) - WINDOW + 1), return_counts=True)
            edge = np.searchsorted(bucket_of(h, buckets), np.arange(buckets + 1)).tolist()
            some = [b for b in range(buckets) if edge[b + 1] > edge[b]]
            yield rows_of({"b": (some, pa.int32()), "body": ([pack(h[edge[b] : edge[b + 1]], n[edge[b] : edge[b + 1]]) for b in some], pa.binary())})

    return run


def _window_repeats(batches):
    """Of rows sorted by b: the window hashes that occur twice."""
    for rows in runs(batches, "b"):
        parts = [unpack(blob(r)) for r in rows]
        h, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(which.reshape(-1), np.concatenate([p[1] for p in parts]))
        yield rows_of({"h": (h[n > 1].view(np.int64), pa.int64())})


def _cut(repeated):
    """Each row's runs of windows that may occur twice (false hits only cost work), as rows of their own."""

    def run(batches):
        for batch in chunks(batches, "bytes", PART):
            buf, offsets = text_buffer(batch.column("bytes"))
            counts = np.diff(offsets) - WINDOW + 1
            hit = in_bitmap(repeated.value, _window_hashes(buf, offsets[:-1], counts))
            row = np.repeat(np.arange(len(counts)), counts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            hits = np.flatnonzero(hit)
            edge = np.ones(len(hits), bool)
            edge[1:] = (hits[1:] != hits[:-1] + 1) | (row[hits[1:]] != row[hits[:-1]])
            first = np.flatnonzero(edge)
            n = np.diff(np.concatenate([first, [len(hits)]]))
            own, start = row[hits[first]], at[hits[first]]
            yield _strings(batch, own, buf, offsets[own] + start, n, start)

    return run


def _strings(batch: pa.RecordBatch, own: np.ndarray, buf: np.ndarray, first: np.ndarray, n: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows (g, d, th, i0, bytes) of n windows each, cut out of rows `own` of a batch."""
    length = n + WINDOW - 1
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    body = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(buf[ragged(first, length)].tobytes())])
    take = lambda c: batch.column(c).to_numpy()[own]
    return pa.RecordBatch.from_arrays([pa.array(take("g")), pa.array(take("d")), pa.array(take("th")), pa.array(take("i0") + start), body], names=["g", "d", "th", "i0", "bytes"])


def _single(batches):
    """Every window of rows (g, d, th, i0, bytes) as a row of its own."""
    for batch in chunks(batches, "bytes", 1 << 14):
        buf, offsets = text_buffer(batch.column("bytes"))
        counts = np.diff(offsets) - WINDOW + 1
        own = np.repeat(np.arange(len(counts)), counts)
        start = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield _strings(batch, own, buf, offsets[own] + start, np.ones(len(own), np.int64), start)


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spans of rows (g, d, th, i0, bytes) whose bytes an earlier row of g has; and the earliest row of each (g, bytes)."""
    place = F.struct("d", "th", "i0")
    first = rows.groupBy("g", "bytes").agg(F.min(place).alias("f"), F.count("*").alias("times"))
    late = rows.join(first.filter("times > 1").select("g", "bytes", "f"), ["g", "bytes"]).filter(place != F.col("f"))
    return late.select("d", "th", "i0", (F.octet_length("bytes") - WINDOW + 1).cast("long").alias("n")), first.select("g", "f.d", "f.th", "f.i0", "bytes")


def _hot_groups(spark: SparkSession, hot: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """Anchors with many contexts: (spans found, rows that are left for the suffix array).

    Contexts are cut to the windows that occur twice, and equal cuts collapse by their
    bytes; that usually leaves few strings of an anchor. Of an anchor that still has more
    than GROUP, every window becomes a row and collapses by its bytes.
    """
    size = hot.agg(F.count("*"), F.sum(F.octet_length("bytes"))).first()
    if not size[0]:
        return [], hot
    buckets = max(1, -(-size[1] // (4 << 20)))
    windows = by_bucket(hot.select("bytes").mapInArrow(_window_pieces(buckets), "b int, body binary"), buckets)
    repeated = spark.sparkContext.broadcast(bitmap(windows.mapInArrow(_window_repeats, "h long"), "h"))
    cut = scratch.save("cut", hot.mapInArrow(_cut(repeated), "g long, d long, th long, i0 long, bytes binary"))
    late, strings = _collapse(cut)
    strings = scratch.save("strings", strings)
    many = strings.groupBy("g").agg(F.count("*").alias("m")).filter(F.col("m") > GROUP).select("g")
    few, rest = strings.join(many, "g", "left_anti"), strings.join(many, "g", "left_semi")
    single = scratch.save("single", rest.mapInArrow(_single, "g long, d long, th long, i0 long, bytes binary"))
    return [late, _collapse(single)[0]], few


def repeated_spans(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, th, spans): for each document with repeats the windows (i0, n) that occur earlier."""

    def count_anchors(batches):
        tally = Tally()
        for batch in chunks(batches, limit=PART):
            yield from tally.add(contexts(*text_buffer(batch.column("text")))[0])
        yield from tally.flush()

    counted = docs.select("text").mapInArrow(count_anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    twice = spark.sparkContext.broadcast(bitmap(counted.filter("n > 1"), "h", BITS))

    def occurrences(batches):
        for batch in chunks(batches, limit=PART):
            buf, offsets = text_buffer(batch.column("text"))
            g, c, text, i0, n = contexts(buf, offsets)
            keep = np.flatnonzero(in_bitmap(twice.value, g))
            text = text[keep]
            d, th = (batch.column(x).to_numpy()[text] for x in ("d", "th"))
            columns = [g[keep].view(np.int64), c[keep].view(np.int64), d, th, i0[keep] - offsets[text], n[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["g", "c", "d", "th", "i0", "n"])

    occ = scratch.save("occurrences", docs.mapInArrow(occurrences, "g long, c long, d long, th long, i0 long, n long"))
    first = scratch.save("first", occ.groupBy("g", "c").agg(F.min(F.struct("d", "th", "i0")).alias("f"), F.count("*").alias("times"), F.first("n").alias("n")))
    # every occurrence of a context but the earliest goes
    late = occ.join(first.filter("times > 1").select("g", "c", "f"), ["g", "c"]).filter(F.struct("d", "th", "i0") != F.col("f")).select("d", "th", "i0", "n")
    several = first.groupBy("g").agg(F.count("*").alias("m")).filter("m > 1")
    mixed = scratch.save("mixed", first.join(several, "g").select("g", "c", "m", "f.d", "f.th", "f.i0"))
    wanted = spark.sparkContext.broadcast(bitmap(mixed, "c", BITS))

    def fetch(batches):
        for batch in chunks(batches, limit=PART):
            buf, offsets = text_buffer(batch.column("text"))
            g, c, text, i0, n = contexts(buf, offsets)
            keep = np.flatnonzero(in_bitmap(wanted.value, c))
            _, one = np.unique(c[keep], return_index=True)
            keep = keep[one]
            length = n[keep] + WINDOW - 1
            data = buf[ragged(i0[keep], length)]
            at = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            body = pa.Array.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(c[keep].view(np.int64)), body], names=["c", "bytes"])

    bodies = docs.select("text").mapInArrow(fetch, "c long, bytes binary").groupBy("c").agg(F.min("bytes").alias("bytes"))
    rows = scratch.save("bodies", mixed.join(bodies, "c").select("g", "m", "d", "th", "i0", "bytes"))
    found, few = _hot_groups(spark, rows.filter(F.col("m") > GROUP).drop("m"), scratch)
    strings = rows.filter(F.col("m") <= GROUP).drop("m").unionByName(few)
    spans = late.unionByName(strings.repartition("g").sortWithinPartitions("g").mapInArrow(_resolve, "d long, th long, i0 long, n long"))
    for more in found:
        spans = spans.unionByName(more)
    return spans.groupBy("d", "th").agg(F.collect_list(F.struct("i0", "n")).alias("spans"))


def dedup_substrings(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None, with_kept: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of docs (doc_id long, text)."""
    scratch = scratch or Scratch(spark, "suffixes")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    spans = scratch.save("spans", repeated_spans(spark, docs.select("d", "th", "text"), scratch))
    scratch.drop("occurrences", "first", "mixed", "bodies", "cut", "strings", "single")

    def remove(batches):
        for batch in chunks(batches, limit=PART):
            buf, offsets = text_buffer(batch.column("text"))
            gone = np.zeros(len(buf) + 1, np.int32)
            spans = batch.column("spans")
            flat = spans.flatten()
            if len(flat):
                per = np.diff(spans.offsets.to_numpy()) if spans.null_count == 0 else np.array([len(s) if s is not None else 0 for s in spans.to_pylist()])
                row = np.repeat(np.arange(batch.num_rows), per)
                start = offsets[row] + flat.field("i0").to_numpy(zero_copy_only=False)
                np.add.at(gone, start, 1)
                np.add.at(gone, start + flat.field("n").to_numpy(zero_copy_only=False) + WINDOW - 1, -1)
            out = np.cumsum(gone)[:-1] > 0
            begin = out.copy()
            begin[1:] &= ~out[:-1]
            at = offsets[:-1][offsets[:-1] < len(buf)]
            begin[at] = out[at]
            removed = np.concatenate([[0], np.cumsum(out)])
            begun = np.concatenate([[0], np.cumsum(begin)])
            kept = buf[~out].tobytes()
            left = (offsets - removed[offsets]).tolist()
            parts = [kept[x:y] for x, y in zip(left[:-1], left[1:], strict=True)]
            columns = [
                batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(removed[offsets])), pa.array(np.diff(begun[offsets])), pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
            ]
            if with_kept:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    fields = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    none = F.array().cast("array<struct<i0:bigint,n:bigint>>")
    joined = docs.join(spans, ["d", "th"], "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return joined.mapInArrow(remove, fields)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    return dedup_substrings(spark, texts(table(spark, sf_dir, "documents")))
