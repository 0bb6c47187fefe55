"""Token ids in a binary format: static range asymmetric numeral system (rANS).

Texts are encoded with a tokenizers vocabulary and packed, in ascending doc_id
order, into blocks of whole documents. All blocks share one frequency table,
counted over every id. In a block LANES interleaved rANS states code the ids
step by step; every CHECK_STEPS steps the states and the stream position are
stored, so a block can be decoded from each checkpoint in parallel. Blocks carry
checksums of their bytes and of their ids and depend on nothing but the table.

A dataset is a folder of two Parquet tables, so that any Hadoop file system holds
it and a lost task is simply rewritten: `table` (one row: precision, frequencies)
and `blocks` (shard, block, frame); `frame` is the binary format described at
pack_block(). Null text is empty; each document ends with END_ID; null ids sort
first, rows of one id by text. An empty corpus gives no blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from .textkit import chunks, folded, ragged, range_hashes, text_buffer, trim, words

END_ID = 2
LANES, CHECK_STEPS, PRECISION, LOW = 64, 256, 20, 1 << 31
#: Ids after which a block is closed; a document is never cut, so a very long one is a large block.
BLOCK_IDS = 1 << 16
U64_ALL = np.uint64(2**64 - 1)
MAGIC = b"QSRANS1\0"
HEADER = struct.Struct("<8sQIIIII")
#: Distinct word pieces an executor's Python process remembers.
MEMORY = 1_000_000
#: New pieces given to the library at a time, and bytes of text held at a time.
SOME, PART = 2_000, 1 << 19

# ---------------------------------------------------------------- tokenizing


def _classes() -> np.ndarray:
    kind = np.full(256, 3, np.uint8)  # other ASCII
    kind[[*range(65, 91), *range(97, 123)]] = 1
    kind[48:58] = 2
    kind[128:] = 0  # joins whatever stands beside it
    return kind


_CLASS = _classes()
_WHOLE = np.zeros(256, bool)
_WHOLE[[ord("<"), ord("'")]] = True


#: The steps before the merges for which texts may be cut into pieces (see WordEncoder).
_PIECEWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def _alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """Whether n[i] bytes from a[i] in data are those from b[i] in other (data)."""
    other = data if other is None else other
    out = np.ones(len(a), bool)
    step = np.concatenate([[0], np.cumsum(n)])
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(step, step[i] + PART, "right")) - 1)
        differ = data[ragged(a[i:j], n[i:j])] != other[ragged(b[i:j], n[i:j])]
        if differ.any():
            out[i + np.unique(np.searchsorted(step[i : j + 1] - step[i], np.flatnonzero(differ), "right") - 1)] = False
        i = j
    return out


def _heads(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to the first 8 bytes of each piece, as a number: all of it where it is no longer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    return at[first] & (U64_ALL >> (np.uint64(8) * (8 - np.minimum(length, 8)).astype(np.uint64)))


class WordEncoder:
    """Ids of whole texts through a memory of encoded pieces.

    A vocabulary whose file names the steps in _PIECEWISE drops white space, folds
    case and never joins ASCII letters, ASCII digits and other ASCII characters, so a
    text's ids are its pieces' ids end to end. Words with an apostrophe (contractions)
    or `<` (special tokens) and characters beside non-ASCII ones are left whole for the
    library to cut. Pieces are found by a hash and taken for known only if their
    bytes are the known ones. Texts of other vocabularies go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        special = all(t["content"].startswith("<") and not re.search(r"\s", t["content"]) for t in form.get("added_tokens") or [])
        self.piecewise = (form.get("normalizer"), form.get("pre_tokenizer")) == _PIECEWISE and special
        self._clear()

    def _clear(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes and their slots
        self.pool = np.array([END_ID], np.uint32)
        self.at, self.n = np.zeros(1, np.int32), np.ones(1, np.int32)
        self.bytes = np.zeros(0, np.uint8)  # of each slot's piece, folded
        self.b_at, self.b_n = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, at = words(buf, offsets)
        if len(starts) == 0:
            return starts, ends, at
        kind = _CLASS[buf]
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        whole = np.concatenate([[0], np.cumsum(_WHOLE[buf])])
        keep = np.flatnonzero(whole[ends] > whole[starts])
        for i in keep:
            cut[starts[i] + 1 : ends[i]] = False
        inside = np.zeros(len(buf) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        cut[:-1] &= np.cumsum(inside[:-1]) > 0
        cut[starts] = True
        first = np.flatnonzero(cut[:-1])
        last = np.concatenate([first[1:], [len(buf)]])
        word_of = np.searchsorted(starts, first, "right") - 1
        return first, np.minimum(last, ends[word_of]), np.searchsorted(first, offsets)

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each has."""
        flat, n = [], []
        # the library's results are large: only the ids of a few at a time are kept
        for a in range(0, len(texts), SOME):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + SOME], add_special_tokens=False)]
            n.append(np.fromiter(map(len, ids), np.int32, len(ids)))
            flat.append(np.fromiter(chain.from_iterable(ids), np.uint32, int(n[-1].sum())))
        return (np.concatenate(flat), np.concatenate(n)) if n else (np.zeros(0, np.uint32), np.zeros(0, np.int32))

    def _add(self, ids: np.ndarray, n: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Slots for pieces with these ids and bytes."""
        size = np.fromiter(map(len, data), np.int64, len(data))
        slot = len(self.n) + np.arange(len(n), dtype=np.int32)
        self.at = np.concatenate([self.at, (len(self.pool) + np.cumsum(n) - n).astype(np.int32)])
        self.n = np.concatenate([self.n, n])
        self.pool = np.concatenate([self.pool, ids])
        self.b_at = np.concatenate([self.b_at, len(self.bytes) + np.cumsum(size) - size])
        self.b_n = np.concatenate([self.b_n, size])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(data), np.uint8)])
        return slot

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by END_ID, and each text's offsets."""
        if not self.piecewise:
            raw = buf.tobytes()
            ids, n = self._library([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            ends = np.cumsum(n, dtype=np.int64)
            return np.insert(ids, ends, END_ID), np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
        first, last, at = self.pieces(buf, offsets)
        low = folded(buf)
        hashes = range_hashes(low, first, last, fold=False)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self._clear()
        # pieces whose bytes are not those of their hash's first are told apart by bytes
        length = last - first
        heads = _heads(low, first, length)
        same = (length == length[example][which]) & (heads == heads[example][which])
        rows = np.flatnonzero(same & (length > 8))
        same[rows] = _alike(low, first[rows], first[example[which[rows]]], length[rows])
        spot = np.searchsorted(self.known, distinct)
        old = np.zeros(len(distinct), bool)
        if len(self.known):
            old = self.known[np.minimum(spot, len(self.known) - 1)] == distinct
        slot = np.zeros(len(distinct), np.int32)
        slot[old] = self.slots[spot[old]]
        rows = np.flatnonzero(old)
        right = length[example[rows]] == self.b_n[slot[rows]]
        checked = rows[right]
        right[right] = _alike(low, first[example[checked]], self.b_at[slot[checked]], length[example[checked]], self.bytes)
        if not right.all():
            wrong = np.zeros(len(distinct), bool)
            wrong[rows[~right]] = True
            same &= ~wrong[which]
        new = np.flatnonzero(~old)
        if len(new):
            raw, kept = buf.tobytes(), low.tobytes()
            spans = [(int(first[e]), int(last[e])) for e in example[new]]
            slot[new] = self._add(*self._library([raw[a:b].decode("utf-8", "replace") for a, b in spans]), [kept[a:b] for a, b in spans])
            self.known = np.insert(self.known, spot[new], distinct[new])
            self.slots = np.insert(self.slots, spot[new], slot[new])
        which = slot[which].astype(np.int64)
        odd = np.flatnonzero(~same)
        if len(odd):
            raw = buf.tobytes()
            texts = [raw[a:b] for a, b in zip(first[odd].tolist(), last[odd].tolist(), strict=True)]
            own = sorted(set(texts))
            slots = dict(zip(own, self._add(*self._library([t.decode("utf-8", "replace") for t in own]), own).tolist(), strict=True))
            which[odd] = [slots[t] for t in texts]
        which = np.insert(which, at[1:], 0)  # slot 0 is the end
        n = self.n[which].astype(np.int64)
        ids = self.pool[ragged(self.at[which].astype(np.int64), n)]
        total = np.concatenate([[0], np.cumsum(n)])
        return ids, total[np.concatenate([[0], at[1:] + np.arange(1, len(at))])]


@cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


# ---------------------------------------------------------------- rANS


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies summing to 2**PRECISION, at least 1 for every id."""
    m, n = 1 << PRECISION, len(counts)
    if n > m // 2:
        raise ValueError("vocabulary too large for the precision")
    spare = m - n
    share = counts * (spare / max(1, counts.sum()))
    freq = np.floor(share).astype(np.int64)
    order = np.argsort(-(share - freq), kind="stable")
    left = spare - int(freq.sum())
    freq[order[: left % n]] += 1
    return (freq + left // n + 1).astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.fill = int(np.argmax(freq))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(checkpoint states, checkpoint positions, words) of each block; all blocks advance together."""
        order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
        steps = np.array([-(-len(blocks[i]) // LANES) for i in order], np.int64)
        most = int(steps.max(initial=0))
        ids = np.full((len(order), most * LANES), self.fill, np.uint32)
        for r, i in enumerate(order):
            ids[r, : len(blocks[i])] = blocks[i]
        ids = ids.reshape(len(order), most, LANES)
        x = np.full((len(order), LANES), LOW, np.uint64)
        emitted = np.zeros((len(order), most, LANES), bool)
        out = np.zeros((len(order), most, LANES), np.uint32)
        states = np.zeros((len(order), -(-most // CHECK_STEPS), LANES), np.uint64)
        prec, low_bits, top = np.uint64(PRECISION), np.uint64(0xFFFFFFFF), np.uint64(63 - PRECISION)
        live_at = np.searchsorted(-steps, -np.arange(most), "left")  # blocks with more than s steps
        for s in range(most - 1, -1, -1):
            k = int(live_at[s])
            sym = ids[:k, s]
            f, c, y = self.freq[sym], self.start[sym], x[:k]
            big = y >= (f << top)
            emitted[:k, s] = big
            out[:k, s] = (y & low_bits).astype(np.uint32)
            y = np.where(big, y >> np.uint64(32), y)
            q = y // f
            x[:k] = (q << prec) + (y - q * f) + c
            if s % CHECK_STEPS == 0:
                states[:k, s // CHECK_STEPS] = x[:k]
        done: list = [None] * len(blocks)
        for r, i in enumerate(order):
            n = int(steps[r])
            per = emitted[r, :n].sum(1)
            pos = np.concatenate([[0], np.cumsum(per)])[:-1][::CHECK_STEPS] if n else np.zeros(0)
            done[i] = (states[r, : len(pos)], pos.astype(np.uint32), out[r, :n][emitted[r, :n]])
        return done

    def decode(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks (states, positions, words, number of ids); every checkpoint of every block is decoded side by side."""
        if not parts:
            return []
        words_ = np.concatenate([p[2] for p in parts] + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
        base = np.cumsum([0] + [len(p[2]) for p in parts])[:-1]
        x = np.concatenate([p[0] for p in parts]).reshape(-1, LANES).astype(np.uint64)
        pos = np.concatenate([p[1].astype(np.int64) + b for p, b in zip(parts, base, strict=True)])
        steps = [-(-p[3] // LANES) for p in parts]
        length = np.concatenate([np.minimum(CHECK_STEPS, s - CHECK_STEPS * np.arange(len(p[1]))) for p, s in zip(parts, steps, strict=True)]).astype(np.int64)
        order = np.argsort(-length, kind="stable")
        x, pos, length = x[order], pos[order], length[order]
        most = int(length.max(initial=0))
        out = np.zeros((len(order), most, LANES), np.uint32)
        mask, prec, low = np.uint64((1 << PRECISION) - 1), np.uint64(PRECISION), np.uint64(LOW)
        live_at = np.searchsorted(-length, -np.arange(most), "left")
        for t in range(most):
            k = int(live_at[t])
            y = x[:k]
            slot = y & mask
            sym = self.symbol[slot]
            out[:k, t] = sym
            y = self.freq[sym] * (y >> prec) + slot - self.start[sym]
            need = y < low
            rank = np.cumsum(need, 1)
            read = words_[np.minimum(pos[:k, None] + rank - 1, len(words_) - 1)]
            x[:k] = np.where(need, (y << np.uint64(32)) | read, y)
            pos[:k] += rank[:, -1]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        result, g = [], 0
        for p, s in zip(parts, steps, strict=True):
            rows = [out[back[g + j], : min(CHECK_STEPS, s - CHECK_STEPS * j)].reshape(-1) for j in range(len(p[1]))]
            g += len(p[1])
            result.append((np.concatenate(rows) if rows else np.zeros(0, np.uint32))[: p[3]])
        return result


def pack_block(start: int, doc_ids: np.ndarray, has_id: np.ndarray, lengths: np.ndarray, ids: np.ndarray, coded: tuple) -> bytes:
    """header | doc ids i64 | null flags u8 | lengths u32 | states u64 | positions u32 | words u32 | crc32.

    Header (little endian): magic, ids before the block, documents, ids, checkpoints,
    words, crc32 of the ids as u32. The last four bytes are the crc32 of all before.
    """
    states, pos, stream = coded
    head = HEADER.pack(MAGIC, start, len(doc_ids), len(ids), len(pos), len(stream), zlib.crc32(ids.astype("<u4").tobytes()))
    body = b"".join([
        head, doc_ids.astype("<i8").tobytes(), has_id.astype("u1").tobytes(), lengths.astype("<u4").tobytes(),
        states.astype("<u8").tobytes(), pos.astype("<u4").tobytes(), stream.astype("<u4").tobytes(),
    ])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(frame: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple, int]:
    """(ids before, doc ids, null flags, lengths, what Coder.decode takes, crc32 of the ids); checks the bytes."""
    if struct.unpack("<I", frame[-4:])[0] != zlib.crc32(frame[:-4]):
        raise ValueError("block bytes do not match their checksum")
    magic, start, docs, n, marks, count, crc = HEADER.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = HEADER.size
    parts = []
    for kind, size in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u8", marks * LANES), ("<u4", marks), ("<u4", count)):
        parts.append(np.frombuffer(frame, kind, size, at))
        at += parts[-1].nbytes
    doc_ids, has_id, lengths, states, pos, stream = parts
    return start, doc_ids, has_id, lengths, (states, pos, stream, n), crc


# ---------------------------------------------------------------- dataset


def write_tokens(spark: SparkSession, docs: DataFrame, vocabulary: str, path: str, scratch: Scratch) -> None:
    """Write (doc_id, text) rows as a token dataset in ascending doc_id order.

    vocabulary: the file of a tokenizers vocabulary that exists on every node.
    """

    def tokenise(batches):
        tool, shard = encoder(vocabulary), TaskContext.get().partitionId()
        block, at, held, size = 0, 0, [], 0

        def close():
            ids = np.concatenate([h[1] for h in held])
            doc_ids = [d for h in held for d in h[0]]
            lengths = np.concatenate([h[2] for h in held])
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([at], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([ids.astype("<u2" if tool.size <= 65536 else "<u4").tobytes()], pa.binary())],
                names=["shard", "block", "at", "n", "docs", "lengths", "ids"],
            )

        for batch in chunks(batches, limit=PART):
            ids, offsets = tool.encode(*text_buffer(batch.column("text")))
            names, a = batch.column("doc_id").to_pylist(), 0
            while a < len(names):
                b = int(np.searchsorted(offsets, offsets[a] + BLOCK_IDS - size, "left"))
                b = min(max(b, a + 1), len(names))
                held.append((names[a:b], ids[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])))
                size += int(offsets[b] - offsets[a])
                a = b
                if size >= BLOCK_IDS:
                    yield close()
                    block, at, held, size = block + 1, at + size, [], 0
        if held:
            yield close()
        held = []
        trim()

    sorted_docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    raw = scratch.save("raw", sorted_docs.mapInArrow(tokenise, "shard int, block long, at long, n long, docs array<long>, lengths array<int>, ids binary"), "lz4")
    # one row for each partition of the sort: bounded by the number of partitions
    shards = sorted(raw.groupBy("shard").agg(F.sum("n")).collect())
    starts = dict(zip([s for s, _ in shards], np.cumsum([0] + [n for _, n in shards])[:-1].tolist(), strict=True))
    size = encoder(vocabulary).size
    width = "<u2" if size <= 65536 else "<u4"

    def tally(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                total += np.bincount(np.frombuffer(ids.as_buffer(), width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    found = raw.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    freq = quantise(counts)
    spark.createDataFrame(pa.table({"precision": pa.array([PRECISION], pa.int32()), "frequencies": pa.array([freq.astype(np.int64).tolist()], pa.list_(pa.int64()))})).write.mode("overwrite").parquet(f"{path}/table")

    def pack(batches):
        coder = Coder(freq)
        for batch in batches:
            rows = batch.to_pylist()
            for a in range(0, len(rows), 16):
                group = rows[a : a + 16]
                ids = [np.frombuffer(r["ids"], width).astype(np.uint32) for r in group]
                frames = []
                for r, block, coded in zip(group, ids, coder.encode(ids), strict=True):
                    has = np.array([d is not None for d in r["docs"]], np.uint8)
                    names = np.array([d or 0 for d in r["docs"]], np.int64)
                    frames.append(pack_block(starts[r["shard"]] + r["at"], names, has, np.array(r["lengths"]), block, coded))
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"] for r in group], pa.int32()), pa.array([r["block"] for r in group], pa.int64()), pa.array(frames, pa.binary())], names=["shard", "block", "frame"])

    raw.mapInArrow(pack, "shard int, block long, frame binary").write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/blocks")
    scratch.drop("raw")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, decoded and checked."""
    row = spark.read.parquet(f"{path}/table").first()
    freq = np.array(row["frequencies"], np.uint64)

    def unpack(batches):
        coder = Coder(freq)
        for batch in batches:
            frames = batch.column("frame").to_pylist()
            for a in range(0, len(frames), 16):
                blocks = [unpack_block(f) for f in frames[a : a + 16]]
                for (start, names, has, lengths, _, crc), ids in zip(blocks, coder.decode([b[4] for b in blocks]), strict=True):
                    data = ids.astype("<u4").tobytes()
                    if zlib.crc32(data) != crc:
                        raise ValueError("token ids do not match their checksum")
                    at = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])
                    sums = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    cols = [pa.array(names, mask=has == 0), pa.array(start + at[:-1]), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())]
                    if with_ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return spark.read.schema("shard int, block long, frame binary").parquet(f"{path}/blocks").select("frame").mapInArrow(unpack, fields)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    scratch = Scratch(spark, "tokens")
    path = f"{scratch.base}/dataset"
    write_tokens(spark, texts(table(spark, sf_dir, "documents")), default_vocabulary(), path, scratch)
    return read_tokens(spark, path)
