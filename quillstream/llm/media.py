"""Media columns: AVI motion JPEG.

`decode_avi` finds the frames of a file through its RIFF index (idx1, or by walking
the movi list), `decode_frames` decodes baseline intra frames of many files side by
side, `shots` cuts a film where the luminance histogram changes by more than an
adaptive threshold, and `clips` turns a binary column into timed clip rows.

`encode_avi` stores bytes losslessly: each 64 bytes are the 64 quantised
coefficients (byte - 128, in zigzag order) of a block of a grey 32x32 frame with
unit quantisation, entropy coded with one restart interval a block; the length of
the payload stands in the stream's `strd` chunk.

Null, empty or undecodable media give no clips and an `error`. Frames without
Huffman tables, as motion JPEG often has them, are read by the standard's typical
ones. Rows that repeat are rows of their own with equal values; an empty table gives
no rows. Files are decoded PIECE bytes at a time; one film is held in memory as a whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, ragged, text_buffer

PIECE = 2 << 20
FPS, SIDE = 10, 32
FRAME_BLOCKS = (SIDE // 8) ** 2
#: Shot cuts: histogram bins, frames that the adaptive threshold looks back on, its spread factor and its least value.
HIST_BINS, LOOK_BACK, SPREAD, LEAST = 32, 12, 3.0, 0.10

# ---------------------------------------------------------------- tables


def _zigzag() -> np.ndarray:
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in order])


ZIGZAG = _zigzag()
_BASIS = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)], np.float32)
_SIZE = np.array([int(abs(v)).bit_length() for v in range(-2048, 2048)], np.int64)

EOB, ZRL = 0x00, 0xF0
#: Code lengths of the AC symbols (run << 4 | size) that the encoder uses: short for what bytes of text give.
_AC_LENGTHS = {5: 2, 4: 2, 7: 3, 3: 4, 6: 4, 8: 5, EOB: 5, 1: 6, 2: 6, ZRL: 8} | {(run << 4) | size: 12 for run in range(1, 16) for size in range(1, 9)}
_DC_LENGTHS = {size: 4 for size in range(9)}


def _canonical(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(codes of each length 1-16, symbols in order, symbol -> (code, length))."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, code, last = {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s] = (code, last)
        code += 1
    return [sum(v == n for v in lengths.values()) for n in range(1, 17)], symbols, codes


def _lookup(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each 16 bits the length of the code they begin with (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, i = 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            a, b = code << (16 - n), (code + 1) << (16 - n)
            length[a:b], symbol[a:b] = n, symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return length, symbol


def _typical(counts: str, first: str, symbols: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(codes of each length, symbols): those listed come first, the others of the alphabet in ascending order."""
    listed = tuple(bytes.fromhex(first))
    return tuple(map(int, counts.split())), (*listed, *(s for s in symbols if s not in listed))


_AC_ALPHABET = [EOB, ZRL] + [(run << 4) | size for run in range(16) for size in range(1, 11)]
_AC_ALPHABET.sort()
#: The typical Huffman tables of ITU-T T.81, Annex K.3, by (class << 4 | table).
TYPICAL_TABLES = {
    0x00: _typical("0 1 5 1 1 1 1 1 1 0 0 0 0 0 0 0", "", list(range(12))),
    0x01: _typical("0 3 1 1 1 1 1 1 1 1 1 0 0 0 0 0", "", list(range(12))),
    0x10: _typical(
        "0 2 1 3 3 2 4 3 5 5 4 4 0 0 1 125",
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
        _AC_ALPHABET,
    ),
    0x11: _typical(
        "0 2 1 2 4 4 3 4 7 5 4 4 0 1 2 119",
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
        _AC_ALPHABET,
    ),
}

_DC, _AC = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_header() -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00"),
        _segment(0xC4, b"\x00" + bytes(_DC[0]) + bytes(_DC[1])),
        _segment(0xC4, b"\x10" + bytes(_AC[0]) + bytes(_AC[1])),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ])


HEADER = _frame_header()

# ---------------------------------------------------------------- encoding


def _entropy_code(coefs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of all blocks end to end, and each block's offsets. coefs: (blocks, 64) in zigzag order, -1023 to 1023."""
    n = len(coefs)
    dc_code = np.zeros((2, 12), np.int64)
    for s, c in _DC[2].items():
        dc_code[:, s] = c
    ac_code = np.zeros((2, 256), np.int64)
    for s, c in _AC[2].items():
        ac_code[:, s] = c

    def bits(value: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        extra = np.where(value < 0, value + (np.int64(1) << size) - 1, value)
        return (code[0] << size) | extra, code[1] + size

    flat = coefs.reshape(-1).astype(np.int64)
    where = np.flatnonzero(flat)
    where = where[where & 63 > 0]
    block, k = where >> 6, where & 63
    prev = np.zeros(len(where), np.int64)
    same = block[1:] == block[:-1]
    prev[1:] = np.where(same, k[:-1], 0)
    run = k - prev - 1
    long_runs = run >> 4
    size = _SIZE[flat[where] + 2048]
    value, length = bits(flat[where], ac_code[:, ((run & 15) << 4) | size], size)
    last = np.zeros(n, np.int64)
    last[block] = k
    spent = np.concatenate([[0], np.cumsum(long_runs + 1)])
    of_block = np.searchsorted(block, np.arange(n + 1))
    ac_tokens = spent[of_block[1:]] - spent[of_block[:-1]]
    ends = last < 63
    tokens = 1 + ac_tokens + ends + 1  # DC, AC, end of block, padding
    start = np.cumsum(tokens) - tokens
    total = int(tokens.sum())
    code, width = np.zeros(total, np.int64), np.zeros(total, np.int64)
    dc = flat[::64]
    dc_size = _SIZE[dc + 2048]
    code[start], width[start] = bits(dc, dc_code[:, dc_size], dc_size)
    at = start[block] + 1 + spent[1:] - 1 - spent[of_block[block]]
    code[at], width[at] = value, length
    if long_runs.any():
        some = np.flatnonzero(long_runs)
        fill = ragged(at[some] - long_runs[some], long_runs[some])
        code[fill], width[fill] = ac_code[0, ZRL], ac_code[1, ZRL]
    stop = start[ends] + 1 + ac_tokens[ends]
    code[stop], width[stop] = ac_code[0, EOB], ac_code[1, EOB]
    done = np.cumsum(width)
    before = done - width
    used = done[start + tokens - 1] - before[start]
    pad = -used & 7
    tail = start + tokens - 1
    code[tail], width[tail] = (np.int64(1) << pad) - 1, pad
    n_bytes = (used + pad) >> 3
    byte_at = np.cumsum(n_bytes) - n_bytes
    bit = np.repeat(byte_at * 8 - before[start], tokens) + before
    bit[tail] = byte_at * 8 + used
    size_all = int(n_bytes.sum())
    # tokens come in bit order, so each 32-bit word is the sum of a run of them
    shifted = code.astype(np.uint64) << (64 - width - (bit & 31)).astype(np.uint64)
    word = bit >> 5
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    at_word = word[first]
    whole = np.zeros((size_all >> 2) + 3, np.uint64)
    whole[at_word] = np.add.reduceat(shifted >> np.uint64(32), first)
    whole[at_word + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    packed = whole.astype(">u4").view(np.uint8)[:size_all]
    ff = packed == 0xFF
    shift = np.concatenate([[0], np.cumsum(ff)])
    out = np.zeros(size_all + int(shift[-1]), np.uint8)
    out[np.arange(size_all) + shift[:-1]] = packed
    edge = np.concatenate([byte_at, [size_all]])
    return out, edge + shift[edge]


def encode_avi(buf: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A motion-JPEG file for each text's bytes, padded with 0 to a positive multiple of 64."""
    n_bytes = np.diff(offsets)
    blocks = np.maximum(1, -(-n_bytes // 64))
    frames = -(-blocks // FRAME_BLOCKS)
    slots = frames * FRAME_BLOCKS
    first = np.cumsum(slots) - slots
    coefs = np.zeros(int(slots.sum()) * 64, np.int16)
    live = ragged(first * 64, blocks * 64)
    coefs[live] = -128
    coefs[ragged(first * 64, n_bytes)] = buf.astype(np.int16) - 128
    data, at = _entropy_code(coefs.reshape(-1, 64))
    # restart markers between the blocks of a frame
    marks = np.arange(int(slots.sum()))
    inner = (marks % FRAME_BLOCKS) != FRAME_BLOCKS - 1
    shift = np.concatenate([[0], np.cumsum(2 * inner)])
    scan = np.zeros(len(data) + int(shift[-1]), np.uint8)
    scan[np.arange(len(data)) + np.repeat(shift[:-1], np.diff(at))] = data
    place = (at[1:] + shift[:-1])[inner]
    scan[place] = 0xFF
    scan[place + 1] = 0xD0 + (marks % FRAME_BLOCKS % 8)[inner]
    edge = (at + shift)[::FRAME_BLOCKS].tolist()
    raw = scan.tobytes()
    out, f = [], 0
    for count, payload in zip(frames.tolist(), (blocks * 64).tolist(), strict=True):
        parts, index, place = [], [], 4
        for i in range(f, f + count):
            jpeg = HEADER + raw[edge[i] : edge[i + 1]] + b"\xff\xd9"
            size = len(jpeg)
            parts.append(b"00dc" + struct.pack("<I", size) + jpeg + b"\0" * (size & 1))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, place, size))
            place += 8 + size + (size & 1)
        f += count
        out.append(_riff(b"".join(parts), b"".join(index), count, payload))
    return out


def _riff(movi: bytes, index: bytes, frames: int, payload: int) -> bytes:
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + chunk(b"strd", struct.pack("<Q", payload))
    body = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl)) + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


# ---------------------------------------------------------------- decoding


@dataclass
class Film:
    seconds_per_frame: float
    frames: list[bytes]
    private: bytes  # the first stream's strd chunk


def _walk(data: bytes, at: int, stop: int):
    while at + 8 <= stop:
        size = struct.unpack_from("<I", data, at + 4)[0]
        yield data[at : at + 4], at + 8, min(size, stop - at - 8)
        at += 8 + size + (size & 1)


def decode_avi(data: bytes) -> Film:
    """Frames of the first video stream, in the index's order."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    tick, rate, private, movi, index = 0.0, None, b"", None, None
    stack = [(12, len(data))]
    streams = 0
    video = 0
    while stack:
        at, stop = stack.pop(0)
        for name, a, n in _walk(data, at, stop):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = (a, n)
            elif name == b"LIST":
                stack.append((a + 4, a + n))
            elif name == b"avih" and n >= 4:
                tick = struct.unpack_from("<I", data, a)[0] / 1e6
            elif name == b"strh" and n >= 28:
                if data[a : a + 4] == b"vids" and rate is None:
                    scale, per = struct.unpack_from("<II", data, a + 20)
                    rate, video = (scale / per if per else 0.0), streams
                streams += 1
            elif name == b"strd" and not private:
                private = data[a : a + n]
            elif name == b"idx1":
                index = (a, n)
    if movi is None:
        raise ValueError("no movi list")
    want = {f"{video:02d}dc".encode(), f"{video:02d}db".encode()}
    frames = []
    if index is not None:
        base = movi[0]
        for j in range(index[1] // 16):
            name, _, place, size = struct.unpack_from("<4sIII", data, index[0] + 16 * j)
            if name in want:
                at = base + place
                if data[at : at + 4] != name and data[place : place + 4] == name:
                    at = place  # some writers count from the file's start
                frames.append(data[at + 8 : at + 8 + size])
    else:
        frames = [data[a : a + n] for name, a, n in _walk(data, movi[0] + 4, movi[0] + movi[1]) if name in want]
    return Film(rate or tick or 1 / 25, frames, private)


@dataclass(frozen=True)
class Layout:
    """What a frame's header fixes: size, components' sampling, quantisers and code tables."""

    width: int
    height: int
    sampling: tuple  # (h, v, quantiser, DC table, AC table) of each component
    quantisers: tuple
    tables: tuple
    restart: int


@cache
def _layout(header: bytes) -> Layout:
    quant, tables, restart, frame, scan = {}, dict(TYPICAL_TABLES), 0, None, None
    at = 2
    while at + 4 <= len(header):
        marker, size = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                quant[name] = tuple(struct.unpack_from(">64H" if wide else ">64B", body, 1))
                body = body[1 + 64 * (1 + wide) :]
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("only 8-bit frames")
            frame = (width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC2 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only baseline frames")
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if frame is None or scan is None or any(c[0] not in scan for c in frame[2]):
        raise ValueError("a frame needs one scan of all its components")
    try:
        sampling = tuple((h, v, quant[q], tables[scan[c] >> 4], tables[16 | (scan[c] & 15)]) for c, h, v, q in frame[2])
    except KeyError:
        raise ValueError("a frame lacks its tables") from None
    names = list(dict.fromkeys(t for s in sampling for t in s[3:]))
    sampling = tuple((h, v, q, names.index(dc), names.index(ac)) for h, v, q, dc, ac in sampling)
    if len(sampling) == 1:
        sampling = ((1, 1, *sampling[0][2:]),)
    return Layout(frame[0], frame[1], sampling, tuple(s[2] for s in sampling), tuple(names), restart)


@cache
def _stacked(tables: tuple) -> tuple[np.ndarray, np.ndarray]:
    found = [_lookup(list(c), list(s)) for c, s in tables]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def split_frame(jpeg: bytes) -> tuple[bytes, bytes]:
    """(everything up to the entropy-coded data, that data)."""
    if jpeg.startswith(HEADER):
        at = len(HEADER)
    else:
        if jpeg[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        at = 2
        while True:
            if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
                raise ValueError("broken frame header")
            marker = jpeg[at + 1]
            at += 2 + struct.unpack_from(">H", jpeg, at + 2)[0]
            if marker == 0xDA:
                break
    end = jpeg.rfind(b"\xff\xd9")
    return jpeg[:at], jpeg[at : end if end >= at else len(jpeg)]


def decode_coefficients(layout: Layout, scans: list[bytes]) -> np.ndarray:
    """Quantised coefficients (frames, blocks in scan order, 64) of frames that share a layout.

    Every restart interval of every frame is a lane; all lanes advance one symbol at a time.
    """
    per_mcu = [c for c, s in enumerate(layout.sampling) for _ in range(s[0] * s[1])]
    hmax, vmax = max(s[0] for s in layout.sampling), max(s[1] for s in layout.sampling)
    mcus = -(-layout.width // (8 * hmax)) * -(-layout.height // (8 * vmax))
    n_blocks = mcus * len(per_mcu)
    raw = np.frombuffer(b"".join(s + b"\xff\xd7" for s in scans), np.uint8)  # a marker closes each frame
    ends = np.cumsum([len(s) + 2 for s in scans])
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    mark = ff[(follow >= 0xD0) & (follow <= 0xD7)]
    drop = np.zeros(len(raw), bool)
    drop[ff[follow == 0] + 1] = True
    drop[mark] = drop[mark + 1] = True
    kept = np.concatenate([[0], np.cumsum(~drop)])
    data = np.concatenate([raw[~drop], np.full(8, 0xFF, np.uint8)])
    wide = (data[:-3].astype(np.uint32) << 24) | (data[1:-2].astype(np.uint32) << 16) | (data[2:-1].astype(np.uint32) << 8) | data[3:]
    lane_end = kept[mark]
    lane_start = np.concatenate([[0], lane_end[:-1]])
    frame = np.searchsorted(ends, mark, "right")
    nth = np.arange(len(mark)) - np.searchsorted(frame, frame, "left")
    span = (layout.restart or mcus) * len(per_mcu)
    block = frame * n_blocks + nth * span
    left = np.minimum(span, n_blocks - nth * span)
    ok = left > 0
    bit, block, left, stop = lane_start[ok] * 8, block[ok], left[ok], lane_end[ok] * 8
    comp = np.array(per_mcu)
    dc_of, ac_of = (np.array([s[j] for s in layout.sampling]) << 16 for j in (3, 4))
    lengths, symbols = _stacked(layout.tables)
    n_comp = len(layout.sampling)
    pred = np.zeros((len(bit), n_comp), np.int64)
    out = np.zeros(len(scans) * n_blocks * 64, np.int16)
    k = np.zeros(len(bit), np.int64)
    done = np.zeros(len(bit), np.int64)  # blocks of the lane
    single = n_comp == 1
    limit = len(wide) - 1
    while len(bit):
        c = np.zeros(len(bit), np.int64) if single else comp[done % len(comp)]
        peek = ((wide[np.minimum(bit >> 3, limit)] << (bit & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)
        at = peek + np.where(k == 0, dc_of[c], ac_of[c])
        used, symbol = lengths[at], symbols[at]
        if not used.all():
            raise ValueError("broken entropy-coded data")
        bit = bit + used
        first = k == 0
        size = np.where(first, symbol, symbol & 15)
        more = (wide[np.minimum(bit >> 3, limit)] << (bit & 7).astype(np.uint32)).astype(np.int64) >> (32 - size)
        bit = bit + size
        value = np.where(size == 0, 0, np.where(more >> np.maximum(size - 1, 0) == 1, more, more - (np.int64(1) << size) + 1))
        run = np.where(first, 0, symbol >> 4)
        k = k + run
        if first.any():
            rows = np.flatnonzero(first)
            pred[rows, c[rows]] += value[rows]
            value[rows] = pred[rows, c[rows]]
        write = (first | (size > 0)) & (k < 64)
        out[(block * 64 + k)[write]] = value[write]
        ended = ~first & (size == 0) & (run != 15)
        k = np.where(ended, 64, k + 1)
        over = k >= 64
        if over.any():
            k[over] = 0
            block = block + over
            done = done + over
            live = done < left
            if (bit > stop).any():
                raise ValueError("entropy-coded data ends early")
            if not live.all():
                bit, k, block, done, left, stop, pred = bit[live], k[live], block[live], done[live], left[live], stop[live], pred[live]
    return out.reshape(len(scans), n_blocks, 64)


def luminance(layout: Layout, coefs: np.ndarray) -> np.ndarray:
    """Pixels (frames, height, width) of the first component."""
    h, v, quant, _, _ = layout.sampling[0]
    hmax, vmax = max(s[0] for s in layout.sampling), max(s[1] for s in layout.sampling)
    across, down = -(-layout.width // (8 * hmax)), -(-layout.height // (8 * vmax))
    per_mcu = sum(s[0] * s[1] for s in layout.sampling)
    n = len(coefs)
    own = coefs.reshape(n, down * across, per_mcu, 64)[:, :, : h * v]
    full = np.zeros((own.size // 64, 64), np.float32)
    full[:, ZIGZAG] = own.reshape(-1, 64) * np.array(quant, np.float32)
    half = (full.reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    pixels = (np.ascontiguousarray(half).reshape(-1, 8) @ _BASIS).reshape(-1, 8, 8).transpose(0, 2, 1)
    pixels = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8)
    image = pixels.reshape(n, down, across, v, h, 8, 8).transpose(0, 1, 3, 5, 2, 4, 6).reshape(n, down * v * 8, across * h * 8)
    return image[:, : -(-layout.height * v // vmax), : -(-layout.width * h // hmax)]


def histograms(images: np.ndarray) -> np.ndarray:
    n = len(images)
    flat = images.reshape(n, -1).astype(np.int64) * HIST_BINS >> 8
    return np.bincount((flat + np.arange(n)[:, None] * HIST_BINS).reshape(-1), minlength=n * HIST_BINS).reshape(n, HIST_BINS)


def shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first, last frame) of each shot: cut where the histogram difference tops the recent mean by SPREAD deviations."""
    if len(hist) == 0:
        return []
    share = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    change = (np.abs(np.diff(share, axis=0)).sum(1) / 2).tolist()
    cuts, seen = [0], []
    for i, d in enumerate(change):
        recent = seen[-LOOK_BACK:]
        mean = sum(recent) / len(recent) if recent else 0.0
        spread = (sum((x - mean) ** 2 for x in recent) / len(recent)) ** 0.5 if recent else 0.0
        if d > max(LEAST, mean + SPREAD * spread):
            cuts.append(i + 1)
            seen = []
        else:
            seen.append(d)
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(hist)], strict=True)]


@dataclass
class Decoded:
    seconds_per_frame: float
    frames: int
    clips: list[tuple[int, int]]
    private: bytes
    blocks: list[np.ndarray]  # the coefficients of runs of frames
    error: str | None = None


def decode_films(files: list[bytes | None]) -> list[Decoded]:
    """All files together: frames that share a header are decoded side by side."""
    films: list[Film | None] = []
    errors: list[str | None] = []
    groups: dict[bytes, list[tuple[int, int, bytes]]] = {}
    for i, data in enumerate(files):
        try:
            film = decode_avi(data or b"")
            parts = [split_frame(f) for f in film.frames]
            for head in {p[0] for p in parts}:
                _layout(head)
            films.append(film)
            errors.append(None)
            for j, (head, scan) in enumerate(parts):
                groups.setdefault(head, []).append((i, j, scan))
        except (ValueError, struct.error, IndexError) as e:
            films.append(None)
            errors.append(str(e) or "broken file")
    hist = [np.zeros((len(f.frames) if f else 0, HIST_BINS), np.int64) for f in films]
    blocks: list[list] = [[None] * (len(f.frames) if f else 0) for f in films]
    for head, members in groups.items():
        layout = _layout(head)
        try:
            runs = [(members, decode_coefficients(layout, [m[2] for m in members]))]
        except ValueError:  # find the broken frames one by one
            runs = []
            for m in members:
                try:
                    runs.append(([m], decode_coefficients(layout, [m[2]])))
                except ValueError as e:
                    errors[m[0]] = str(e)
        for own, coefs in runs:
            h = histograms(luminance(layout, coefs))
            for row, (i, j, _) in enumerate(own):
                hist[i][j] = h[row]
                blocks[i][j] = coefs[row]
    out = []
    for film, h, b, error in zip(films, hist, blocks, errors, strict=True):
        if film is None or error:
            out.append(Decoded(0.0, 0, [], b"", [], error))
        else:
            out.append(Decoded(film.seconds_per_frame, len(film.frames), shots(h), film.private, b))
    return out


# ---------------------------------------------------------------- DataFrame operators


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as a motion-JPEG file; null text is empty."""

    def run(batches):
        for batch in chunks(batches, limit=PIECE):
            buf, offsets = text_buffer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(encode_avi(buf, offsets), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, clip, first_frame, last_frame, start_s, end_s): a row for each shot of each file."""

    def run(batches):
        for batch in chunks(batches, "media", PIECE):
            rows = []
            for name, film in zip(batch.column("id").to_pylist(), decode_films(batch.column("media").to_pylist()), strict=True):
                t = film.seconds_per_frame
                rows += [(name, c, a, b, a * t, (b + 1) * t) for c, (a, b) in enumerate(film.clips)]
            kinds = [batch.schema.field("id").type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "clip", "first_frame", "last_frame", "start_s", "end_s"])

    kind = dict(media.dtypes)[id_col]
    out = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, f"id {kind}, clip int, first_frame long, last_frame long, start_s double, end_s double")
    return out.withColumnRenamed("id", id_col)


def payload_of(film: Decoded) -> bytes:
    """The bytes that encode_avi stored."""
    n = struct.unpack("<Q", film.private)[0]
    return (np.concatenate(film.blocks).reshape(-1)[:n] + 128).astype(np.uint8).tobytes()


def digests(media: DataFrame) -> DataFrame:
    """What is read back of each stored file: payload, its digests and the clips as text."""

    def run(batches):
        for batch in chunks(batches, "media", PIECE):
            files = batch.column("media").to_pylist()
            rows = []
            for data, film in zip(files, decode_films(files), strict=True):
                payload = payload_of(film)
                t = film.seconds_per_frame
                feature = f"{film.frames} frames: " + " ".join(f"{a * t:.1f}-{(b + 1) * t:.1f}" for a, b in film.clips)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(film.clips)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips int")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tables import table, texts

    return digests(to_media(texts(table(spark, sf_dir, "documents"))))
