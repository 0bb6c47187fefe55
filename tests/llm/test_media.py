"""Films against other ways to read them: the JVM's JPEG codec, the movi list, a plain cut of shots."""

import struct

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import media as M
from quillstream.llm.textkit import text_buffer


def jpeg(jvm, gateway, pixels, colour):
    """The JVM's JPEG of (height, width) or (height, width, 3) pixels."""
    kinds = jvm.java.awt.image.BufferedImage
    h, w = pixels.shape[:2]
    image = kinds(w, h, kinds.TYPE_INT_RGB if colour else kinds.TYPE_BYTE_GRAY)
    flat = pixels.reshape(h * w, -1).astype(int)
    if colour:
        values = gateway.new_array(jvm.int, h * w)
        for i, (r, g, b) in enumerate(flat.tolist()):
            values[i] = (r << 16) | (g << 8) | b
        image.setRGB(0, 0, w, h, values, 0, w)
    else:
        values = gateway.new_array(jvm.int, h * w)
        for i, (v,) in enumerate(flat.tolist()):
            values[i] = v
        image.getRaster().setPixels(0, 0, w, h, values)
    out = jvm.java.io.ByteArrayOutputStream()
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def without_tables(data):
    """The frame less its Huffman tables."""
    out, at = data[:2], 2
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker != 0xC4:
            out += data[at : at + 2 + size]
        at += 2 + size
        if marker == 0xDA:
            return out + data[at:]


def smooth(rng, h, w):
    """A picture with little detail, which JPEG keeps well."""
    y, x = np.mgrid[:h, :w] / 16
    return np.clip(128 + 90 * np.sin(x + rng.random()) * np.cos(y + rng.random()), 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def codec(spark):
    return spark.sparkContext._jvm, spark.sparkContext._gateway


def test_typical_tables_are_the_standards(codec):
    tables = codec[0].javax.imageio.plugins.jpeg.JPEGHuffmanTable
    for key, name in {0x00: "StdDCLuminance", 0x01: "StdDCChrominance", 0x10: "StdACLuminance", 0x11: "StdACChrominance"}.items():
        counts, symbols = M.TYPICAL_TABLES[key]
        want = getattr(tables, name)
        lengths = list(want.getLengths())
        assert list(counts) == lengths + [0] * (16 - len(lengths)) and list(symbols) == list(want.getValues())


@pytest.mark.parametrize("colour", [False, True])
@pytest.mark.parametrize("size", [(32, 48), (37, 21)])
def test_frames_of_another_encoder(codec, colour, size):
    rng = np.random.default_rng(3)
    grey = smooth(rng, *size)
    pixels = np.stack([grey, smooth(rng, *size), smooth(rng, *size)], axis=2) if colour else grey
    data = jpeg(*codec, pixels, colour)
    assert without_tables(data) != data
    images = []
    for frame in (data, without_tables(data)):
        head, scan = M.split_frame(frame)
        layout = M._layout(head)
        images.append(M.luminance(layout, M.decode_coefficients(layout, [scan, scan]))[1])
    assert (images[0] == images[1]).all() and images[0].shape == size
    want = pixels @ [0.299, 0.587, 0.114] if colour else grey
    assert np.abs(images[0].astype(float) - want).mean() < 6


def test_movi_list_gives_the_index_s_frames():
    buf, at = text_buffer(pa.array(["one film " * 900, "", "z" * 5000]))
    for data in M.encode_avi(buf, at):
        place = data.rindex(b"idx1")
        bare = data[:place]
        bare = bare[:4] + struct.pack("<I", len(bare) - 8) + bare[8:]
        from_start = data[: place + 8]  # offsets from the file's start
        base = data.index(b"movi")
        for j in range((len(data) - place - 8) // 16):
            name, flags, offset, size = struct.unpack_from("<4sIII", data, place + 8 + 16 * j)
            from_start += struct.pack("<4sIII", name, flags, offset + base, size)
        frames = M.decode_avi(data).frames
        assert frames and frames == M.decode_avi(bare).frames == M.decode_avi(from_start).frames


def plain_shots(hist):
    """First frames of shots, by the rule in words."""
    firsts, changes = [0], []
    for i in range(1, len(hist)):
        a, b = hist[i - 1] / hist[i - 1].sum(), hist[i] / hist[i].sum()
        d = 0.5 * np.abs(a - b).sum()
        last = changes[-M.LOOK_BACK :]
        limit = max(M.LEAST, np.mean(last) + M.SPREAD * np.std(last)) if last else M.LEAST
        if d > limit:
            firsts.append(i)
            changes = []
        else:
            changes.append(d)
    return firsts


def test_shots_against_a_plain_cut():
    rng = np.random.default_rng(8)
    images, scenes = [], []
    for level in (20, 120, 220, 90, 160):  # five scenes with noise
        scenes.append(len(images))
        images += [np.clip(level + rng.normal(0, 12, (24, 24)), 0, 255).astype(np.uint8) for _ in range(int(rng.integers(4, 20)))]
    images = np.stack(images)
    hist = M.histograms(images)
    for h, image in zip(hist, images, strict=True):
        assert h.tolist() == [int(((image >= 256 * k // M.HIST_BINS) & (image < 256 * (k + 1) // M.HIST_BINS)).sum()) for k in range(M.HIST_BINS)]
    found = M.shots(hist)
    assert [a for a, _ in found] == plain_shots(hist) and set(scenes) <= {a for a, _ in found}
    assert [b + 1 for _, b in found] == [a for a, _ in found[1:]] + [len(images)]
    for _ in range(50):
        hist = rng.integers(0, 50, (int(rng.integers(1, 40)), M.HIST_BINS)) + 1
        assert [a for a, _ in M.shots(hist)] == plain_shots(hist)
    assert M.shots(hist[:0]) == []
