"""PNG of every depth, filter and interlace against a plain encoder; damaged files are errors, never crashes."""

import random
import struct
import sys
import time
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from glyphflow.plans import workflow as W
from glyphflow.sources import images

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import tests


def predicted(kind, left, up, corner):
    if kind < 2:
        return left if kind else 0
    if kind == 2:
        return up
    if kind == 3:
        return (left + up) // 2
    p = left + up - corner
    return min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]


def filtered(rows, step, kinds):
    """Rows of bytes with their filters applied, byte by byte."""
    out, above = b"", [0] * len(rows[0])
    for y, row in enumerate(rows):
        kind = kinds[y % len(kinds)]
        at = lambda line, k: line[k] if k >= 0 else 0
        out += bytes([kind]) + bytes((row[k] - predicted(kind, at(row, k - step), above[k], at(above, k - step))) & 255 for k in range(len(row)))
        above = row
    return out


def packed(samples, bits):
    """Rows of samples (h x w*channels) as bytes."""
    if bits == 16:
        return [b"".join(struct.pack(">H", v) for v in row) for row in samples.tolist()]
    return [np.packbits((np.array(row)[:, None] >> np.arange(bits)[::-1] & 1).ravel().astype(np.uint8)).tobytes() for row in samples.tolist()]


def png(samples, bits, colour, kinds=(0,), lace=0, palette=None):
    h, w, channels = samples.shape
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b""
    for x0, y0, dx, dy in images._PASSES if lace else ((0, 0, 1, 1),):
        some = samples[y0::dy, x0::dx]
        if some.size:
            raw += filtered(packed(some.reshape(len(some), -1), bits), max(1, channels * bits // 8), kinds)
    head = part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, lace))
    return images._PNG + head + (part(b"PLTE", palette.tobytes()) if palette is not None else b"") + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


CASES = [(c, b) for c, depths in images._DEPTHS.items() for b in depths]


@pytest.mark.parametrize("lace", [0, 1])
@pytest.mark.parametrize("colour, bits", CASES)
def test_png(colour, bits, lace):
    r, channels = np.random.default_rng(bits * 10 + colour), images._CHANNELS[colour]
    for h, w in ((1, 1), (5, 3), (13, 17)):
        a = r.integers(0, 1 << bits, (h, w, channels))
        palette = r.integers(0, 256, (1 << bits, 3)).astype(np.uint8) if colour == 3 else None
        got = images.decode(png(a, bits, colour, (0, 1, 2, 3, 4, 4, 3, 1), lace, palette))
        if colour == 3:
            want = palette[a[..., 0]]
        else:
            eight = a >> 8 if bits == 16 else a * 255 // ((1 << bits) - 1)
            want = eight[..., :3] if channels > 2 else np.repeat(eight[..., :1], 3, axis=2)
        assert (got == want).all()


def test_blocks_of_filters(monkeypatch):
    monkeypatch.setattr(images, "_BLOCK", 1)
    r = random.Random(1)
    a = np.random.default_rng(2).integers(0, 256, (70, 9, 3))
    for _ in range(5):
        assert (images.decode(png(a, 8, 2, [r.randrange(5) for _ in range(70)])) == a).all()


def test_damaged():
    a = np.arange(60).reshape(4, 5, 3)
    good = png(a, 8, 2)
    palette = np.zeros((2, 3), np.uint8)
    bad = [good[:n] for n in range(8, len(good) - 13)] + [
        png(a[..., :1], 8, 3), png(a[..., :1], 8, 3, palette=palette), good.replace(b"IHDR", b"IHDX"), good[:8] + b"\xff" * 40,
        images._PNG + struct.pack(">I4s", 13, b"IHDR") + struct.pack(">IIBBBBB", 1 << 20, 1 << 20, 8, 2, 0, 0, 0) + b"\0" * 4, png(a, 8, 2, (0,), 0)[:-20], b"GIF89a", png(np.zeros((2, 2, 1), int), 3, 0),
    ]
    for raw in bad:
        with pytest.raises(ValueError):
            images.decode(raw)
    with pytest.raises(ValueError):
        images.decode(good, most=19)


def test_speed_of_real_filters():
    a = np.random.default_rng(3).integers(0, 256, (640, 640, 3)).astype(np.uint8)
    raw, best = b"".join(bytes([4]) + row.tobytes() for row in a.reshape(640, -1)), 9.0
    for _ in range(3):
        start = time.process_time()
        images._unfiltered(raw, 640, 1920, 3)
        best = min(best, time.process_time() - start)
    assert best < 0.4  # byte by byte: some two seconds


def test_no_row_ends_a_job(spark):
    class Picky:
        def detect(self, image):
            if image.max() > 200:
                raise RuntimeError("too bright")
            return [W.Box([(0, 0), (1, 0), (1, 1), (0, 1)], 0.25)]

    class Hello:
        def recognise(self, image, quad):
            return "hi", 0.5

    W.STAGES["picky"], W.STAGES["hello"] = Picky, Hello
    W.workflow("picky", detect="picky", recognise="hello")
    dim, bright = (images.encode_png(np.full((3, 3, 3), v, np.uint8)) for v in (9, 250))
    broken = png(np.full((2, 2, 1), 7), 8, 3, palette=np.zeros((2, 3), np.uint8))
    rows = spark.createDataFrame([("a", dim), ("b", bright), ("c", broken), ("d", None), ("e", bytearray(b"junk"))], "name string, content binary")
    e = W.Engine(W.with_workflow("picky"))
    got = {r.key: (r.status, r.error, r.text) for r in e.transform(rows, "name").collect()}
    assert got["a"] == (200, None, "hi") and got["b"] == (500, "detection: too bright", None)
    assert [got[k][0] for k in "cde"] == [400] * 3
    found = {r.key: (r.status, r.score, r.x1) for r in e.detect_frames(rows, "name").collect()}
    assert found["a"] == (200, 0.25, 1) and found["b"][0] == 500 and found["c"][0] == 400
