"""Images as bytes: PNG and raw bitmaps in numpy, base64 and multipart requests, folders of files.

PNG is read here (all depths, interlaced or not; 16 bits are cut to their high byte, transparency is left out) and written
(8 bits); other formats go through Pillow where it is installed.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(image: np.ndarray) -> bytes:
    h, w = image.shape[:2]
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(image[..., :3], np.uint8))
    return _PNG + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


#: Samples that the wavefront of one block of rows holds.
_BLOCK = 1 << 22


def _wavefront(kinds: np.ndarray, raw: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Rows of mean or Paeth filters below a finished row. A pixel needs those to its left, above and above left, so all pixels of
    an anti-diagonal are done at once. ``raw``: rows x pixels x bytes; rows are skewed, row j by j places."""
    m, w, step = raw.shape
    at, skewed = np.zeros((w + m + 1, m + 1, step), np.int16), np.zeros((w + m + 1, m + 1, step), np.int16)
    j, x = np.mgrid[1 : m + 1, 0:w]
    skewed[x + j, j] = raw
    at[np.arange(w), 0] = above
    paeth, mixed = bool((kinds == 4).any()), len(np.unique(kinds)) > 1
    is_paeth = (kinds == 4)[:, None]
    for d in range(1, w + m):
        lo, hi = max(1, d - w + 1), min(m, d) + 1
        left, up = at[d - 1, lo:hi], at[d - 1, lo - 1 : hi - 1]
        if paeth:
            corner = at[d - 2, lo - 1 : hi - 1] if d > 1 else np.zeros_like(up)
            by_left, by_up = up - corner, left - corner
            by_corner = np.abs(by_left + by_up)
            by_left, by_up = np.abs(by_left), np.abs(by_up)
            more = np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))
            if mixed:
                more = np.where(is_paeth[lo - 1 : hi - 1], more, (left + up) >> 1)
        else:
            more = (left + up) >> 1
        at[d, lo:hi] = (skewed[d, lo:hi] + more) & 255
    return at[x + j, j].astype(np.uint8)


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    """Bytes of the rows of an image, each behind a byte that names its filter."""
    rows = np.frombuffer(raw, np.uint8, h * (stride + 1)).reshape(h, stride + 1)
    kinds, data = rows[:, 0], rows[:, 1:]
    if (kinds > 4).any():
        raise ValueError("unknown filter")
    pad = -stride % step  # rows under one byte a pixel have none to spare, others are whole pixels
    out, y, most = np.zeros((h, stride + pad), np.uint8), 0, max(16, _BLOCK // max(1, stride))
    while y < h:
        above = out[y - 1] if y else np.zeros(stride + pad, np.uint8)
        if kinds[y] < 3:
            line = np.pad(data[y], (0, pad))
            out[y] = line if kinds[y] == 0 else np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if kinds[y] == 1 else line + above
            y += 1
            continue
        end = y + 1
        while end < h and end - y < most and kinds[end] > 2:
            end += 1
        block = np.pad(data[y:end], ((0, 0), (0, pad))).reshape(end - y, -1, step)
        out[y:end] = _wavefront(kinds[y:end], block, above.reshape(-1, step)).reshape(end - y, -1)
        y = end
    return out[:, :stride]


def _samples(raw: bytes, w: int, h: int, bits: int, channels: int) -> tuple[np.ndarray, int]:
    """h x w x channels of one pass (8 bits; fewer as they are), and how many bytes it took."""
    stride = -(-w * channels * bits // 8)
    rows = _unfiltered(raw, h, stride, max(1, channels * bits // 8))
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        rows = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    return rows[:, : w * channels].reshape(h, w, channels), h * (stride + 1)


# First column and row, and steps, of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


def _png(content: bytes, most: int) -> np.ndarray:
    at, body, palette, head, kind = 8, [], None, None, b""
    while kind != b"IEND":
        n, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", content, at + 8 + n)[0] != zlib.crc32(kind + data):
            raise ValueError("checksum")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(data)
        at += n + 12
    if head is None:
        raise ValueError("no header")
    w, h, bits, colour, _, _, lace = head
    if not w or not h or bits not in _DEPTHS.get(colour, ()) or lace > 1:
        raise ValueError("no such size or kind")
    if w * h > most:
        raise ValueError(f"more than {most} pixels")
    channels = _CHANNELS[colour]
    room = sum(-(-(h - y0) // dy) * (1 + -(-(-(-(w - x0) // dx)) * channels * bits // 8)) for x0, y0, dx, dy in (_PASSES if lace else ((0, 0, 1, 1),)) if w > x0 and h > y0)
    raw = zlib.decompressobj().decompress(b"".join(body), room)
    if len(raw) < room:
        raise ValueError("cut off")
    out, at = np.zeros((h, w, channels), np.uint8), 0
    for x0, y0, dx, dy in _PASSES if lace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            out[y0::dy, x0::dx], size = _samples(raw[at:], pw, ph, bits, channels)
            at += size
    if colour == 3:
        if palette is None or out.max() >= len(palette):
            raise ValueError("colour beyond the palette")
        return palette[out[..., 0]]
    if bits < 8:
        out = (out.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    return np.repeat(out[..., :1], 3, axis=2) if channels < 3 else np.ascontiguousarray(out[..., :3])


#: Pixels of the largest image that is decoded.
LARGEST = 1 << 28


def decode(content: bytes | None, most: int = LARGEST) -> np.ndarray:
    """H x W x 3 of an image; ValueError where it is none, is damaged, or has more than ``most`` pixels."""
    if not content:
        raise ValueError("no image")
    content = bytes(content)
    if content.startswith(_PNG):
        try:
            return _png(content, most)
        except (struct.error, zlib.error, ValueError, IndexError) as e:
            raise ValueError(f"bad image: {e}") from None
    try:
        from PIL import Image
    except ImportError:
        raise ValueError("unknown image format") from None
    try:
        image = Image.open(io.BytesIO(content))
        if image.width * image.height > most:
            raise ValueError(f"more than {most} pixels")
        return np.asarray(image.convert("RGB"))
    except Exception as e:
        raise ValueError(f"bad image: {e}") from None


def size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height; of a PNG from its header alone. None where the image cannot be read."""
    if content and content.startswith(_PNG) and content[12:16] == b"IHDR" and len(content) > 24:
        return struct.unpack_from(">II", content, 16)
    try:
        return decode(content).shape[1::-1]
    except ValueError:
        return None


@F.arrow_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def sizes(content: pa.Array) -> pa.Array:
    got = [size(c) or (None, None) for c in content.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in (0, 1)], ["width", "height"])


#: Rows of pixels that leave a worker at a time.
PIXELS = 1 << 16


def pixels(frames: DataFrame, margin: int = 0) -> DataFrame:
    """image_id, x, y, r, g, b of the pixels within ``margin`` of the boxes of every image. ``frames``: image_id, content, boxes (array of
    x0, y0, x1, y1). Images that cannot be read have none."""

    def rows(batches):
        for b in batches:
            for i, content, boxes in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                try:
                    image = decode(content)
                except ValueError:
                    continue
                wanted = np.zeros(image.shape[:2], bool)
                for q in boxes or ():
                    wanted[max(0, q["y0"] - margin) : max(0, q["y1"] + margin), max(0, q["x0"] - margin) : max(0, q["x1"] + margin)] = True
                y, x = np.nonzero(wanted)
                for k in range(0, len(y), PIXELS):
                    ys, xs = y[k : k + PIXELS], x[k : k + PIXELS]
                    at = image[ys, xs].astype(np.int64)
                    own = pa.array([i.as_py()] * len(ys), b.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([own, *(pa.array(v) for v in (xs, ys, at[:, 0], at[:, 1], at[:, 2]))], ["image_id", "x", "y", "r", "g", "b"])

    kind = T.StructType([frames.schema["image_id"], *(T.StructField(c, T.LongType()) for c in ("x", "y", "r", "g", "b"))])
    return frames.select("image_id", "content", "boxes").mapInArrow(rows, kind)


def data_url(content: bytes, kind: str = "image/png") -> str:
    return f"data:{kind};base64,{base64.b64encode(content).decode()}"


def data_urls(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content), "\r\n", ""))  # Spark breaks lines


def from_base64(text: Column) -> Column:
    """Bytes of base64 text, standard or URL-safe, with or without a data URL in front and spaces around; null where it is none."""
    plain = F.regexp_replace(F.trim(text), "^data:[^,]*,", "")
    return F.try_to_binary(F.translate(plain, "-_", "+/"), F.lit("base64"))


def requests(frames: DataFrame) -> DataFrame:
    """``frames`` (content_type, body as bytes) with content, error (the same for all that is wrong with an image) and reason: JSON
    bodies hold {"image": base64}, multipart bodies a part of the name image."""

    @F.arrow_udf("binary")
    def of(kinds: pa.Array, bodies: pa.Array) -> pa.Array:
        return pa.array([part_of(k, b or b"")[0] for k, b in zip(kinds.to_pylist(), bodies.to_pylist())], pa.binary())

    is_ = lambda kind: F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit(kind))
    multipart, plain = is_("multipart/form-data"), is_("application/json")
    text = F.decode("body", "UTF-8")
    read = F.from_json(text, "image string, whole string", {"columnNameOfCorruptRecord": "whole"})
    broken = read.isNull() | read["whole"].isNotNull()
    part = of(F.when(multipart, F.col("content_type")), F.when(multipart, F.col("body")))  # other rows are not read there
    content = F.when(multipart, part).when(plain & ~broken, from_base64(read["image"]))
    reason = F.when(multipart, F.when(part.isNull(), "no image part").when(F.octet_length(part) == 0, "empty image")).when(
        plain, F.when(broken, "bad json").when(F.coalesce(read["image"], F.lit("")) == "", "empty image").when(content.isNull(), "bad base64").when(F.octet_length(content) == 0, "empty image")
    ).otherwise("unsupported content type")
    d = frames.withColumn("content", F.when(reason.isNull(), content)).withColumn("reason", reason)
    return d.withColumn("error", F.when(F.col("content").isNull(), F.lit("invalid image")))


def part_of(kind: str, body: bytes, name: str = "image") -> tuple[bytes | None, str | None]:
    """The part of a multipart body with a name."""
    m = re.search(r'boundary="?([^";]+)', kind or "")
    for part in body.split(b"--" + m[1].encode()) if m else []:
        head, _, data = part.partition(b"\r\n\r\n")
        if re.search(rb'name="%s"' % name.encode(), head):
            return data.removesuffix(b"\r\n"), None
    return None, f"no field {name}"


def json_image(body: str) -> bytes:
    """Bytes of the image in a JSON request; ValueError where there is none."""
    try:
        return base64.b64decode(json.loads(body)["image"].strip().replace("-", "+").replace("_", "/"), validate=True)
    except Exception:
        raise ValueError("invalid image") from None


def folder(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """path, content of the files of a folder, read in parallel."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
