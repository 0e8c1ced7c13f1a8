"""Raster kernels in numpy (H x W x 3 arrays of bytes), and their Arrow-batched columns over images held as rows."""

from __future__ import annotations

import numpy as np

MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def bilinear(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples at real coordinates: neighbours clamped to the image, blended on 16 bits and cut to 8."""
    h, w = image.shape[:2]
    x0, y0 = np.trunc(x).astype(int), np.trunc(y).astype(int)
    fx, fy = (x - x0)[..., None], (y - y0)[..., None]
    cx, cy = (lambda v: np.clip(v, 0, w - 1)), (lambda v: np.clip(v, 0, h - 1))
    at = lambda yy, xx: image[cy(yy), cx(xx)].astype(float) * 257
    top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.clip(np.trunc((top * (1 - fy) + low * fy) / 257 + 1e-9), 0, 255).astype(np.uint8)


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear resize without a shift by half a pixel."""
    h, w = image.shape[:2]
    y, x = np.mgrid[0:height, 0:width].astype(float)
    return bilinear(image, x * w / width, y * h / height)


def homographies(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrices that take four points each of ``src`` (N x 4 x 2) to ``dst`` (4 x 2, or N of them); not numbers where there
    is none, as three of the points lie on a line."""
    src = np.asarray(src, float)
    dst = np.broadcast_to(np.asarray(dst, float), src.shape)
    x, y, u, v = src[..., 0], src[..., 1], dst[..., 0], dst[..., 1]
    one, zero = np.ones_like(x), np.zeros_like(x)
    rows = np.stack([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y], -1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y], -1)], 2).reshape(-1, 8, 8)
    want = dst.reshape(-1, 8)
    h, sound = np.full((len(rows), 8), np.nan), np.linalg.matrix_rank(rows) == 8
    h[sound] = np.linalg.solve(rows[sound], want[sound][..., None])[..., 0]
    return np.concatenate([h, np.ones((len(h), 1))], axis=1).reshape(-1, 3, 3)


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3 x 3 matrix that takes four points of ``src`` to ``dst``."""
    return homographies(np.asarray(src, float)[None], dst)[0]


def inverse(h: np.ndarray) -> np.ndarray:
    return h if abs(np.linalg.det(h)) < 1e-12 else np.linalg.inv(h)


def warp(image: np.ndarray, quad: np.ndarray, width: int, height: int) -> np.ndarray:
    """The quad (top left, top right, bottom right, bottom left) of an image as a straight picture; white where it leaves it. ValueError
    where no map does that: the quad has no area, or the picture no second row or column."""
    width, height = max(1, width), max(1, height)
    to = [(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)]
    there = homography(np.asarray(quad, float), np.array(to, float))
    if np.isnan(there).any():
        raise ValueError("a quad without area")
    back = inverse(there)
    y, x = np.mgrid[0:height, 0:width].astype(float)
    u, v, w = np.tensordot(back, np.stack([x, y, np.ones_like(x)]), 1)
    flat = abs(w) < 1e-10
    w = np.where(flat, 1.0, w)
    sx, sy = np.round(u / w, 9), np.round(v / w, 9)
    h0, w0 = image.shape[:2]
    out = ~flat & (sx >= 0) & (sy >= 0) & (sx <= w0 - 1) & (sy <= h0 - 1)
    return np.where(out[..., None], bilinear(image, np.where(out, sx, 0), np.where(out, sy, 0)), 255).astype(np.uint8)


def ordered(quad) -> np.ndarray:
    """The points of least and largest sums and differences: top left, top right, bottom right, bottom left; first on ties."""
    q = np.array(quad, float)
    total, side = q.sum(axis=1), q[:, 0] - q[:, 1]
    return q[[total.argmin(), side.argmax(), total.argmax(), side.argmin()]]


def sides(quad: np.ndarray) -> tuple[float, float]:
    """Longer width and longer height of an ordered quad."""
    size = lambda a, b: float(np.hypot(*(quad[a] - quad[b])))
    return max(size(0, 1), size(3, 2)), max(size(0, 3), size(1, 2))


def line_crop(image: np.ndarray, quad, height: int = 48) -> np.ndarray:
    """A quad as a line of ``height``: straight, its width in proportion; one that stands upright is read down, turned to the left."""
    q = ordered(quad)
    w, h = sides(q)
    h = max(h, 1.0)
    length = lambda v: max(1, int(np.floor(v + 0.5)))
    if h > w:
        return rotate_ccw(warp(image, q, height, length(height * h / w) if w else 1))
    return warp(image, q, length(height * w / h), height)


def region_crop(image: np.ndarray, quad) -> np.ndarray:
    """A quad laid straight in its own size, fractions cut off, without turning it."""
    q = ordered(quad)
    return warp(image, q, *(max(1, int(v)) for v in sides(q)))


def rotate_ccw(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.rot90(image))


def nchw(image: np.ndarray, mean=MEAN, std=STD) -> np.ndarray:
    """1 x 3 x H x W floats, scaled to one and normalised by channel."""
    x = (image.astype(np.float32) / 255 - np.array(mean, np.float32)) / np.array(std, np.float32)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None]).astype(np.float32)


def detector_input(image: np.ndarray, longest: int = 1280, multiple: int = 32) -> tuple[np.ndarray, int, int]:
    """Tensor of an image scaled to ``longest`` (nearest neighbour) and padded, and the scaled width and height."""
    h, w = image.shape[:2]
    scale = min(1.0, longest / max(h, w))
    rw, rh = max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5))
    pad = lambda v: (v + multiple - 1) // multiple * multiple
    near = lambda n, top: np.minimum((np.arange(n) / scale + 0.5).astype(int), top - 1)
    full = np.zeros((pad(rh), pad(rw), 3), np.uint8)
    full[:rh, :rw] = image[near(rh, h)[:, None], near(rw, w)[None]]
    return nchw(full), rw, rh


def layout_input(image: np.ndarray, size: int = 800, mean=MEAN, std=STD) -> dict[str, np.ndarray]:
    """The three input tensors of a layout model."""
    h, w = image.shape[:2]
    return {"im_shape": np.array([[size, size]], np.float32), "image": nchw(resize(image, size, size), mean, std), "scale_factor": np.array([[size / h, size / w]], np.float32)}


def crop(image: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
    """The part of an image from x0, y0 up to but without x1, y1."""
    h, w = image.shape[:2]
    x0, x1, y0, y1 = max(0, x0), min(w, x1), max(0, y0), min(h, y1)
    return image[y0:y1, x0:x1] if x1 > x0 and y1 > y0 else image[:0, :0]


def cropped_quad(image: np.ndarray, quad: list[tuple[int, int]], pad: int = 10) -> np.ndarray:
    """The inside of a quad, clamped to the image, on white, with a white border of ``pad``; one black pixel where nothing is left."""
    from .grid import inside

    h, w = image.shape[:2]
    xs, ys = [x for x, _ in quad], [y for _, y in quad]
    bound = lambda v, lo, hi: lo if v < lo else min(v, hi)
    x0, y0, x1, y1 = bound(min(xs), 0, w - 1), bound(min(ys), 0, h - 1), bound(max(xs), 1, w), bound(max(ys), 1, h)
    if x1 <= x0 or y1 <= y0:
        return np.zeros((1, 1, 3), np.uint8)
    out = np.full((y1 - y0 + 2 * pad, x1 - x0 + 2 * pad, 3), 255, np.uint8)
    y, x = np.mgrid[0 : y1 - y0, 0 : x1 - x0]
    keep = inside(x, y, [(px - x0, py - y0) for px, py in quad])
    out[pad : pad + y1 - y0, pad : pad + x1 - x0][keep] = image[y0:y1, x0:x1][keep]
    return out
