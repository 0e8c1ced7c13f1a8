"""Box and colour expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def width(p: str = "") -> Column:
    return F.col(p + "x1") - F.col(p + "x0")


def height(p: str = "") -> Column:
    return F.col(p + "y1") - F.col(p + "y0")


def vertical(p: str = "") -> Column:
    return height(p) > width(p)


def area(p: str = "") -> Column:
    return F.when((width(p) <= 0) | (height(p) <= 0), F.lit(0)).otherwise(width(p) * height(p)).cast("long")


def center_x(p: str = "") -> Column:
    return F.expr(f"({p}x0 + {p}x1) div 2")


def center_y(p: str = "") -> Column:
    return F.expr(f"({p}y0 + {p}y1) div 2")


def _span(a: str, b: str, axis: str) -> Column:
    return F.least(F.col(f"{a}{axis}1"), F.col(f"{b}{axis}1")) - F.greatest(F.col(f"{a}{axis}0"), F.col(f"{b}{axis}0"))


def intersection(a: str, b: str) -> Column:
    w, h = _span(a, b, "x"), _span(a, b, "y")
    return F.when((w <= 0) | (h <= 0), F.lit(0)).otherwise(w * h).cast("long")


def gap_squared(a: str, b: str) -> Column:
    dx, dy = F.greatest(F.lit(0), -_span(a, b, "x")), F.greatest(F.lit(0), -_span(a, b, "y"))
    return dx * dx + dy * dy


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(v < lo, lo).when(v > hi, hi).otherwise(v)


def gray() -> Column:
    return F.expr("(299 * r + 587 * g + 114 * b) div 1000")


def rounded(v: Column) -> Column:
    """Half away from zero for what is not negative, as an integer."""
    return F.floor(v + 0.5).cast("long")


def resized(width: Column, height: Column, longest: int = 1280, multiple: int = 32) -> dict[str, Column]:
    """Size of an image scaled to at most ``longest`` on its longer side, and padded to a multiple."""
    scale = F.least(F.lit(1.0), longest / F.greatest(width, height))
    w, h = (F.greatest(F.lit(1).cast("long"), rounded(v * scale)) for v in (width, height))
    pad = lambda v: ((v + multiple - 1) - (v + multiple - 1) % multiple).cast("long")
    return {"w": w, "h": h, "pad_w": pad(w), "pad_h": pad(h)}


def corners(p: str = "") -> Column:
    """Quad of a box: top left, top right, bottom right, bottom left."""
    at = lambda x, y: F.struct(F.col(p + x).alias("x"), F.col(p + y).alias("y"))
    return F.array(at("x0", "y0"), at("x1", "y0"), at("x1", "y1"), at("x0", "y1"))


def ordered_corners(quad: Column) -> Column:
    """The points of least and largest sums and differences: top left, top right, bottom right, bottom left; first on ties."""

    def first(key, most: bool):
        keys = F.transform(quad, key)
        return F.element_at(quad, F.array_position(keys, F.array_max(keys) if most else F.array_min(keys)).cast("int"))

    total, side = (lambda q: q["x"] + q["y"]), (lambda q: q["x"] - q["y"])
    return F.array(first(total, False), first(side, True), first(total, True), first(side, False))


def half_turn(quad: Column) -> Column:
    return F.concat(F.slice(quad, 3, 2), F.slice(quad, 1, 2))


def flipped(logits: Column, least: float = 0.9) -> Column:
    """Whether the second of two class scores wins and is sure; fewer than two, or none at all: false."""
    a, b = F.get(logits, F.lit(0)), F.get(logits, F.lit(1))
    return F.coalesce((b > a) & (b > least), F.lit(False))


def bounds(quad: Column) -> dict[str, Column]:
    xs, ys = F.transform(quad, lambda q: q["x"]), F.transform(quad, lambda q: q["y"])
    return {"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys)}


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow((a["x"] - b["x"]).cast("double"), 2.0) + F.pow((a["y"] - b["y"]).cast("double"), 2.0))


def crop_size(quad: Column, height: int = 48) -> dict[str, Column]:
    """Width and height of the straightened crop of ``height`` pixels a line, and whether it stands upright; without the fixed
    height, the plain size."""
    q = ordered_corners(quad)
    p = [F.element_at(q, k) for k in (1, 2, 3, 4)]
    w = F.greatest(distance(p[0], p[1]), distance(p[3], p[2]))
    h = F.greatest(F.greatest(distance(p[0], p[3]), distance(p[1], p[2])), F.lit(1.0))
    long = F.greatest(F.lit(1).cast("long"), F.when(h > w, rounded(height * h / F.greatest(w, F.lit(1e-9)))).otherwise(rounded(height * w / h)))
    return {"upright": h > w, "length": long, "w": F.greatest(F.lit(1).cast("long"), w.cast("long")), "h": h.cast("long")}


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast: borders at the least coordinates are inside, those at the largest are not."""
    out = F.lit(False)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]]):
        if yi != yj:
            out = out != (((F.lit(float(yi)) > y) != (F.lit(float(yj)) > y)) & (x < (xj - xi) * (y - yi) / float(yj - yi) + xi))
    return out


def in_corners(x: Column, y: Column, polygon: Column, corners: int = 4) -> Column:
    """The same for a polygon column of so many corners, each row its own."""
    at = lambda k, c: F.element_at(polygon, k % corners + 1)[c].cast("double")
    out = F.lit(False)
    for k in range(corners):
        xi, yi, xj, yj = at(k, "x"), at(k, "y"), at(k - 1, "x"), at(k - 1, "y")
        out = out != (((yi > y) != (yj > y)) & F.coalesce(x < (xj - xi) * (y - yi) / F.nullif(yj - yi, F.lit(0.0)) + xi, F.lit(False)))
    return out


def neighbours(polygon: Column) -> tuple[Column, Column]:
    """The corners before and behind those of a polygon, round the end."""
    n = F.greatest(F.size(polygon), F.lit(1))
    return F.concat(F.slice(polygon, n, F.lit(1)), F.slice(polygon, F.lit(1), n - 1)), F.concat(F.slice(polygon, F.lit(2), n - 1), F.slice(polygon, F.lit(1), F.lit(1)))


def in_polygon_of(x: Column, y: Column, polygon: Column) -> Column:
    """``in_polygon`` for a polygon column of any number of corners, each row its own."""
    edges = F.zip_with(polygon, neighbours(polygon)[0], lambda p, q: F.struct(*[v[c].cast("double").alias(c + k) for k, v in (("i", p), ("j", q)) for c in "xy"]))
    crosses = lambda e: ((e["yi"] > y) != (e["yj"] > y)) & F.coalesce(x < (e["xj"] - e["xi"]) * (y - e["yi"]) / F.nullif(e["yj"] - e["yi"], F.lit(0.0)) + e["xi"], F.lit(False))
    return F.aggregate(edges, F.lit(False), lambda acc, e: acc != crosses(e))


def signed_area(polygon: Column) -> Column:
    edges = F.zip_with(polygon, neighbours(polygon)[1], lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e) / 2


def perimeter(polygon: Column) -> Column:
    edges = F.zip_with(polygon, neighbours(polygon)[1], distance)
    return F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + e)


def unclipped(polygon: Column, ratio: float) -> Column:
    """A polygon (x, y doubles) with its edges moved outward by area * ratio / perimeter. Its corners are where moved neighbours
    meet, or midway between their ends where they are parallel; polygons of fewer than three corners or no length stay."""
    signed, around = signed_area(polygon), perimeter(polygon)
    far = F.abs(signed) * ratio / F.nullif(around, F.lit(0.0)) * F.when(signed >= 0, 1).otherwise(-1)

    def moved(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        size = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))
        ox, oy = dy / size * far, -dx / size * far
        return F.struct((p["x"] + ox).alias("ax"), (p["y"] + oy).alias("ay"), (q["x"] + ox).alias("bx"), (q["y"] + oy).alias("by"))

    edges = F.zip_with(polygon, neighbours(polygon)[1], moved)

    def meet(e, f):
        ex, ey, fx, fy = e["bx"] - e["ax"], e["by"] - e["ay"], f["bx"] - f["ax"], f["by"] - f["ay"]
        cross = ex * fy - ey * fx
        t = ((f["ax"] - e["ax"]) * fy - (f["ay"] - e["ay"]) * fx) / F.nullif(cross, F.lit(0.0))
        flat = F.abs(cross) < 1e-10
        at = lambda a, b, c, d: F.when(flat, (b + c) / 2).otherwise(a + t * d)
        return F.struct(at(e["ax"], e["bx"], f["ax"], ex).alias("x"), at(e["ay"], e["by"], f["ay"], ey).alias("y"))

    return F.when((F.size(polygon) < 3) | (around < 1e-10), polygon).otherwise(F.zip_with(neighbours(edges)[0], edges, meet))


def from_square(quad: list[tuple[Column, Column]]) -> dict[str, Column]:
    """Coefficients a to h of the map from the unit square to a quad (x, y of its corners, in the order of ``corners``): x is
    (a u + b v + c) / (g u + h v + 1), y is (d u + e v + f) / (g u + h v + 1)."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = quad
    ax, bx, sx, ay, by, sy = x1 - x2, x3 - x2, x0 - x1 + x2 - x3, y1 - y2, y3 - y2, y0 - y1 + y2 - y3
    den = F.nullif(ax * by - bx * ay, F.lit(0.0))
    g, h = (sx * by - bx * sy) / den, (ax * sy - sx * ay) / den
    return {"a": x1 - x0 + g * x1, "b": x3 - x0 + h * x3, "c": x0, "d": y1 - y0 + g * y1, "e": y3 - y0 + h * y3, "f": y0, "g": g, "h": h}


def to_square(m: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    """Where a point of the quad of ``from_square`` lies in the unit square (null where the quad has no area)."""
    a, b, c, d, e, f, g, h = (m[k] for k in "abcdefgh")
    w = F.nullif((d * h - e * g) * x + (b * g - a * h) * y + (a * e - b * d), F.lit(0.0))
    return ((e - f * h) * x + (c * h - b) * y + (b * f - c * e)) / w, ((f * g - d) * x + (a - c * g) * y + (c * d - a * f)) / w


def bilinear(cells: Column, width: int, height: int, x: Column, y: Column) -> Column:
    """A grey picture (flat array of bytes) at a real place: neighbours clamped to it, blended on 16 bits and cut to 8."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    clip = lambda v, top: F.least(F.greatest(v, F.lit(0)), F.lit(top - 1))
    at = lambda row, col: F.get(cells, (clip(row, height) * width + clip(col, width)).cast("int")).cast("double") * 257
    top, low = (at(y0 + k, x0) * (1 - fx) + at(y0 + k, x0 + 1) * fx for k in (0, 1))
    return F.least(F.greatest(F.floor((top * (1 - fy) + low * fy) / 257 + 1e-9), F.lit(0)), F.lit(255)).cast("long")


def colour_distance(a: list[Column], b: list[Column]) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a, b)), F.lit(0))
