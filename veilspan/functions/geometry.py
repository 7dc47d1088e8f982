"""Boxes, quads, angles and page transforms as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated(c: Column) -> Column:
    return c.cast("int")


def inflate(l: Column, t: Column, r: Column, b: Column, px: Column, width: Column, height: Column) -> Column:  # noqa: E741
    """Grown by ``px`` on all sides, within the canvas."""
    return F.struct(F.greatest(l - px, F.lit(0)).alias("l"), F.greatest(t - px, F.lit(0)).alias("t"), F.least(r + px, width).alias("r"), F.least(b + px, height).alias("b"))


def area(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    return (r - l).cast("long") * (b - t).cast("long")


def contains(box: Column, x: Column, y: Column) -> Column:
    return x.between(box["l"], box["r"]) & y.between(box["t"], box["b"])


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def quad_of(l: Column, t: Column, r: Column, b: Column) -> Column:  # noqa: E741
    """Corners in path order: top left, top right, bottom right, bottom left."""
    return F.array(point(l, t), point(r, t), point(r, b), point(l, b))


def as_quad(points: Column) -> Column:
    return F.when(F.size(points) == 4, points)


def quad_angle(q: Column) -> Column:
    return F.degrees(F.atan2(q[1]["y"] - q[0]["y"], q[1]["x"] - q[0]["x"]))


def inflate_quad(q: Column, px: Column) -> Column:
    """Grown along its own axes; one without length or height stays."""
    ax, ay = q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]
    dx, dy = q[3]["x"] - q[0]["x"], q[3]["y"] - q[0]["y"]
    la, ld = F.hypot(ax, ay), F.hypot(dx, dy)
    ax, ay, dx, dy = (v / F.nullif(n, F.lit(0.0)) * px for v, n in ((ax, la), (ay, la), (dx, ld), (dy, ld)))
    grown = F.array(*[point(q[k]["x"] + sa * ax + sd * dx, q[k]["y"] + sa * ay + sd * dy) for k, (sa, sd) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    return F.when((la > 0) & (ld > 0), grown).otherwise(q)


def rotation(width: Column, height: Column, angle: Column) -> Column:
    """Rotation about the origin, moved so that the page's corners have no negative coordinate."""
    c, s = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    zero = F.lit(0.0)
    return F.struct(c.alias("c"), s.alias("s"), (-F.least(zero, c * width, c * width - s * height, -s * height)).alias("tx"),
                    (-F.least(zero, s * width, s * width + c * height, c * height)).alias("ty"))


def apply(tr: Column, p: Column) -> Column:
    return point(tr["c"] * p["x"] - tr["s"] * p["y"] + tr["tx"], tr["s"] * p["x"] + tr["c"] * p["y"] + tr["ty"])


def invert(tr: Column, p: Column) -> Column:
    x, y = p["x"] - tr["tx"], p["y"] - tr["ty"]
    return point(tr["c"] * x + tr["s"] * y, -tr["s"] * x + tr["c"] * y)


def hull(q: Column) -> Column:
    xs, ys = F.transform(q, lambda p: p["x"]), F.transform(q, lambda p: p["y"])
    return F.struct(*[truncated(f(v)).alias(n) for n, f, v in (("l", F.array_min, xs), ("t", F.array_min, ys), ("r", F.array_max, xs), ("b", F.array_max, ys))])


def _finite(a: Column, value: Column) -> Column:
    a = a.cast("double")
    return F.when(F.isnan(a) | (F.abs(a) == float("inf")), F.lit(0.0)).otherwise(value)


def from_horizontal(a: Column) -> Column:
    """0 to 90."""
    m = F.pmod(a.cast("double"), F.lit(180.0))
    return _finite(a, F.when(m <= 90, m).otherwise(180 - m))


def signed_deviation(a: Column) -> Column:
    """Above -90, up to 90."""
    m = a.cast("double") % 180
    return _finite(a, F.when(m <= -90, m + 180).when(m > 90, m - 180).otherwise(m))


def normalized(a: Column) -> Column:
    """-180 up to, not including, 180."""
    m = a.cast("double") % 360
    return _finite(a, F.when(m < -180, m + 360).when(m >= 180, m - 360).otherwise(m))


def circular_distance(a: Column, b: Column) -> Column:
    return F.abs(normalized(a - b))


def is_slanted(q: Column) -> Column:
    return F.coalesce(from_horizontal(quad_angle(q)) >= 3, F.lit(False))


def fit(box_w: Column, box_h: Column, width: Column, height: Column) -> Column:
    """Letterboxing of an image in a box: scale and offsets, all 0 if a side isn't positive."""
    ok = (width > 0) & (height > 0) & (box_w > 0) & (box_h > 0)
    w, h = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    scale = F.least(box_w / w, box_h / h)
    return F.struct(*[F.when(ok, v).otherwise(F.lit(0.0)).alias(n) for n, v in (("scale", scale), ("dx", (box_w - width * scale) / 2), ("dy", (box_h - height * scale) / 2))])


def to_image(f: Column, x: Column, y: Column) -> Column:
    """Image point of a screen point; null without a scale."""
    s = F.nullif(f["scale"], F.lit(0.0))
    return F.when(f["scale"] > 0, F.struct(truncated((x - f["dx"]) / s).alias("x"), truncated((y - f["dy"]) / s).alias("y")))


def subsample(long_edge: Column, cap: int = 2048) -> Column:
    """The power of two by which an image is read smaller: doubled while half the edge is at least the cap."""
    times = F.floor(F.log2(F.greatest(long_edge, F.lit(1)) / F.lit(float(cap))))
    return F.pow(F.lit(2), F.greatest(F.lit(0), times)).cast("int")
