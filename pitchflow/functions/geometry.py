"""Geometry and formula columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_X, PITCH_Y = 105.0, 68.0


def c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def distance(x1, y1, x2, y2) -> Column:
    dx, dy = c(x1) - c(x2), c(y1) - c(y2)
    return F.sqrt(dx * dx + dy * dy)


def box_centre(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return (c(x1) + c(x2)) / 2, (c(y1) + c(y2)) / 2


def box_foot(x1="x1", y1="y1", x2="x2", y2="y2") -> tuple[Column, Column]:
    return (c(x1) + c(x2)) / 2, c(y2)


def box_area(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.greatest(c(x2) - c(x1), F.lit(0.0)) * F.greatest(c(y2) - c(y1), F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes with column prefixes a and b."""
    w = F.least(c(f"{a}x2"), c(f"{b}x2")) - F.greatest(c(f"{a}x1"), c(f"{b}x1"))
    h = F.least(c(f"{a}y2"), c(f"{b}y2")) - F.greatest(c(f"{a}y1"), c(f"{b}y1"))
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    one, two = (box_area(f"{p}x1", f"{p}y1", f"{p}x2", f"{p}y2") for p in (a, b))
    return F.when(one + two - both > 0, both / (one + two - both)).otherwise(0.0)


def project(px, py, h: list[Column]) -> tuple[Column, Column]:
    """A pixel by a row-major 3 x 3 homography."""
    px, py = c(px), c(py)
    w = h[6] * px + h[7] * py + h[8]
    return (h[0] * px + h[1] * py + h[2]) / w, (h[3] * px + h[4] * py + h[5]) / w


def inverted(h: list[Column]) -> list[Column]:
    """Adjugate of a 3 x 3 matrix: its inverse up to scale, which a homography ignores."""
    a, b, d, e, f, g, i, j, k = h
    return [f * k - g * j, d * j - b * k, b * g - d * f, g * i - e * k, a * k - d * i, d * e - a * g, e * j - f * i, b * i - a * j, a * f - b * e]


def clamp(x, low: float, high: float) -> Column:
    return F.greatest(F.least(c(x), F.lit(high)), F.lit(low))


def goal_distance(x, y) -> Column:
    """Distance to the nearer goal line's centre: right if x > 52.5."""
    return distance(F.when(c(x) > PITCH_X / 2, PITCH_X).otherwise(0.0), 34.0, x, y)


def expected_goals(x, y) -> Column:
    """Logistic in distance and visible goal angle, within 0.01 and 0.99."""
    d = goal_distance(x, y)
    angle = F.when(d < 0.01, F.lit(3.141592653589793 / 2)).otherwise(F.atan(7.32 * d / (d * d + 3.66 * 3.66)))
    return clamp(1 / (1 + F.exp(-(-1.5 - 0.08 * d + 1.2 * angle))), 0.01, 0.99)


def third(x) -> Column:
    return F.when(c(x) < 35, "defensive").when(c(x) < 70, "middle").otherwise("attacking")


def touchline_distance(y) -> Column:
    return F.least(c(y), PITCH_Y - c(y))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a line segment."""
    px, py, ax, ay, bx, by = (c(v) for v in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 > 0, clamp(((px - ax) * dx + (py - ay) * dy) / len2, 0.0, 1.0)).otherwise(0.0)
    return distance(px, py, ax + t * dx, ay + t * dy)


def colour_name(hue, saturation, value) -> Column:
    """Name of an HSV colour (hue 0-179, others 0-255)."""
    h, s, v = c(hue), c(saturation), c(value)
    return (
        F.when(v < 50, "black").when((s < 40) & (v > 180), "white").when(s < 40, "grey")
        .when((h < 10) | (h >= 170), "red").when(h < 22, "orange").when(h < 35, "yellow").when(h < 85, "green")
        .when(h < 100, "cyan").when(h < 130, "blue").when(h < 150, "purple").otherwise("pink")
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def chi_square(a: Column, b: Column) -> Column:
    term = F.zip_with(a, b, lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0).cast("double"))
    return 0.5 * F.aggregate(term, F.lit(0.0), lambda s, x: s + x)


def bhattacharyya(a: Column, b: Column) -> Column:
    root = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(1 - root, F.lit(0.0)))


def clock(seconds) -> Column:
    """mm:ss."""
    s = F.floor(c(seconds)).cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), s % 60)
