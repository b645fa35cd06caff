"""Plane geometry as column functions over plain doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def area(b: Box) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where there is no area."""
    both = overlap_area(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def overlap_of_smaller(a: Box, b: Box) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap_area(a, b) / least).otherwise(0.0)


def intersects(a: Box, b: Box) -> Column:
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def contains(outer: Box, inner: Box) -> Column:
    return (outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3])


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Shortest distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return distance(px, py, ax + t * dx, ay + t * dy)


def point_box(px: Column, py: Column, b: Box) -> Column:
    """Distance from a point to a box; 0 inside."""
    dx = F.greatest(b[0] - px, px - b[2], F.lit(0.0))
    dy = F.greatest(b[1] - py, py - b[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def direction(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Orientation of a segment in degrees, folded to [0, 180)."""
    d = F.degrees(F.atan2(by - ay, bx - ax))
    folded = F.pmod(d, F.lit(180.0))
    return F.when(folded >= 180.0, 0.0).otherwise(folded)


def in_band(angle: Column, lo: float, hi: float) -> Column:
    """Whether a folded angle is in a band that may wrap past 180."""
    lo, hi = lo % 180.0, hi % 180.0
    return angle.between(lo, hi) if lo <= hi else (angle >= lo) | (angle <= hi)


def path_length(vertices: Column, closed: Column) -> Column:
    """Length of a vertex array, with the closing edge of a ring."""
    n = F.size(vertices)

    def edge(a: Column, i: Column) -> Column:
        b = F.get(vertices, F.when(i + 1 < n, i + 1).otherwise(F.when(closed, 0)))
        return F.coalesce(distance(a["x"], a["y"], b["x"], b["y"]), F.lit(0.0))

    return F.aggregate(F.transform(vertices, edge), F.lit(0.0), lambda s, x: s + x)


def ring_area(vertices: Column) -> Column:
    """Shoelace area of a ring."""
    n = F.size(vertices)

    def cross(a: Column, i: Column) -> Column:
        b = F.get(vertices, F.pmod(i + 1, n))
        return a["x"] * b["y"] - b["x"] * a["y"]

    return F.abs(F.aggregate(F.transform(vertices, cross), F.lit(0.0), lambda s, x: s + x)) / 2


def turn_angles(vertices: Column) -> Column:
    """Signed turn in degrees at every vertex of a ring."""
    n = F.size(vertices)

    def turn(v: Column, i: Column) -> Column:
        p, q = F.get(vertices, F.pmod(i - 1 + n, n)), F.get(vertices, F.pmod(i + 1, n))
        ax, ay, bx, by = v["x"] - p["x"], v["y"] - p["y"], q["x"] - v["x"], q["y"] - v["y"]
        t = F.degrees(F.atan2(ax * by - ay * bx, ax * bx + ay * by))
        return F.when(t <= -180, 180.0).otherwise(t)

    return F.transform(vertices, turn)


def to_display(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """An unrotated page point in the displayed frame (G6); width and height are of the unrotated page."""
    r = F.pmod(rotation, F.lit(360))
    dx = F.when(r == 90, height - y).when(r == 180, width - x).when(r == 270, y).otherwise(x)
    dy = F.when(r == 90, x).when(r == 180, height - y).when(r == 270, width - x).otherwise(y)
    return dx, dy


def from_display(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The inverse of `to_display`."""
    r = F.pmod(rotation, F.lit(360))
    ux = F.when(r == 90, y).when(r == 180, width - x).when(r == 270, width - y).otherwise(x)
    uy = F.when(r == 90, height - x).when(r == 180, height - y).when(r == 270, x).otherwise(y)
    return ux, uy


def rotated(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    """A point turned about the origin."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return x * c - y * s, x * s + y * c


def in_ring(px: Column, py: Column, vertices: Column) -> Column:
    """Point in polygon by crossings."""
    n = F.size(vertices)

    def crosses(a: Column, i: Column) -> Column:
        b = F.get(vertices, F.pmod(i + 1, n))
        at = a["x"] + (py - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])
        return F.when((a["y"] > py) != (b["y"] > py), (px < at).cast("int")).otherwise(0)

    return F.aggregate(F.transform(vertices, crosses), F.lit(0), lambda s, x: s + x) % 2 == 1
