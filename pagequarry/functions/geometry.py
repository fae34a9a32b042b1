"""Affine and rectangle arithmetic as native column expressions.

A matrix is ``array<double>`` of (a, b, c, d, e, f); a rectangle is
``array<double>`` of (x0, y0, x1, y1). Products are rounded before they are
added, as written here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A rectangle with its corners in order."""
    return F.array(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def is_finite(values: Column) -> Column:
    return F.forall(values, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def matrix_mul(m: Column, n: Column) -> Column:
    """``n`` applied first, then ``m``."""
    return F.array(
        m[0] * n[0] + m[2] * n[1],
        m[1] * n[0] + m[3] * n[1],
        m[0] * n[2] + m[2] * n[3],
        m[1] * n[2] + m[3] * n[3],
        m[0] * n[4] + m[2] * n[5] + m[4],
        m[1] * n[4] + m[3] * n[5] + m[5],
    )


def matrix_mul_finite(m: Column, n: Column) -> Column:
    """The product, or null if any element of it is not finite."""
    p = matrix_mul(m, n)
    return F.when(is_finite(p), p)


def point(m: Column, x: Column, y: Column) -> Column:
    return F.struct((m[0] * x + m[2] * y + m[4]).alias("x"), (m[1] * x + m[3] * y + m[5]).alias("y"))


def width(r: Column) -> Column:
    return r[2] - r[0]


def height(r: Column) -> Column:
    return r[3] - r[1]


def is_empty(r: Column) -> Column:
    return (width(r) <= 0) | (height(r) <= 0)


def _overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (b0 <= a1) & (a0 <= b1)


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.least(F.abs(a0 - b1), F.abs(a1 - b0))


def h_overlaps(a: Column, b: Column) -> Column:
    """Touching counts."""
    return _overlaps(a[0], a[2], b[0], b[2])


def v_overlaps(a: Column, b: Column) -> Column:
    return _overlaps(a[1], a[3], b[1], b[3])


def h_overlap(a: Column, b: Column) -> Column:
    """The smaller distance between opposite edges of overlapping spans, else 0; no intersection width."""
    return F.when(h_overlaps(a, b), _gap(a[0], a[2], b[0], b[2])).otherwise(F.lit(0.0))


def v_overlap(a: Column, b: Column) -> Column:
    return F.when(v_overlaps(a, b), _gap(a[1], a[3], b[1], b[3])).otherwise(F.lit(0.0))


def h_distance(a: Column, b: Column) -> Column:
    return F.when(h_overlaps(a, b), F.lit(0.0)).otherwise(_gap(a[0], a[2], b[0], b[2]))


def v_distance(a: Column, b: Column) -> Column:
    return F.when(v_overlaps(a, b), F.lit(0.0)).otherwise(_gap(a[1], a[3], b[1], b[3]))


def transform_rect(m: Column, r: Column) -> Column:
    """Bounds of the four transformed corners."""
    corners = [point(m, r[i], r[j]) for i in (0, 2) for j in (1, 3)]
    xs, ys = [c["x"] for c in corners], [c["y"] for c in corners]
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def union_rect(r: Column) -> Column:
    """Aggregate: bounds of all rectangles of a group."""
    return F.array(F.min(r[0]), F.min(r[1]), F.max(r[2]), F.max(r[3]))


def page_matrix(media: Column, rotation: Column, space: str = "screen") -> Column:
    """From default user space to page (origin bottom left) or screen (y down) space, with the page's rotation."""
    if space in ("default", "user"):
        return F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    x0, y0, x1, y1 = media[0], media[1], media[2], media[3]
    one, zero = F.lit(1.0), F.lit(0.0)
    turn = F.pmod(rotation, F.lit(360))
    upright = {
        0: (one, zero, zero, one, -x0, -y0),
        90: (zero, -one, one, zero, -y0, x1),
        180: (-one, zero, zero, -one, x1, y1),
        270: (zero, one, -one, zero, y1, -x0),
    }

    def flipped(angle: int) -> Column:
        a, b, c, d, e, f = upright[angle]
        tall = (y1 - y0) if angle in (0, 180) else (x1 - x0)
        return F.array(a, -b, c, -d, e, tall - f) if space == "screen" else F.array(a, b, c, d, e, f)

    return F.when(turn == 90, flipped(90)).when(turn == 180, flipped(180)).when(turn == 270, flipped(270)).otherwise(flipped(0))
