"""Boxes: a box is four columns x0, y0, x1, y1, named with a common prefix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def box_array(prefix: str = "") -> Column:
    """The box as an array; null where a coordinate is."""
    x = box(prefix)
    return F.when(~(x[0].isNull() | x[1].isNull() | x[2].isNull() | x[3].isNull()), F.array(*x))


def normalize_box(bbox: Column, poly: Column, points: int | None = None, invalid: Column | None = None) -> Column:
    """Array of four coordinates from a flat box or a polygon of at least four points.

    ``points`` limits how many points count; ``invalid`` is given for what is neither.
    """
    used = F.slice(poly, 1, points) if points else poly
    axis = lambda k: F.transform(used, lambda p: F.get(p, F.lit(k)))
    around = F.array(F.array_min(axis(0)), F.array_min(axis(1)), F.array_max(axis(0)), F.array_max(axis(1)))
    flat = F.when(F.size(bbox) >= 4, F.slice(bbox, 1, 4))
    return F.coalesce(F.when(F.size(poly) >= 4, around), flat, F.array().cast("array<double>") if invalid is None else invalid)


def inside(inner: str, outer: str, margin: float = 0.0) -> Column:
    """Whether the inner box lies in the outer one, give or take ``margin`` on each side; false where a coordinate is null."""
    a, b = box(inner), box(outer)
    m = F.lit(float(margin))
    return F.coalesce((a[0] >= b[0] - m) & (a[1] >= b[1] - m) & (a[2] <= b[2] + m) & (a[3] <= b[3] + m), F.lit(False))


def caption_score(figure: str, text: str) -> Column:
    """0.7 for horizontal alignment and 0.3 for nearness; 0 if the boxes touch or overlap vertically."""
    f, t = box(figure), box(text)
    width = f[2] - f[0]
    aside = F.abs((f[0] + f[2]) / 2 - (t[0] + t[2]) / 2)
    align = F.when(width > 0, F.greatest(F.lit(0.0), 1 - aside / F.when(width > 0, width))).otherwise(F.lit(0.0))
    gap = F.when(t[1] > f[3], t[1] - f[3]).when(t[3] < f[1], f[1] - t[3])
    return F.when(gap.isNotNull(), F.coalesce(align * 0.7 + F.greatest(F.lit(0.0), 1 - gap / 100) * 0.3, F.lit(0.0))).otherwise(F.lit(0.0))


def horizontal_overlap(a: str, b: str) -> Column:
    """The common width as a share of the narrower box's."""
    p, q = box(a), box(b)
    common = F.least(p[2], q[2]) - F.greatest(p[0], q[0])
    narrow = F.least(p[2] - p[0], q[2] - q[0])
    return F.when((common > 0) & (narrow > 0), common / F.when(narrow > 0, narrow)).otherwise(F.lit(0.0))


def word_box(text: Column, start: Column, end: Column, line: str = "") -> Column:
    """The box of characters ``start`` to ``end`` of a text line, by even widths, with some padding; array of four."""
    x0, y0, x1, y1 = box(line)
    n = F.length(text)
    char = (x1 - x0) / F.when(n > 0, n)
    pad_x, pad_y = char * 0.1, (y1 - y0) * 0.05
    word = F.array(F.greatest(x0, x0 + start * char - pad_x), y0 - pad_y, F.least(x1, x0 + end * char + pad_x), y1 + pad_y)
    return F.when(x0.isNull() | y0.isNull() | x1.isNull() | y1.isNull(), F.lit(None)).when(n == 0, F.array(x0, y0, x1, y1)).otherwise(word)


def dimensions(prefix: str = "") -> Column:
    """Struct of width, height and area; null if one of the first two is 0 or null."""
    x0, y0, x1, y1 = box(prefix)
    w, h = x1 - x0, y1 - y0
    return F.when((w != 0) & (h != 0), F.struct(w.alias("width"), h.alias("height"), (w * h).alias("area")))
