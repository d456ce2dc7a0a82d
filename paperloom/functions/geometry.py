"""Boxes as arrays of left, top, right and bottom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box_of(raw: Column | str) -> Column:
    """The box of four numbers, or of a polygon of eight or more; null where it is neither."""
    raw = _col(raw)
    xs, ys = F.filter(raw, lambda _, i: i % 2 == 0), F.filter(raw, lambda _, i: i % 2 == 1)
    polygon = F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return F.when(F.size(raw) == 4, raw).when((F.size(raw) >= 8) & (F.size(raw) % 2 == 0), polygon)


def valid_box(raw: Column | str) -> Column:
    """A normalised box, five places, or null."""
    raw = _col(raw)
    left, top, right, bottom = (F.get(raw, F.lit(i)) for i in range(4))
    fine = (F.size(raw) == 4) & left.between(0, 1) & top.between(0, 1) & right.between(0, 1) & bottom.between(0, 1) & (left <= right) & (top <= bottom)
    return F.when(fine, F.transform(raw, lambda x: F.round(x, 5)))


def normalised(raw: Column | str, width: Column | str, height: Column | str) -> Column:
    """A box in shares of the page, clamped, seven places."""
    box = box_of(raw)
    share = lambda i, by: F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.get(box, F.lit(i)) / _col(by))), 7)
    return F.when(box.isNotNull() & (_col(width) > 0) & (_col(height) > 0), F.array(share(0, width), share(1, height), share(2, width), share(3, height)))


def area(box: Column | str) -> Column:
    box = _col(box)
    side = lambda a, b: F.greatest(F.lit(0.0), F.get(box, F.lit(b)) - F.get(box, F.lit(a)))
    return side(0, 2) * side(1, 3)


def shared_area(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    side = lambda low, high: F.greatest(F.lit(0.0), F.least(F.get(a, F.lit(high)), F.get(b, F.lit(high))) - F.greatest(F.get(a, F.lit(low)), F.get(b, F.lit(low))))
    return side(0, 2) * side(1, 3)


def overlap_ratio(a: Column | str, b: Column | str) -> Column:
    """The share of the first box that the second covers."""
    return F.coalesce(F.when(area(a) > 0, shared_area(a, b) / area(a)), F.lit(0.0))


def iou(a: Column | str, b: Column | str) -> Column:
    """Shared by joint area."""
    both = shared_area(a, b)
    whole = area(a) + area(b) - both
    return F.coalesce(F.when(whole > 0, both / whole), F.lit(0.0))


def center_x(box: Column | str) -> Column:
    box = _col(box)
    return (F.get(box, F.lit(0)) + F.get(box, F.lit(2))) / 2


def center_y(box: Column | str) -> Column:
    box = _col(box)
    return (F.get(box, F.lit(1)) + F.get(box, F.lit(3))) / 2


def turned_back(box: Column | str, turns: Column | str, width: Column | str, height: Column | str, scale: Column | str | None = None) -> Column:
    """A box found on a page turned by so many quarters (counter-clockwise), scaled, in coordinates of the page itself."""
    box, turns, width, height = _col(box), _col(turns), _col(width), _col(height)
    by = _col(scale) if scale is not None else F.lit(1.0)
    x1, y1, x2, y2 = (F.get(box, F.lit(i)) / by for i in range(4))
    quarter = F.pmod(turns, F.lit(4))
    place = lambda x, y: F.when(quarter == 0, F.array(x, y)).when(quarter == 1, F.array(width - y, x)).when(quarter == 2, F.array(width - x, height - y)).otherwise(F.array(y, height - x))
    a, b = place(x1, y1), place(x2, y2)
    low = lambda i: F.least(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
    high = lambda i: F.greatest(F.get(a, F.lit(i)), F.get(b, F.lit(i)))
    return F.when(box.isNotNull(), F.array(low(0), low(1), high(0), high(1)))


def union_box(box: Column | str) -> Column:
    """Aggregate: the box around all boxes, five places; null where there is none."""
    box = _col(box)
    least, most = (lambda i: F.round(F.min(F.get(box, F.lit(i))), 5)), (lambda i: F.round(F.max(F.get(box, F.lit(i))), 5))
    return F.when(F.count(box) > 0, F.array(least(0), least(1), most(2), most(3)))
