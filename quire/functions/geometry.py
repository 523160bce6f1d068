"""Column functions over boxes: structs of x, y, w, h in points, y down."""

from pyspark.sql import Column, functions as F

from quire import constants as K


def box(x, y, w, h) -> Column:
    return F.struct(
        *[c.cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))]
    )


def right(b: Column) -> Column:
    return b["x"] + b["w"]


def bottom(b: Column) -> Column:
    return b["y"] + b["h"]


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return box(x, y, F.greatest(right(a), right(b)) - x, F.greatest(bottom(a), bottom(b)) - y)


def overlap_x(a: Column, b: Column) -> Column:
    return F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])


def overlap_y(a: Column, b: Column) -> Column:
    return F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])


def touches(a: Column, b: Column) -> Column:
    """Overlap, edges included."""
    return (
        (a["x"] <= right(b)) & (b["x"] <= right(a)) & (a["y"] <= bottom(b)) & (b["y"] <= bottom(a))
    )


def around(xs: Column, ys: Column) -> Column:
    """The box around points, given as two arrays."""
    x, y = F.array_min(xs), F.array_min(ys)
    return box(x, y, F.array_max(xs) - x, F.array_max(ys) - y)


def round_to(value: Column, per_point: int = 100) -> Column:
    """Half up, to 1/per_point."""
    return F.floor(value * per_point + 0.5) / per_point


def rounded(b: Column) -> Column:
    return box(*[round_to(b[k]) for k in "xywh"])


def in_margin(b: Column, page_height: Column) -> Column:
    """Wholly in the page's top or bottom band."""
    band = page_height * K.MARGIN_FRACTION
    return (bottom(b) <= band) | (b["y"] >= page_height - band)


def union_agg(b: Column) -> Column:
    """Aggregate: the box around a group's boxes."""
    x, y = F.min(b["x"]), F.min(b["y"])
    return box(x, y, F.max(right(b)) - x, F.max(bottom(b)) - y)
