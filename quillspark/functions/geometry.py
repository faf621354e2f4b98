"""Box geometry as column expressions. Coordinates have their origin at the bottom left."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HORIZONTAL, VERTICAL = "horizontal", "vertical"


def col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def orientation(l: Column | str = "l", t: Column | str = "t", r: Column | str = "r", b: Column | str = "b") -> Column:  # noqa: E741
    """horizontal if a box is at least as wide as high, else vertical; null without a box."""
    l, t, r, b = map(col, (l, t, r, b))  # noqa: E741
    missing = l.isNull() | t.isNull() | r.isNull() | b.isNull()
    return F.when(missing, F.lit(None).cast("string")).when(F.abs(r - l) >= F.abs(t - b), HORIZONTAL).otherwise(VERTICAL)


def measures() -> dict[str, Column]:
    """left and centres of boxes with columns l, t, r, b."""
    return {"left": F.least("l", "r"), "center_x": (F.col("l") + F.col("r")) / 2, "center_y": (F.col("t") + F.col("b")) / 2}


def effective_orientation(label: Column | str = "label") -> Column:
    """Tables are read horizontally whatever their shape; a box without place has none."""
    own = orientation()
    return F.when(own.isNull(), own).when(col(label) == "table", HORIZONTAL).otherwise(own)


def polygon_centre(poly: Column | str) -> tuple[Column, Column]:
    """Means of the x and of the y of an array of points."""
    points = col(poly)
    mean = lambda axis: F.aggregate(F.transform(points, lambda p: p[axis].cast("double")), F.lit(0.0), lambda a, x: a + x) / F.size(points)
    return mean("x"), mean("y")


def crop_rectangle(width: Column | str, height: Column | str) -> dict[str, Column]:
    """The pixels of a box in an image of that size, y from the top, clamped to it; fractions are cut off."""
    w, h = col(width), col(height)
    return {
        "crop_left": F.greatest(F.lit(0), F.col("l").cast("int")),
        "crop_top": F.greatest(F.lit(0), (h - F.col("t")).cast("int")),
        "crop_right": F.least(w, F.col("r").cast("int")),
        "crop_bottom": F.least(h, (h - F.col("b")).cast("int")),
    }
