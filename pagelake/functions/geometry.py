"""Boxes as four columns with a prefix (left, top, right, bottom; pixels, origin top left)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("left", "top", "right", "bottom")


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def area(b) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0)) * F.greatest(b[3] - b[1], F.lit(0))


def intersection(a, b) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a, b) -> Column:
    inside = intersection(a, b)
    return inside / F.nullif(area(a) + area(b) - inside, F.lit(0))


def overlap_of_smaller(a, b) -> Column:
    return intersection(a, b) / F.nullif(F.least(area(a), area(b)), F.lit(0))


def share_inside(a, b) -> Column:
    return intersection(a, b) / F.nullif(area(a), F.lit(0))


def clamp(b, width: Column, height: Column) -> list[Column]:
    return [F.least(F.greatest(x, F.lit(0)), m) for x, m in zip(b, (width, height, width, height))]


def pad(b, by: int, width: Column, height: Column) -> list[Column]:
    return clamp((b[0] - by, b[1] - by, b[2] + by, b[3] + by), width, height)


def normalised(b, width: Column, height: Column) -> list[Column]:
    return [F.round(x / m, 5) for x, m in zip(b, (width, height, width, height))]


def turned(b, width: Column, height: Column, turns: Column) -> list[Column]:
    """The box after so many quarter turns clockwise of its page."""
    l, t, r, m = b  # noqa: E741
    forms = {0: (l, t, r, m), 1: (height - m, l, height - t, r), 2: (width - r, height - m, width - l, height - t), 3: (t, width - r, m, width - l)}
    return [F.when(turns % 4 == 1, forms[1][i]).when(turns % 4 == 2, forms[2][i]).when(turns % 4 == 3, forms[3][i]).otherwise(forms[0][i]) for i in range(4)]


def turned_counterclockwise(b, width: Column, height: Column, turns: Column) -> list[Column]:
    """The box after so many quarter turns counterclockwise of its page."""
    return turned(b, width, height, F.pmod(-turns, F.lit(4)))


def union_of(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))


def side_level(size: Column) -> Column:
    """The least n, 0 or more, whose power of two is no less than the size (or one more, where a logarithm is not exact)."""
    return F.ceil(F.log2(F.greatest(size.cast("double"), F.lit(1.0)))).cast("int")


def level_cell(at: Column, level: Column) -> Column:
    """The cell of a coordinate on a level; its cells are half its power of two wide, so that a side covers three at most."""
    return F.floor(at.cast("double") / F.pow(F.lit(2.0), level - 1)).cast("long")


CELLS = ["_lx", "_ly", "_gx", "_gy"]


def spread_boxes(boxes: DataFrame) -> DataFrame:
    """Every box once for each cell that it meets, on the level of its width and that of its height."""
    span = lambda low, high, level: F.explode(F.sequence(level_cell(F.col(low), F.col(level)), level_cell(F.col(high), F.col(level))))
    sized = boxes.filter("right >= left and bottom >= top").withColumn("_lx", side_level(F.col("right") - F.col("left"))).withColumn("_ly", side_level(F.col("bottom") - F.col("top")))
    return sized.withColumn("_gx", span("left", "right", "_lx")).withColumn("_gy", span("top", "bottom", "_ly"))


def box_levels(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The levels (_lx, _ly) of a key's boxes."""
    sized = boxes.filter("right >= left and bottom >= top")
    return sized.select(*keys, side_level(F.col("right") - F.col("left")).alias("_lx"), side_level(F.col("bottom") - F.col("top")).alias("_ly")).distinct()


def at_levels(points: DataFrame, levels: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Every point once for each level, with its cell there."""
    return points.join(levels, keys).withColumn("_gx", level_cell(F.col(x), F.col("_lx"))).withColumn("_gy", level_cell(F.col(y), F.col("_ly")))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins points (keys, x, y) to the boxes (keys, left, top, right, bottom) that hold them, by grid cells of the boxes' own sizes, so
    that a page with many boxes is an equi join with a residual and never a nested loop. A point lies in one cell of each level: no row
    comes twice. Both sides are dealt by cell: they outgrow the files that they come from, by whose size a join would be broadcast."""
    if how in ("left_semi", "left_anti"):
        at = points.select(*keys, "x", "y").distinct()
        held = points_in_boxes(at, boxes.select(*keys, *SIDES).distinct(), keys).select(*keys, "x", "y").distinct()
        return points.join(held, [*keys, "x", "y"], how).select(points.columns)
    p, b = at_levels(points, box_levels(boxes, keys), keys).alias("p"), spread_boxes(boxes).alias("b")
    on = F.col("p.x").between(F.col("b.left"), F.col("b.right")) & F.col("p.y").between(F.col("b.top"), F.col("b.bottom"))
    for k in [*keys, *CELLS]:
        on = on & (F.col(f"p.{k}") == F.col(f"b.{k}"))
    keep = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"b.{c}") for c in boxes.columns if c not in points.columns]
    return p.join(b.hint("merge"), on).select(*keep)


def moved(b, dx: Column, dy: Column) -> list[Column]:
    """A crop's box in the page that the crop was cut from at (dx, dy)."""
    return [x + d for x, d in zip(b, (dx, dy, dx, dy))]
