"""Boxes on a page: distances, relations, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NEAR = 50.0


def distance(a: str, b: str) -> Column:
    """Between the nearest sides of two boxes given as structs with left, top, right, bottom."""
    gap = lambda lo, hi: F.greatest(F.lit(0.0), F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"))
    return F.sqrt(gap("left", "right") * gap("left", "right") + gap("top", "bottom") * gap("top", "bottom"))


def _told(pairs: DataFrame, page: str, near: float) -> DataFrame:
    """page, source, target, relation of pairs of boxes a and b: OVERLAPS alone, or sides and NEAR."""
    over = "a.left < b.right and b.left < a.right and a.top < b.bottom and b.top < a.bottom"
    apart = F.array_compact(
        F.array(
            F.when(F.expr("a.right <= b.left"), "LEFT_OF"),
            F.when(F.expr("a.left >= b.right"), "RIGHT_OF"),
            F.when(F.expr("a.bottom <= b.top"), "ABOVE"),
            F.when(F.expr("a.top >= b.bottom"), "BELOW"),
            F.when(distance("a", "b") <= near, "NEAR"),
        )
    )
    return pairs.select(page, "source", "target", F.explode(F.when(F.expr(over), F.array(F.lit("OVERLAPS"))).otherwise(apart)).alias("relation"))


def relations(boxes: DataFrame, page: str, key: str, near: float = NEAR) -> DataFrame:
    """page, source, target, relation of all ordered pairs on one page.

    A pair of far boxes is related too, so the result itself goes with the square
    of a page's boxes; near_relations has those that lie close.
    """
    box = F.struct("left", "top", "right", "bottom")
    a = boxes.select(page, F.col(key).alias("source"), box.alias("a"))
    b = boxes.select(page, F.col(key).alias("target"), box.alias("b"))
    return _told(a.join(b, page).where("source <> target"), page, near)


def near_pairs(first: DataFrame, second: DataFrame, page: str, near: float, cell: float | None = None) -> DataFrame:
    """page, source, a, target, b of boxes of first (page, source, a) and second (page, target, b) within `near` of each other.

    Boxes are joined by the cells of a grid that they touch, those of first with a
    margin; a pair that meets in several cells counts in the one that has the
    corner of their common part. So pairs are looked at in proportion to what lies
    close, whatever a page holds. cell: the side of a cell; if not given, four times
    `near` or the mean side of the second boxes, what is larger.
    """
    mean = cell or second.agg(F.avg(F.expr("(b.right - b.left + b.bottom - b.top) / 2"))).first()[0] or 0.0
    side = cell or max(1.0, 4 * near, mean)
    at = lambda c: F.floor(c / side)

    def cells(rows: DataFrame, box: str, margin: float) -> DataFrame:
        span = lambda lo, hi: F.sequence(at(F.col(f"{box}.{lo}") - margin), at(F.col(f"{box}.{hi}") + margin))
        return rows.withColumn("_x", F.explode(span("left", "right"))).withColumn("_y", F.explode(span("top", "bottom")))

    met = cells(first, "a", near).join(cells(second, "b", 0.0), [page, "_x", "_y"])
    owner = lambda side_, c: at(F.greatest(F.col(f"a.{side_}") - near, F.col(f"b.{side_}"))) == F.col(c)
    return met.where(owner("left", "_x") & owner("top", "_y") & (distance("a", "b") <= near)).drop("_x", "_y")


def near_relations(boxes: DataFrame, page: str, key: str, near: float = NEAR) -> DataFrame:
    """The rows of `relations` for pairs within `near`, by a grid."""
    box = F.struct("left", "top", "right", "bottom")
    a = boxes.select(page, F.col(key).alias("source"), box.alias("a"))
    b = boxes.select(page, F.col(key).alias("target"), box.alias("b"))
    return _told(near_pairs(a, b, page, near).where("source <> target"), page, near)


def reading_order(boxes: DataFrame, page: str, key: str, row_height: float = 10.0) -> DataFrame:
    """Adds place: by row bucket of the top, then left."""
    order = W.partitionBy(page).orderBy(F.floor(F.col("top") / row_height), "left", key)
    return boxes.withColumn("place", F.row_number().over(order))


def paragraphs(boxes: DataFrame, page: str) -> DataFrame:
    """Adds paragraph: a new one after a gap of at least 1.8 medians (8 at least) or a line that ends a sentence."""
    w = W.partitionBy(page).orderBy("top", "left")
    gaps = boxes.withColumns({"_gap": F.col("top") - F.lag("bottom").over(w), "_ended": F.lag("text").over(w).rlike(r"[.!?]\s*$")})
    middle = gaps.groupBy(page).agg(F.median("_gap").alias("_mid"))
    new = (F.col("_gap") >= F.greatest(F.col("_mid") * 1.8, F.lit(8.0))) | F.col("_ended")
    return gaps.join(middle, page).withColumn("paragraph", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).drop("_gap", "_ended", "_mid")
