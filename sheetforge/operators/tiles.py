"""Point-in-box joins within drawings of many boxes, over grids of tiles.

A box lies in the grid whose tiles are at least as long as it, so it meets at most four tiles; a point lies in one tile of each grid in use.
Boxes and points meet by (drawing, grid, tile), so a drawing's pairs are dealt over as many tasks as it has tiles, and each pair meets once. Only pairs
that share a tile are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetforge.scratch import stored

#: Drawings of more boxes than this are joined by tiles; those of fewer are gathered.
MANY = 1_000
#: Side of the tiles of grid 0; those of each further grid are eight times as long.
TILE, STEP, GRIDS = 64, 8, 10


def side(grid: Column) -> Column:
    """Length of a grid's tiles."""
    return (F.lit(float(TILE)) * F.pow(F.lit(float(STEP)), grid)).cast("long")


def large_drawings(boxes: DataFrame, many: int | None = None) -> DataFrame | None:
    """(drawing_id) of drawings with more than ``many`` boxes (default: MANY), stored; None without any."""
    many = MANY if many is None else many
    large = stored(boxes.groupBy("drawing_id").count().where(F.col("count") > many).select("drawing_id"), "large")
    return None if large.isEmpty() else large


def points_in_boxes(points: DataFrame, boxes: DataFrame, px: str, py: str, low: tuple[str, str], high: tuple[str, str], inside: Column) -> DataFrame:
    """Pairs of ``points`` and ``boxes`` of one drawing for which ``inside`` holds.

    Both have drawing_id; other column names differ. ``px``, ``py``: the point; ``low``, ``high``: columns of the corners of the box, between which every point that is
    inside lies, both ends included. Points or boxes with null places meet nothing; repeated rows meet as often as they stand there.
    """
    longest = F.greatest(*[F.col(b).cast("long") - F.col(a) for a, b in zip(low, high, strict=True)])
    grid = F.greatest(F.ceil(F.log(float(STEP), F.greatest(longest, F.lit(1)) / TILE)), F.lit(0)).cast("int")
    # rounding of the logarithm may name a grid that is too fine by one
    placed = boxes.withColumn("_grid", grid).withColumn("_grid", F.when(side(F.col("_grid")) < longest, F.col("_grid") + 1).otherwise(F.col("_grid")))
    used = sorted(r["_grid"] for r in placed.select("_grid").where("_grid is not null").distinct().collect())  # at most GRIDS
    size = side(F.col("_grid"))
    for at, (a, b) in zip(("_tx", "_ty"), zip(low, high, strict=True), strict=True):
        placed = placed.withColumn(at, F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))))
    dealt = points.withColumn("_grid", F.explode(F.array(*[F.lit(g) for g in used]).cast("array<int>")))
    dealt = dealt.withColumns({"_tx": F.floor(F.col(px) / size), "_ty": F.floor(F.col(py) / size)})
    return dealt.join(placed, ["drawing_id", "_grid", "_tx", "_ty"]).where(inside).drop("_grid", "_tx", "_ty")


def boxes_near_boxes(boxes: DataFrame, margin: float) -> DataFrame:
    """Pairs (columns with a_ and b_) of different boxes (drawing_id, _n, x, y, w, h) of one drawing whose areas, each grown by ``margin``, meet; a__n < b__n.

    Each box lies in the grid of its size and in all coarser ones in use; a pair meets in the coarser grid of the two, in the tile
    that holds the lower corner of what both share, so once. In its own grid a box meets at most nine tiles, in coarser ones at most four.
    """
    grow = {"_x0": F.floor(F.col("x") - margin).cast("long"), "_y0": F.floor(F.col("y") - margin).cast("long"), "_x1": F.ceil(F.col("x") + F.col("w") + margin).cast("long"), "_y1": F.ceil(F.col("y") + F.col("h") + margin).cast("long")}
    grown = boxes.withColumns(grow)
    longest = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1))
    placed = grown.withColumn("_own", F.greatest(F.ceil(F.log(float(STEP), longest / TILE)), F.lit(0)).cast("int"))
    used = sorted(r["_own"] for r in placed.select("_own").where("_own is not null").distinct().collect())  # at most GRIDS
    dealt = placed.withColumn("_grid", F.explode(F.array(*[F.lit(g) for g in used]).cast("array<int>"))).where("_grid >= _own")
    size = side(F.col("_grid"))
    for at, (low, high) in zip(("_tx", "_ty"), (("_x0", "_x1"), ("_y0", "_y1")), strict=True):
        dealt = dealt.withColumn(at, F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))))
    key = ["drawing_id", "_grid", "_tx", "_ty"]
    a, b = (dealt.select(*key, *[F.col(c).alias(p + c) for c in dealt.columns if c not in key]) for p in ("a_", "b_"))
    both = a.join(b, key).where((F.col("a__n") < F.col("b__n")) & (F.greatest("a__own", "b__own") == F.col("_grid")))
    met = (F.col("a__x0") <= F.col("b__x1")) & (F.col("b__x0") <= F.col("a__x1")) & (F.col("a__y0") <= F.col("b__y1")) & (F.col("b__y0") <= F.col("a__y1"))
    owner = (F.floor(F.greatest("a__x0", "b__x0") / size) == F.col("_tx")) & (F.floor(F.greatest("a__y0", "b__y0") / size) == F.col("_ty"))
    return both.where(met & owner).select("drawing_id", *[p + c for p in ("a_", "b_") for c in ("_n", "x", "y", "w", "h")])
