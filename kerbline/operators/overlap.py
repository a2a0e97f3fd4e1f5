"""Pairs of overlapping boxes, found through a grid instead of all pairs of a frame.

Boxes whose IoU is above a threshold have sides within a factor ``1 / threshold``
and share the corner where their overlap begins. So in a crowded frame each box is
put in a grid of cells about its own size, and pairs meet only in the cell of that
corner; the frame is spread over its cells. Counting operators keep exact copies of
a box as one row with a count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import Box, iou
from ..session import beside, checkpointed

CORNERS = ["x1", "y1", "x2", "y2"]


def _level(low: str, high: str) -> Column:
    return F.floor(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(1e-9)))).cast("int")


def _cells(df: DataFrame, reach: int) -> DataFrame:
    """One row per grid cell a box covers, on its own level and ``reach`` coarser ones.

    Two boxes of different levels meet on the coarser of the two, so only coarser
    levels are needed. On a level of at least its own a box covers at most three
    cells a side.
    """

    def axis(low: str, high: str, level: str, cell: str, table: DataFrame) -> DataFrame:
        own = _level(low, high)
        table = table.withColumn(level, F.explode(F.sequence(own, own + reach)))
        width = F.pow(F.lit(2.0), F.col(level))
        return table.withColumn(
            cell,
            F.explode(
                F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
            ),
        )

    df = axis("x1", "x2", "level_x", "cell_x", df)
    return axis("y1", "y2", "level_y", "cell_y", df)


def _named(df: DataFrame, group: list[str], extra: list[str], mark: str) -> DataFrame:
    kept = [*group, *extra]
    return df.select(*kept, *[F.col(c).alias(mark + c) for c in df.columns if c not in kept])


def _iou_of_pair() -> Column:
    return iou(Box(*(F.col(f"l_{c}") for c in CORNERS)), Box(*(F.col(f"r_{c}") for c in CORNERS)))


def _through_grid(left: DataFrame, right: DataFrame, group: list[str], threshold: float) -> DataFrame:
    reach = math.ceil(math.log2(1 / threshold))
    grid = ["level_x", "cell_x", "level_y", "cell_y"]
    own = {"own_x": _level("x1", "x2"), "own_y": _level("y1", "y2")}
    a = _named(_cells(left.withColumns(own), reach), group, grid, "l_")
    b = _named(_cells(right.withColumns(own), reach), group, grid, "r_")

    def cell(level: str, low: str) -> Column:
        return F.floor(F.greatest(f"l_{low}", f"r_{low}") / F.pow(F.lit(2.0), F.col(level)))

    meets = (
        (F.col("level_x") == F.greatest("l_own_x", "r_own_x"))
        & (F.col("level_y") == F.greatest("l_own_y", "r_own_y"))
        & (F.col("cell_x") == cell("level_x", "x1"))
        & (F.col("cell_y") == cell("level_y", "y1"))
    )
    owns = [f"{m}_{c}" for m in "lr" for c in own]
    return a.join(b, [*group, *grid]).filter(meets).drop(*grid, *owns)


def overlapping(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    threshold: float,
    inclusive: bool = False,
    crowded: int = 64,
) -> DataFrame:
    """Pairs ``(group, l_*, r_*, iou)`` above the threshold (> 0), each once.

    Columns other than the group are prefixed ``l_`` and ``r_``. Frames of at most
    ``crowded`` boxes are joined on the frame; fuller ones, if there are any, go
    through the grid. The two ways give the same pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    left, right = left.filter(solid), right.filter(solid)
    full = (
        left.select(*group, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(right.select(*group, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(*group)
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter((F.col("a") > crowded) | (F.col("b") > crowded))
        .select(*group)
    )
    full = checkpointed(full)
    some = not full.isEmpty()
    plain = left.join(full, group, "left_anti") if some else left
    pairs = _named(plain, group, [], "l_").join(_named(right, group, [], "r_"), group)
    if some:
        dense = _through_grid(
            left.join(full, group, "left_semi"), right.join(full, group, "left_semi"), group, threshold
        )
        pairs = pairs.unionByName(dense)
    value = F.col("iou")
    return (
        pairs
        .withColumn("iou", _iou_of_pair())
        .filter(value >= threshold if inclusive else value > threshold)
    )


def copies(df: DataFrame, group: list[str], extra: list[str] | None = None) -> DataFrame:
    """Exact copies of a box in one frame as one row with ``n_copies``."""
    return df.groupBy(*group, *CORNERS, *(extra or [])).agg(F.count("*").alias("n_copies"))


def overlap_counts(df: DataFrame, group: list[str], heavy: float = 0.4, duplicate: float = 0.9) -> DataFrame:
    """One row: pairs in a frame with IoU above ``duplicate`` and above ``heavy`` only."""
    distinct = checkpointed(copies(df, group))
    ordered = F.struct(*(F.col(f"l_{c}") for c in CORNERS)) < F.struct(
        *(F.col(f"r_{c}") for c in CORNERS)
    )
    pairs = overlapping(distinct, distinct, group, heavy).filter(ordered)
    weight = F.col("l_n_copies") * F.col("r_n_copies")
    between = pairs.agg(
        F.sum(F.when(F.col("iou") > duplicate, weight)).alias("dup"),
        F.sum(F.when(F.col("iou") <= duplicate, weight)).alias("over"),
    )
    n = F.col("n_copies")
    solid = (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))
    same = distinct.filter(solid).agg(F.sum(n * (n - 1) / 2).cast("bigint").alias("same"))
    zero = F.lit(0).cast("bigint")
    return beside(between, same).select(
        (F.coalesce("dup", zero) + F.coalesce("same", zero)).alias("duplicate_pairs"),
        F.coalesce("over", zero).alias("overlap_pairs"),
    )
