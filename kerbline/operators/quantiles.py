"""Exact quantiles without gathering a group's values in one place.

Spark's own exact percentile keeps every distinct value of a group in one buffer.
Here equal values are counted first; a sketch cuts each group into about equal
ranges; the ranges are counted, and only those ranges that hold a wanted rank are
ranked value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import beside

RANGES = 256


def quantiles(
    df: DataFrame, group: list[str], column: str, probs: list[float], weight: str | None = None
) -> DataFrame:
    """``(group..., q)``: linearly interpolated quantiles in the order of ``probs``. Nulls are skipped.

    With ``weight``, rows are values with a count and each value comes once a group.
    """
    keys = group
    src = df.filter(F.col(column).isNotNull()).withColumn("__v", F.col(column).cast("double"))
    n = F.count("*") if weight is None else F.sum(weight)
    counted = src.groupBy(*keys, "__v").agg(n.alias("__n"))
    shares = F.expr("array(" + ", ".join(f"{i / RANGES}D" for i in range(1, RANGES)) + ")")
    # One row of at most 256 cuts per group.
    cuts = src.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("__v", shares, F.lit(2000))).alias("__cuts")
    )
    ranged = (counted.join(cuts, keys) if keys else beside(counted, cuts)).withColumn(
        "__range", F.size(F.filter("__cuts", lambda c: F.col("__v") > c))
    ).drop("__cuts")
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum("__n").alias("__size"))
    prior = W.partitionBy(*keys).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    placed = sizes.withColumns(
        {"__before": F.coalesce(F.sum("__size").over(prior), F.lit(0)), "__total": F.sum("__size").over(whole)}
    )
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs))))
    rank = F.col("w.p") * (F.col("__total") - 1)
    wanted = placed.withColumn("w", at).select(
        *keys, "__range", "__before", "__size", F.col("w.i").alias("i"), rank.alias("__rank"),
        F.explode(F.array(F.floor(rank), F.ceil(rank))).alias("__at"),
    ).filter((F.col("__at") >= F.col("__before")) & (F.col("__at") < F.col("__before") + F.col("__size")))
    needed = wanted.select(*keys, "__range", "__before").distinct()
    upto = W.partitionBy(*keys, "__range").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = ranged.join(needed, [*keys, "__range"]).withColumn("__end", F.col("__before") + F.sum("__n").over(upto))
    value = (
        wanted.select(*keys, "__range", "i", "__rank", "__at")
        .join(ends.select(*keys, "__range", "__v", "__n", "__end"), [*keys, "__range"])
        .filter((F.col("__at") < F.col("__end")) & (F.col("__at") >= F.col("__end") - F.col("__n")))
    )
    low = F.max(F.when(F.col("__at") == F.floor("__rank"), F.col("__v")))
    high = F.max(F.when(F.col("__at") == F.ceil("__rank"), F.col("__v")))
    share = F.first("__rank") - F.floor(F.first("__rank"))
    each = value.groupBy(*keys, "i").agg((low + (high - low) * share).alias("q"))
    return each.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q")
    )
