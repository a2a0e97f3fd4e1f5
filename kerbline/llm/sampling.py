"""A bounded sample of labelled rows, for fits only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 40


def fitting_sample(known: DataFrame, most: int, inner: int | None = None) -> DataFrame:
    """Rows of ``known`` (one a doc_id) whose hash of doc_id is small: all if there are at most ``most``, else about that many.

    ``first`` tells those of the smallest hashes, about ``inner`` of them. The hash decides row by row, so tasks
    send no candidates anywhere; the number varies by its square root around ``most``.
    """
    number = known.count()
    share = lambda n: SCALE if number <= n else n * SCALE // number
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SCALE))
    return known.filter(place < share(most)).withColumn("first", place < share(most if inner is None else inner))
