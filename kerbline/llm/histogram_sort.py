"""Sharding by histogram sort: near equal bytes in each shard, with one exchange of the rows.

The rows' order is that of a hash of doc_id. Candidate boundaries of the order are probed: each round
counts the exact bytes between the probes inside the intervals where a splitter must lie, everywhere
at once, and goes on with the one sub-interval of each that holds its target. A splitter is done when
the bytes below it are within the tolerance of its target, or no document lies between two probes
any more. Only then the rows move, once, each with its final shard. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

STEP = 12  #: bits that a round of probes adds
WIDTH = 63  #: bits of the key
CELL_BITS = 12  #: leading bits of the key by which rows are numbered
SPREAD = 16  #: parts in which rows of one cell are numbered


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key by which rows are ordered, kept apart from the texts."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    return rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 1))


def splitters(rows: DataFrame, shards: int, tolerance: int) -> list[int]:
    """The first key of each shard but the first; the bytes below it are within ``tolerance`` of their part of all bytes,
    or as near as whole keys allow."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    targets = [total * k // shards for k in range(1, shards)]
    found: dict[int, int] = {}
    # Of each open target: the interval's prefix, and the bytes below the interval.
    open_ = {k: (0, 0) for k in range(len(targets))}
    width = WIDTH
    while open_ and total:
        step = min(STEP, width)
        prefixes = sorted({prefix for prefix, _ in open_.values()})
        within = F.shiftrightunsigned("key", width) if width < 63 else F.lit(0).cast("long")
        probe = F.shiftrightunsigned("key", width - step)
        counted = rows.filter(within.isin(prefixes)).groupBy(probe.alias("probe")).agg(F.sum("size").alias("bytes"))
        # At most (shards - 1) << STEP counts.
        counts = sorted((r["probe"], r["bytes"]) for r in counted.collect())
        width -= step
        for k, (prefix, below) in list(open_.items()):
            for probe_, bytes_ in (c for c in counts if c[0] >> step == prefix):
                if below + bytes_ > targets[k]:
                    break
                below += bytes_
            # The target lies in the interval of probe_, which has bytes_ and begins at ``below``.
            before, after = targets[k] - below, below + bytes_ - targets[k]
            if min(before, after) <= tolerance or not width:
                found[k] = (probe_ if before <= after else probe_ + 1) << width
                del open_[k]
            else:
                open_[k] = (probe_, below)
    return [found[k] for k in sorted(found)]


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.0005) -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, law ("bytes"), shard, slot and grown_shard (null).

    Shards follow each other in the order of a hash of doc_id, text and size; ``tolerance`` is how far a boundary may lie
    from its place, as a part of a shard's bytes (a document larger than that may shift it by up to half its size).
    Slots count from 0 without a gap. A null text is empty. Equal rows have equal keys and so one shard. Copies under
    different ids are spread like any other documents. An empty table gives no rows.
    """
    rows = checkpointed(keyed(docs.select("doc_id", "text")))
    total = rows.agg(F.sum("size")).first()[0] or 0
    edges = splitters(rows, shards, int(total / shards * tolerance))
    at: Column = F.lit(0)
    for edge in edges:
        at = at + (F.col("key") >= F.lit(edge)).cast("int")
    cell = F.shiftrightunsigned("key", WIDTH - CELL_BITS).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "key", at.alias("shard"), cell.alias("cell"), F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).cast("int").alias("part"))
    # The one exchange: a row goes to its shard, cell and part, where it is numbered.
    cells = placed.groupBy("shard", "cell", "part").count()
    before = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = cells.select("shard", "cell", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begins"))
    own = Window.partitionBy("shard", "cell", "part").orderBy("key", "doc_id", "text_crc32")
    return (
        placed.withColumn("nth", F.row_number().over(own) - 1)
        .join(begins, ["shard", "cell", "part"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("begins") + F.col("nth")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
