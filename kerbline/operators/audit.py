"""Dataset audit: orphans, agreement of two formats, profiles, tables per class and clip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import beside, checkpointed, match
from .ordered import scan, tick_bucket
from .quantiles import quantiles


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, missing_in)``: keys of one side that the other has not."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(
        b.join(a, key, "left_anti").withColumn("missing_in", F.lit("left"))
    )


def compare_formats(a: DataFrame, b: DataFrame, key: str, tol: float = 1e-3, crowded: int = 10_000) -> DataFrame:
    """Two box tables of the same dataset: ``(key, what, error)`` where they differ.

    Boxes of a key are paired by their place in the order of class, x, y, w and h.
    ``what`` is ``count``, ``class`` or ``geom``; a key with unequal counts is not
    compared further. Keys of at most ``crowded`` boxes go through one shuffle of
    both tables; fuller ones, and boxes without a key, through ``_compare_runs``.
    """
    fields = ["cls", "xc", "yc", "w", "h"]
    both = a.select(key, F.lit(0).alias("__side"), *fields).unionByName(b.select(key, F.lit(1).alias("__side"), *fields))
    full = checkpointed(both.groupBy(key).count().filter((F.col("count") > crowded) | F.col(key).isNull()).select(key))
    if full.isEmpty():
        return _compare_places(both, key, fields, tol)
    apart = _compare_runs(match(a, full, [key], "left_semi"), match(b, full, [key], "left_semi"), key, tol)
    return _compare_places(match(both, full, [key], "left_anti"), key, fields, tol).unionByName(apart)


def _compare_places(both: DataFrame, key: str, fields: list[str], tol: float) -> DataFrame:
    """``compare_formats`` of both tables, told apart by ``__side``, with a key's boxes in one window."""
    side = W.partitionBy(key, "__side")
    placed = both.repartition(key).withColumns({"__at": F.row_number().over(side.orderBy(*fields)), "__n": F.count("*").over(side)})
    of = lambda c, mark: F.max(F.when(F.col("__side") == mark, F.col(c)))
    paired = placed.groupBy(key, "__at").agg(
        *[F.coalesce(of("__n", k), F.lit(0)).alias(f"n{m}") for k, m in enumerate("ab")],
        *[of(c, k).alias(f"{m}_{c}") for k, m in enumerate("ab") for c in fields],
    )
    unequal, first = F.col("na") != F.col("nb"), F.col("__at") == 1
    worst = F.greatest(*(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) for f in fields[1:]))
    what = (
        F.when(unequal, F.when(first, F.lit("count")))
        .when(F.col("a_cls") != F.col("b_cls"), F.lit("class"))
        .when(worst > tol, F.lit("geom"))
    )
    error = F.when(unequal, F.abs(F.col("na") - F.col("nb")).cast("double")).otherwise(worst)
    return paired.select(key, what.alias("what"), error.alias("error")).filter(F.col("what").isNotNull())


def _compare_runs(a: DataFrame, b: DataFrame, key: str, tol: float) -> DataFrame:
    """``compare_formats`` for keys with very many boxes.

    Equal boxes are paired as runs with a count, so that a key holding very many
    copies of a box stays one row a side.
    """
    fields = ["cls", "xc", "yc", "w", "h"]

    def side(df: DataFrame, mark: str) -> DataFrame:
        runs = df.groupBy(key, *fields).agg(F.count("*").alias("__n"))
        # Along the order: the class, then 64 stripes of x, so that one class of a crowded key is many windows.
        stripe = F.least(F.greatest(F.floor(F.col("xc") * 64), F.lit(0)), F.lit(63))
        bucket = F.col("cls").cast("bigint") * 64 + F.coalesce(stripe, F.lit(0))
        ranked = scan(
            runs, [key], fields, bucket, {"__end": ("total", F.col("__n"))}
        )
        return ranked.select(
            key,
            (F.col("__end") - F.col("__n")).alias(f"{mark}_start"),
            F.col("__end").alias(f"{mark}_end"),
            *[F.col(f).alias(f"{mark}_{f}") for f in fields],
        )

    counts = (
        a.groupBy(key).agg(F.count("*").alias("na"))
        .join(b.groupBy(key).agg(F.count("*").alias("nb")), key, "full_outer")
        .na.fill(0, ["na", "nb"])
    )
    unequal = counts.filter(F.col("na") != F.col("nb")).select(
        key, F.lit("count").alias("what"), F.abs(F.col("na") - F.col("nb")).cast("double").alias("error")
    )
    equal = counts.filter(F.col("na") == F.col("nb")).select(key)
    # Runs of both sides are cut at each other's ends: a key's positions fall in
    # blocks of 256, runs meet in the blocks they share.
    block = 256

    def blocks(df: DataFrame, mark: str) -> DataFrame:
        return df.withColumn(
            "__block",
            F.explode(
                F.sequence(
                    F.floor(F.col(f"{mark}_start") / block), F.floor((F.col(f"{mark}_end") - 1) / block)
                )
            ),
        )

    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    paired = (
        blocks(side(a, "a"), "a")
        .join(blocks(side(b, "b"), "b"), [key, "__block"])
        .filter(start < end)
        .filter(F.col("__block") == F.floor(start / block))
        .join(equal, key, "left_semi")
    )
    worst = F.greatest(*(F.abs(F.col(f"a_{f}") - F.col(f"b_{f}")) for f in fields[1:]))
    what = F.when(F.col("a_cls") != F.col("b_cls"), F.lit("class")).when(worst > tol, F.lit("geom"))
    differing = paired.select(
        key, what.alias("what"), worst.alias("error"), F.explode(F.sequence(start, end - 1)).alias("__at")
    ).filter(F.col("what").isNotNull())
    return unequal.unionByName(differing.drop("__at"))


def boxes_per_frame(frames: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """One row: mean, median and maximum boxes a frame, and frames with 0, 1, 2, 3 or more."""
    counts = boxes.groupBy(key).agg(F.count("*").alias("n"))
    every = frames.select(key).distinct().join(counts, key, "left").select(
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )
    n = F.col("n")
    return every.agg(
        F.avg("n").alias("mean"),
        # Few distinct values: one per number of boxes a frame can hold.
        F.percentile("n", F.lit(0.5)).alias("median"),
        F.max("n").alias("most"),
        F.count_if(n == 0).alias("zero"),
        F.count_if(n == 1).alias("one"),
        F.count_if(n == 2).alias("two"),
        F.count_if(n >= 3).alias("three_up"),
    )


PROBABILITIES = {"min": 0.0, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}


def quantile_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per column with its quantiles, interpolated linearly.

    Exact by default; ``approximate`` takes the nearest values of a sketch instead.
    """
    entries = F.array(
        *(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns)
    )
    long = df.select(F.explode(entries).alias("e")).select("e.measure", "e.value")
    probs = list(PROBABILITIES.values())
    if approximate:
        found = long.groupBy("measure").agg(F.percentile_approx("value", F.array(*map(F.lit, probs))).alias("q"))
    else:
        found = quantiles(long, ["measure"], "value", probs)
    return found.select("measure", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(PROBABILITIES)])


def size_buckets(df: DataFrame, scaled: str = "side_scaled", native: str = "side_px") -> DataFrame:
    """One row: boxes under 8, 12, 16 and 32 px after scaling, and small, medium, large ones."""
    s, p = F.col(scaled), F.col(native)
    under = [F.count_if(s < edge).alias(f"under_{edge}") for edge in (8, 12, 16, 32)]
    return df.agg(
        F.count("*").alias("n"),
        *under,
        *[F.avg((s < edge).cast("double") * 100).alias(f"pct_under_{edge}") for edge in (8, 12, 16, 32)],
        F.count_if(p < 32).alias("small"),
        F.count_if((p >= 32) & (p < 96)).alias("medium"),
        F.count_if(p >= 96).alias("large"),
    )


def class_table(df: DataFrame, classes: DataFrame, key: str, cls: str = "cls") -> DataFrame:
    """Per class: boxes, frames, share and side quantiles. ``classes`` is ``(cls, name)``.

    Classes without a box show as zero, undeclared ones with name ``?``.
    Distinct frames are counted after one grouping by class and frame.
    """
    frames = df.groupBy(cls, key).agg(F.count("*").alias("n")).groupBy(cls).agg(
        F.sum("n").alias("boxes"), F.count("*").alias("frames")
    )
    total = df.agg(F.count("*").alias("total"))
    sides = F.array(
        F.struct(F.lit(0).alias("m"), F.col("side_px").alias("value")),
        F.struct(F.lit(1).alias("m"), F.col("side_scaled").alias("value")),
    )
    long = df.select(cls, F.explode(sides).alias("e")).select(cls, "e.m", "e.value")
    found = quantiles(long, [cls, "m"], "value", [0.5, 0.05, 0.95])
    q = found.groupBy(cls).agg(
        F.first(F.when(F.col("m") == 0, F.col("q")), ignorenulls=True).alias("q"),
        F.first(F.when(F.col("m") == 1, F.get("q", F.lit(0))), ignorenulls=True).alias("median_scaled"),
    )
    joined = beside(classes.join(frames.join(q, cls), cls, "full_outer"), total)
    zero = F.lit(0).cast("bigint")
    return joined.select(
        cls,
        F.coalesce("name", F.lit("?")).alias("name"),
        F.coalesce("boxes", zero).alias("boxes"),
        F.coalesce("frames", zero).alias("frames"),
        (F.coalesce("boxes", zero) * 100 / F.col("total")).alias("share_pct"),
        F.get("q", F.lit(0)).alias("median_px"),
        F.get("q", F.lit(1)).alias("p05_px"),
        F.get("q", F.lit(2)).alias("p95_px"),
        "median_scaled",
    )


def size_histogram(frames: DataFrame) -> DataFrame:
    """Frames per ``(width, height)``; ``is_mode`` marks the commonest (ties: the smallest size)."""
    counts = frames.groupBy("width", "height").agg(F.count("*").alias("n"))
    mode = counts.agg(
        F.min_by(F.struct("width", "height"), F.struct((-F.col("n")).alias("n"), "width", "height")).alias("m")
    )
    return beside(counts, mode).select(
        "width",
        "height",
        "n",
        ((F.col("width") == F.col("m.width")) & (F.col("height") == F.col("m.height"))).alias("is_mode"),
    )


def attribute_counts(df: DataFrame, attributes: str) -> DataFrame:
    """``(name, value, n)`` over a map column."""
    return df.select(F.explode(attributes).alias("name", "value")).groupBy("name", "value").agg(
        F.count("*").alias("n")
    )


def labelled_per_clip(frames: DataFrame, boxes: DataFrame, key: str, clip: str) -> DataFrame:
    """Per clip: labelled frames, empty frames, and whether nothing is labelled."""
    marked = with_boxes(frames, boxes, key)
    return marked.groupBy(clip).agg(
        F.count_if("has_box").alias("labelled"),
        F.count_if(~F.col("has_box")).alias("empty"),
        (F.count_if("has_box") == 0).alias("nothing"),
    )


def with_boxes(frames: DataFrame, boxes: DataFrame, key: str) -> DataFrame:
    """Every frame with ``has_box``."""
    some = boxes.groupBy(key).agg(F.lit(True).alias("has_box"))
    return frames.join(some, key, "left").withColumn("has_box", F.coalesce("has_box", F.lit(False)))


def empty_near_labelled(
    frames: DataFrame, clip: str, frame: str, has_box: Column, reach: int = 450
) -> DataFrame:
    """Empty frames with the distance to the nearest labelled frame of the clip, and if within reach."""
    at = F.when(F.col("__has"), F.col(frame))
    bucket = tick_bucket(frame)
    marked = frames.withColumn("__has", has_box)
    both = scan(marked, [clip], [frame], bucket, {"__before": ("latest", at), "__after": ("following", at)})
    gap = F.least(F.col(frame) - F.col("__before"), F.col("__after") - F.col(frame))
    return both.filter(~F.col("__has")).select(
        *[c for c in frames.columns], gap.alias("gap"), F.coalesce(gap <= reach, F.lit(False)).alias("near")
    )


def frame_gaps(frames: DataFrame, clip: str, frame: str) -> DataFrame:
    """One row: median, smallest and largest step between neighbouring frames of a clip."""
    stepped = scan(
        frames.select(clip, frame), [clip], [frame], tick_bucket(frame), {"before": ("previous", F.col(frame))}
    )
    gaps = stepped.filter(F.col("before").isNotNull()).select((F.col(frame) - F.col("before")).alias("gap"))
    counts = gaps.groupBy("gap").agg(F.count("*").alias("n"))
    q = quantiles(counts, [], "gap", [0.0, 0.5, 1.0], weight="n")
    kind = gaps.schema["gap"].dataType
    return q.select(
        F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(0)).cast(kind).alias("least"),
        F.get("q", F.lit(2)).cast(kind).alias("most"),
    )


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def dangling(df: DataFrame, key: str, target: DataFrame) -> DataFrame:
    """Rows whose reference points at nothing."""
    return df.join(target.select(key), key, "left_anti")


def totals_agree(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows on either side and whether they agree."""
    na, nb = a.agg(F.count("*").alias("n_a")), b.agg(F.count("*").alias("n_b"))
    return beside(na, nb).withColumn("agree", F.col("n_a") == F.col("n_b"))


def same_content(a: DataFrame, b: DataFrame, key: str, digest: str = "digest") -> DataFrame:
    """One row over shared keys: how many, how many with one digest, the share."""
    joined = a.select(key, F.col(digest).alias("da")).join(b.select(key, F.col(digest).alias("db")), key)
    same = F.col("da") == F.col("db")
    return joined.agg(
        F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.avg(same.cast("double")).alias("share")
    )


def unused_and_undeclared(boxes: DataFrame, classes: DataFrame, cls: str = "cls") -> DataFrame:
    """``(cls, problem)``: declared classes never used, used classes never declared."""
    used = boxes.select(cls).distinct()
    return (
        classes.select(cls).join(used, cls, "left_anti").withColumn("problem", F.lit("unused"))
        .unionByName(
            used.join(classes.select(cls), cls, "left_anti").withColumn("problem", F.lit("undeclared"))
        )
    )


def frames_by_dataset(lists: DataFrame, clips: DataFrame, datasets: list[str]) -> DataFrame:
    """Per clip, how many frames each dataset took, beside the facts of the clip.

    ``lists`` is ``(dataset, clip, frame)``; ``clips`` is one row per clip.
    """
    counts = lists.groupBy("clip").agg(
        *[F.count_if(F.col("dataset") == d).alias(d) for d in datasets]
    )
    return clips.join(counts, "clip", "left").na.fill(0, datasets)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of a total order; each task keeps only its own first ``k``."""
    return df.orderBy(*order).limit(k)


#: Columns that ``with_mixed_order`` adds; ascending, they give its order.
MIXED_ORDER = ["__named", "__number", "__name", "__smaller"]


def with_mixed_order(df: DataFrame, label: str, size: str) -> DataFrame:
    """Numeric labels first and by number, then the others by name; the clearest first inside each.

    Adds the columns of ``MIXED_ORDER``, by which all rows can be ordered or numbered.
    """
    number = F.expr(f"try_cast(`{label}` AS DOUBLE)")
    return df.withColumns({"__named": number.isNull(), "__number": number, "__name": F.col(label), "__smaller": -F.col(size)})


def widest_per_frame(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """The widest box of each frame (ties: the smallest ``x1`` and ``y1``), as the nearest of a class."""
    rest = [c for c in boxes.columns if c not in keys]
    rank = F.struct((F.col("x2") - F.col("x1")).alias("w"), (-F.col("x1")).alias("a"), (-F.col("y1")).alias("b"))
    return boxes.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("d")).select(*keys, "d.*")
