"""Putting a dataset together: which frames, which boxes, which split, and what it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import label_line
from ..functions.taxonomy import DISPOSITIONS, fold_thin
from ..session import beside, checkpointed, match

BLOCKING = tuple(d for d in DISPOSITIONS if d != "not_a_sign")


# ---- numbering --------------------------------------------------------------------


def numbered_globally(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row number from 1 over the whole table, in a total order, without one big window.

    Rows are cut into ranges of the whole order, so equal leading values do not
    crowd one task, and put in order inside them. The ranges come from a sample, so
    they are kept once; Spark's row ids tell a row's range and its place there, and
    only the ranges' counts are added up.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    marked = checkpointed(ordered.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per range, as many as there are shuffle partitions.
    prior = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    counts = marked.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    return (
        marked.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .withColumn(name, (F.col("__before") + place + 1).cast("bigint"))
        .drop("__part", "__before", "__id")
    )


def box_numbers(boxes: DataFrame, frame: str, order: list[str], name: str = "box_no", crowded: int = 10_000) -> DataFrame:
    """Index from 0 of each box in its frame, in the order of the box columns.

    A frame's boxes are numbered in one window. Those of frames with more than ``crowded`` boxes are first cut into bands
    of the first order column, so such a frame is numbered in parts.
    """
    from .ordered import scan

    full = checkpointed(boxes.groupBy(frame).count().filter(F.col("count") > crowded).select(frame))
    place = F.row_number().over(W.partitionBy(frame).orderBy(*order)).cast("bigint") - 1
    if full.isEmpty():
        return boxes.withColumn(name, place)
    band = F.floor(F.col(order[0]) / 8)
    numbered = scan(match(boxes, full, [frame], "left_semi"), [frame], order, band, {"__n": ("total", F.lit(1).cast("bigint"))})
    return (
        match(boxes, full, [frame], "left_anti")
        .withColumn(name, place)
        .unionByName(numbered.withColumn(name, F.col("__n") - 1).drop("__n"))
    )


def renumber(df: DataFrame, order: list[str], name: str = "new_id") -> DataFrame:
    """Fresh contiguous ids from 1 over rows of several sources."""
    return numbered_globally(df, order, name)


def first_source_wins(df: DataFrame, name: str, source: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, skipped)``: of rows with one name the one of the first source stays."""
    first = df.groupBy(name).agg(F.min(source).alias("__first"))
    marked = df.join(first, name)
    return (
        marked.filter(F.col(source) == F.col("__first")).drop("__first"),
        marked.filter(F.col(source) != F.col("__first")).withColumnRenamed("__first", "kept_from"),
    )


def spaced_pick(df: DataFrame, group: list[str], order: list[str], bucket: Column, n: int) -> DataFrame:
    """``n`` rows of each group, evenly spaced along the order, first and last included."""
    from .ordered import numbered

    ranked = numbered(df, group, order, bucket, "__rank")
    size = df.groupBy(*group).agg(F.count("*").alias("__size"))
    last = F.col("__size") - 1
    place = (F.col("__rank") - 1).cast("bigint")
    if n == 1:
        wanted = place == 0
    else:
        # The places are the whole parts of i * last / (n - 1) for i = 0 .. n - 1.
        nearest = F.ceil(place * (n - 1) / last)
        wanted = (last == 0) | (
            (nearest <= n - 1) & (F.floor(nearest * last / (n - 1)) == place)
        )
    return ranked.join(size, group).filter(wanted | (F.col("__size") <= n)).select(df.columns)


# ---- sources to one dataset ---------------------------------------------------------


def merge_sessions(
    images: DataFrame, annotations: DataFrame, pictures: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Several labelling sessions to one dataset: ``(images, annotations, notes)``.

    ``images`` is ``(source, image_id, name, width, height)``, ``annotations`` is
    ``(source, annotation_id, image_id, idx, ...)`` with class names resolved, and
    ``pictures`` is ``(source, name)``, the files that are really there. The first
    source of a name wins. Images without a file go, with their boxes; files no
    image lists come in as background, sized like the session's commonest image.
    Ids are renumbered from 1 in the order of source and name.
    """
    every = merged_images(images, pictures)
    fresh = annotations.join(
        every.filter(F.col("image_id").isNotNull()).select("source", "image_id", "new_image_id"),
        ["source", "image_id"],
    )
    return every, numbered_globally(fresh, ["source", "annotation_id"], "new_annotation_id"), merge_notes(images, pictures)


def _unlisted(images: DataFrame, kept: DataFrame) -> DataFrame:
    """Pictures that no image lists, as background sized like their session's commonest image."""
    counts = images.groupBy("source", "width", "height").agg(F.count("*").alias("n"))
    modal = counts.groupBy("source").agg(
        F.min_by(F.struct("width", "height"), F.struct((-F.col("n")).alias("n"), "width", "height")).alias("m")
    )
    return (
        kept.join(images, ["source", "name"], "left_anti")
        .join(modal, "source")
        .select("source", F.lit(None).cast("bigint").alias("image_id"), "name", "m.width", "m.height")
    )


def merged_images(images: DataFrame, pictures: DataFrame) -> DataFrame:
    """The images of ``merge_sessions`` alone, with ``new_image_id``."""
    kept, _ = first_source_wins(pictures, "name", "source")
    listed = images.join(kept, ["source", "name"], "left_semi")
    every = listed.select("source", "image_id", "name", "width", "height").unionByName(_unlisted(images, kept))
    return numbered_globally(every, ["source", "name"], "new_image_id")


def merge_notes(images: DataFrame, pictures: DataFrame) -> DataFrame:
    """The notes of ``merge_sessions`` alone, ``(source, name, note)``; nothing is numbered for them."""
    kept, skipped = first_source_wins(pictures, "name", "source")
    return (
        skipped.select("source", "name", F.lit("came from an earlier source").alias("note"))
        .unionByName(
            images.join(pictures, ["source", "name"], "left_anti").select(
                "source", "name", F.lit("listed, no file").alias("note")
            )
        )
        .unionByName(_unlisted(images, kept).select("source", "name", F.lit("file, not listed").alias("note")))
    )


def latest_batch(df: DataFrame, frame: str, batch: str) -> DataFrame:
    """Rows of each frame's latest batch only."""
    last = df.groupBy(frame).agg(F.max(batch).alias(batch))
    return df.join(last, [frame, batch], "left_semi")


def union_once(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Union over passes, each key once; the first table that has it wins."""
    every = None
    for i, table in enumerate(tables):
        part = table.withColumn("__pass", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rest = [c for c in every.columns if c not in [*key, "__pass"]]
    return every.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct("__pass", *rest)).alias("r")
    ).select(*key, "r.*")


def frame_reasons(boxes: DataFrame, frame: str, classes: DataFrame, label: str = "label", order: str = "box_no") -> DataFrame:
    """``(frame, reason)`` for frames that must go: an unnamed sign, or a label nobody knows.

    The first unnamed sign by ``order`` gives the reason; ``not_a_sign`` boxes do not count.
    """
    known = classes.select(F.col("fine").alias(label)).withColumn("__known", F.lit(True))
    marked = boxes.filter(F.col(label) != "not_a_sign").join(known, label, "left")
    special = F.col(label).isin(*BLOCKING)
    return (
        marked.groupBy(frame)
        .agg(
            F.min_by(label, F.when(special, F.col(order))).alias("first"),
            F.max(F.col("__known").isNull() & ~special).alias("unknown"),
        )
        .withColumn(
            "reason",
            F.coalesce("first", F.when(F.col("unknown"), F.lit("unknown_label"))),
        )
        .filter(F.col("reason").isNotNull())
        .select(frame, "reason")
    )


def usable_frames(
    frames: DataFrame, boxes: DataFrame, reviewed: DataFrame, frame: str, classes: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(frames, boxes, dropped)`` of what a human has reviewed and named completely.

    Frames nobody reviewed are left out, with reason ``not_reviewed``; frames
    without boxes stay as background.
    """
    bad = frame_reasons(boxes, frame, classes)
    unseen = (
        frames.join(reviewed.select(frame), frame, "left_anti")
        .select(frame)
        .withColumn("reason", F.lit("not_reviewed"))
    )
    dropped = unseen.unionByName(bad.join(unseen, frame, "left_anti").join(frames.select(frame), frame, "left_semi"))
    good = frames.join(dropped, frame, "left_anti")
    return good, boxes.filter(F.col("label") != "not_a_sign").join(good.select(frame), frame, "left_semi"), dropped


# ---- label propagation ---------------------------------------------------------------


def poisoned_frames(
    passes: DataFrame, labelled: DataFrame, blocked: DataFrame, members: DataFrame, tolerate: float = 30.0
) -> DataFrame:
    """``(clip, frame, reason)``: frames holding a real sign that will get no box.

    ``passes`` is ``(clip, track, frame, size, labelable, crop_id)`` over all tracks
    found; tracks seen in several passes count once, by the smallest pass. ``labelled``
    and ``blocked`` hold crop ids; ``members`` is ``(crop_id, clip, frame)``.
    """
    known = labelled.select("crop_id").distinct()
    loose = passes.filter(~F.coalesce("labelable", F.lit(False))).join(known, "crop_id", "left_anti")
    first = loose.groupBy("clip", "track").agg(F.min("pass_no").alias("pass_no"))
    unboxed = (
        loose.join(first, ["clip", "track", "pass_no"], "left_semi")
        .filter(F.col("size") >= tolerate)
        .select("clip", "frame", F.lit(0).alias("rank"))
    )
    unnamed = members.join(blocked, "crop_id", "left_semi").select("clip", "frame", F.lit(1).alias("rank"))
    return (
        unboxed.unionByName(unnamed)
        .groupBy("clip", "frame")
        .agg(F.min("rank").alias("rank"))
        .select(
            "clip",
            "frame",
            F.when(F.col("rank") == 0, F.lit("unboxed_sign")).otherwise(F.lit("unnamed_sign")).alias("reason"),
        )
    )


def propagate(
    members: DataFrame,
    labels: DataFrame,
    poison: DataFrame,
    dimension: DataFrame,
    step: float = 0.20,
    val_fraction: float = 0.2,
    min_signs: int = 5,
    seed: int = 0,
) -> DataFrame:
    """One label per track to a box on every sampled frame, with its fate.

    ``members`` is ``(crop_id, clip, frame, x1, y1, x2, y2, size)``, ``labels`` is
    ``(crop_id, label)``. ``fate`` is ``kept``, a reason of ``poison``, or
    ``split_conflict`` where tracks of both sides meet on a frame.
    """
    from .splits import split_conflicts, stratified_split
    from .tracks import change_sample

    named = labels.join(dimension.select(F.col("fine").alias("label")), "label", "left_semi")
    folded = fold_thin(named, dimension, min_signs).select("crop_id", "folded")
    sides = stratified_split(folded, "crop_id", "folded", val_fraction, seed)
    drawn = members.join(sides, "crop_id")
    kept = change_sample(checkpointed(drawn), ["crop_id"], "frame", "size", step)
    judged = checkpointed(kept.join(poison, ["clip", "frame"], "left"))
    clash = (
        split_conflicts(judged.filter(F.col("reason").isNull()), ["clip", "frame"])
        .withColumn("clash", F.lit("split_conflict"))
    )
    return (
        judged.join(clash, ["clip", "frame"], "left")
        .withColumn("fate", F.coalesce("reason", "clash", F.lit("kept")))
        .drop("reason", "clash")
    )


def propagation_report(placed: DataFrame) -> DataFrame:
    """Per class: raw detections, signs, val signs, boxes kept and their number a sign, boxes lost by reason, frames with a
    kept box in train and in val, and whether val has no sign."""
    def lost(reason: str) -> Column:
        return F.count_if(F.col("fate") == reason).alias(reason)

    per_sign = placed.groupBy("folded", "crop_id", "split").agg(
        F.count("*").alias("detections"),
        F.count_if(F.col("fate") == "kept").alias("boxes"),
        lost("unboxed_sign"), lost("unnamed_sign"), lost("split_conflict"),
    )
    total = [F.sum(c).alias(c) for c in ("detections", "boxes", "unboxed_sign", "unnamed_sign", "split_conflict")]
    frames = placed.filter("fate = 'kept'").groupBy("folded", "split", "clip", "frame").agg(F.lit(1).alias("one"))
    per_split = frames.groupBy("folded").agg(
        F.count_if(F.col("split") == "train").alias("train_frames"), F.count_if(F.col("split") == "val").alias("val_frames")
    )
    report = per_sign.groupBy("folded").agg(
        F.count("*").alias("signs"),
        F.count_if(F.col("split") == "val").alias("val_signs"),
        *total,
        (F.count_if(F.col("split") == "val") == 0).alias("no_val"),
    )
    return match(report, per_split, ["folded"], "left").na.fill(0, ["train_frames", "val_frames"]).withColumn(
        "boxes_per_sign", F.round(F.col("boxes") / F.col("signs"), 6)
    )


# ---- output -------------------------------------------------------------------------


def label_texts(frames: DataFrame, boxes: DataFrame, frame: str, keep: list[str]) -> DataFrame:
    """One row per frame with its label file text; empty for background frames.

    Boxes are ``(frame, cls, xc, yc, w, h)``. A text is one file of the output, so
    the boxes of a frame do meet in one value.
    """
    line = label_line(*(F.col(c) for c in ("cls", "xc", "yc", "w", "h")))
    texts = boxes.select(frame, line.alias("line")).groupBy(frame).agg(
        F.concat(F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n")).alias("text")
    )
    return frames.select(frame, *keep).join(texts, frame, "left").withColumn(
        "text", F.coalesce("text", F.lit(""))
    )


def split_stats(frames: DataFrame, boxes: DataFrame, frame: str) -> DataFrame:
    """Per split: images, boxes and images without a box. ``frames`` has ``split``."""
    counts = boxes.groupBy(frame).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return frames.join(counts, frame, "left").groupBy("split").agg(
        F.count("*").alias("images"), F.sum(n).cast("bigint").alias("boxes"), F.count_if(n == 0).alias("negatives")
    )


def class_histogram(boxes: DataFrame, classes: DataFrame, cls: str = "cls") -> DataFrame:
    """Boxes per class, classes without one shown as 0."""
    counts = boxes.groupBy(cls).agg(F.count("*").alias("n"))
    return classes.join(counts, cls, "left").select(
        *classes.columns, F.coalesce("n", F.lit(0)).cast("bigint").alias("boxes")
    )


def subset_tally(frames: DataFrame, boxes: DataFrame, subset: list[str], frame: str, clip: str, classes: list[int]) -> DataFrame:
    """Per subset: clips, images, boxes, backgrounds and boxes of each class."""
    per_frame = boxes.groupBy(frame).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("cls") == c).alias(f"cls_{c}") for c in classes]
    )
    joined = frames.join(per_frame, frame, "left").na.fill(0)
    per_clip = joined.groupBy(*subset, clip).agg(
        F.count("*").alias("images"),
        F.sum("n").alias("boxes"),
        F.count_if(F.col("n") == 0).alias("backgrounds"),
        *[F.sum(f"cls_{c}").alias(f"cls_{c}") for c in classes],
    )
    return per_clip.groupBy(*subset).agg(
        F.count("*").alias("clips"),
        *[F.sum(c).alias(c) for c in ("images", "boxes", "backgrounds", *[f"cls_{c}" for c in classes])],
    )


def dataset_card(stats: DataFrame, histogram: DataFrame, dropped: DataFrame, facts: dict[str, str]) -> DataFrame:
    """One JSON document: the facts, statistics per split, class histogram and dropped rows."""
    parts = stats.agg(F.sort_array(F.collect_list(F.struct(*stats.columns))).alias("splits"))
    parts = beside(parts, histogram.agg(F.sort_array(F.collect_list(F.struct(*histogram.columns))).alias("classes")))
    parts = beside(parts, dropped.agg(F.count("*").alias("dropped")))
    wide = parts.select(*[F.lit(v).alias(k) for k, v in sorted(facts.items())], "splits", "classes", "dropped")
    return wide.select(F.to_json(F.struct(*wide.columns)).alias("card"))


def export_faults(boxes: DataFrame, n_classes: int) -> DataFrame:
    """Boxes of a finished export that break its rules, with the first ``problem`` of each."""
    cls = F.col("cls")
    inside = F.lit(True)
    for c in ("xc", "yc", "w", "h"):
        inside = inside & F.col(c).between(0, 1)
    problem = F.when(~cls.between(0, n_classes - 1), F.lit("class_range")).when(~inside, F.lit("coordinates"))
    return boxes.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def export_manifest(picks: DataFrame, index: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Picked frames with where they came from, and counts per video.

    ``picks`` is ``(video, frame_no)``, ``index`` adds time, size and interval,
    ``files`` holds the frames that exist; a pick without a file is skipped.
    """
    rows = picks.distinct().join(index, ["video", "frame_no"]).join(files, ["video", "frame_no"], "left_semi")
    return rows, rows.groupBy("video").agg(F.count("*").alias("n_frames"))


def carry_boxes(frames: DataFrame, cached: DataFrame, boxes: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(frames, boxes, skipped)`` for a new batch: only frames in the cache, with their boxes."""
    have = cached.select(key).distinct()
    taken = frames.join(have, key, "left_semi")
    return taken, boxes.join(taken.select(key), key, "left_semi"), frames.join(have, key, "left_anti")
