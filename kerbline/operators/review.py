"""The human loop: matching reviewed boxes to proposals, patches, annotators, logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import DISPOSITIONS
from ..session import beside, checkpointed, values
from .build import numbered_globally
from .components import components
from .overlap import overlapping

EXCLUDED = tuple(d for d in DISPOSITIONS if d != "too_small")


def greedy_match(
    left: DataFrame,
    right: DataFrame,
    group: list[str],
    left_key: str,
    right_key: str,
    min_iou: float,
    crowded: int = 100_000,
) -> DataFrame:
    """One-to-one pairs ``(group, left_key, right_key, iou)``.

    In the order of ``left_key``, each left box takes the unused right box of the
    highest IoU (ties: the smallest ``right_key``) if that is at least ``min_iou``.
    Only pairs above the threshold take part. A left box is decided after those it
    shares right boxes with, directly or through others; so the pairs of a frame pass
    once, in order, through one task, and those of a frame with more than ``crowded``
    pairs through one task for each connected part of them.
    """
    keys = [f"l_{left_key}", f"r_{right_key}"]
    pairs = overlapping(
        left.select(*group, left_key, "x1", "y1", "x2", "y2"),
        right.select(*group, right_key, "x1", "y1", "x2", "y2"),
        group,
        min_iou,
        inclusive=True,
    ).select(*group, F.col(keys[0]).alias("l"), F.col(keys[1]).alias("r"), "iou")
    pairs = checkpointed(pairs)
    full = checkpointed(pairs.groupBy(*group).count().filter(F.col("count") > crowded).select(*group))
    if full.isEmpty():
        matched = _in_order(pairs.withColumn("__part", F.lit(0).cast("bigint")), group)
    else:
        parts = _with_parts(pairs.join(full, group, "left_semi"), group)
        matched = _in_order(pairs.join(full, group, "left_anti").withColumn("__part", F.lit(0).cast("bigint")).unionByName(parts), group)
    return matched.select(*group, F.col("l").alias(left_key), F.col("r").alias(right_key), "iou")


def _with_parts(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Pairs with ``__part``, one number for all that hang together by their boxes."""
    node = lambda side: F.struct(*group, F.lit(side).alias("side"), F.col(side).cast("string").alias("box"))
    edges = pairs.select(node("l").alias("u"), node("r").alias("v"))
    found = components(edges).select(F.col("node").alias("u"), F.xxhash64("component").alias("__part"))
    named = pairs.withColumn("u", node("l"))
    return named.join(found, "u").select(*pairs.columns, "__part")


def _in_order(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Each left box's first pair with a right box that no earlier left box of its frame and part has taken."""
    whole = [*group, "__part"]
    ordered = pairs.repartition(*whole).sortWithinPartitions(*whole, "l", F.desc("iou"), "r")
    marked = ordered.withColumns({"__g": F.xxhash64(*whole), "__l": F.xxhash64("l"), "__r": F.xxhash64("r")})
    return marked.mapInArrow(_first_free, marked.schema)


def _first_free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ordered pairs, each left box's first one whose right box no earlier left box of its part has taken.

    Where no two left boxes of a part want the same box first, all have it. Only parts where two do, and those that
    go on in the next batch, are walked pair by pair.
    """
    part = settled = None
    used: set[int] = set()
    for batch in batches:
        g, left, right = (batch.column(c).to_numpy() for c in ("__g", "__l", "__r"))
        if not len(g):
            continue
        new_part = np.append(True, g[1:] != g[:-1])
        number = np.cumsum(new_part) - 1
        first = np.flatnonzero(new_part | np.append(True, left[1:] != left[:-1]))
        order = np.lexsort((right[first], number[first]))
        owner, wanted = number[first][order], right[first][order]
        twice = (owner[1:] == owner[:-1]) & (wanted[1:] == wanted[:-1])
        walk = np.zeros(number[-1] + 1, bool)
        walk[owner[1:][twice]] = True
        walk[-1] = True
        walk[0] |= bool(g[0] == part)
        keep = np.zeros(len(g), bool)
        keep[first[~walk[number[first]]]] = True
        starts = np.append(np.flatnonzero(new_part), len(g))
        for k in np.flatnonzero(walk).tolist():
            begin, stop = int(starts[k]), int(starts[k + 1])
            if g[begin] != part:
                part, settled, used = g[begin], None, set()
            for at, (lone, other) in enumerate(zip(left[begin:stop].tolist(), right[begin:stop].tolist(), strict=True), begin):
                if lone != settled and other not in used:
                    settled, keep[at] = lone, True
                    used.add(other)
        yield batch.filter(pa.array(keep))


def review_outcomes(
    reviewed: DataFrame,
    proposed: DataFrame,
    reviewed_frames: DataFrame,
    frame: str,
    min_iou: float = 0.5,
) -> DataFrame:
    """``(frame, outcome)`` rows: accepted, relabelled, deleted, added, not_reviewed.

    Both sides have ``box_no`` (their order) and ``label``. Proposals on frames no
    human has seen are ``not_reviewed`` and count neither as kept nor as deleted.
    """
    pairs = greedy_match(
        reviewed.withColumnRenamed("box_no", "reviewed_no"),
        proposed.withColumnRenamed("box_no", "proposed_no"),
        [frame],
        "reviewed_no",
        "proposed_no",
        min_iou,
    )
    mine = proposed.select(frame, F.col("box_no").alias("proposed_no"), F.col("label").alias("was"))
    theirs = reviewed.select(frame, F.col("box_no").alias("reviewed_no"), F.col("label").alias("now"))
    seen = reviewed_frames.select(frame).distinct().withColumn("seen", F.lit(True))
    drawn = (
        theirs.join(pairs, [frame, "reviewed_no"], "left")
        .join(mine, [frame, "proposed_no"], "left")
        .select(
            frame,
            F.when(F.col("proposed_no").isNull(), F.lit("added"))
            .when(F.col("was") == F.col("now"), F.lit("accepted"))
            .otherwise(F.lit("relabelled"))
            .alias("outcome"),
        )
    )
    gone = (
        mine.join(pairs, [frame, "proposed_no"], "left_anti")
        .join(seen, frame, "left")
        .select(
            frame,
            F.when(F.col("seen"), F.lit("deleted")).otherwise(F.lit("not_reviewed")).alias("outcome"),
        )
    )
    return drawn.unionByName(gone)


def review_cost(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def exported_classes(lines: DataFrame) -> DataFrame:
    """``(archive, cls, label)`` of the ``obj.names`` of exports, from ``(archive, member, line_no, value)``.

    The order of the names in an export gives its class numbers, whatever order the task was made with.
    """
    names = lines.filter(F.element_at(F.split("member", "/"), -1) == "obj.names")
    return names.filter(F.trim("value") != "").select("archive", F.col("line_no").cast("int").alias("cls"), F.trim("value").alias("label"))


def name_boxes(boxes: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes ``(archive, cls, ...)`` with the label their own export gives the class, and those whose class it lacks."""
    named = boxes.join(classes, ["archive", "cls"], "left")
    return named.filter(F.col("label").isNotNull()), named.filter(F.col("label").isNull()).drop("label")


def import_tracks(
    peaks: DataFrame, context: DataFrame, boxes: DataFrame, frame: str, min_iou: float = 0.3
) -> tuple[DataFrame, DataFrame]:
    """Labels for tracks from reviewed boxes: ``(crop labels, boxes drawn by hand)``.

    Peak boxes choose first, in ``order``; context boxes then use up what they
    match, so that only boxes nobody proposed count as added. A peak without a
    match becomes ``not_a_sign``. ``peaks`` and ``context`` have ``order``;
    ``boxes`` has ``box_no`` and ``label``.
    """
    asked = peaks.select(frame, F.struct(F.lit(0).alias("turn"), F.col("order")).alias("turn"), "x1", "y1", "x2", "y2").unionByName(
        context.select(frame, F.struct(F.lit(1).alias("turn"), F.col("order")).alias("turn"), "x1", "y1", "x2", "y2")
    )
    pairs = greedy_match(asked, boxes, [frame], "turn", "box_no", min_iou)
    found = pairs.filter(F.col("turn.turn") == 0).select(
        frame, F.col("turn.order").alias("order"), "box_no"
    )
    named = (
        peaks.join(found, [frame, "order"], "left")
        .join(boxes.select(frame, "box_no", "label"), [frame, "box_no"], "left")
        .select("crop_id", F.coalesce("label", F.lit("not_a_sign")).alias("label"))
    )
    return named, boxes.join(pairs, [frame, "box_no"], "left_anti")


def patch_labels(boxes: DataFrame, patches: DataFrame, tol: float = 2e-3) -> DataFrame:
    """Delete or re-class boxes near patch points ``(stem, x, y, new_cls)``; null class deletes.

    A delete wins over a new class, and of two new classes the one of the smaller
    ``patch_no``. Points meet boxes on stem and a coarse cell about the tolerance.
    Applying the same patches again changes nothing.
    """
    cell = 4 * tol

    def cells(column: Column) -> Column:
        return F.sequence(F.floor((column - tol) / cell), F.floor((column + tol) / cell))

    points = patches.select(
        F.col("stem"),
        F.col("x").alias("px"),
        F.col("y").alias("py"),
        "new_cls",
        "patch_no",
        F.explode(cells(F.col("x"))).alias("cx"),
    ).select("*", F.explode(cells(F.col("py"))).alias("cy"))
    columns = boxes.columns
    keyed = boxes.withColumns({"cx": F.floor(F.col("xc") / cell), "cy": F.floor(F.col("yc") / cell)})
    spots = keyed.select("stem", "cx", "cy", "xc", "yc").distinct()
    verdict = (
        spots.join(points, ["stem", "cx", "cy"])
        .filter((F.abs(F.col("px") - F.col("xc")) < tol) & (F.abs(F.col("py") - F.col("yc")) < tol))
        .groupBy("stem", "xc", "yc")
        .agg(
            F.max(F.col("new_cls").isNull()).alias("gone"),
            F.min_by("new_cls", F.when(F.col("new_cls").isNotNull(), F.col("patch_no"))).alias("to"),
        )
    )
    return (
        boxes.join(verdict, ["stem", "xc", "yc"], "left")
        .filter(~F.coalesce("gone", F.lit(False)))
        .withColumn("cls", F.coalesce("to", "cls"))
        .select(columns)
    )


def label_or_fallback(proposed: DataFrame, predictions: DataFrame, dimension: DataFrame, key: str = "crop_id") -> DataFrame:
    """Add ``label``: the prediction if it is a known class, else the catch-all of the coarse class."""
    known = predictions.join(dimension.select(F.col("fine").alias("pred")), "pred")
    rest = dimension.filter("is_catch_all").select(F.col("parent").alias("coarse"), "catch_all")
    return (
        proposed.join(known.select(key, "pred"), key, "left")
        .join(rest, "coarse", "left")
        .withColumn("label", F.coalesce("pred", "catch_all"))
        .drop("pred", "catch_all")
    )


def coarse_of(crops: DataFrame, labels: DataFrame, dimension: DataFrame, key: str = "crop_id") -> DataFrame:
    """Add ``parent``: that of the human label, else the detector's class; neither is an error."""
    human = labels.join(dimension, F.col("label") == F.col("fine")).select(
        key, F.col("parent").alias("human")
    )
    return (
        crops.join(human, key, "left")
        .withColumn(
            "parent",
            F.coalesce(
                "human",
                "coarse",
                F.raise_error(F.concat(F.lit("no coarse class for "), F.col(key).cast("string"))).cast("string"),
            ),
        )
        .drop("human")
    )


def both_annotators(a: DataFrame, b: DataFrame, item: str = "item") -> DataFrame:
    """``(item, a, b)`` for every item either annotator labelled."""
    return a.select(item, F.col("label").alias("a")).join(
        b.select(item, F.col("label").alias("b")), item, "full_outer"
    )


def agreement(pairs: DataFrame) -> DataFrame:
    """One row over items labelled by both: how many, how many agree, the rate."""
    same = (F.col("a") == F.col("b")).cast("int")
    return pairs.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).agg(
        F.count("*").alias("n_both"),
        F.coalesce(F.sum(same), F.lit(0)).cast("bigint").alias("n_agreed"),
        F.avg(same.cast("double")).alias("rate"),
    )


def answer_key(pairs: DataFrame, item: str = "item", solo: bool = False) -> DataFrame:
    """``(item, label, annotators)``: agreed labels, and on demand those of one annotator.

    Items that are no sign, undecided or several signs at once are left out; too
    small ones stay.
    """
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    label = F.coalesce("a", "b")
    wanted = (both & (F.col("a") == F.col("b"))) | (~both if solo else F.lit(False))
    return pairs.filter(wanted & ~label.isin(*EXCLUDED)).select(
        item, label.alias("label"), F.when(both, F.lit(2)).otherwise(F.lit(1)).alias("annotators")
    )


def disagreements(pairs: DataFrame, item: str = "item") -> DataFrame:
    return pairs.filter(F.col("a") != F.col("b")).select(item, "a", "b")


def key_composition(key: DataFrame, dimension: DataFrame, warn_share: float = 0.20) -> DataFrame:
    """Items per class with empty classes shown, the too-small share, and whether it is too high."""
    names = dimension.select(F.col("fine").alias("label")).unionByName(
        values(dimension.sparkSession, [("too_small",)], "label string")
    )
    counts = key.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("label") == "too_small", F.col("n"))), F.lit(0)).alias("small"),
    )
    share = F.when(F.col("total") > 0, F.col("small") / F.col("total")).otherwise(F.lit(0.0))
    return beside(names.join(counts, "label", "left"), total).select(
        "label",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        share.alias("small_share"),
        (share > warn_share).alias("warn"),
    )


def settle_by_position(disputed: DataFrame, answers: DataFrame, item: str = "item") -> DataFrame:
    """Answers given by line number of the list ordered by ``(a, b, item)``: ``(item, label)``."""
    ranked = numbered_globally(disputed, ["a", "b", item], "line")
    return ranked.join(answers, "line").select(item, "label")


def replay_log(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The last verdict per key; a key whose last event is ``UNDONE`` is gone."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("e"))
    return last.select(*keys, "e.*").filter(F.col("final") != "UNDONE")


def accept_rate(log: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    taken = F.col("accepted").cast("double")
    return replay_log(log, keys, seq).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col("accepted").cast("int")), F.lit(0)).cast("bigint").alias("n_accepted"),
        F.avg(taken).alias("rate"),
    )


def only_new(rows: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key has no record of having been processed."""
    return rows.join(seen.select(*key).distinct(), key, "left_anti")


def take_batch(predictions: DataFrame, batch: DataFrame, known: DataFrame, key: str = "crop_id") -> tuple[DataFrame, DataFrame]:
    """Predictions of this batch and one row of counts; a file with no shared key is refused.

    The counts column ``right_batch`` raises an error when read, if nothing overlaps.
    """
    mine = batch.select(key).distinct().withColumn("mine", F.lit(1))
    marked = predictions.join(mine, key, "left").join(
        known.select(F.col("fine").alias("pred")).distinct().withColumn("valid", F.lit(1)), "pred", "left"
    )
    counts = marked.agg(
        F.count(F.col("mine")).alias("n_taken"),
        F.count(F.when(F.col("mine").isNull(), F.lit(1))).alias("n_foreign"),
        F.count(F.when(F.col("valid").isNull(), F.lit(1))).alias("n_unknown_label"),
    ).withColumn(
        "right_batch",
        F.when(F.col("n_taken") > 0, F.lit(True)).otherwise(
            F.raise_error(F.lit("no prediction belongs to this batch")).cast("boolean")
        ),
    )
    return marked.filter(F.col("mine").isNotNull()).select(predictions.columns), counts


def boxes_on_peak_frames(members: DataFrame, tops: DataFrame) -> DataFrame:
    """Every track's box on frames that are some track's peak; ``is_peak`` marks its own."""
    chosen = tops.select("clip", F.col("peak.frame").alias("frame")).distinct()
    own = tops.select(
        "clip", "track", F.col("peak.frame").alias("frame"), F.lit(True).alias("is_peak")
    )
    return (
        members.join(chosen, ["clip", "frame"], "left_semi")
        .join(own, ["clip", "track", "frame"], "left")
        .withColumn("is_peak", F.coalesce("is_peak", F.lit(False)))
    )


def context_boxes(members: DataFrame, tops: DataFrame) -> DataFrame:
    """Boxes on peak frames that belong to tracks not peaking there."""
    return boxes_on_peak_frames(members, tops).filter(~F.col("is_peak")).drop("is_peak")


def ingest(human: DataFrame, model: DataFrame, item: str = "item") -> tuple[DataFrame, DataFrame]:
    """Model labels only where no human label stands: ``(all labels, one row of counts)``."""
    both = human.select(item, F.col("label").alias("h")).join(
        model.select(item, F.col("label").alias("m")), item, "full_outer"
    )
    merged = both.select(
        item,
        F.coalesce("h", "m").alias("label"),
        F.when(F.col("h").isNull(), F.lit("model")).otherwise(F.lit("human")).alias("by"),
    )
    counts = both.agg(
        F.count(F.when(F.col("h").isNull(), F.lit(1))).alias("n_taken"),
        F.count(F.when(F.col("h").isNotNull() & F.col("m").isNotNull(), F.lit(1))).alias("n_held"),
    )
    return merged, counts


def add_tracks(existing: DataFrame, found: DataFrame, key: str = "crop_id") -> DataFrame:
    """Existing tracks and the new ones that have a crop, are labelable and not yet present."""
    fresh = found.filter(F.col(key).isNotNull() & F.col("labelable")).join(
        existing.select(key), key, "left_anti"
    )
    return existing.unionByName(fresh, allowMissingColumns=True)
