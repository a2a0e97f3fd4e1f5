"""Tracks: merging split ones, thinning their detections, their best view.

Detections are ``(clip, track, frame, x1, y1, x2, y2, size, ...)``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import box, centre
from ..session import checkpointed
from .components import with_component
from .ordered import NOWHERE, entries, restored, solid
from .overlap import overlapping
from .quantiles import quantiles

BOX = ["x1", "y1", "x2", "y2"]
BUCKET = 16
#: Detections of a clip that one task merges; the clips with more go through rounds over all of them.
IN_TASK = 2000


def one_per_frame(dets: DataFrame, keys: list[str]) -> DataFrame:
    """The largest detection of each ``keys`` and frame; ties go to the smallest box columns."""
    rest = [c for c in dets.columns if c not in [*keys, "frame"]]
    best = F.max_by(
        F.struct(*rest), F.struct("size", *[(-F.col(c)).alias(c) for c in BOX])
    )
    return dets.groupBy(*keys, "frame").agg(best.alias("d")).select(
        *keys, "frame", *[F.col(f"d.{c}").alias(c) for c in rest]
    )


def _shared(dets: DataFrame) -> DataFrame:
    """Pairs of tracks, one of them ``touched``, that overlap on at least two frames of a clip."""
    rows = dets.select("clip", "frame", "track", "touched", *BOX)
    once = ~F.col("r_touched") | (F.col("l_track") < F.col("r_track"))
    pairs = overlapping(rows.filter("touched"), rows, ["clip", "frame"], 0.5).filter((F.col("l_track") != F.col("r_track")) & once)
    return (
        pairs.groupBy("clip", F.least("l_track", "r_track").alias("a"), F.greatest("l_track", "r_track").alias("b"))
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= 2)
        .select("clip", "a", "b")
    )


def _handed_over(dets: DataFrame, low: int = -3, high: int = 12) -> DataFrame:
    """Pairs of tracks, one of them ``touched``, where one starts about where and when the other ends."""
    view = F.struct("frame", "size", *BOX)
    ends = dets.groupBy("clip", "track").agg(
        F.min_by(view, "frame").alias("first"), F.max_by(view, "frame").alias("last"), F.first("touched").alias("touched")
    )
    left = ends.select(
        "clip",
        F.col("track").alias("a"),
        F.col("touched").alias("ta"),
        F.col("last").alias("x"),
        F.explode(
            F.sequence(
                F.floor((F.col("last.frame") + low) / BUCKET),
                F.floor((F.col("last.frame") + high) / BUCKET),
            )
        ).alias("bucket"),
    )
    right = ends.select(
        "clip",
        F.col("track").alias("b"),
        F.col("touched").alias("tb"),
        F.col("first").alias("y"),
        F.floor(F.col("first.frame") / BUCKET).alias("bucket"),
    )
    gap = F.col("y.frame") - F.col("x.frame")
    (px, py), (qx, qy) = centre(box("x.")), centre(box("y."))
    ratio = F.col("y.size") / F.greatest(F.col("x.size"), F.lit(1e-9))
    return (
        left.join(right, ["clip", "bucket"])
        .filter((F.col("a") != F.col("b")) & (F.col("ta") | F.col("tb")))
        .filter(gap.between(low, high) & (ratio > 0.5) & (ratio < 2.0))
        .filter(
            F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
            < F.greatest(F.col("x.size"), F.col("y.size"))
        )
        .select("clip", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    )


def same_sign_pairs(dets: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """``(clip, a, b)`` with ``a < b``: tracks of one clip that show the same sign.

    ``dets`` has at most one detection per track and frame. With ``touched``
    (clip, track) only pairs with one of these tracks are looked for.
    """
    if touched is None:
        marked = dets.withColumn("touched", F.lit(True))
    else:
        marked = dets.join(touched.select("clip", "track", F.lit(True).alias("touched")), ["clip", "track"], "left")
        marked = marked.withColumn("touched", F.coalesce("touched", F.lit(False)))
    return _shared(marked).unionByName(_handed_over(marked)).distinct()


def merge_tracks(dets: DataFrame) -> DataFrame:
    """Relabel detections so that each sign has one track, until nothing changes.

    The track with the largest view survives (ties: the smallest id) and keeps the
    largest detection of each frame. A clip of ordinary size is merged by one task, so
    its rounds are no jobs of the driver; all others go through a round together. Tracks
    that a round left as they were have been compared with each other, so the next
    round looks only for pairs with a track that has just taken others in.
    """
    now = checkpointed(one_per_frame(dets, ["clip", "track"]))
    kinds = dict(now.dtypes)
    numbers = [*BOX, "size"]
    if any(kinds[c] != "double" for c in numbers) or any(kinds[c] not in ("int", "bigint") for c in ("track", "frame")):
        return _merged_in_rounds(now)
    odd = F.lit(False)
    for c in ("track", "frame", *numbers):
        odd = odd | F.col(c).isNull() | (F.isnan(c) if c in numbers else F.lit(False))
    crowded = now.groupBy("clip").agg(F.count("*").alias("n"), F.max(odd).alias("odd")).filter((F.col("n") > IN_TASK) | F.col("odd")).select("clip")
    named = now.filter("clip IS NOT NULL")
    done = checkpointed(named.join(crowded, "clip", "left_anti").select(now.columns).groupBy("clip").applyInArrow(_merged_in_clip, now.schema))
    rest = checkpointed(named.join(crowded, "clip", "left_semi").select(now.columns).unionByName(now.filter("clip IS NULL")))
    return done if rest.isEmpty() else done.unionByName(_merged_in_rounds(rest))


def _merged_in_clip(clip: pa.Table) -> pa.Table:
    """The rounds of ``merge_tracks`` over one clip."""
    track, frame, size, *box = (clip.column(c).to_numpy() for c in ("track", "frame", "size", *BOX))
    x1, y1, x2, y2 = box
    at = np.arange(len(track))  # the rows that are left, and the tracks they are of
    touched = np.unique(track)
    while True:
        own = track[at]
        fresh = np.isin(own, touched)
        pairs = np.concatenate([_shared_in_clip(own, fresh, frame[at], *(c[at] for c in box)), _handed_in_clip(own, fresh, frame[at], size[at], *(c[at] for c in box))])
        if not len(pairs):
            left = clip.take(pa.array(at))
            return left.set_column(left.schema.get_field_index("track"), left.schema.field("track"), pa.array(own, left.schema.field("track").type))
        root: dict[int, int] = {}
        for a, b in pairs.tolist():
            a, b = (_root(root, x) for x in (a, b))
            root[max(a, b)] = min(a, b)
        peak = {t: size[at][own == t].max() for t in root.keys() | set(root.values())}
        best: dict[int, tuple] = {}
        for t in peak:
            top = _root(root, t)
            best[top] = min(best.get(top, (-peak[t], t)), (-peak[t], t))
        track = track.copy()
        for t in peak:
            track[at[own == t]] = best[_root(root, t)][1]
        touched = np.array([t for _, t in best.values()])
        order = at[np.lexsort((y2[at], x2[at], y1[at], x1[at], -size[at], frame[at], track[at]))]
        first = np.append(True, (track[order][1:] != track[order][:-1]) | (frame[order][1:] != frame[order][:-1]))
        at = order[first]


def _root(root: dict[int, int], t: int) -> int:
    while root.setdefault(t, t) != t:
        t = root[t]
    return t


def _shared_in_clip(track, fresh, frame, x1, y1, x2, y2) -> np.ndarray:
    """``_shared`` over one clip."""
    order = np.argsort(frame, kind="stable")
    order = order[(x2[order] > x1[order]) & (y2[order] > y1[order])]
    place, f = np.arange(len(order)), frame[order]
    count = np.searchsorted(f, f, "right") - place - 1
    left = np.repeat(place, count)
    right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + left + 1
    a, b = order[left], order[right]
    met = (track[a] != track[b]) & (fresh[a] | fresh[b])
    a, b = a[met], b[met]
    inter = np.maximum(0.0, np.minimum(x2[a], x2[b]) - np.maximum(x1[a], x1[b])) * np.maximum(0.0, np.minimum(y2[a], y2[b]) - np.maximum(y1[a], y1[b]))
    area = (x2 - x1) * (y2 - y1)
    near = inter / (area[a] + area[b] - inter) > 0.5
    ends = np.sort(np.stack([track[a][near], track[b][near]], axis=1), axis=1)
    pairs, n = np.unique(ends, axis=0, return_counts=True)
    return pairs[n >= 2]


def _handed_in_clip(track, fresh, frame, size, x1, y1, x2, y2, low: int = -3, high: int = 12) -> np.ndarray:
    """``_handed_over`` over one clip."""
    order = np.lexsort((frame, track))
    new = np.append(True, track[order][1:] != track[order][:-1])
    first, last = order[new], order[np.append(new[1:], True)]
    x, y = last[:, None], first[None, :]
    gap, ratio = frame[y] - frame[x], size[y] / np.maximum(size[x], 1e-9)
    dx, dy = (x1[x] + x2[x]) / 2 - (x1[y] + x2[y]) / 2, (y1[x] + y2[x]) / 2 - (y1[y] + y2[y]) / 2
    met = (track[x] != track[y]) & (fresh[x] | fresh[y]) & (gap >= low) & (gap <= high) & (ratio > 0.5) & (ratio < 2.0)
    i, j = np.nonzero(met & (np.sqrt(dx * dx + dy * dy) < np.maximum(size[x], size[y])))
    return np.sort(np.stack([track[last[i]], track[first[j]]], axis=1), axis=1)


def _merged_in_rounds(now: DataFrame) -> DataFrame:
    """``merge_tracks`` of clips of any size, over detections that are one a track and frame."""
    touched = None
    while True:  # a round with pairs leaves fewer tracks, so the rounds end
        pairs = checkpointed(same_sign_pairs(now, touched))
        if pairs.isEmpty():
            return now
        node = lambda column: F.struct("clip", F.col(column).alias("track"))
        edges = pairs.select(node("a").alias("u"), node("b").alias("v"))
        paired = pairs.select("clip", F.explode(F.array("a", "b")).alias("track")).distinct()
        sizes = now.join(paired, ["clip", "track"]).groupBy("clip", "track").agg(F.max("size").alias("peak"))
        named = with_component(sizes.withColumn("node", node("track")), "node", edges)
        survivor = named.groupBy("component").agg(
            F.min_by("track", F.struct((-F.col("peak")).alias("p"), "track")).alias("survivor")
        )
        rename = checkpointed(named.join(survivor, "component").select("clip", "track", "survivor"))
        touched = rename.select("clip", F.col("survivor").alias("track")).distinct()
        relabelled = now.join(rename, ["clip", "track"]).drop("track").withColumnRenamed("survivor", "track")
        merged = one_per_frame(relabelled.select(now.columns), ["clip", "track"]).select(now.columns)
        now = checkpointed(now.join(rename, ["clip", "track"], "left_anti").select(now.columns).unionByName(merged))


def peaks(dets: DataFrame, min_dets: int = 3, min_side: float = 60.0) -> DataFrame:
    """One row per track: its largest view, how often seen, whether its class flips.

    Tracks seen fewer than ``min_dets`` times are left out; ``labelable`` tells
    whether the best view is large enough to name.
    """
    view = F.struct("size", (-F.col("frame")).alias("f"), *[(-F.col(c)).alias(c) for c in BOX])
    return (
        dets.groupBy("clip", "track")
        .agg(
            F.count("*").alias("n_dets"),
            (F.min("cls") != F.max("cls")).alias("flips_class"),
            F.max_by(F.struct("frame", "cls", "conf", "size", *BOX), view).alias("peak"),
        )
        .filter(F.col("n_dets") >= min_dets)
        .withColumn("labelable", F.col("peak.size") >= min_side)
    )


def class_flips_by_size(dets: DataFrame, tops: DataFrame, edges: tuple[float, ...] = (30, 60, 100)) -> DataFrame:
    """Share of detections whose class differs from the peak's, and median confidence, by size band."""
    band = F.lit(len(edges))
    for i, edge in reversed(list(enumerate(edges))):
        band = F.when(F.col("size") < edge, F.lit(i)).otherwise(band)
    joined = dets.join(tops.select("clip", "track", F.col("peak.cls").alias("peak_cls")), ["clip", "track"])
    banded = joined.withColumn("band", band)
    middle = quantiles(banded, ["band"], "conf", [0.5])
    return (
        banded.groupBy("band")
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col("cls") != F.col("peak_cls")).cast("double")).alias("share_other_class"),
        )
        .join(middle, "band")
        .select("band", "n", "share_other_class", F.get("q", F.lit(0)).alias("median_conf"))
    )


# ---- thinning ---------------------------------------------------------------------


def change_sample(
    dets: DataFrame,
    keys: list[str],
    frame: str,
    value: str,
    step: float = 0.20,
    bucket: int = 4096,
) -> DataFrame:
    """Keep a row when its value differs from the last *kept* one by ``step`` or more.

    The first row of a key is kept. See ``_sampled`` for how a long key is split.
    """
    return _sampled(
        dets,
        keys,
        frame,
        value,
        lambda last, now: F.abs(now - last) / F.greatest(last, F.lit(1e-9)) >= step,
        F.floor(F.col(frame) / bucket),
    )


def interval_sample(
    frames: DataFrame, keys: list[str], frame: str, time: str, interval: float, per_bucket: int = 64
) -> DataFrame:
    """Keep the first frame at or after the last kept time plus ``interval`` seconds.

    Buckets are ``per_bucket`` intervals long; only the frames of a bucket's first
    interval can be the first one kept in it.
    """
    return _sampled(
        frames,
        keys,
        frame,
        time,
        lambda last, now: now + 1e-6 >= last + interval,
        F.floor(F.col(time) / (interval * per_bucket)),
        horizon=interval,
    )


def fixed_step_sample(frames: DataFrame, frame: str, fps: Column, interval: float) -> DataFrame:
    """Every ``max(1, round(fps * interval))``-th frame, from frame 0."""
    step = F.greatest(F.lit(1), F.bround(fps * interval)).cast("bigint")
    return frames.filter(F.col(frame) % step == 0)


def _sampled(
    dets: DataFrame,
    keys: list[str],
    frame: str,
    value: str,
    differs,
    bucket: Column,
    horizon: float | None = None,
) -> DataFrame:
    """Sampling against the last kept value, over buckets of the order.

    What a bucket does depends only on the value it is entered with, and through
    it only on which row is kept first. That row is always a new maximum or a new
    minimum of its bucket. So each bucket lists, for those rows alone, the value it
    is left with; two lists compose into that of both stretches, so entered values are
    found by a parallel prefix, and each bucket is replayed from its own. A key that has
    one bucket only is run at once. ``frame`` is unique inside a key.
    """
    slot, number = "__slot", "double"
    rest = [c for c in dets.columns if c not in [*keys, frame]]
    row = F.struct(F.col(frame).alias("f"), F.col(value).cast(number).alias("v"), F.struct(*rest).alias("d"))
    rows, solid_keys = solid(dets.withColumn(slot, F.coalesce(bucket.cast("bigint"), F.lit(NOWHERE))), keys)
    grouped = rows.groupBy(*solid_keys, slot).agg(F.sort_array(F.collect_list(row)).alias("__rows"))

    def run(rows: Column, start: Column) -> Column:
        return F.aggregate(
            rows, start, lambda last, r: F.when(differs(last, r["v"]), r["v"]).otherwise(last)
        )

    def is_record(lo: Column, hi: Column, v: Column) -> Column:
        fresh = lo.isNull() | (v < lo) | (v > hi)
        return fresh if horizon is None else fresh & F.coalesce(hi < lo + horizon, F.lit(True))

    records = F.aggregate(
        "__rows",
        F.struct(
            F.lit(None).cast(number).alias("lo"),
            F.lit(None).cast(number).alias("hi"),
            F.lit(1).alias("i"),
            F.array().cast("array<struct<v:double,i:int>>").alias("out"),
        ),
        lambda s, r: F.struct(
            F.least(s["lo"], r["v"]).alias("lo"),
            F.greatest(s["hi"], r["v"]).alias("hi"),
            (s["i"] + 1).alias("i"),
            F.when(
                is_record(s["lo"], s["hi"], r["v"]),
                F.array_append(s["out"], F.struct(r["v"].alias("v"), s["i"].alias("i"))),
            )
            .otherwise(s["out"])
            .alias("out"),
        ),
        lambda s: s["out"],
    )
    exits = F.transform(
        F.col("__records"),
        lambda r: F.struct(
            r["v"].alias("v"),
            run(F.slice("__rows", r["i"] + 1, F.size("__rows")), r["v"]).alias("leave"),
        ),
    )
    def leave(last: Column, links: Column) -> Column:
        first = F.get(F.filter(links, lambda e: last.isNull() | differs(last, e["v"])), F.lit(0))
        return F.coalesce(first["leave"], last)

    def compose(first: Column, second: Column) -> Column:
        """What two stretches do together: the first one's records go on through the second; what is a record of both follows."""
        seen = F.transform(first, lambda e: e["v"])
        through = F.transform(first, lambda e: F.struct(e["v"].alias("v"), leave(e["leave"], second).alias("leave")))
        return F.concat(through, F.filter(second, lambda e: is_record(F.array_min(seen), F.array_max(seen), e["v"])))

    def through(grouped: DataFrame) -> DataFrame:
        """Buckets with the value they are entered with."""
        entered = entries(
            grouped.withColumn("__records", records).select(*solid_keys, slot, exits.alias("__exits")),
            solid_keys,
            slot,
            "__exits",
            compose,
            leave,
            F.lit(None).cast(number),
        )
        return grouped.join(entered, [*solid_keys, slot])

    # A key with one bucket enters it with nothing; no summary has to be made of it.
    long = checkpointed(rows.groupBy(*solid_keys).agg((F.min(slot) != F.max(slot)).alias("__long")).filter("__long").select(*solid_keys))
    some = not long.isEmpty()
    begun = (grouped.join(long, solid_keys, "left_anti") if some else grouped).withColumn("__entry", F.lit(None).cast(number))
    if some:
        begun = begun.unionByName(through(grouped.join(long, solid_keys, "left_semi")))
    kept = F.aggregate(
        "__rows",
        F.struct(
            F.col("__entry").alias("last"),
            F.array().cast(dets.select(F.array(F.col(frame))).schema[0].dataType).alias("out"),
        ),
        lambda s, r: F.when(
            s["last"].isNull() | differs(s["last"], r["v"]),
            F.struct(r["v"].alias("last"), F.array_append(s["out"], r["f"]).alias("out")),
        ).otherwise(s),
        lambda s: s["out"],
    )
    done = begun.withColumn("__kept", kept)
    taken = done.select(*solid_keys, F.explode(F.filter("__rows", lambda r: F.array_contains("__kept", r["f"]))).alias("r"))
    return taken.select(*restored(keys), F.col("r.f").alias(frame), *[F.col(f"r.d.{c}").alias(c) for c in rest]).select(dets.columns)
