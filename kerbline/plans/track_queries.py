"""Tracks: one per frame, same-sign pairs, merging, peaks and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import build as U
from ..operators import review as R
from ..operators import tracks as T
from ..session import checkpointed
from . import views as V
from .registry import query

BOX = ("x1", "y1", "x2", "y2")


def _one(spark, folder):
    return T.one_per_frame(V.track_detections(spark, folder), ["clip", "track"])


def _stored(spark, folder):
    """The same, kept as the stored table that a tracker leaves."""
    return checkpointed(_one(spark, folder))


@query("one_per_frame", "tone", "SELECT clip, track, frame, x1, y1, x2, y2, size FROM tone")
def one_per_frame(spark, folder):
    return _one(spark, folder).select("clip", "track", "frame", *BOX, "size")


_IOU = """greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"""


@query("same_sign_pairs", "pone", f"""
WITH s AS (SELECT clip, a, b FROM (SELECT a.clip, a.track AS a, b.track AS b, {_IOU} AS i, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
  FROM pone a JOIN pone b ON a.clip = b.clip AND a.frame = b.frame AND a.track < b.track) WHERE i / (s - i) > 0.5::DOUBLE GROUP BY 1, 2, 3 HAVING count(*) >= 2),
f AS (SELECT clip, track, arg_min({{'f': frame, 's': size, 'x': (x1 + x2) / 2, 'y': (y1 + y2) / 2}}, frame) AS p, arg_max({{'f': frame, 's': size, 'x': (x1 + x2) / 2, 'y': (y1 + y2) / 2}}, frame) AS q FROM pone GROUP BY 1, 2),
h AS (SELECT a.clip, least(a.track, b.track) AS a, greatest(a.track, b.track) AS b FROM f a JOIN f b ON a.clip = b.clip AND a.track <> b.track
  WHERE b.p.f - a.q.f BETWEEN -3 AND 12 AND b.p.s / greatest(a.q.s, 1e-9) > 0.5::DOUBLE AND b.p.s / greatest(a.q.s, 1e-9) < 2.0::DOUBLE
   AND sqrt(power(a.q.x - b.p.x, 2) + power(a.q.y - b.p.y, 2)) < greatest(a.q.s, b.p.s))
SELECT * FROM s UNION SELECT * FROM h""")
def same_sign_pairs(spark, folder):
    return T.same_sign_pairs(checkpointed(T.one_per_frame(V.track_pieces(spark, folder), ["clip", "track"])))


@query("merged_tracks")
def merged_tracks(spark, folder):
    merged = T.merge_tracks(V.track_pieces(spark, folder))
    return merged.groupBy("clip", "track").agg(
        F.count("*").alias("n_dets"), F.max("size").alias("peak_size"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")
    )


@query("merged_tracks_settled", "pieces", """
SELECT clip, count(DISTINCT frame) AS n_frames, max(size) AS peak_size, 0 AS pairs_left FROM pieces GROUP BY clip""")
def merged_tracks_settled(spark, folder):
    """Merging keeps every frame and the largest view of each clip, and leaves no pair that one more round would merge."""
    merged = T.merge_tracks(V.track_pieces(spark, folder))
    left = T.same_sign_pairs(merged).groupBy("clip").agg(F.count("*").alias("n"))
    kept = merged.groupBy("clip").agg(F.count_distinct("frame").alias("n_frames"), F.max("size").alias("peak_size"))
    return kept.join(left, "clip", "left").select("clip", "n_frames", "peak_size", F.coalesce("n", F.lit(0)).cast("int").alias("pairs_left"))


@query("track_peaks", "tone", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY clip, track ORDER BY size DESC, frame, x1, y1, x2, y2) AS rn,
  count(*) OVER (PARTITION BY clip, track) AS n, min(cls) OVER (PARTITION BY clip, track) <> max(cls) OVER (PARTITION BY clip, track) AS flips FROM tone)
SELECT clip, track, n AS n_dets, flips AS flips_class, frame AS peak_frame, round(size, 6) AS peak_size, size >= 60 AS labelable FROM p WHERE rn = 1 AND n >= 3""")
def track_peaks(spark, folder):
    return T.peaks(_one(spark, folder)).select(
        "clip", "track", "n_dets", "flips_class", F.col("peak.frame").alias("peak_frame"), F.round("peak.size", 6).alias("peak_size"), "labelable"
    )


@query("class_flips_by_size", "tone", """
WITH p AS (SELECT clip, track, arg_max(cls, size) AS pc FROM (SELECT *, row_number() OVER (PARTITION BY clip, track ORDER BY size DESC, frame, x1, y1, x2, y2) AS rn,
  count(*) OVER (PARTITION BY clip, track) AS n FROM tone) WHERE rn = 1 AND n >= 3 GROUP BY 1, 2)
SELECT CASE WHEN size < 30 THEN 0 WHEN size < 60 THEN 1 WHEN size < 100 THEN 2 ELSE 3 END AS band, count(*) AS n,
 round(avg(CASE WHEN cls <> pc THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share_other_class, round(quantile_cont(conf, 0.5), 6) AS median_conf FROM tone JOIN p USING (clip, track) GROUP BY 1""")
def class_flips_by_size(spark, folder):
    one = _stored(spark, folder)
    return T.class_flips_by_size(one, T.peaks(one)).select(
        "band", "n", F.round("share_other_class", 6).alias("share_other_class"), F.round("median_conf", 6).alias("median_conf")
    )


@query("change_sample", "tone", """
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY clip, track ORDER BY frame) AS rn FROM tone),
s(clip, track, rn, last, kept) AS (SELECT clip, track, rn, size, true FROM r WHERE rn = 1
 UNION ALL SELECT r.clip, r.track, r.rn, CASE WHEN abs(r.size - s.last) / greatest(s.last, 1e-9) >= 0.2::DOUBLE THEN r.size ELSE s.last END, abs(r.size - s.last) / greatest(s.last, 1e-9) >= 0.2::DOUBLE
 FROM s JOIN r ON r.clip = s.clip AND r.track = s.track AND r.rn = s.rn + 1)
SELECT r.clip, r.track, r.frame, r.size FROM s JOIN r USING (clip, track, rn) WHERE kept""")
def change_sample(spark, folder):
    return T.change_sample(_stored(spark, folder), ["clip", "track"], "frame", "size").select("clip", "track", "frame", "size")


@query("interval_sample", "", """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
s(user_id, rn, last, kept) AS (SELECT user_id, rn, t, true FROM e WHERE rn = 1
 UNION ALL SELECT e.user_id, e.rn, CASE WHEN e.t + 1e-6 >= s.last + 86400 THEN e.t ELSE s.last END, e.t + 1e-6 >= s.last + 86400
 FROM s JOIN e ON e.user_id = s.user_id AND e.rn = s.rn + 1)
SELECT e.user_id, e.event_id FROM s JOIN e USING (user_id, rn) WHERE kept""")
def interval_sample(spark, folder):
    e = V.timed_events(spark, folder).select("user_id", "event_id", (F.unix_micros("ts") / 1e6).alias("t"))
    return T.interval_sample(e, ["user_id"], "event_id", "t", 86400.0).select("user_id", "event_id")


@query("fixed_step_sample", "frames", """
SELECT frame_key, frame_no FROM frames WHERE frame_no % greatest(1, CAST(round_even((frame_key % 4) * 1.5::DOUBLE, 0) AS BIGINT)) = 0""")
def fixed_step_sample(spark, folder):
    return T.fixed_step_sample(V.frames(spark, folder), "frame_no", (F.col("frame_key") % 4).cast("double"), 1.5).select("frame_key", "frame_no")


@query("box_numbers", "det", """
SELECT frame_key, x1, y1, x2, y2, cls, 'o' || frame_key || '_b' || (row_number() OVER (PARTITION BY frame_key ORDER BY x1, y1, x2, y2, cls, conf) - 1) AS crop_id FROM det""")
def box_numbers(spark, folder):
    from ..functions.keys import box_crop_id

    det = V.detections(spark, folder).select("frame_key", *BOX, "cls", "conf")
    numbered = U.box_numbers(det, "frame_key", [*BOX, "cls", "conf"])
    return numbered.select(
        "frame_key", *BOX, "cls", box_crop_id(F.concat(F.lit("o"), F.col("frame_key").cast("string")), F.col("box_no")).alias("crop_id")
    )


_PEAKS = """p AS (SELECT clip, track, frame AS pf, size AS ps FROM (SELECT *, row_number() OVER (PARTITION BY clip, track ORDER BY size DESC, frame, x1, y1, x2, y2) AS rn,
  count(*) OVER (PARTITION BY clip, track) AS n FROM tone) WHERE rn = 1 AND n >= 3)"""


@query("boxes_on_peak_frames", "tone", f"""
WITH {_PEAKS} SELECT t.clip, t.track, t.frame, t.size, (p.track IS NOT NULL) AS is_peak FROM tone t LEFT JOIN p ON p.clip = t.clip AND p.track = t.track AND p.pf = t.frame
WHERE (t.clip, t.frame) IN (SELECT (clip, pf) FROM p)""")
def boxes_on_peak_frames(spark, folder):
    one = _stored(spark, folder)
    return R.boxes_on_peak_frames(one, T.peaks(one)).select("clip", "track", "frame", "size", "is_peak")


@query("context_boxes", "tone", f"""
WITH {_PEAKS} SELECT t.clip, t.track, t.frame FROM tone t WHERE (t.clip, t.frame) IN (SELECT (clip, pf) FROM p)
 AND (t.clip, t.track, t.frame) NOT IN (SELECT (clip, track, pf) FROM p)""")
def context_boxes(spark, folder):
    one = _stored(spark, folder)
    return R.context_boxes(one, T.peaks(one)).select("clip", "track", "frame")


@query("added_tracks", "tone", f"""
WITH {_PEAKS}, f AS (SELECT clip, CASE WHEN ps >= 20 THEN clip || '_t' || track END AS crop_id, ps >= 30 AS labelable FROM p),
e AS (SELECT * FROM f WHERE clip % 2 = 0 AND crop_id IS NOT NULL)
SELECT clip, count(*) AS n FROM (SELECT clip, crop_id FROM e UNION ALL SELECT clip, crop_id FROM f WHERE crop_id IS NOT NULL AND labelable AND crop_id NOT IN (SELECT crop_id FROM e)) GROUP BY 1""")
def added_tracks(spark, folder):
    peaks = T.peaks(_one(spark, folder), min_side=30.0)
    key = F.concat_ws("_t", F.col("clip").cast("string"), F.col("track").cast("string"))
    found = peaks.select("clip", F.when(F.col("peak.size") >= 20, key).alias("crop_id"), "labelable")
    existing = found.filter("clip % 2 = 0 AND crop_id IS NOT NULL")
    return R.add_tracks(existing, found).groupBy("clip").agg(F.count("*").alias("n"))
