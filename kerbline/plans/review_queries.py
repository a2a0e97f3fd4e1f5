"""The human loop over the derived boxes and annotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..operators import review as R
from ..operators.build import box_numbers
from ..session import checkpointed
from . import views as V
from .registry import query

BOX = ["x1", "y1", "x2", "y2"]


def _numbered(spark, folder):
    det = V.detections(spark, folder).select("frame_key", *BOX, "cls", "conf")
    return box_numbers(det, "frame_key", [*BOX, "cls", "conf"]).withColumn("label", F.col("cls").cast("string"))


def _proposed(spark, folder):
    # Proposals and reviews are stored tables in this loop, so they are kept once.
    return checkpointed(_numbered(spark, folder))


def _reviewed(proposed):
    """What a human made of the proposals: some deleted, renamed or moved, some drawn anew."""
    b = proposed.withColumn("k", F.col("frame_key") * 7 + F.col("box_no") * 3)
    kept = b.filter("k % 10 <> 0").withColumns({
        "label": F.when(F.col("k") % 10 == 1, F.lit("9")).otherwise(F.col("label")),
        "x1": F.col("x1") + F.col("k") % 5, "x2": F.col("x2") + F.col("k") % 5,
    })
    drawn = b.filter("k % 23 = 0").withColumns({"box_no": F.col("box_no") + 1000, "x1": F.col("x1") + 70, "x2": F.col("x2") + 70})
    return kept.unionByName(drawn).select("frame_key", "box_no", *BOX, "label").filter("frame_key % 50 <> 0")


_REVIEW = """
prop AS (SELECT frame_key, row_number() OVER (PARTITION BY frame_key ORDER BY x1, y1, x2, y2, cls, conf) - 1 AS box_no, x1, y1, x2, y2, CAST(cls AS VARCHAR) AS label FROM det),
k AS (SELECT *, frame_key * 7 + box_no * 3 AS k FROM prop),
rev AS (SELECT frame_key, box_no, x1 + k % 5 AS x1, y1, x2 + k % 5 AS x2, y2, CASE WHEN k % 10 = 1 THEN '9' ELSE label END AS label FROM k WHERE k % 10 <> 0 AND frame_key % 50 <> 0
  UNION ALL SELECT frame_key, box_no + 1000, x1 + 70, y1, x2 + 70, y2, label FROM k WHERE k % 23 = 0 AND frame_key % 50 <> 0)"""
_MATCH = f"""{_REVIEW},
ov AS (SELECT a.frame_key, a.box_no AS l, b.box_no AS r,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM rev a JOIN prop b USING (frame_key)),
cand AS (SELECT frame_key, l, list({{'r': r, 'iou': i / (sa + sb - i)}} ORDER BY i / (sa + sb - i) DESC, r) AS c FROM ov WHERE i / (sa + sb - i) >= 0.5::DOUBLE GROUP BY 1, 2),
seqd AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY l) AS n FROM cand),
go(frame_key, n, used, l, pick) AS (
  SELECT frame_key, n, [c[1].r], l, c[1] FROM seqd WHERE n = 1
  UNION ALL SELECT s.frame_key, s.n, list_append(g.used, [x FOR x IN s.c IF NOT list_contains(g.used, x.r)][1].r), s.l, [x FOR x IN s.c IF NOT list_contains(g.used, x.r)][1]
  FROM go g JOIN seqd s ON s.frame_key = g.frame_key AND s.n = g.n + 1),
matched AS (SELECT frame_key, l AS reviewed_no, pick.r AS proposed_no, pick.iou AS iou FROM go WHERE pick IS NOT NULL)"""


@query("greedy_match", "det", f"WITH RECURSIVE {_MATCH} SELECT frame_key, reviewed_no, proposed_no, round(iou, 6) AS iou FROM matched")
def greedy_match(spark, folder):
    proposed = _proposed(spark, folder)
    left = _reviewed(proposed).withColumnRenamed("box_no", "reviewed_no")
    right = proposed.withColumnRenamed("box_no", "proposed_no")
    pairs = R.greedy_match(left, right, ["frame_key"], "reviewed_no", "proposed_no", 0.5)
    return pairs.withColumn("iou", F.round("iou", 6))


@query("review_cost", "det", f"""WITH RECURSIVE {_MATCH},
o AS (SELECT CASE WHEN m.proposed_no IS NULL THEN 'added' WHEN p.label = r.label THEN 'accepted' ELSE 'relabelled' END AS outcome
  FROM rev r LEFT JOIN matched m ON m.frame_key = r.frame_key AND m.reviewed_no = r.box_no LEFT JOIN prop p ON p.frame_key = m.frame_key AND p.box_no = m.proposed_no
  UNION ALL SELECT CASE WHEN p.frame_key % 50 <> 0 THEN 'deleted' ELSE 'not_reviewed' END FROM prop p LEFT JOIN matched m ON m.frame_key = p.frame_key AND m.proposed_no = p.box_no WHERE m.frame_key IS NULL)
SELECT outcome, count(*) AS n FROM o GROUP BY 1""")
def review_cost(spark, folder):
    seen = V.frames(spark, folder).filter("frame_key % 50 <> 0").select("frame_key")
    proposed = _proposed(spark, folder)
    return R.review_cost(R.review_outcomes(_reviewed(proposed), proposed, seen, "frame_key"))


_TRACK_MATCH = f"""{_REVIEW},
pk AS (SELECT clip, track, frame, x1, y1, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY clip, track ORDER BY size DESC, frame, x1, y1, x2, y2) AS rn,
  count(*) OVER (PARTITION BY clip, track) AS n FROM tone) WHERE rn = 1 AND n >= 3),
ask AS (SELECT clip * 25 + frame AS frame_key, 0 AS turn, track AS ord, x1, y1, x2, y2 FROM pk
  UNION ALL SELECT clip * 25 + frame, 1, track, x1, y1, x2, y2 FROM tone WHERE (clip, frame) IN (SELECT (clip, frame) FROM pk) AND (clip, track, frame) NOT IN (SELECT (clip, track, frame) FROM pk)),
bx AS (SELECT * FROM rev WHERE frame_key IN (SELECT clip * 25 + frame FROM pk)),
ov AS (SELECT a.frame_key, a.turn, a.ord, b.box_no AS r,
  greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb FROM ask a JOIN bx b USING (frame_key)),
cand AS (SELECT frame_key, turn, ord, list(r ORDER BY i / (sa + sb - i) DESC, r) AS c FROM ov WHERE i / (sa + sb - i) >= 0.3::DOUBLE GROUP BY 1, 2, 3),
seqd AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY turn, ord) AS n FROM cand),
go(frame_key, n, used, turn, ord, pick) AS (
  SELECT frame_key, n, [c[1]], turn, ord, c[1] FROM seqd WHERE n = 1
  UNION ALL SELECT s.frame_key, s.n, list_append(g.used, [x FOR x IN s.c IF NOT list_contains(g.used, x)][1]), s.turn, s.ord, [x FOR x IN s.c IF NOT list_contains(g.used, x)][1]
  FROM go g JOIN seqd s ON s.frame_key = g.frame_key AND s.n = g.n + 1),
m AS (SELECT * FROM go WHERE pick IS NOT NULL)"""


@query("reviewed_track_labels", "det tone", f"""WITH RECURSIVE {_TRACK_MATCH}
SELECT label, count(*) AS n FROM (SELECT coalesce(b.label, 'not_a_sign') AS label FROM pk
  LEFT JOIN m ON m.frame_key = pk.clip * 25 + pk.frame AND m.turn = 0 AND m.ord = pk.track LEFT JOIN bx b ON b.frame_key = m.frame_key AND b.box_no = m.pick) GROUP BY 1
UNION ALL SELECT '(added)', count(*) FROM bx WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.frame_key = bx.frame_key AND m.pick = bx.box_no)""")
def reviewed_track_labels(spark, folder):
    from ..operators import tracks as T

    # In ranges of frames, rows move once as they are, and nearly all of a track's are together when its peak is looked for.
    dealt = V.track_detections(spark, folder).repartitionByRange("clip", "frame")
    one = checkpointed(T.one_per_frame(dealt, ["clip", "track"]))
    tops = checkpointed(T.peaks(one))
    frame = (F.col("clip") * 25 + F.col("frame")).alias("frame_key")
    peaks = tops.select(
        "clip", F.col("track").alias("order"), F.col("peak.frame").alias("frame"), *[F.col(f"peak.{c}").alias(c) for c in BOX]
    ).select(frame, "order", *BOX, F.concat_ws("_t", F.col("clip").cast("string"), F.col("order").cast("string")).alias("crop_id"))
    context = R.context_boxes(one, tops).select(frame, F.col("track").alias("order"), *BOX)
    # Of the reviews only those on peak frames are kept, not the proposals they are made from.
    boxes = checkpointed(_reviewed(_numbered(spark, folder)).join(peaks.select("frame_key").distinct(), "frame_key", "left_semi"))
    named, added = R.import_tracks(peaks, context, boxes, "frame_key")
    return named.groupBy("label").agg(F.count("*").alias("n")).unionByName(
        added.agg(F.lit("(added)").alias("label"), F.count("*").alias("n"))
    )


@query("patched_labels", "norm", """
WITH p AS (SELECT frame_key AS stem, xc AS x, yc + 0.001::DOUBLE AS y, CASE WHEN track_no = 0 THEN NULL ELSE track_no END AS new_cls, CAST(cls AS BIGINT) AS patch_no FROM norm WHERE frame_key % 7 = 0 AND cls = 2),
b AS (SELECT frame_key AS stem, cls, xc, yc, w, h FROM norm),
m AS (SELECT b.*, (SELECT bool_or(p.new_cls IS NULL) FROM p WHERE p.stem = b.stem AND abs(p.x - b.xc) < 0.002::DOUBLE AND abs(p.y - b.yc) < 0.002::DOUBLE) AS gone,
 (SELECT min(p.new_cls) FROM p WHERE p.stem = b.stem AND abs(p.x - b.xc) < 0.002::DOUBLE AND abs(p.y - b.yc) < 0.002::DOUBLE) AS dest FROM b)
SELECT stem, CAST(coalesce(dest, cls) AS INT) AS cls, round(xc, 6) AS xc, round(yc, 6) AS yc FROM m WHERE NOT coalesce(gone, false)""")
def patched_labels(spark, folder):
    n = V.normalised(spark, folder).withColumnRenamed("frame_key", "stem")
    patches = n.filter("stem % 7 = 0 AND cls = 2").select(
        "stem", F.col("xc").alias("x"), (F.col("yc") + 0.001).alias("y"), F.when(F.col("track_no") != 0, F.col("track_no")).alias("new_cls"),
        F.col("track_no").alias("patch_no"),
    )
    done = R.patch_labels(n.select("stem", "cls", "xc", "yc", "w", "h"), patches)
    return done.select("stem", "cls", F.round("xc", 6).alias("xc"), F.round("yc", 6).alias("yc"))


def _kinds(spark):
    return X.taxonomy(spark, V.KIND_GROUPS)


@query("label_or_fallback", "ann kinds", """
SELECT item, coarse, CASE WHEN pred IN (SELECT fine FROM kinds) THEN pred ELSE CASE coarse WHEN 'engage' THEN 'view' ELSE 'signup' END END AS label
FROM (SELECT item, CASE WHEN a IN ('click', 'view') THEN 'engage' ELSE 'rest' END AS coarse, CASE WHEN item % 6 = 0 THEN 'banana' WHEN item % 6 = 1 THEN NULL ELSE pred END AS pred FROM ann)""")
def label_or_fallback(spark, folder):
    ann = V.annotations(spark, folder)
    coarse = F.when(F.col("a").isin("click", "view"), F.lit("engage")).otherwise(F.lit("rest"))
    proposed = ann.select(F.col("item").alias("crop_id"), coarse.alias("coarse"))
    pred = ann.filter("item % 6 <> 1").select(
        F.col("item").alias("crop_id"), F.when(F.col("item") % 6 == 0, F.lit("banana")).otherwise(F.col("pred")).alias("pred")
    )
    return R.label_or_fallback(proposed, pred, _kinds(spark)).select(F.col("crop_id").alias("item"), "coarse", "label")


@query("coarse_parents", "ann kinds", """
SELECT item, coalesce(k.parent, 'rest') AS parent FROM ann LEFT JOIN kinds k ON k.fine = CASE WHEN item % 5 = 0 THEN NULL ELSE a END""")
def coarse_parents(spark, folder):
    ann = V.annotations(spark, folder)
    crops = ann.select(F.col("item").alias("crop_id"), F.lit("rest").alias("coarse"))
    labels = ann.filter("item % 5 <> 0").select(F.col("item").alias("crop_id"), F.col("a").alias("label"))
    return R.coarse_of(crops, labels, _kinds(spark)).select(F.col("crop_id").alias("item"), "parent")


def _pairs(spark, folder):
    ann = V.annotations(spark, folder)
    a = ann.filter("item % 13 <> 0").select("item", F.when(F.col("item") % 17 == 0, F.lit("not_a_sign")).when(F.col("item") % 19 == 0, F.lit("too_small")).otherwise(F.col("a")).alias("label"))
    b = ann.filter("item % 14 <> 0").select("item", F.when(F.col("item") % 17 == 0, F.lit("not_a_sign")).when(F.col("item") % 19 == 0, F.lit("too_small")).otherwise(F.col("b")).alias("label"))
    return R.both_annotators(a, b)


_PAIRS = """pairs AS (SELECT item, x.label AS a, y.label AS b FROM
 (SELECT item, CASE WHEN item % 17 = 0 THEN 'not_a_sign' WHEN item % 19 = 0 THEN 'too_small' ELSE a END AS label FROM ann WHERE item % 13 <> 0) x
 FULL JOIN (SELECT item, CASE WHEN item % 17 = 0 THEN 'not_a_sign' WHEN item % 19 = 0 THEN 'too_small' ELSE b END AS label FROM ann WHERE item % 14 <> 0) y USING (item))"""


@query("agreement_rate", "ann", f"""
WITH {_PAIRS} SELECT count(*) AS n_both, CAST(sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS BIGINT) AS n_agreed, round(avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL""")
def agreement_rate(spark, folder):
    return R.agreement(_pairs(spark, folder)).withColumn("rate", F.round("rate", 6))


@query("answer_key", "ann", f"""
WITH {_PAIRS} SELECT item, a AS label, 2 AS annotators FROM pairs WHERE a = b AND a <> 'not_a_sign'
UNION ALL SELECT item, coalesce(a, b), 1 FROM pairs WHERE (a IS NULL OR b IS NULL) AND coalesce(a, b) <> 'not_a_sign'""")
def answer_key(spark, folder):
    return R.answer_key(_pairs(spark, folder), solo=True)


@query("disagreements", "ann", f"WITH {_PAIRS} SELECT item, a, b FROM pairs WHERE a <> b")
def disagreements(spark, folder):
    return R.disagreements(_pairs(spark, folder))


@query("key_composition", "ann kinds", f"""
WITH {_PAIRS}, k AS (SELECT a AS label FROM pairs WHERE a = b AND a <> 'not_a_sign'),
s AS (SELECT sum(CASE WHEN label = 'too_small' THEN 1.0::DOUBLE ELSE 0.0 END) / count(*) AS share FROM k)
SELECT n.label, count(k.label) AS n, round((SELECT share FROM s), 6) AS small_share, (SELECT share FROM s) > 0.2::DOUBLE AS warn
FROM (SELECT fine AS label FROM kinds UNION ALL SELECT 'too_small') n LEFT JOIN k ON k.label = n.label GROUP BY n.label""")
def key_composition(spark, folder):
    return R.key_composition(R.answer_key(_pairs(spark, folder)), _kinds(spark)).withColumn("small_share", F.round("small_share", 6))


@query("settled_by_position", "ann", f"""
WITH {_PAIRS}, d AS (SELECT item, row_number() OVER (ORDER BY a, b, item) AS line FROM pairs WHERE a <> b)
SELECT item, 'view' AS label FROM d WHERE line IN (SELECT event_id FROM events WHERE event_id % 3 = 0)""")
def settled_by_position(spark, folder):
    answers = V.annotations(spark, folder).filter("item % 3 = 0").select(F.col("item").alias("line"), F.lit("view").alias("label"))
    return R.settle_by_position(R.disagreements(_pairs(spark, folder)), answers)


@query("replayed_log", "", """
SELECT user_id, k, seq, final, accepted FROM (SELECT user_id, event_type AS k, event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'UNDONE' ELSE 'set' END AS final, value > 30 AS accepted,
 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND final <> 'UNDONE'""")
def replayed_log(spark, folder):
    return R.replay_log(_log(spark, folder), ["user_id", "k"])


def _log(spark, folder):
    return V.table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("k"), F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 5 == 0, F.lit("UNDONE")).otherwise(F.lit("set")).alias("final"), (F.col("value") > 30).alias("accepted"),
    )


@query("accept_rate", "", """
SELECT count(*) AS n, CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS n_accepted, round(avg(CASE WHEN accepted THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS rate
FROM (SELECT event_id % 5 = 0 AS undone, value > 30 AS accepted, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND NOT undone""")
def accept_rate(spark, folder):
    return R.accept_rate(_log(spark, folder), ["user_id", "k"]).withColumn("rate", F.round("rate", 6))


@query("only_new", "det", "SELECT frame_key, track_no FROM det WHERE frame_key NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def only_new(spark, folder):
    seen = V.table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("frame_key"))
    return R.only_new(V.detections(spark, folder).select("frame_key", "track_no"), seen, ["frame_key"])


@query("batch_guard", "ann kinds", """
SELECT count(*) FILTER (item % 2 = 0) AS n_taken, count(*) FILTER (item % 2 <> 0) AS n_foreign, count(*) FILTER (p NOT IN (SELECT fine FROM kinds)) AS n_unknown_label, true AS right_batch
FROM (SELECT item, CASE WHEN item % 9 = 0 THEN 'banana' ELSE pred END AS p FROM ann)""")
def batch_guard(spark, folder):
    ann = V.annotations(spark, folder).withColumnRenamed("item", "crop_id")
    pred = ann.select("crop_id", F.when(F.col("crop_id") % 9 == 0, F.lit("banana")).otherwise(F.col("pred")).alias("pred"))
    return R.take_batch(pred, ann.filter("crop_id % 2 = 0"), _kinds(spark))[1]


@query("human_before_model", "ann", """
SELECT item, CASE WHEN item % 3 = 0 THEN a ELSE pred END AS label, CASE WHEN item % 3 = 0 THEN 'human' ELSE 'model' END AS "by" FROM ann""")
def human_before_model(spark, folder):
    ann = V.annotations(spark, folder)
    human = ann.filter("item % 3 = 0").select("item", F.col("a").alias("label"))
    model = ann.select("item", F.col("pred").alias("label"))
    return R.ingest(human, model)[0]


@query("held_labels", "ann", """
SELECT count(*) FILTER (item % 3 <> 0) AS n_taken, count(*) FILTER (item % 3 = 0) AS n_held FROM ann""")
def held_labels(spark, folder):
    ann = V.annotations(spark, folder)
    human = ann.filter("item % 3 = 0").select("item", F.col("a").alias("label"))
    model = ann.select("item", F.col("pred").alias("label"))
    return R.ingest(human, model)[1]


@query("exported_class_order", "", """
WITH names AS (SELECT n_regionkey AS archive, n_name AS label, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) - 1 AS cls FROM nation)
SELECT label, count(*) AS n FROM customer JOIN names ON archive = c_nationkey % 5 AND cls = c_custkey % 7 GROUP BY label
UNION ALL SELECT 'unknown', count(*) FROM customer WHERE c_custkey % 7 >= (SELECT count(*) FROM nation WHERE n_regionkey = c_nationkey % 5)""")
def exported_class_order(spark, folder):
    nation = V.table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name"), False).alias("names"))
    lines = nation.select(F.col("n_regionkey").alias("archive"), F.lit("export/obj.names").alias("member"), F.posexplode("names").alias("line_no", "value"))
    customers = V.table(spark, folder, "customer")
    boxes = customers.select((F.col("c_nationkey") % 5).alias("archive"), (F.col("c_custkey") % 7).cast("int").alias("cls"))
    named, unknown = R.name_boxes(boxes, R.exported_classes(lines))
    rest = unknown.agg(F.count("*").alias("n")).select(F.lit("unknown").alias("label"), "n")
    return named.groupBy("label").agg(F.count("*").alias("n")).unionByName(rest)
