"""Boxes, keys, labels and text: projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import keys as K
from ..functions import taxonomy as X
from ..functions import text as T
from . import views as V
from .registry import query

def frame_size():
    return F.col("width"), F.col("height")


BOX_ID = ["frame_key", "track_no", "x1", "y1", "x2", "y2", "cls", "conf"]


@query("clamped_boxes", "det", """
SELECT frame_key, track_no, cls, round((a + c) / 2 / 200, 6) AS xc, round((b + d) / 2 / 200, 6) AS yc,
  round((c - a) / 200, 6) AS w, round((d - b) / 200, 6) AS h, (c - a <= 0 OR d - b <= 0) AS degenerate
FROM (SELECT *, greatest(0, x1 - 20) AS a, greatest(0, y1 - 20) AS b, least(120, x2 - 20) AS c, least(120, y2 - 20) AS d FROM det)
WHERE c - a > 0 AND d - b > 0
UNION ALL
SELECT frame_key, track_no, cls, NULL, NULL, NULL, NULL, true
FROM (SELECT *, greatest(0, x1 - 20) AS a, greatest(0, y1 - 20) AS b, least(120, x2 - 20) AS c, least(120, y2 - 20) AS d FROM det)
WHERE c - a <= 0 OR d - b <= 0""".replace("/ 200", "/ 120"))
def clamped_boxes(spark, folder):
    det = V.detections(spark, folder)
    moved = B.Box(*(F.col(c) - 20 for c in ("x1", "y1", "x2", "y2")))
    n = B.clamped_norm(moved, F.lit(120.0), F.lit(120.0))
    return det.withColumn("n", n).select(
        "frame_key", "track_no", "cls", *[F.round(F.col("n")[c], 6).alias(c) for c in ("xc", "yc", "w", "h")],
        F.col("n").isNull().alias("degenerate"),
    )


@query("centre_form_and_back", "norm", """
SELECT frame_key, track_no, round(xc, 6) AS xc, round(yc, 6) AS yc, round(w, 6) AS w, round(h, 6) AS h,
  round((xc - w / 2) * 250, 4) AS back_x1, round((yc - h / 2) * 250, 4) AS back_y1,
  round((xc + w / 2) * 250, 4) AS back_x2, round((yc + h / 2) * 250, 4) AS back_y2 FROM norm""")
def centre_form_and_back(spark, folder):
    c = B.to_centred(B.box(), *frame_size())
    back = B.to_pixels(c, *frame_size())
    return V.detections(spark, folder).select(
        "frame_key", "track_no", *[F.round(v, 6).alias(n) for n, v in c._asdict().items()],
        *[F.round(v, 4).alias(f"back_{n}") for n, v in back._asdict().items()],
    )


@query("box_geometry", "geo", """
SELECT frame_key, track_no, round(pw, 4) AS pw, round(ph, 4) AS ph, round(w * h, 6) AS area_n, round(aspect, 4) AS aspect,
  round(side_px, 4) AS side_px, round(side_scaled, 4) AS side_scaled, round(xc - w / 2, 6) AS "left", round(yc + h / 2, 6) AS bottom FROM geo""")
def box_geometry(spark, folder):
    geo = B.geometry(V.normalised(spark, folder), 640)
    return geo.select(
        "frame_key", "track_no", *[F.round(c, 4).alias(c) for c in ("pw", "ph", "aspect", "side_px", "side_scaled")],
        F.round("area_n", 6).alias("area_n"), F.round("left", 6).alias("left"), F.round("bottom", 6).alias("bottom"),
    )


@query("crop_windows", "det", """
SELECT frame_key, track_no,
  round(greatest(0, (x1 + x2) / 2 - 0.6::DOUBLE * m), 4) AS sx1, round(greatest(0, (y1 + y2) / 2 - 0.6::DOUBLE * m), 4) AS sy1,
  round(least(250, (x1 + x2) / 2 + 0.6::DOUBLE * m), 4) AS sx2, round(least(250, (y1 + y2) / 2 + 0.6::DOUBLE * m), 4) AS sy2,
  greatest(0, trunc((x1 + x2) / 2 - (x2 - x1) * 1.25::DOUBLE)) AS cx1, greatest(0, trunc((y1 + y2) / 2 - (y2 - y1) * 1.25::DOUBLE)) AS cy1,
  least(250, trunc((x1 + x2) / 2 + (x2 - x1) * 1.25::DOUBLE)) AS cx2, least(250, trunc((y1 + y2) / 2 + (y2 - y1) * 1.25::DOUBLE)) AS cy2
FROM (SELECT *, greatest(x2 - x1, y2 - y1) AS m FROM det)""")
def crop_windows(spark, folder):
    square, context = B.square_window(B.box(), *frame_size()), B.context_window(B.box(), *frame_size())
    return V.detections(spark, folder).filter(~B.is_degenerate(context)).select(
        "frame_key", "track_no",
        *[F.round(v, 4).alias(f"s{n}") for n, v in square._asdict().items()],
        *[v.alias(f"c{n}") for n, v in context._asdict().items()],
    )


@query("ground_positions", "det", """
WITH g AS (SELECT *, radians(-0.5) + atan2(y2 - 125, f) AS dep FROM (SELECT *, 125 / tan(radians(140) / 2) AS f FROM det))
SELECT frame_key, track_no, round(1.15 / tan(dep), 4) AS forward, round((1.15 / tan(dep)) * ((x1 + x2) / 2 - 125) / f, 4) AS lateral,
  round(sqrt(power((1.15 / tan(dep)) * ((x1 + x2) / 2 - 125) / f, 2) + power(1.15 / tan(dep), 2)), 4) AS "range" FROM g WHERE dep > 1e-3""")
def ground_positions(spark, folder):
    det = V.detections(spark, folder).withColumn("p", B.ground_position(B.box(), 250.0, 250.0))
    return det.filter(F.col("p").isNotNull()).select(
        "frame_key", "track_no", *[F.round(F.col("p")[c], 4).alias(c) for c in ("forward", "lateral", "range")]
    )


@query("box_faults", "norm", """
WITH m AS (SELECT xc - 0.2::DOUBLE AS xc, yc, w, CASE WHEN frame_key % 40 = 0 THEN 0 ELSE h END AS h, cls FROM norm)
SELECT fault, count(*) AS n FROM (
 SELECT 'zero_area' AS fault FROM m WHERE w <= 0 OR h <= 0 UNION ALL
 SELECT 'out_of_range' FROM m WHERE NOT (xc BETWEEN 0 AND 1 AND yc BETWEEN 0 AND 1) OR w > 1 OR h > 1 UNION ALL
 SELECT 'over_edge' FROM m WHERE xc - w / 2 < -1e-6 OR yc - h / 2 < -1e-6 OR xc + w / 2 > 1 + 1e-6 OR yc + h / 2 > 1 + 1e-6)
GROUP BY fault""")
def box_faults(spark, folder):
    moved = V.normalised(spark, folder).withColumns({
        "xc": F.col("xc") - 0.2, "h": F.when(F.col("frame_key") % 40 == 0, F.lit(0.0)).otherwise(F.col("h")),
    })
    return moved.select(F.explode(B.box_faults()).alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


@query("crop_looks", "geo", """
WITH g AS (SELECT aspect, conf * 100 AS luma, l AS contrast FROM (SELECT *, side_px AS l FROM geo))
SELECT look, count(*) AS n FROM (
 SELECT 'odd_aspect' AS look FROM g WHERE aspect > 1.8::DOUBLE OR aspect < 0.6::DOUBLE UNION ALL
 SELECT 'night' FROM g WHERE luma < 60 UNION ALL SELECT 'flat' FROM g WHERE contrast < 20) GROUP BY look""")
def crop_looks(spark, folder):
    geo = B.geometry(V.normalised(spark, folder), 640)
    return geo.select(F.explode(B.frame_look(F.col("aspect"), F.col("conf") * 100, F.col("side_px"))).alias("look")).groupBy(
        "look"
    ).agg(F.count("*").alias("n"))


@query("frame_and_crop_ids", "det", """
SELECT frame_key, printf('c%d_f%06d', clip_no, frame_no) AS frame_id, printf('c%d_t%04d', clip_no, track_no) AS crop_id,
  'c' || clip_no AS clip, CAST(frame_no AS INT) AS parsed_no, CASE WHEN frame_no % 10 = 3 THEN 'UNPARSED' ELSE 'c' || clip_no END AS lenient FROM det""")
def frame_and_crop_ids(spark, folder):
    clip = F.concat(F.lit("c"), F.col("clip_no").cast("string"))
    stem = K.frame_id(clip, F.col("frame_no"))
    broken = F.when(F.col("frame_no") % 10 == 3, F.concat(stem, F.lit("x"))).otherwise(stem)
    return V.detections(spark, folder).select(
        "frame_key", stem.alias("frame_id"), K.track_crop_id(clip, F.col("track_no")).alias("crop_id"),
        K.clip_of(stem, strict=True).alias("clip"), K.frame_no_of(stem).alias("parsed_no"), K.clip_of(broken).alias("lenient"),
    )


@query("frame_times", "frames", """
SELECT frame_key, CASE WHEN frame_key % 300 BETWEEN 1 AND 240 THEN frame_no / CAST(frame_key % 300 AS DOUBLE) ELSE 0 END AS t,
  printf('%02d:%02d', CAST(floor(frame_key / 60) AS BIGINT), CAST(frame_key % 60 AS BIGINT)) AS clock FROM frames""")
def frame_times(spark, folder):
    fps = (F.col("frame_key") % 300).cast("double")
    return V.frames(spark, folder).select(
        "frame_key", K.seconds_of(F.col("frame_no"), fps).alias("t"), K.clock(F.col("frame_key")).alias("clock")
    )


@query("content_digests", "", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def content_digests(spark, folder):
    return V.table(spark, folder, "documents").select(
        "doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256")
    )


@query("difference_hashes", "hashes", "SELECT image_id, h, bit_count(h)::INT AS bits FROM hashes")
def difference_hashes(spark, folder):
    return V.hashes(spark, folder).select("image_id", "h", F.bit_count("h").alias("bits"))


@query("patch_statistics", "", """
SELECT vec_id, round(list_avg([x::DOUBLE FOR x IN embedding]), 6) AS mean, round(list_stddev_pop([x::DOUBLE FOR x IN embedding]), 6) AS spread FROM embeddings""")
def patch_statistics(spark, folder):
    values = F.col("embedding").cast("array<double>")
    return V.table(spark, folder, "embeddings").select(
        "vec_id", F.round(K.mean_of(values), 6).alias("mean"), F.round(K.spread_of(values), 6).alias("spread")
    )


@query("label_lines", "norm", "SELECT frame_key, track_no, printf('%d %.6f %.6f %.6f %.6f', cls, xc, yc, w, h) AS line FROM norm")
def label_lines(spark, folder):
    return V.normalised(spark, folder).select(
        "frame_key", "track_no", K.label_line(*(F.col(c) for c in ("cls", "xc", "yc", "w", "h"))).alias("line")
    )


_SUPER = " ".join(f"WHEN src IN ({', '.join(map(str, ids))}) THEN {i}" for i, ids in enumerate(X.SUPER_CLASSES.values()))


@query("class_remap", "", f"""
SELECT label_set, idx, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT '4class' AS label_set, CASE {_SUPER} ELSE -1 END AS idx FROM (SELECT l_partkey % 50 AS src FROM lineitem) UNION ALL
 SELECT '1class', CASE WHEN l_partkey % 50 < 43 THEN 0 ELSE -1 END FROM lineitem UNION ALL
 SELECT 'thai3', CASE WHEN l_partkey % 50 < 3 THEN l_partkey % 50 ELSE -1 END FROM lineitem) GROUP BY label_set, idx""")
def class_remap(spark, folder):
    src = V.table(spark, folder, "lineitem").select((F.col("l_partkey") % 50).cast("int").alias("cls"))
    out = None
    for name in ("4class", "1class", "thai3"):
        kept, dropped = X.remap(src, X.label_map(spark, name))
        part = kept.select("idx").unionByName(dropped.select(F.lit(-1).alias("idx"))).groupBy("idx").agg(F.count("*").alias("n"))
        part = part.select(F.lit(name).alias("label_set"), "idx", "n")
        out = part if out is None else out.unionByName(part)
    return out


_FINE_ROWS = ", ".join(
    f"({i}, '{n}', '{p}')" for i, (n, p) in enumerate((n, p) for p, g in X.FINE.items() for n in g)
)


@query("fine_to_parent", "", f"""
WITH named(idx, name, parent) AS (VALUES {_FINE_ROWS}),
fine AS (SELECT *, arg_max(name, CASE WHEN starts_with(name, 'other_') THEN 1000 - idx ELSE idx END) OVER (PARTITION BY parent) AS catch_all FROM named)
SELECT parent, catch_all, count(*) AS n, count(DISTINCT idx) AS classes, CAST(sum(CASE WHEN name = catch_all THEN 1 ELSE 0 END) AS BIGINT) AS in_catch_all
FROM lineitem JOIN fine ON idx = l_partkey % 21 GROUP BY parent, catch_all""")
def fine_to_parent(spark, folder):
    src = V.table(spark, folder, "lineitem").select((F.col("l_partkey") % 21).cast("int").alias("idx"))
    joined = src.join(F.broadcast(X.taxonomy(spark)), "idx")
    per_class = joined.groupBy("parent", "catch_all", "idx", "is_catch_all").agg(F.count("*").alias("n"))
    return per_class.groupBy("parent", "catch_all").agg(
        F.sum("n").alias("n"), F.count("*").alias("classes"),
        F.sum(F.when(F.col("is_catch_all"), F.col("n")).otherwise(0)).alias("in_catch_all"),
    )


@query("resolved_names", "", """
SELECT CASE lower(trim(raw)) WHEN 'regulatory' THEN 0 WHEN 'regulartory' THEN 0 WHEN 'warning' THEN 1 WHEN 'information' THEN 2 ELSE -1 END AS idx, count(*) AS n
FROM (SELECT CASE l_partkey % 5 WHEN 0 THEN ' Regulatory' WHEN 1 THEN 'REGULARTORY ' WHEN 2 THEN 'warning' WHEN 3 THEN 'Information' ELSE 'sign' END AS raw FROM lineitem) GROUP BY 1""")
def resolved_names(spark, folder):
    raw = F.element_at(
        F.array(*map(F.lit, (" Regulatory", "REGULARTORY ", "warning", "Information", "sign"))), (F.col("l_partkey") % 5 + 1).cast("int")
    )
    known, unknown = X.resolve_names(
        V.table(spark, folder, "lineitem").select(raw.alias("raw")), "raw", X.aliases(spark)
    )
    return known.select("idx").unionByName(unknown.select(F.lit(-1).alias("idx"))).groupBy("idx").agg(F.count("*").alias("n"))


_ANSWERS = ("I think it is no_right_u_turn.", "keep_left_or_right", "a blue rectangle", "other_information", "Perhaps KEEP_LEFT or stop", "unclear")
_EXPECTED = {
    "Regulatory": ("no_right_u_turn", "keep_left_or_right", "unparsed", "unparsed", "keep_left", "unclear"),
    "Warning": ("unparsed",) * 5 + ("unclear",),
    "Information": ("unparsed",) * 5 + ("unclear",),
}


@query("parsed_answers", "", "SELECT parent, parsed, count(*) AS n FROM (SELECT l_orderkey % 3 AS p, l_partkey % 6 AS r FROM lineitem) JOIN (VALUES "
       + ", ".join(f"({p}, {r}, '{X.COARSE[p]}', '{_EXPECTED[X.COARSE[p]][r]}')" for p in range(3) for r in range(6))
       + ") AS t(p2, r2, parent, parsed) ON p = p2 AND r = r2 GROUP BY parent, parsed")
def parsed_answers(spark, folder):
    raw = F.element_at(F.array(*map(F.lit, _ANSWERS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    parent = F.element_at(F.array(*map(F.lit, X.COARSE)), (F.col("l_orderkey") % 3 + 1).cast("int"))
    rows = V.table(spark, folder, "lineitem").select(raw.alias("raw"), parent.alias("parent"))
    return rows.select("parent", X.parse_answer(F.col("raw"), F.col("parent")).alias("parsed")).groupBy("parent", "parsed").agg(
        F.count("*").alias("n")
    )


@query("prompts", "", """
WITH o AS (SELECT p_type AS parent, p_brand AS option, 'size ' || max(p_size) AS looks_like, p_brand = 'Brand#1' AS rest, CAST(substr(p_brand, 7) AS INT) AS idx
           FROM part GROUP BY p_type, p_brand),
l AS (SELECT parent, string_agg('- ' || option || ': ' || looks_like, chr(10) ORDER BY rest, idx) AS lines, max(CASE WHEN rest THEN option END) AS rest FROM o GROUP BY parent)
SELECT parent, 'A photo of a road sign known to be ' || CASE WHEN substr(parent, 1, 1) IN ('A', 'E', 'I', 'O', 'U') THEN 'an' ELSE 'a' END || ' ' || parent
 || ' sign. Answer with one name of this list only:' || chr(10) || lines || chr(10) || '- unclear: cannot be read' || chr(10) || 'If none is described, answer ' || rest || '.' AS prompt FROM l WHERE rest IS NOT NULL""")
def prompts(spark, folder):
    options = V.table(spark, folder, "part").groupBy(F.col("p_type").alias("parent"), F.col("p_brand").alias("option")).agg(
        F.concat(F.lit("size "), F.max("p_size").cast("string")).alias("looks_like")
    ).withColumns({
        "is_catch_all": F.col("option") == "Brand#1", "idx": F.expr("CAST(substr(option, 7) AS INT)"),
    })
    return X.prompts(options).filter(F.col("prompt").isNotNull())


_NAMES = "none,ARM frequency capped,throttled,soft temperature limit"


@query("flag_words", "", """
SELECT flags, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN v & 1 = 1 THEN 'under-voltage' END, CASE WHEN v & 2 = 2 THEN 'ARM frequency capped' END,
 CASE WHEN v & 4 = 4 THEN 'throttled' END, CASE WHEN v & 8 = 8 THEN 'soft temperature limit' END) AS flags
 FROM (SELECT CASE WHEN l_partkey % 17 = 16 THEN 0 ELSE l_partkey % 17 END AS v FROM lineitem)) GROUP BY flags""")
def flag_words(spark, folder):
    low = F.col("l_partkey") % 17
    word = F.when(low == 16, F.lit("n/a")).otherwise(F.concat(F.lit("0x5000"), F.lower(F.hex(low))))
    return V.table(spark, folder, "lineitem").select(F.array_join(T.flag_names(word), ",").alias("flags")).groupBy("flags").agg(
        F.count("*").alias("n")
    )


@query("metric_lookup", "", """
SELECT p_partkey, p_retailprice AS map50, CAST(p_size AS DOUBLE) AS map, CAST(NULL AS DOUBLE) AS recall FROM part""")
def metric_lookup(spark, folder):
    metrics = F.create_map(
        F.lit("metrics/mAP50(B)"), F.col("p_retailprice"), F.lit("metrics/mAP50-95(B)"), F.col("p_size").cast("double")
    )
    return V.table(spark, folder, "part").select(
        "p_partkey", T.metric_like(metrics, "mAP50(").alias("map50"), T.metric_like(metrics, "mAP50-95(").alias("map"),
        T.metric_like(metrics, "recall(").alias("recall"),
    )


@query("derived_stages", "", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'reviewed' WHEN o_totalprice > 200000 THEN 'in_review' WHEN o_custkey % 2 = 0 THEN 'detected' ELSE 'empty' END AS stage FROM orders""")
def derived_stages(spark, folder):
    return V.table(spark, folder, "orders").select(
        "o_orderkey",
        T.first_present([
            (F.col("o_orderstatus") == "F", "reviewed"), (F.col("o_totalprice") > 200000, "in_review"), (F.col("o_custkey") % 2 == 0, "detected"),
        ], "empty").alias("stage"),
    )


@query("pick_verdicts", "frames det", """
WITH c AS (SELECT f.frame_key, count(d.frame_key) AS n FROM frames f LEFT JOIN det d USING (frame_key) GROUP BY f.frame_key)
SELECT CASE WHEN (n > 0) <> (frame_key % 7 = 0) THEN 'sign' ELSE 'empty' END AS verdict, count(*) AS n_frames FROM c GROUP BY 1""")
def pick_verdicts(spark, folder):
    n = V.detections(spark, folder).groupBy("frame_key").agg(F.count("*").alias("n"))
    rows = V.frames(spark, folder).join(n, "frame_key", "left")
    verdict = T.pick_verdict(F.coalesce("n", F.lit(0)), F.col("frame_key") % 7 == 0)
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n_frames"))


@query("module_states", "", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'off' WHEN event_id % 4 = 0 THEN 'paused' WHEN raw IN ('on', 'paused') THEN raw ELSE 'off' END AS state
FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'on' WHEN 'click' THEN 'paused' ELSE event_type END AS raw FROM events)""")
def module_states(spark, folder):
    from ..operators.state import module_state

    raw = F.expr("CASE event_type WHEN 'view' THEN 'on' WHEN 'click' THEN 'paused' ELSE event_type END")
    return V.table(spark, folder, "events").select(
        "event_id", module_state(raw, F.col("event_id") % 3 != 0, F.col("event_id") % 4 != 0).alias("state")
    )


@query("gated_readings", "det", """
SELECT frame_key, track_no, CASE WHEN x2 - x1 < 32 THEN NULL WHEN conf < 0.6::DOUBLE THEN NULL ELSE CAST(frame_no AS INT) END AS value,
 CASE WHEN x2 - x1 < 32 THEN 0 ELSE conf END AS confidence FROM det""")
def gated_readings(spark, folder):
    r = T.gated_reading(F.col("frame_no"), F.col("conf"), F.col("x2") - F.col("x1"))
    return V.detections(spark, folder).select("frame_key", "track_no", r["value"].alias("value"), r["confidence"].alias("confidence"))


@query("class_filters", "det", """
SELECT frame_key, track_no, cls FROM det WHERE conf >= 0.5::DOUBLE AND cls <> 2 AND cls = 0""")
def class_filters(spark, folder):
    name = F.element_at(F.array(*map(F.lit, ("car", "stop", "information"))), F.col("cls") + 1)
    det = V.detections(spark, folder).withColumn("name", name)
    return det.filter((F.col("conf") >= 0.5) & X.publishable(F.col("name")) & F.col("name").isin(*X.ROAD_USERS)).select(
        "frame_key", "track_no", "cls"
    )
