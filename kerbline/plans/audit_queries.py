"""Audit of the derived dataset: orphans, profiles, tables, top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes as B
from ..operators import audit as A
from ..operators import build as U
from ..operators import dedup as D
from ..operators.overlap import overlap_counts
from ..session import values
from . import views as V
from .registry import query

CLASSES = [(0, "Regulatory"), (1, "Warning"), (2, "Information"), (3, "Other")]


def _classes(spark):
    return values(spark, CLASSES, "cls int, name string")


def _geo(spark, folder):
    return B.geometry(V.normalised(spark, folder), 640)


@query("class_table", "geo", """
WITH c(cls, name) AS (VALUES (0, 'Regulatory'), (1, 'Warning'), (2, 'Information'), (3, 'Other'))
SELECT c.cls, any_value(c.name) AS name, count(g.cls) AS boxes, count(DISTINCT g.frame_key) AS frames,
 round(count(g.cls) * 100 / (SELECT count(*) FROM geo), 6) AS share_pct, round(quantile_cont(side_px, 0.5), 4) AS median_px,
 round(quantile_cont(side_px, 0.05), 4) AS p05_px, round(quantile_cont(side_px, 0.95), 4) AS p95_px, round(quantile_cont(side_scaled, 0.5), 4) AS median_scaled
FROM c LEFT JOIN geo g ON g.cls = c.cls GROUP BY c.cls""")
def class_table(spark, folder):
    table = A.class_table(_geo(spark, folder), _classes(spark), "frame_key")
    digits = {"share_pct": 6, "median_px": 4, "p05_px": 4, "p95_px": 4, "median_scaled": 4}
    return table.select(
        "cls", "name", "boxes", "frames", *[F.round(c, d).alias(c) for c, d in digits.items()]
    )


@query("orphans", "", """
SELECT l_orderkey AS frame_key, 'right' AS missing_in FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1)
 WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 0)
UNION ALL SELECT l_orderkey, 'left' FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 0)
 WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber % 2 = 1)""")
def orphans(spark, folder):
    li = V.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("frame_key"), "l_linenumber")
    return A.orphans(li.filter("l_linenumber % 2 = 1"), li.filter("l_linenumber % 2 = 0"), "frame_key")


@query("format_agreement", "norm", """
WITH b AS (SELECT frame_key, CASE WHEN frame_key % 31 = 0 AND cls = 1 THEN 2 ELSE cls END AS cls, CASE WHEN frame_key % 29 = 0 THEN xc + 0.002::DOUBLE ELSE xc END AS xc, yc, w, h
  FROM norm WHERE NOT (frame_key % 37 = 0 AND cls = 0)),
ra AS (SELECT frame_key, cls, xc, yc, w, h, row_number() OVER (PARTITION BY frame_key ORDER BY cls, xc, yc, w, h) AS rn FROM norm),
rb AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY cls, xc, yc, w, h) AS rn FROM b),
n AS (SELECT frame_key, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT frame_key, count(*) AS na FROM norm GROUP BY 1)
  FULL JOIN (SELECT frame_key, count(*) AS nb FROM b GROUP BY 1) USING (frame_key)),
p AS (SELECT frame_key, ra.cls AS ca, rb.cls AS cb, greatest(abs(ra.xc - rb.xc), abs(ra.yc - rb.yc), abs(ra.w - rb.w), abs(ra.h - rb.h)) AS e
  FROM ra JOIN rb USING (frame_key, rn) JOIN n USING (frame_key) WHERE na = nb)
SELECT frame_key, 'count' AS what, CAST(abs(na - nb) AS DOUBLE) AS error FROM n WHERE na <> nb
UNION ALL SELECT frame_key, CASE WHEN ca <> cb THEN 'class' ELSE 'geom' END, round(e, 6) FROM p WHERE ca <> cb OR e > 1e-3""")
def format_agreement(spark, folder):
    a = V.normalised(spark, folder).select("frame_key", "cls", "xc", "yc", "w", "h")
    b = a.filter(~((F.col("frame_key") % 37 == 0) & (F.col("cls") == 0))).withColumns({
        "cls": F.when((F.col("frame_key") % 31 == 0) & (F.col("cls") == 1), F.lit(2)).otherwise(F.col("cls")),
        "xc": F.when(F.col("frame_key") % 29 == 0, F.col("xc") + 0.002).otherwise(F.col("xc")),
    })
    return A.compare_formats(a, b, "frame_key").withColumn("error", F.round("error", 6))


@query("boxes_per_frame", "frames det", """
SELECT round(avg(n), 6) AS mean, quantile_cont(n, 0.5) AS median, max(n) AS most, count(*) FILTER (n = 0) AS zero, count(*) FILTER (n = 1) AS one,
 count(*) FILTER (n = 2) AS two, count(*) FILTER (n >= 3) AS three_up
FROM (SELECT f.frame_key, count(d.frame_key) AS n FROM frames f LEFT JOIN det d USING (frame_key) GROUP BY f.frame_key)""")
def boxes_per_frame(spark, folder):
    return A.boxes_per_frame(V.frames(spark, folder), V.detections(spark, folder), "frame_key").withColumn(
        "mean", F.round("mean", 6)
    )


_Q = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {n}" for n, p in
               (("min", 0), ("p05", 0.05), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p95", 0.95), ("max", 1)))


@query("quantile_profile", "geo", " UNION ALL ".join(
    f"SELECT '{c}' AS measure, {_Q} FROM (SELECT {c} AS v FROM geo)"
    for c in ("pw", "ph", "side_px", "aspect", "side_scaled", "xc", "yc")))
def quantile_profile(spark, folder):
    profile = A.quantile_profile(_geo(spark, folder), ["pw", "ph", "side_px", "aspect", "side_scaled", "xc", "yc"])
    return profile.select("measure", *[F.round(c, 4).alias(c) for c in A.PROBABILITIES])


@query("size_buckets", "geo", """
SELECT count(*) AS n, count(*) FILTER (side_scaled < 8) AS under_8, count(*) FILTER (side_scaled < 12) AS under_12, count(*) FILTER (side_scaled < 16) AS under_16,
 count(*) FILTER (side_scaled < 32) AS under_32, round(100.0 * count(*) FILTER (side_scaled < 8) / count(*), 6) AS pct_under_8,
 round(100.0 * count(*) FILTER (side_scaled < 12) / count(*), 6) AS pct_under_12, round(100.0 * count(*) FILTER (side_scaled < 16) / count(*), 6) AS pct_under_16,
 round(100.0 * count(*) FILTER (side_scaled < 32) / count(*), 6) AS pct_under_32, count(*) FILTER (side_px < 32) AS small,
 count(*) FILTER (side_px >= 32 AND side_px < 96) AS medium, count(*) FILTER (side_px >= 96) AS large FROM geo""")
def size_buckets(spark, folder):
    b = A.size_buckets(_geo(spark, folder))
    return b.select(*[F.round(c, 6).alias(c) if c.startswith("pct") else F.col(c) for c in b.columns])


@query("size_histogram", "", """
WITH f AS (SELECT CAST(640 + 64 * (o_custkey % 7) AS INT) AS width, CAST(480 + 48 * (o_custkey % 3) AS INT) AS height FROM orders),
c AS (SELECT width, height, count(*) AS n FROM f GROUP BY 1, 2)
SELECT width, height, n, row_number() OVER (ORDER BY n DESC, width, height) = 1 AS is_mode FROM c""")
def size_histogram(spark, folder):
    f = V.table(spark, folder, "orders").select(
        (640 + 64 * (F.col("o_custkey") % 7)).cast("int").alias("width"), (480 + 48 * (F.col("o_custkey") % 3)).cast("int").alias("height")
    )
    return A.size_histogram(f)


@query("overlap_counts", "det", """
WITH d AS (SELECT *, row_number() OVER (ORDER BY frame_key, x1, y1, x2, y2) AS id FROM det
   UNION ALL SELECT *, 100000000 + row_number() OVER (ORDER BY frame_key, x1, y1, x2, y2) FROM det WHERE frame_key % 13 = 0),
p AS (SELECT greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM d a JOIN d b ON a.frame_key = b.frame_key AND a.id < b.id)
SELECT count(*) FILTER (i / (s - i) > 0.9::DOUBLE) AS duplicate_pairs, count(*) FILTER (i / (s - i) > 0.4::DOUBLE AND i / (s - i) <= 0.9::DOUBLE) AS overlap_pairs FROM p""")
def overlaps(spark, folder):
    det = V.detections(spark, folder).select("frame_key", "x1", "y1", "x2", "y2")
    return overlap_counts(det.unionByName(det.filter("frame_key % 13 = 0")), ["frame_key"])


@query("attribute_counts", "", """
SELECT name, value, count(*) AS n FROM (SELECT 'priority' AS name, o_orderpriority AS value FROM orders UNION ALL
 SELECT 'occluded', CASE WHEN o_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM orders UNION ALL
 SELECT 'rotation', CAST(o_custkey % 4 * 90 AS VARCHAR) FROM orders WHERE o_custkey % 4 > 0) GROUP BY 1, 2""")
def attribute_counts(spark, folder):
    turn = F.col("o_custkey") % 4
    attributes = F.map_filter(
        F.create_map(
            F.lit("priority"), F.col("o_orderpriority"), F.lit("occluded"), F.when(F.col("o_custkey") % 2 == 0, "true").otherwise("false"),
            F.lit("rotation"), F.when(turn > 0, (turn * 90).cast("string")),
        ),
        lambda _, v: v.isNotNull(),
    )
    return A.attribute_counts(V.table(spark, folder, "orders").select(attributes.alias("a")), "a")


@query("labelled_per_clip", "frames det", """
SELECT clip_no, count(*) FILTER (has) AS labelled, count(*) FILTER (NOT has) AS empty, count(*) FILTER (has) = 0 AS nothing
FROM (SELECT *, frame_key IN (SELECT frame_key FROM det) AS has FROM frames) GROUP BY clip_no""")
def labelled_per_clip(spark, folder):
    return A.labelled_per_clip(
        V.frames(spark, folder), V.detections(spark, folder), "frame_key", "clip_no"
    )


@query("empty_near_labelled", "frames det", """
WITH m AS (SELECT clip_no, frame_no, frame_key IN (SELECT frame_key FROM det) AS has FROM frames),
g AS (SELECT *, frame_no - last_value(CASE WHEN has THEN frame_no END IGNORE NULLS) OVER (PARTITION BY clip_no ORDER BY frame_no ROWS UNBOUNDED PRECEDING) AS b,
 first_value(CASE WHEN has THEN frame_no END IGNORE NULLS) OVER (PARTITION BY clip_no ORDER BY frame_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - frame_no AS a FROM m)
SELECT clip_no, frame_no, least(a, b) AS gap, coalesce(least(a, b) <= 2, false) AS near FROM g WHERE NOT has""")
def empty_near_labelled(spark, folder):
    marked = A.with_boxes(V.frames(spark, folder), V.detections(spark, folder), "frame_key")
    near = A.empty_near_labelled(
        marked.select("clip_no", "frame_no", "has_box"), "clip_no", "frame_no", F.col("has_box"), 2
    )
    return near.select("clip_no", "frame_no", "gap", "near")


@query("frame_gaps", "", """
SELECT quantile_cont(g, 0.5) AS median, min(g) AS least, max(g) AS most FROM (SELECT o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderkey) AS g FROM orders) WHERE g IS NOT NULL""")
def frame_gaps(spark, folder):
    f = V.table(spark, folder, "orders").select((F.col("o_custkey") % 10).alias("clip"), F.col("o_orderkey").alias("frame"))
    return A.frame_gaps(f, "clip", "frame")


@query("repeated_keys", "", """
SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def repeated_keys(spark, folder):
    return A.repeated_keys(V.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("dangling_references", "", """
SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 40)""")
def dangling_references(spark, folder):
    parts = V.table(spark, folder, "part").filter("p_size < 40").select(F.col("p_partkey").alias("l_partkey"))
    return A.dangling(V.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), "l_partkey", parts)


@query("format_totals", "", """
SELECT (SELECT count(*) FROM lineitem) AS n_a, (SELECT count(*) FROM lineitem WHERE l_quantity > 1) AS n_b,
 (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM lineitem WHERE l_quantity > 1) AS agree""")
def format_totals(spark, folder):
    li = V.table(spark, folder, "lineitem")
    return A.totals_agree(li, li.filter("l_quantity > 1"))


@query("same_content", "", """
SELECT count(*) AS n, count(*) FILTER (md5(text) = md5(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END)) AS n_same,
 round(avg(CASE WHEN md5(text) = md5(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS share FROM documents""")
def same_content(spark, folder):
    docs = V.table(spark, folder, "documents")
    a = docs.select("doc_id", F.md5("text").alias("digest"))
    b = docs.select(
        "doc_id", F.md5(F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("digest")
    )
    return A.same_content(a, b, "doc_id").withColumn("share", F.round("share", 6))


@query("unused_and_undeclared", "det", """
SELECT 3 AS cls, 'unused' AS problem WHERE 3 NOT IN (SELECT cls FROM det) UNION ALL SELECT DISTINCT cls, 'undeclared' FROM det WHERE cls NOT IN (0, 1, 3)""")
def unused_and_undeclared(spark, folder):
    declared = _classes(spark).filter("cls <> 2")
    return A.unused_and_undeclared(V.detections(spark, folder), declared)


@query("frames_by_dataset", "frames", """
WITH l AS (SELECT clip_no AS clip, CASE WHEN frame_key % 3 = 0 THEN 'gold' WHEN frame_key % 3 = 1 THEN 'audit' ELSE 'batch' END AS dataset FROM frames)
SELECT c.clip, c.n_frames, coalesce(g, 0) AS gold, coalesce(a, 0) AS audit, coalesce(b, 0) AS batch
FROM (SELECT clip_no AS clip, count(*) AS n_frames FROM frames GROUP BY 1) c LEFT JOIN
 (SELECT clip, count(*) FILTER (dataset = 'gold') AS g, count(*) FILTER (dataset = 'audit') AS a, count(*) FILTER (dataset = 'batch') AS b FROM l GROUP BY 1) x USING (clip)""")
def frames_by_dataset(spark, folder):
    f = V.frames(spark, folder)
    name = F.element_at(F.array(*map(F.lit, ("gold", "audit", "batch"))), (F.col("frame_key") % 3 + 1).cast("int"))
    lists = f.select(name.alias("dataset"), F.col("clip_no").alias("clip"), F.col("frame_key").alias("frame"))
    clips = f.groupBy(F.col("clip_no").alias("clip")).agg(F.count("*").alias("n_frames"))
    return A.frames_by_dataset(lists, clips, ["gold", "audit", "batch"])


@query("lowest_contrast", "det", """
SELECT frame_key, track_no, conf, x1, y1, x2, y2 FROM det ORDER BY conf, frame_key, track_no, x1, y1, x2, y2 LIMIT 20""")
def lowest_contrast(spark, folder):
    order = [F.col(c) for c in ("conf", "frame_key", "track_no", "x1", "y1", "x2", "y2")]
    return A.top_k(V.detections(spark, folder).select("frame_key", "track_no", "conf", "x1", "y1", "x2", "y2"), order, 20)


@query("fullest_frames", "det", """
SELECT frame_key, n, round(least_area, 4) AS least_area FROM (SELECT frame_key, count(*) AS n, min((x2 - x1) * (y2 - y1)) AS least_area FROM det GROUP BY 1) ORDER BY n DESC, frame_key LIMIT 6""")
def fullest_frames(spark, folder):
    per = V.detections(spark, folder).groupBy("frame_key").agg(
        F.count("*").alias("n"), F.round(F.min(B.area(B.box())), 4).alias("least_area")
    )
    return A.top_k(per, [F.col("n").desc(), F.col("frame_key")], 6)


@query("largest_clips", "frames", "SELECT clip_no, count(*) AS n FROM frames GROUP BY 1 ORDER BY n DESC, clip_no LIMIT 10")
def largest_clips(spark, folder):
    per = V.frames(spark, folder).groupBy("clip_no").agg(F.count("*").alias("n"))
    return A.top_k(per, [F.col("n").desc(), F.col("clip_no")], 10)


@query("mixed_label_order", "", """
SELECT p_partkey, label, px, row_number() OVER (ORDER BY TRY_CAST(label AS DOUBLE) IS NULL, TRY_CAST(label AS DOUBLE), label, px DESC, p_partkey) AS place
FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'x' WHEN p_size % 7 = 0 THEN '?' ELSE CAST(p_size AS VARCHAR) END AS label, p_retailprice AS px FROM part)""")
def mixed_label_order(spark, folder):
    label = F.when(F.col("p_size") % 5 == 0, "x").when(F.col("p_size") % 7 == 0, "?").otherwise(F.col("p_size").cast("string"))
    rows = V.table(spark, folder, "part").select("p_partkey", label.alias("label"), F.col("p_retailprice").alias("px"))
    keyed = A.with_mixed_order(rows, "label", "px")
    return U.numbered_globally(keyed, [*A.MIXED_ORDER, "p_partkey"], "place").drop(*A.MIXED_ORDER)


@query("widest_per_frame", "det", """
SELECT frame_key, cls, x1, y1, x2 FROM (SELECT *, row_number() OVER (PARTITION BY frame_key, cls ORDER BY x2 - x1 DESC, x1, y1) AS rn FROM det) WHERE rn = 1""")
def widest_per_frame(spark, folder):
    det = V.detections(spark, folder).select("frame_key", "cls", "x1", "y1", "x2", "y2")
    return A.widest_per_frame(det, ["frame_key", "cls"]).select("frame_key", "cls", "x1", "y1", "x2")


@query("near_duplicate_pairs", "hashes", """
WITH d AS (SELECT h, count(*) AS n, min(image_id) AS k FROM hashes GROUP BY h)
SELECT a.k AS key_a, b.k AS key_b, a.n AS n_a, b.n AS n_b, bit_count(xor(a.h, b.h))::INT AS distance FROM d a JOIN d b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 10""")
def near_duplicate_pairs(spark, folder):
    return D.near_duplicates(V.hashes(spark, folder), "image_id", "h", 10)


@query("exact_copies", "hashes", "SELECT h, count(*) AS n, min(image_id) AS first_key FROM hashes GROUP BY h HAVING count(*) > 1")
def exact_copies(spark, folder):
    return D.distinct_hashes(V.hashes(spark, folder), "image_id", "h").filter("n > 1")


@query("near_duplicate_counts", "hashes", """
WITH p AS (SELECT bit_count(xor(a.h, b.h)) AS d, a.clip = b.clip AS w FROM hashes a JOIN hashes b ON a.image_id < b.image_id)
SELECT CAST(t AS INT) AS threshold, count(*) AS pairs, count(*) FILTER (w) AS within_clip, count(*) FILTER (NOT w) AS cross_clip FROM p JOIN (VALUES (3), (5), (8), (10)) AS x(t) ON d <= t GROUP BY t""")
def near_duplicate_counts(spark, folder):
    return D.pair_counts(V.hashes(spark, folder), "h", "clip")


@query("scene_groups", "hashes", """
WITH RECURSIVE d AS (SELECT h, count(*) AS n FROM hashes GROUP BY h),
e AS (SELECT a.h AS u, b.h AS v FROM d a JOIN d b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 5),
r(h, c) AS (SELECT h, h FROM d UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.h),
m AS (SELECT h, min(c) AS c FROM r GROUP BY h)
SELECT c AS scene, count(*) AS n_hashes, CAST(sum(n) AS BIGINT) AS n_frames FROM m JOIN d USING (h) GROUP BY c""")
def scene_groups(spark, folder):
    return D.scene_sizes(V.hashes(spark, folder), "h", 5)
