"""Readers and the contract check, fed with text that is made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import label_line
from ..operators.infer import detect_with, reader_udf, run_model
from ..sources import contract as C
from ..sources import readers as R
from . import views as V
from .registry import query


@query("gt_annotations", "det", """
SELECT printf('%05d', frame_key) AS stem, CAST(x1 AS INT) AS "left", CAST(y1 AS INT) AS top, CAST(x2 AS INT) AS "right", CAST(floor(y2) AS INT) AS bottom, cls AS class_id FROM det WHERE frame_key % 97 <> 0""")
def gt_annotations(spark, folder):
    return R.split_gt_lines(_gt_lines(spark, folder))[0]


def _gt_lines(spark, folder):
    d = V.detections(spark, folder)
    whole = [F.floor(c).cast("string") for c in ("x1", "y1", "x2", "y2")]
    name = F.format_string("%05d.ppm", F.col("frame_key"))
    full = F.concat_ws(";", name, *whole, F.col("cls").cast("string"))
    return d.select(F.when(F.col("frame_key") % 97 == 0, F.concat_ws(";", name, *whole)).otherwise(full).alias("value"))


@query("bad_gt_lines", "det", "SELECT 'field-count' AS reason, count(*) AS n FROM det WHERE frame_key % 97 = 0 HAVING count(*) > 0")
def bad_gt_lines(spark, folder):
    return R.split_gt_lines(_gt_lines(spark, folder))[1].groupBy("reason").agg(F.count("*").alias("n"))


def _label_lines(spark, folder):
    n = V.normalised(spark, folder)
    line = label_line(*(F.col(c) for c in ("cls", "xc", "yc", "w", "h")))
    broken = F.when(F.col("frame_key") % 31 == 0, F.concat(line, F.lit(" 1"))).when(F.col("frame_key") % 37 == 0, F.concat(F.lit("x"), line)).otherwise(line)
    return n.select(F.col("frame_key").alias("stem"), broken.alias("value"))


@query("read_label_lines", "norm", """
SELECT frame_key AS stem, cls, round(xc, 6) AS xc, round(yc, 4) AS yc, round(w, 6) AS w, round(h, 4) AS h FROM norm WHERE frame_key % 31 <> 0 AND frame_key % 37 <> 0""")
def read_label_lines(spark, folder):
    good = R.split_label_lines(_label_lines(spark, folder))[0]
    return good.select("stem", "cls", F.round("xc", 6).alias("xc"), F.round("yc", 4).alias("yc"), F.round("w", 6).alias("w"), F.round("h", 4).alias("h"))


@query("malformed_label_lines", "norm", """
SELECT frame_key AS stem, CASE WHEN frame_key % 31 = 0 THEN 'field-count' ELSE 'parse' END AS reason, count(*) AS n FROM norm WHERE frame_key % 31 = 0 OR frame_key % 37 = 0 GROUP BY 1, 2""")
def malformed_label_lines(spark, folder):
    return R.split_label_lines(_label_lines(spark, folder))[1].groupBy("stem", "reason").agg(F.count("*").alias("n"))


@query("export_violations", "norm", """
WITH m AS (SELECT frame_key AS stem, cls, xc + 0.6::DOUBLE AS xc, yc, w, h FROM norm)
SELECT stem, CASE WHEN cls = 2 THEN 'class_range' ELSE 'coordinates' END AS problem, count(*) AS n FROM m WHERE cls = 2 OR xc NOT BETWEEN 0 AND 1 OR yc NOT BETWEEN 0 AND 1 OR w NOT BETWEEN 0 AND 1 OR h NOT BETWEEN 0 AND 1 GROUP BY 1, 2""")
def export_violations(spark, folder):
    from ..operators.build import export_faults

    n = V.normalised(spark, folder).select(F.col("frame_key").alias("stem"), "cls", (F.col("xc") + 0.6).alias("xc"), "yc", "w", "h")
    return export_faults(n, 2).groupBy("stem", "problem").agg(F.count("*").alias("n"))


def _images(spark, folder):
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".txt", ".ppm"))), (F.col("doc_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("._")).otherwise(F.lit("")), F.col("doc_id").cast("string"), suffix)
    return V.table(spark, folder, "documents").select(path.alias("path"), "source", "doc_id")


@query("image_catalogue", "", """
SELECT '/data/' || source AS dir, count(*) AS n_images FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 7 <> 0 GROUP BY 1""")
def image_catalogue(spark, folder):
    files = _images(spark, folder)
    kept = R.only_images(files)
    return kept.groupBy("dir").agg(F.count("*").alias("n_images"))


@query("annotation_folders", "", """
SELECT d.dir, coalesce(n, 0) AS n_images, 3 AS depth FROM (SELECT DISTINCT '/data/' || source AS dir FROM documents) d LEFT JOIN (SELECT '/data/' || source AS dir, count(*) AS n FROM documents WHERE doc_id % 4 <> 2 AND doc_id % 7 <> 0 GROUP BY 1) i USING (dir)""")
def annotation_folders(spark, folder):
    files = _images(spark, folder)
    images = R.only_images(files)
    return R.rank_annotation_dirs(files.select(F.concat(F.lit("/data/"), "source").alias("dir")), images)


@query("coco_documents", "", """
SELECT l_orderkey AS image_id, CAST(l_partkey % 3 + 1 AS INT) AS category_id, CASE WHEN l_linenumber % 2 = 0 THEN 'true' ELSE 'false' END AS occluded, count(*) AS n, round(sum(l_quantity), 4) AS w FROM lineitem GROUP BY 1, 2, 3""")
def coco_documents(spark, folder):
    li = V.table(spark, folder, "lineitem")
    doc = F.to_json(F.struct(
        F.array(F.struct(F.col("l_orderkey").alias("id"), F.concat("l_returnflag", F.lit(".jpg")).alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))).alias("images"),
        F.array(F.struct(
            F.lit(1).alias("id"), F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") % 3 + 1).alias("category_id"),
            F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity"), F.lit(2.0)).alias("bbox"),
            F.create_map(F.lit("occluded"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("true")).otherwise(F.lit("false"))).alias("attributes"),
        )).alias("annotations"),
        F.array(F.struct(F.lit(1).alias("id"), F.lit("Regulatory").alias("name"))).alias("categories"),
    ))
    parsed = li.select(F.from_json(doc, R.COCO).alias("d"), F.lit("x").alias("source")).select("d.*", "source")
    notes = R.coco_tables(parsed)[1]
    return notes.groupBy("image_id", "category_id", F.element_at("attributes", "occluded").alias("occluded")).agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w")
    )


@query("track_documents", "", """
SELECT CAST(l_orderkey AS VARCHAR) AS clip, CAST(l_linenumber AS INT) AS track, count(*) * 2 AS n, round(sum(l_quantity + l_quantity + 1), 4) AS size, count(*) FILTER (l_partkey % 2 = 0) * 2 AS unnamed FROM lineitem GROUP BY 1, 2""")
def track_documents(spark, folder):
    li = V.table(spark, folder, "lineitem")

    def member(frame, extra):
        return F.struct(
            F.lit(frame).alias("frame"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0), F.lit(4.0)).alias("xyxy"), F.lit(1).alias("cls"),
            F.lit(0.5).alias("conf"), (F.col("l_quantity") + extra).alias("size"),
        )

    doc = F.to_json(F.struct(
        F.col("l_orderkey").cast("string").alias("clip"), F.col("l_linenumber").alias("track_id"),
        F.when(F.col("l_partkey") % 2 == 1, F.lit("c")).alias("crop_id"), F.array(member(1, 0), member(2, 1)).alias("members"),
    ))
    members = R.track_tables(li.select(F.from_json(doc, R.TRACKS).alias("t")).select("t.*"))[1]
    return members.groupBy("clip", "track").agg(
        F.count("*").alias("n"), F.round(F.sum("size"), 4).alias("size"), F.count_if(F.col("crop_id").isNull()).alias("unnamed")
    )


@query("label_column", "ann", "SELECT item AS crop_id, CASE WHEN item % 2 = 0 THEN pred ELSE a END AS label FROM ann")
def label_column(spark, folder):
    ann = V.annotations(spark, folder)
    t = ann.select(F.col("item").alias("crop_id"), F.when(F.col("item") % 2 == 0, F.col("pred")).alias("pred"), F.col("a").alias("label"))
    return R.label_column(t, "crop_id")


@query("notebook_picks", "", """
SELECT 'c' || doc_id AS clip, 'f' || k AS frame_id, k = 1 AS flipped FROM documents JOIN (VALUES (1), (2)) AS v(k) ON true WHERE doc_id % 5 <> 0 AND (k = 1 OR doc_id % 2 = 0)""")
def notebook_picks(spark, folder):
    second = F.when(F.col("doc_id") % 2 == 0, F.lit(', "f2"')).otherwise(F.lit(""))
    good = F.format_string('{"clips": {"c%d": {"selected": ["f1"%s], "flipped": ["f1"]}}}', F.col("doc_id"), second)
    return R.notebook_rows(
        V.table(spark, folder, "documents").select(F.when(F.col("doc_id") % 5 == 0, F.lit("{oops")).otherwise(good).alias("json")), "json"
    )


def _catalogue(spark, folder):
    extract = F.when(F.col("doc_id") % 3 > 0, F.lit(', "extract": {"interval_s": 2.0}')).otherwise(F.lit(""))
    downloads = F.when(F.col("doc_id") % 3 == 2, F.format_string('{"at": "a", "count": 1}, {"at": "b", "count": %d}', F.col("doc_id") % 50)).otherwise(F.lit(""))
    doc = F.format_string('{"videos": {"v%d": {"selected": ["a", "b"], "downloads": [%s]%s}}}', F.col("doc_id"), downloads, extract)
    return R.catalogue_rows(V.table(spark, folder, "documents").select(doc.alias("json")), "json")


@query("video_catalogue", "", """
SELECT 'v' || doc_id AS video, round(n_chars / 1000.0::DOUBLE, 1) AS size_mb, CASE doc_id % 3 WHEN 0 THEN 'untouched' WHEN 1 THEN 'in_progress' ELSE 'done' END AS state,
 CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS extracted, 2 AS selected, CASE WHEN doc_id % 3 = 2 THEN 'b' END AS last_download, doc_id % 3 > 0 AND doc_id % 2 = 1 AS stale FROM documents""")
def video_catalogue(spark, folder):
    docs = V.table(spark, folder, "documents").select(F.format_string("v%d", F.col("doc_id")).alias("video"), "n_chars", "doc_id")
    videos = docs.select("video", (F.col("n_chars") * 1000).alias("size_bytes"))
    index = docs.filter("doc_id % 2 = 0").select("video", F.col("n_chars").alias("n_frames"), F.lit(1.0).alias("index_duration_s"))
    return R.describe_catalogue(videos, _catalogue(spark, folder), index).select(
        "video", "size_mb", "state", "extracted", "selected", "last_download", "stale"
    )


@query("download_totals", "", """
SELECT count(*) * 2 AS n_selected, CAST(sum(CASE WHEN doc_id % 3 = 2 THEN doc_id % 50 ELSE 0 END) AS BIGINT) AS n_downloaded, round(sum(CASE WHEN doc_id % 3 = 2 THEN doc_id % 50 ELSE 0 END) * 100 / 1500.0::DOUBLE, 6) AS pct_of_target FROM documents""")
def download_totals(spark, folder):
    total = F.coalesce(F.sum("last_count"), F.lit(0))
    return _catalogue(spark, folder).agg(
        F.sum("n_selected").alias("n_selected"), total.alias("n_downloaded"), F.round(total * 100 / 1500.0, 6).alias("pct_of_target")
    )


@query("parsed_messages", "", """
SELECT event_id AS msg_id, CASE WHEN event_type = 'view' THEN round(value, 2) WHEN event_type = 'error' THEN -1.0::DOUBLE END AS speed, CASE WHEN event_type = 'click' THEN round(value, 2) END AS speed_limit,
 CASE WHEN event_type = 'purchase' THEN value > 50 END AS lane_warning, CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'stop' END END AS sign_seen FROM events WHERE event_id % 50 NOT IN (7, 8)""")
def parsed_messages(spark, folder):
    return C.parse_messages(V.messages(spark, folder), "json").select("msg_id", "speed", "speed_limit", "lane_warning", "sign_seen")


@query("contract_violations", "", """
SELECT fault, key, count(*) AS n FROM (
 SELECT 'malformed' AS fault, '' AS key FROM events WHERE event_id % 50 IN (7, 8) UNION ALL
 SELECT 'unknown_key', 'sped' FROM events WHERE event_type = 'error' AND event_id % 50 NOT IN (7, 8) UNION ALL
 SELECT 'out_of_range', 'speed' FROM events WHERE event_type = 'error' AND event_id % 50 NOT IN (7, 8) UNION ALL
 SELECT 'out_of_range', 'lane_confidence' FROM events WHERE event_type = 'click' AND round(value, 2) > 1 AND event_id % 50 NOT IN (7, 8) UNION ALL
 SELECT 'bad_value', 'lane_direction' FROM events WHERE event_type = 'purchase' AND event_id % 4 = 3 AND event_id % 50 NOT IN (7, 8) UNION ALL
 SELECT 'bad_value', 'module_status' FROM events WHERE event_type = 'signup' AND event_id % 7 = 0 AND event_id % 50 NOT IN (7, 8)) GROUP BY 1, 2""")
def contract_violations(spark, folder):
    return C.violations(V.messages(spark, folder), "json", ["msg_id"]).groupBy("fault", "key").agg(F.count("*").alias("n"))


def _load_detector():
    def detect(batch):
        big = batch[batch["value"] > 50]
        return big.assign(score=big["value"] / 1000.0)[["event_id", "score"]]

    return detect


@query("plugged_detector", "", "SELECT event_id, value / 1000.0::DOUBLE AS score FROM events WHERE value > 50")
def plugged_detector(spark, folder):
    return detect_with(V.table(spark, folder, "events").select("event_id", "value"), _load_detector, "event_id bigint, score double")


def _load_reader():
    def read(batch):
        import pandas as pd

        return pd.DataFrame({"value": (batch["value"] // 10).astype("int32"), "conf": 0.5})

    return read


@query("plugged_reader", "", "SELECT event_id, CAST(floor(value / 10) AS INT) AS reading, CAST(0.5 AS DOUBLE) AS conf FROM events")
def plugged_reader(spark, folder):
    read = reader_udf(_load_reader)
    e = V.table(spark, folder, "events").select("event_id", read(F.struct("value")).alias("r"))
    return e.select("event_id", F.col("r.value").alias("reading"), F.col("r.conf").alias("conf"))


@query("resumed_inference", "", "SELECT event_id, value / 1000.0::DOUBLE AS score, 'm2' AS model_id FROM events WHERE value > 50 AND event_id % 3 <> 0")
def resumed_inference(spark, folder):
    e = V.table(spark, folder, "events").select("event_id", "value")
    done = e.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("m2")).otherwise(F.lit("m1")).alias("model_id"))
    return run_model(e, _load_detector, "event_id bigint, score double", "event_id", done, "m2")
