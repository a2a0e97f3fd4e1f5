"""Scores of predictions, readings, runs and benchmarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as X
from ..operators import score as S
from . import views as V
from .registry import query


def _kinds(spark):
    return X.taxonomy(spark, V.KIND_GROUPS)


def _key(spark, folder):
    return V.annotations(spark, folder).select("item", F.when(F.col("item") % 23 == 0, F.lit("too_small")).otherwise(F.col("a")).alias("label"))


def _pred(spark, folder):
    ann = V.annotations(spark, folder).filter("item % 10 <> 3")
    return ann.select("item", F.when(F.col("item") % 15 == 0, F.lit("unclear")).when(F.col("item") % 16 == 0, F.lit("unparsed")).otherwise(F.col("pred")).alias("pred"))


_GRADED = """g AS (SELECT item, a AS label, parent, CASE WHEN item % 10 = 3 THEN NULL WHEN item % 15 = 0 THEN 'unclear' WHEN item % 16 = 0 THEN 'unparsed' ELSE pred END AS pred
 FROM ann JOIN kinds ON fine = a WHERE item % 23 <> 0),
c AS (SELECT parent, label, count(*) AS n, count(*) FILTER (pred = label) AS hits FROM g GROUP BY 1, 2),
p AS (SELECT *, hits / n::DOUBLE AS recall, row_number() OVER (PARTITION BY parent ORDER BY n DESC, label) = 1 AS is_blind FROM c)"""


@query("per_class_recall", "ann kinds", f"WITH {_GRADED} SELECT label, parent, n, hits, round(recall, 6) AS recall, is_blind FROM p")
def per_class_recall(spark, folder):
    return S.per_class(_key(spark, folder), _pred(spark, folder), _kinds(spark)).withColumn("recall", F.round("recall", 6))


@query("classification_score", "ann kinds", f"""WITH {_GRADED}, r AS (SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(hits) / sum(n), 6) AS accuracy, round(sum(CASE WHEN is_blind THEN n ELSE 0 END) / sum(n), 6) AS blind_accuracy,
 avg(recall) FILTER (n >= 5) AS m, avg(CASE WHEN is_blind THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (n >= 5) AS b, count(*) FILTER (n >= 5) AS n_scored_classes FROM p)
SELECT n, accuracy, blind_accuracy, round(m, 6) AS macro_recall, round(b, 6) AS blind_macro_recall, n_scored_classes,
 (SELECT count(*) FROM g WHERE pred IS NULL) AS n_missing, (SELECT count(*) FROM g WHERE pred = 'unclear') AS n_abstained, (SELECT count(*) FROM g WHERE pred = 'unparsed') AS n_unparsed,
 CASE WHEN m <= b THEN 'no_better_than_blind' WHEN m <= 0.5 THEN 'reads_some' ELSE 'usable' END AS verdict FROM r""")
def classification_score(spark, folder):
    s = S.score(_key(spark, folder), _pred(spark, folder), _kinds(spark))
    rounded = ("accuracy", "blind_accuracy", "macro_recall", "blind_macro_recall")
    return s.select(*[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in s.columns])


@query("confusion", "ann kinds", f"WITH {_GRADED} SELECT label, coalesce(pred, 'MISSING') AS pred, count(*) AS n FROM g WHERE coalesce(pred, 'MISSING') <> label GROUP BY 1, 2 ORDER BY n DESC, label, pred LIMIT 8")
def confusion(spark, folder):
    return S.confusion(_key(spark, folder), _pred(spark, folder), _kinds(spark))


@query("contingency", "ann", """
SELECT a, count(*) FILTER (b = 'click') AS click, count(*) FILTER (b = 'view') AS "view", count(*) FILTER (b = 'error') AS error FROM ann GROUP BY a""")
def contingency(spark, folder):
    return S.contingency(V.annotations(spark, folder), "a", "b", ["click", "view", "error"])


@query("proportion_interval", "ann", """
SELECT hits, n, round(p, 6) AS rate, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS low,
 round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS high
FROM (SELECT count(*) FILTER (a = pred) AS hits, count(*) AS n, count(*) FILTER (a = pred) / count(*)::DOUBLE AS p, 1.959964::DOUBLE AS z FROM ann)""")
def proportion_interval(spark, folder):
    return S.proportion(V.annotations(spark, folder), F.col("a") == F.col("pred")).select(
        "hits", "n", *[F.round(c, 6).alias(c) for c in ("rate", "low", "high")]
    )


def _readings(spark, folder):
    label = F.when(F.col("frame_no") == 24, F.lit("x")).when(F.col("frame_no") == 23, F.lit("?")).otherwise(F.col("frame_no").cast("string"))
    value = F.when(F.col("frame_key") % 6 == 0, F.lit(99)).otherwise(F.col("frame_no").cast("int"))
    return V.detections(spark, folder).select(label.alias("label"), value.alias("value"), "conf", (F.col("x2") - F.col("x1")).alias("px"))


_READ = """r AS (SELECT *, TRY_CAST(label AS INT) AS num, px >= 32 AND conf >= 0.6::DOUBLE AS ans, coalesce(value = TRY_CAST(label AS INT), false) AS ok FROM
 (SELECT CASE WHEN frame_no = 24 THEN 'x' WHEN frame_no = 23 THEN '?' ELSE CAST(frame_no AS VARCHAR) END AS label, CASE WHEN frame_key % 6 = 0 THEN 99 ELSE CAST(frame_no AS INT) END AS value, conf, x2 - x1 AS px FROM det))"""


@query("reading_score", "det", f"""WITH {_READ}
SELECT count(num) AS n_numbers, count(*) FILTER (num IS NOT NULL AND px >= 32) AS n_above_size, count(*) FILTER (num IS NOT NULL AND ans AND ok) AS n_right, count(*) FILTER (num IS NOT NULL AND ans AND NOT ok) AS n_wrong,
 count(*) FILTER (num IS NOT NULL AND NOT ans) AS n_declined, count(*) FILTER (num IS NULL) AS n_junk, count(*) FILTER (num IS NULL AND NOT ans) AS n_junk_declined, count(*) FILTER (num IS NOT NULL AND ok) AS n_right_ungated,
 round(count(*) FILTER (num IS NOT NULL AND ans AND ok) / count(num)::DOUBLE, 6) AS gated_accuracy, round(count(*) FILTER (num IS NOT NULL AND ok) / count(num)::DOUBLE, 6) AS ungated_accuracy FROM r""")
def reading_score(spark, folder):
    s = S.reading_score(_readings(spark, folder))
    return s.select(*[F.round(c, 6).alias(c) if c.endswith("accuracy") else F.col(c) for c in s.columns])


@query("reading_score_by_value", "det", f"WITH {_READ} SELECT num AS number, count(*) AS n, count(*) FILTER (value = num) AS n_right FROM r WHERE num IS NOT NULL GROUP BY num")
def reading_score_by_value(spark, folder):
    return S.reading_score_by_value(_readings(spark, folder))


def _benchmarks(spark, folder):
    return V.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run"), F.concat("l_returnflag", "l_linestatus").alias("variant"), F.col("l_extendedprice").alias("total_ms"),
        F.round(1000 / F.col("l_extendedprice"), 6).alias("fps"), F.when(F.col("l_linenumber") == 3, F.lit("failed")).otherwise(F.lit("ok")).alias("status"),
        F.concat(F.lit("0x5000"), (F.col("l_partkey") % 4).cast("string")).alias("throttled"),
    )


_BENCH = """bench AS (SELECT l_suppkey AS run, l_returnflag || l_linestatus AS variant, l_extendedprice AS total_ms, round(1000 / l_extendedprice, 6) AS fps, '0x5000' || (l_partkey % 4) AS throttled FROM lineitem WHERE l_linenumber <> 3),
best AS (SELECT run, variant, total_ms, fps FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY total_ms, variant) AS rn FROM bench) WHERE rn = 1),
rates AS (SELECT l_suppkey AS run, max(lr) AS lr_peak, arg_max(lr, epoch) AS lr_last FROM (SELECT l_suppkey, CAST(floor(l_extendedprice * 100) AS BIGINT) * 100000 + l_partkey AS epoch, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS lr FROM lineitem) WHERE lr IS NOT NULL GROUP BY 1)"""


@query("fastest_variant", "", f"WITH {_BENCH} SELECT run, variant, total_ms, fps, (SELECT string_agg(DISTINCT throttled, ',' ORDER BY throttled) FROM bench b WHERE b.run = best.run) AS flags FROM best")
def fastest_variant(spark, folder):
    return S.fastest_variant(_benchmarks(spark, folder)).withColumn("flags", F.array_join("flags", ","))


def _epochs(spark, folder):
    return V.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("run"), (F.floor(F.col("l_extendedprice") * 100) * 100000 + F.col("l_partkey")).alias("epoch"),
        F.when(F.col("l_linenumber") == 7, F.lit("")).otherwise(F.col("l_tax").cast("string")).alias("lr"),
    )


@query("learning_rates", "", f"WITH {_BENCH} SELECT * FROM rates")
def learning_rates(spark, folder):
    return S.learning_rates(_epochs(spark, folder))


@query("stage_latency", "", """
SELECT *, round(1000 / m, 6) AS fps, 1000 / m >= 18 AS target_met FROM (SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_l_quantity, round(avg(l_partkey % 40), 6) AS mean_infer, round(avg(l_quantity + l_partkey % 40), 6) AS mean_total, avg(l_quantity + l_partkey % 40) AS m FROM lineitem GROUP BY 1, 2)""".replace("SELECT *,", "SELECT l_returnflag, l_linestatus, mean_l_quantity, mean_infer, mean_total,", 1))
def stage_latency(spark, folder):
    t = V.table(spark, folder, "lineitem").withColumn("infer", (F.col("l_partkey") % 40).cast("double"))
    s = S.stage_latency(t, ["l_returnflag", "l_linestatus"], ["l_quantity", "infer"])
    return s.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("mean_l_quantity", "mean_infer", "mean_total", "fps")], "target_met")


@query("run_table", "", f"""WITH {_BENCH} SELECT s_suppkey AS run, 'set' || s_nationkey % 3 AS label_set, CAST(640 + 384 * (s_suppkey % 2) AS INT) AS imgsz, s_acctbal AS map50, s_acctbal / 2 AS "map",
 CAST(NULL AS DOUBLE) AS "precision", CAST(s_nationkey AS DOUBLE) AS recall, lr_peak, lr_last, variant, total_ms, fps FROM supplier LEFT JOIN rates ON rates.run = s_suppkey LEFT JOIN best ON best.run = s_suppkey""")
def run_table(spark, folder):
    runs = V.table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("run"), F.concat(F.lit("set"), (F.col("s_nationkey") % 3).cast("string")).alias("label_set"),
        (640 + 384 * (F.col("s_suppkey") % 2)).cast("int").alias("imgsz"),
        F.create_map(
            F.lit("metrics/mAP50(B)"), F.col("s_acctbal"), F.lit("metrics/mAP50-95(B)"), F.col("s_acctbal") / 2,
            F.lit("metrics/recall(B)"), F.col("s_nationkey").cast("double"),
        ).alias("metrics"),
    )
    return S.run_table(runs, S.learning_rates(_epochs(spark, folder)), S.fastest_variant(_benchmarks(spark, folder)).drop("flags"))


@query("scaling_curve", "frames det", """
SELECT percent, count(DISTINCT clip_no) AS clips, count(*) AS images, percent / 100.0::DOUBLE AS map50 FROM frames JOIN (VALUES (25), (50), (75)) AS p(percent) ON clip_no % 100 < percent GROUP BY percent""")
def scaling_curve(spark, folder):
    from ..operators.build import subset_tally
    from ..session import values

    percents = F.explode(F.filter(F.array(F.lit(25), F.lit(50), F.lit(75)), lambda p: F.col("clip_no") % 100 < p))
    frames = V.frames(spark, folder).select("frame_key", "clip_no").withColumn("percent", percents)
    tally = subset_tally(frames, V.detections(spark, folder), ["percent"], "frame_key", "clip_no", [])
    runs = values(spark, [(25, 0.25), (50, 0.5), (75, 0.75)], "percent int, map50 double")
    return S.scaling_curve(tally.select("percent", "clips", "images"), runs)
