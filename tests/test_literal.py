"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from kerbline.functions import boxes as B
from kerbline.functions import keys as K
from kerbline.functions import taxonomy as X
from kerbline.functions import text as Tx
from kerbline.operators import build as U
from kerbline.operators import review as R
from kerbline.operators import score as S
from kerbline.operators import splits as L
from kerbline.operators import state as St


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def lit_box(a):
    return B.Box(*(F.lit(float(v)) for v in a))


@pytest.mark.parametrize("a, b, want", [
    ((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (0, 0, 10, 5), 0.5), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0),
])
def test_iou(spark, a, b, want):
    assert one(spark, B.iou(lit_box(a), lit_box(b)))[0] == pytest.approx(want)


def test_clamped_norm(spark):
    size = F.lit(100.0), F.lit(50.0)
    r = one(spark, B.clamped_norm(lit_box((10, 10, 30, 30)), *size).alias("a"), B.clamped_norm(lit_box((40, 10, 40, 30)), *size).alias("b"))
    assert tuple(r.a) == pytest.approx((0.2, 0.4, 0.2, 0.4)) and r.b is None


def test_square_window(spark):
    size = F.lit(640.0), F.lit(480.0)
    w = one(spark, *B.square_window(lit_box((100, 100, 140, 140)), *size))
    assert (w[2] - w[0], w[3] - w[1]) == pytest.approx((48, 48))
    w = one(spark, *B.square_window(lit_box((0, 0, 40, 40)), *size))
    assert (w[2] - w[0], w[3] - w[1]) == pytest.approx((44, 44))


def test_keys(spark):
    r = one(spark, K.clip_of(F.lit("a_f1_f000012")), K.frame_no_of(F.lit("a_f1_f000012")), K.clip_of(F.lit("nope")), K.frame_no_of(F.lit("nope")))
    assert tuple(r) == ("a_f1", 12, "UNPARSED", -1)
    with pytest.raises(Exception, match="not <clip>_f<frame>"):
        one(spark, K.clip_of(F.lit("nope"), strict=True))


def test_grid_hash(spark):
    rows = F.array(*(F.array(*(F.lit(x) for x in range(9))) for _ in range(8)))
    assert one(spark, K.grid_difference_hash(rows))[0] == -1


@pytest.mark.parametrize("raw, parent, want", [
    ("I think it is no_right_u_turn.", "Regulatory", "no_right_u_turn"), ("keep_left_or_right", "Regulatory", "keep_left_or_right"),
    ("a blue rectangle", "Information", "unparsed"), ("other_information", "Information", "unparsed"), ("UNCLEAR", "Warning", "unclear"),
])
def test_parse_answer(spark, raw, parent, want):
    assert one(spark, X.parse_answer(F.lit(raw), F.lit(parent)))[0] == want


def test_label_sets(spark):
    four = X.label_map(spark, "4class").collect()
    assert sorted(r.src_id for r in four) == list(range(43)) and {r.idx for r in four} == {0, 1, 2, 3}
    assert X.taxonomy(spark).count() == 21
    assert {r.catch_all for r in X.taxonomy(spark).collect()} == {"other_regulatory", "other_warning", "information"}
    with pytest.raises(KeyError):
        X.label_map(spark, "5class")


def test_fold(spark):
    rows = spark.createDataFrame([("stop",)] * 2 + [("speed_limit",)] * 9 + [("information",)], "label string")
    got = {(r.label, r.folded) for r in X.fold_thin(rows, X.taxonomy(spark)).collect()}
    assert got == {("stop", "other_regulatory"), ("speed_limit", "speed_limit"), ("information", "information")}


def test_score(spark):
    labels = ["information"] * 3 + ["u_turn"] + ["pedestrian_crossing"] * 2 + ["other_warning"]
    preds = ["information"] * 3 + ["u_turn"] + ["pedestrian_crossing"] * 2 + ["unclear"]
    key = spark.createDataFrame(list(enumerate(labels)), "item int, label string")
    pred = spark.createDataFrame(list(enumerate(preds)), "item int, pred string")
    r = S.score(key, pred, X.taxonomy(spark), min_support=1).first()
    assert (r.accuracy, r.blind_accuracy) == pytest.approx((6 / 7, 5 / 7))
    assert (r.macro_recall, r.blind_macro_recall) == pytest.approx((0.75, 0.5))
    assert (r.n_abstained, r.verdict) == (1, "usable")


def test_wilson(spark):
    r = one(spark, Tx.wilson(F.lit(33), F.lit(38)).alias("w")).w
    assert (round(r.low * 100, 1), round(r.high * 100, 1)) == (72.7, 94.2)


def test_flags(spark):
    r = one(spark, Tx.flag_names(F.lit("0x50005")), Tx.flag_names(F.lit("n/a")), Tx.flag_names(F.lit("")))
    assert r[0] == ["under-voltage", "throttled"] and r[1] == [] and r[2] == []


@pytest.mark.parametrize("tolerate, want", [(30, {1}), (0, {0, 1}), (999, set())])
def test_poison(spark, tolerate, want):
    rows = []
    for pass_no in (0, 1):  # the same pass twice counts once
        rows += [("c", 0, 0, 80.0, True, "a", pass_no), ("c", 0, 1, 90.0, True, "a", pass_no)]
        rows += [("c", 1, 0, 20.0, False, None, pass_no), ("c", 1, 1, 45.0, False, None, pass_no)]
        rows += [("c", 2, 0, 10.0, False, None, pass_no), ("c", 2, 1, 12.0, False, None, pass_no)]
    passes = spark.createDataFrame(rows, "clip string, track int, frame int, size double, labelable boolean, crop_id string, pass_no int")
    nothing = spark.createDataFrame([], "crop_id string")
    members = spark.createDataFrame([], "crop_id string, clip string, frame int")
    got = U.poisoned_frames(passes, spark.createDataFrame([("a",)], "crop_id string"), nothing, members, tolerate)
    assert {r.frame for r in got.collect()} == want


def test_nested_subsets(spark):
    order = spark.createDataFrame([(f"c{i}", i) for i in range(1, 21)], "clip string, pos int")
    got = {p: set() for p in (25, 50, 75)}
    for r in L.nested_subsets(order).collect():
        got[r.percent].add(r.clip)
    assert [len(got[p]) for p in (25, 50, 75)] == [5, 10, 15] and got[25] < got[50] < got[75]


def test_splits_do_not_leak(spark):
    groups = spark.createDataFrame([(f"c{i % 30}",) for i in range(300)], "clip string")
    split = L.group_split(groups, "clip", 0.2, 1)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {"train": 24, "val": 6}
    L.assert_no_leak(split, groups, "clip", ("train", "val"))
    both = split.unionByName(split.filter("split = 'val'").withColumn("split", F.lit("train")))
    with pytest.raises(ValueError, match="two_splits"):
        L.assert_no_leak(both, groups, "clip", ("train", "val"))
    lone = L.group_split(spark.createDataFrame([("a",)], "clip string"), "clip")
    assert [tuple(r) for r in lone.collect()] == [("a", "train")]


def test_balanced_split(spark):
    counts = spark.createDataFrame([(f"c{i}", i % 3, 1 + i % 4) for i in range(20)] + [("e1", None, None), ("e2", None, None)], "clip string, cls int, n int")
    split = L.balanced_group_split(counts, "clip", 64, 3)
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 22 and sizes["val"] == 5 and sizes["test"] == 2
    ranked = L._ranked(spark.range(300).select("id", F.md5(F.col("id").cast("string")).alias("k"), F.lit(1).alias("g")), ["g"], ["k", "id"], 10**6)
    keys = [r.k for r in ranked.orderBy("__rank").collect()]
    assert keys == sorted(keys) and len(keys) == 300


def test_review_chain(spark):
    schema = "frame string, box_no int, x1 double, y1 double, x2 double, y2 double, label string"
    proposed = spark.createDataFrame([
        ("a", 0, 0.0, 0.0, 10.0, 10.0, "stop"), ("a", 1, 50.0, 50.0, 60.0, 60.0, "stop"), ("b", 0, 0.0, 0.0, 9.0, 9.0, "stop"), ("z", 0, 0.0, 0.0, 9.0, 9.0, "stop"),
    ], schema)
    reviewed = spark.createDataFrame([
        ("a", 0, 0.0, 0.0, 10.0, 9.0, "stop"), ("a", 1, 50.0, 50.0, 60.0, 61.0, "u_turn"), ("b", 0, 90.0, 90.0, 99.0, 99.0, "stop"),
    ], schema)
    frames = spark.createDataFrame([("a",), ("b",)], "frame string")
    cost = {r.outcome: r.n for r in R.review_cost(R.review_outcomes(reviewed, proposed, frames, "frame")).collect()}
    assert cost == {"accepted": 1, "relabelled": 1, "deleted": 1, "added": 1, "not_reviewed": 1}


def test_patches_are_idempotent(spark):
    boxes = spark.createDataFrame([("s", 0, 0.5, 0.5, 0.1, 0.1), ("s", 2, 0.7, 0.5, 0.1, 0.1), ("t", 1, 0.5, 0.5, 0.1, 0.1)], "stem string, cls int, xc double, yc double, w double, h double")
    patches = spark.createDataFrame([("s", 0.5011, 0.4999, None, 0), ("s", 0.5, 0.5, 1, 1), ("s", 0.7, 0.5, 0, 2)], "stem string, x double, y double, new_cls int, patch_no int")
    once = R.patch_labels(boxes, patches)
    want = {("s", 0, 0.7), ("t", 1, 0.5)}
    assert {(r.stem, r.cls, r.xc) for r in once.collect()} == want
    assert {(r.stem, r.cls, r.xc) for r in R.patch_labels(once, patches).collect()} == want


def test_wrong_batch_is_refused(spark):
    pred = spark.createDataFrame([("x", "stop")], "crop_id string, pred string")
    batch = spark.createDataFrame([("y",)], "crop_id string")
    with pytest.raises(Exception, match="no prediction belongs"):
        R.take_batch(pred, batch, X.taxonomy(spark))[1].collect()


def test_alert_order(spark):
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))

    def state(**given):
        base = {
            "ts": F.to_timestamp(F.lit("2024-01-01 00:00:01")), "adas_at": at, "speed_at": at, "sign_at": at, "last_sign_seen": F.lit("stop"),
            "last_speed": F.lit(60.0), "last_speed_limit": F.lit(50), "last_lane_warning": F.lit(True), "last_lane_direction": F.lit("none"),
            "last_system_fault": F.lit("x"), "last_fcw_warning": F.lit(True),
        }
        return spark.range(1).select(*[v.alias(k) for k, v in {**base, **given}.items()])

    assert St.alerts(state(), "ts").first().active == ["fcw", "fault", "lane_left", "overspeed", "sign"]
    late = St.alerts(state(ts=F.to_timestamp(F.lit("2024-01-01 00:00:03"))), "ts").first()
    assert late.active == ["adas_offline", "sign"] and late.level == "system"
    r = St.alerts(state(last_speed=F.lit(52.0), last_fcw_warning=F.lit(False), last_system_fault=F.lit(""), last_lane_direction=F.lit("right")), "ts").first()
    assert r.active == ["lane_right", "sign"]
    r = St.alerts(state(signs_on=F.lit(False), lane_on=F.lit(False), fcw_on=F.lit(False), last_system_fault=F.lit("")), "ts").first()
    assert (r.active, r.reason, r.level, r.limit) == ([], "none", "none", 0)


@pytest.mark.parametrize("digits", [0, 1, 2, None])
def test_class_sums_of_trials(spark, digits):
    """Sums by leading digits and single groups against an order of all groups, trial by trial."""
    import hashlib

    counts = {g: {c: (g * 7 + c * 5) % 11 + 1 for c in range(3) if (g + c) % 4} for g in range(60)}
    rows = [(g, c, n) for g, own in counts.items() for c, n in own.items()]
    filled = spark.createDataFrame(rows, "g int, cls int, n long").groupBy("g").agg(F.collect_list(F.struct("cls", "n")).alias("__boxes"))
    got = L.trial_sums(filled, "g", 12, 5, 12, 6, digits).groupBy("trial", "cls", "split").agg(F.sum("n").alias("n")).collect()
    want = {}
    for trial in range(12):
        order = sorted(counts, key=lambda g: (hashlib.md5(f"5|{trial}|{g}".encode()).hexdigest(), g))
        for rank, g in enumerate(order, 1):
            for c, n in counts[g].items():
                side = "val" if rank <= 12 else "test" if rank <= 18 else "train"
                want[trial, c, side] = want.get((trial, c, side), 0) + n
    assert {(r.trial, r.cls, r.split): r.n for r in got} == want


def test_leading_digits_of_md5():
    """Heads and texts of any length, few and many, against hashlib."""
    import hashlib
    import random

    import numpy as np

    from kerbline.functions import digests as D

    made = random.Random(4)
    for size, length, m, n in [(2, 0, 1, 1), (5, 1, 3, 1), (6, 7, 1, 5), (7, 52, 2, 3), (63, 64, 2, 2), (130, 3, 3, 2), (9, 6, 2, D.LANES + 3), (8, 6, 40, 1000)]:
        heads, texts = [made.randbytes(size) for _ in range(m)], [made.randbytes(length) for _ in range(n)]
        words = D.text_words(np.frombuffer(b"".join(texts), np.uint8).reshape(n, length), size % 4)
        got = D.leading(np.frombuffer(b"".join(heads), np.uint8).reshape(m, size), words, length)
        some = texts[: 3 if n > 1000 else n] + texts[-3:]
        assert got[:, [*range(len(some) - len(texts[-3:])), *range(n - len(texts[-3:]), n)]].tolist() == [
            [int(hashlib.md5(h + t).hexdigest()[:8], 16) for t in some] for h in heads
        ]


@pytest.mark.parametrize(("kind", "alike"), [("int", 0), ("string", 0), ("int", 28), ("string", 31)])
def test_trials_run_whole(spark, monkeypatch, kind, alike):
    """Whole trials in one task, without a row for each group and trial: as dealt by bins, with a null group, and where keys begin alike."""
    import pyarrow as pa

    rows = [(g, f"c{c}", (g * 7 + c * 5) % 11 + 1) for g in range(130) for c in range(3) if (g + c) % 4] + [(None, "c1", 9)]
    counts = spark.createDataFrame(rows, "g int, cls string, n int").withColumn("g", F.col("g").cast(kind))
    filled = counts.groupBy("g").agg(F.collect_list(F.struct("cls", "n")).alias("__boxes"))

    def added(df):
        return {(r.trial, r.cls, r.split): r.n for r in df.groupBy("trial", "cls", "split").agg(F.sum("n").alias("n")).collect()}

    want = added(L.trial_sums(filled, "g", 13, 5, 26, 13, in_task=0))
    whole = L.trial_sums(filled, "g", 13, 5, 26, 13)
    assert "md5(" not in whole._jdf.queryExecution().analyzed().toString()
    assert added(whole) == want
    if alike:
        leading = L.leading
        monkeypatch.setattr(L, "leading", lambda *a: leading(*a) >> alike)
        tail = F.concat_ws("|", F.lit(""), F.col("g").cast("string")).alias("tail")
        groups = filled.select(tail, F.col("__boxes").alias("boxes")).toArrow()
        got = pa.Table.from_batches(L._sums_of_trials(groups, 5, range(13), 26, 13)).to_pylist()
        assert {(r["trial"], r["cls"], r["split"]): r["n"] for r in got} == want


def test_groups_of_one_name_are_dealt_by_bins(spark):
    """Where two groups give the same text, or a task cannot hold them, trials are added up by bins."""
    rows = [(bytes([c]), c % 2, 1) for c in (200, 201, 202, 203, 65, 66)]
    filled = spark.createDataFrame(rows, "g binary, cls int, n int").groupBy("g").agg(F.collect_list(F.struct("cls", "n")).alias("__boxes"))
    one = spark.createDataFrame([("a", 0, 1.5)], "g string, cls int, n double").groupBy("g").agg(F.collect_list(F.struct("cls", "n")).alias("__boxes"))
    assert L._whole_trials(one, "g", 3, 5, 1, 1, 100) is None
    assert L._whole_trials(filled.select(F.lit("x").alias("g"), "__boxes"), "g", 3, 5, 1, 1, 100) is None
    assert L._whole_trials(filled, "g", 3, 5, 1, 1, 5) is None


def test_trials_are_dealt_in_blocks(spark):
    """Nearly all groups of a trial meet in one task, whatever the number of tasks."""
    filled = spark.range(3000).select(F.col("id").alias("g"), F.array(F.struct(F.lit(0).alias("cls"), F.lit(1).alias("n"))).alias("__boxes"))
    dealt = L._spread(filled, "g", 3000, 2000, 256)
    held = dealt.groupBy("trial", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    told = held.agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.count_distinct("task").alias("tasks"), F.count_distinct("trial").alias("trials")).first()
    assert told.n == 6_000_000 and told.trials == 2000 and told.tasks > 4 and told.blocks <= 2 * 2000
