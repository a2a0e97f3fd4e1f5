"""The ways taken for crowded groups give what the plain ways give."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import audit as A
from kerbline.operators import components as C
from kerbline.operators import dedup as D
from kerbline.operators import events as E
from kerbline.operators import ordered as O
from kerbline.operators import overlap as V
from kerbline.operators import review as R
from kerbline.operators import tracks as T
from kerbline.operators.build import box_numbers, numbered_globally
from kerbline.operators.quantiles import quantiles
from kerbline.session import checkpointed


def bits(x: int) -> int:
    return bin(x & (2**64 - 1)).count("1")


def signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >= 2**63 else x


@pytest.fixture(scope="module")
def hashes():
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(40)]
    near = []
    for h in base:
        for _ in range(4):
            turned = h
            for b in rnd.sample(range(64), rnd.randint(0, 12)):
                turned ^= 1 << b
            near.append(turned)
    dark = [rnd.getrandbits(20) for _ in range(40)]  # one band value shared by many
    return sorted({signed(h) for h in base + near + dark})


@pytest.mark.parametrize(("k", "crowded", "number"), [
    (1, 20_000, 1), (1, 20, 2), (3, 20_000, None), (3, 20, None), (5, 20, None), (5, 20_000, 3), (5, 20, 3), (10, 20_000, 2), (10, 20, 2), (10, 20, 3), (10, 20, 4), (10, 20_000, 5),
])
def test_near_duplicates_are_complete(spark, hashes, k, crowded, number):
    df = spark.createDataFrame([(h,) for h in hashes], "h bigint")
    got = [tuple(r) for r in D.hash_pairs(df, k, crowded, number and D.cut(number, k)).collect()]
    want = {(a, b, bits(a ^ b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if bits(a ^ b) <= k}
    assert len(got) == len(set(got)) and set(got) == want


def test_listed_rows_are_weighed_and_dealt_out(spark, monkeypatch):
    """Listed rows cost more than chance meetings; many tasks list them, and neither side is broadcast for the hashes' few bytes."""
    assert [len(D.bands_for(n, 10)) for n in (133_000, 600_000)] == [4, 4]
    monkeypatch.setattr(D, "ROWS_A_TASK", 1_000)
    df = spark.range(500).select((F.xxhash64("id")).alias("h"))
    tasks = -(-500 * D.rows_of(D.bands_for(500, 10)) // 1_000)
    plan = D.hash_pairs(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert tasks > 10 and f", {tasks}), REPARTITION_BY_NUM" in plan
    assert "SortMergeJoin [band" in plan and "BroadcastHashJoin [band" not in plan


def test_bands_follow_the_number_of_hashes():
    for k in range(64):
        for m in range(1, min(8, k + 1) + 1):
            bands = D.cut(m, k)
            assert sum(b.width for b in bands) == 64 and sum(b.radius + 1 for b in bands) == k + 1
    assert [len(D.bands_for(n, 10)) for n in (1, 60_000, 1_000_000, 77_000_000)] == [8, 4, 3, 2]
    # What a hash costs at 77 million of them: rows listed and met by chance.
    assert D.cost(D.bands_for(77_000_000, 10), 77_000_000) < 12_500


def test_copies_are_counted_not_listed(spark):
    rows = [(i, 5, i % 3) for i in range(60)] + [(100, 7, 0)]
    df = spark.createDataFrame(rows, "id int, h bigint, clip int")
    got = {r.threshold: (r.pairs, r.within_clip, r.cross_clip) for r in D.pair_counts(df, "h", "clip").collect()}
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :]]
    within = sum(a[2] == b[2] for a, b in pairs)
    assert got[3] == (len(pairs), within, len(pairs) - within)


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(200, 201)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert got == want


@pytest.mark.parametrize("task_edges", [5_000, 40])
def test_components_of_few_edges_are_written_by_few_tasks(spark, monkeypatch, task_edges):
    written = []

    def kept(df):
        written.append(checkpointed(df))
        return written[-1]

    monkeypatch.setattr(C, "checkpointed", kept)
    monkeypatch.setattr(C, "TASK_EDGES", task_edges)
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400, x) for x in range(401, 460)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.node: r.component for r in C.components(spark.createDataFrame(edges, "u int, v int")).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == low
    assert max(x.rdd.getNumPartitions() for x in written[1:]) <= len(edges) // task_edges + 1


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


@pytest.fixture(scope="module")
def boxes():
    rnd = random.Random(5)
    out = []
    for i in range(240):
        x, y = float(rnd.randint(-5, 60)), float(rnd.randint(-5, 60))
        out.append((rnd.choice([0, 0, 0, 1]), i, x, y, x + rnd.choice([3, 10, 25, 40]), y + rnd.choice([3, 9, 20, 31])))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.9])
@pytest.mark.parametrize("crowded", [10_000, 5])
def test_overlap_grid(spark, boxes, threshold, crowded):
    df = spark.createDataFrame(boxes, "f int, i int, x1 double, y1 double, x2 double, y2 double")
    pairs = V.overlapping(df, df, ["f"], threshold, crowded=crowded).filter("l_i < r_i")
    got = [(r.l_i, r.r_i) for r in pairs.collect()]
    want = {(a[1], b[1]) for a in boxes for b in boxes if a[0] == b[0] and a[1] < b[1] and iou(a[2:], b[2:]) > threshold}
    assert len(got) == len(set(got)) and set(got) == want


def assert_nothing_better(left, right, least, got):
    """Every box has the best of what boxes of smaller number left over, the lowest number of equals, or there is none."""
    owner = {(f, b): a for (f, a), b in got.items()}
    assert len(owner) == len(got)
    for f, a, *box in left:
        free = [(-iou(box, r[2:]), r[1]) for r in right if r[0] == f and owner.get((f, r[1]), a) >= a]
        score, best = min(free, default=(0.0, None))
        assert got.get((f, a)) == (best if -score >= least else None)


@pytest.mark.parametrize("crowded", [100_000, 0])
def test_greedy_match(spark, boxes, crowded):
    left, right = boxes[::2], boxes[1::2]
    schema = "f int, {} int, x1 double, y1 double, x2 double, y2 double"
    got = R.greedy_match(
        spark.createDataFrame(left, schema.format("a")), spark.createDataFrame(right, schema.format("b")), ["f"], "a", "b", 0.3, crowded
    )
    assert_nothing_better(left, right, 0.3, {(r.f, r.a): r.b for r in got.collect()})


def test_greedy_match_of_a_long_chain(spark):
    """Every left box overlaps two right ones and would take its neighbour's: the pairs pass once all the same."""
    n = 10_000
    place = spark.range(n).select(F.lit(0).alias("f"), F.col("id"), (F.col("id") * 10.0).alias("x"))
    box = lambda shift, name: place.select("f", F.col("id").alias(name), (F.col("x") + shift).alias("x1"), F.lit(0.0).alias("y1"), (F.col("x") + shift + 10).alias("x2"), F.lit(10.0).alias("y2"))
    got = R.greedy_match(box(0.0, "a"), box(-5.0, "b"), ["f"], "a", "b", 0.3).select("a", "b").collect()
    assert sorted((r.a, r.b) for r in got) == [(i, i) for i in range(n)]


def test_parts_of_a_crowded_frame_are_matched_apart(spark):
    """One frame of many clusters of boxes: split by parts it gives the same pairs, from several tasks."""
    rnd = random.Random(3)
    place = [(0, i, x := 100.0 * (i // 4) + rnd.random() * 6, 0.0, x + 10, 10.0) for i in range(800)]
    left = spark.createDataFrame(place, "f int, a int, x1 double, y1 double, x2 double, y2 double")
    right = left.withColumnRenamed("a", "b").withColumns({"x1": F.col("x1") + 1, "x2": F.col("x2") + 1})
    whole, split = (R.greedy_match(left, right, ["f"], "a", "b", 0.2, crowded) for crowded in (100_000, 10))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, split.collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions would be put together again
    try:
        assert split.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_first_choices_over_batches():
    """Pairs cut into batches anywhere, parts with and without contested boxes."""
    import pyarrow as pa

    rnd = random.Random(13)
    rows = [(g, l, r) for g in range(40) for l in range(rnd.randrange(1, 6)) for r in rnd.sample(range(6), rnd.randrange(1, 4))]
    want, taken, had = [], set(), set()
    for g, l, r in rows:
        free = (g, l) not in had and (g, r) not in taken
        want.append(free)
        if free:
            had.add((g, l))
            taken.add((g, r))
    for size in (1, 3, 50, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.record_batch({c: pa.array([x[k] for x in p], pa.int64()) for k, c in enumerate(("__g", "__l", "__r"))}) for p in parts]
        got = [tuple(x.values()) for b in R._first_free(iter(batches)) for x in b.to_pylist()]
        assert got == [x for x, w in zip(rows, want, strict=True) if w]


def assert_sampled(rows, step, kept):
    """The first row is kept; any other if and only if it is ``step`` away from the kept row before it."""
    value, ordered = dict(rows), sorted(kept)
    assert ordered[0] == rows[0][0]
    for frame, v in rows[1:]:
        before = value[max(k for k in ordered if k < frame)]
        assert (frame in value.keys() & set(ordered)) == (abs(v - before) >= step * max(before, 1e-9))


@pytest.fixture(params=[2, 1024])
def fan(request, monkeypatch):
    """How many buckets are put together at once: with two, short chains go through all levels."""
    from kerbline.operators import ordered

    monkeypatch.setattr(ordered, "FAN", request.param)


@pytest.mark.parametrize("bucket", [3, 16, 4096])
@pytest.mark.parametrize("step", [0.0, 0.2, 0.5])
def test_change_sample(spark, bucket, step, fan):
    rnd = random.Random(7)
    short = list(enumerate([10.0, 10.5, 11.0, 20.0, 20.0, 40.0, 41.0]))
    long = [(i, rnd.choice([10.0, 11.0, 12.0, 13.0, 20.0, 15.0, 30.0]) + rnd.random()) for i in range(300)]
    df = spark.createDataFrame([(1, *r) for r in short] + [(2, *r) for r in long], "g int, f int, v double")
    rows = T.change_sample(df, ["g"], "f", "v", step, bucket).collect()
    assert_sampled(short, step, [r.f for r in rows if r.g == 1])
    assert_sampled(long, step, [r.f for r in rows if r.g == 2])


def test_keys_of_one_bucket_are_sampled_at_once(spark):
    rows = [(g, f, 10.0 + 3 * (f % 5) + g) for g in range(4) for f in range(20)]
    df = spark.createDataFrame(rows, "g int, f int, v double")
    taken = T.change_sample(df, ["g"], "f", "v", 0.2)
    for g in range(4):
        assert_sampled([r[1:] for r in rows if r[0] == g], 0.2, [r.f for r in taken.collect() if r.g == g])
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(taken) and "Join" in plan(T.change_sample(df, ["g"], "f", "v", 0.2, 8))


def test_interval_sample(spark, fan):
    rnd = random.Random(9)
    times = sorted(rnd.random() * 200 for _ in range(400))
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "g int, f int, t double")
    want, following = [], None
    for i, t in enumerate(times):
        if following is None or t + 1e-6 >= following:
            want.append(i)
            following = t + 2.0
    for per_bucket in (2, 64):
        rows = T.interval_sample(df, ["g"], "f", "t", 2.0, per_bucket).collect()
        assert sorted(r.f for r in rows) == want


@pytest.mark.parametrize("size", [7, 1000])
def test_fold_states(spark, size, fan):
    rnd = random.Random(11)
    rows = [(g, t, rnd.choice("abx")) for g in range(2) for t in range(200)]

    def step(state, row):
        return (
            F.when(row["e"] == "x", F.lit("")).when((row["e"] == "a") & (state == ""), F.lit("A"))
            .when((row["e"] == "b") & (state == "A"), F.lit("B")).otherwise(state)
        )

    df = spark.createDataFrame(rows, "g int, t int, e string")
    got = {(r.g, r.t): r.state for r in O.fold_states(df, ["g"], ["t"], O.tick_bucket("t", size), ["", "A", "B"], step, ["e"]).collect()}
    now = {}
    for g, t, e in rows:
        state = now.get(g, "")
        now[g] = "" if e == "x" else "A" if e == "a" and state == "" else "B" if e == "b" and state == "A" else state
        assert got[(g, t)] == now[g]


def test_quantiles(spark):
    import numpy as np

    rnd = random.Random(13)
    rows = [(g, rnd.choice([1.0, 2.0, rnd.random() * 100])) for g in range(3) for _ in range(500)]
    got = quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 0.05, 0.5, 0.95, 1.0]).collect()
    for r in got:
        want = np.percentile([v for g, v in rows if g == r.g], [0, 5, 50, 95, 100])
        assert list(r.q) == pytest.approx(list(want))


def test_numbering(spark):
    rnd = random.Random(15)
    rows = [(rnd.choice([1, 1, 1, rnd.randint(0, 99)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r.a, r.b): r.n for r in numbered_globally(df, ["a", "b"], "n").collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows), start=1)}


# ---- event operators against their definitions --------------------------


def sessions(ticks, gap):
    """Ticks in order, cut where more than ``gap`` ticks without any lie between two."""
    cuts = [0, *[k for k in range(1, len(ticks)) if ticks[k] - ticks[k - 1] > gap + 1], len(ticks)]
    return [ticks[a:b] for a, b in itertools.pairwise(cuts)]


def names_at(rnd, n):
    return [[x for x in ("stop", "keep_left", "u_turn") if rnd.random() < 0.3] for _ in range(n)]


@pytest.mark.parametrize("bucket", [16, 4096])
def test_confirm_events(spark, bucket):
    rnd = random.Random(17)
    ticks = names_at(rnd, 300)
    want = set()
    for name in ("stop", "keep_left", "u_turn"):
        for session in sessions([t for t, names in enumerate(ticks) if name in names], 4):
            want |= {(t, name) for t in session[2:3]}  # its third sighting
    df = spark.createDataFrame([("s", t, n) for t, names in enumerate(ticks) for n in names], "s string, t int, n string")
    got = {(r.t, r.n) for r in E.confirm_events(df, "s", "t", "n", 3, 4, bucket).collect()}
    assert got == want and want


@pytest.mark.parametrize("bucket", [16, 4096])
def test_vote(spark, bucket):
    rnd = random.Random(19)
    values = [rnd.choice([None, None, None, 30, 50, 80]) for _ in range(400)]
    want = set()
    for session in sessions([t for t, v in enumerate(values) if v is not None], 3):
        thirds = [[t for t in session if values[t] == v][2:3] for v in (30, 50, 80)]
        want |= {(t, values[t]) for t in sorted(sum(thirds, []))[:1]}  # the earliest third reading of a value
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(values)], "s string, t int, v int")
    got = {(r.t, r.v) for r in E.vote(df, "s", "t", "v", 3, 3, bucket).collect()}
    assert got == want and want


@pytest.mark.parametrize("bucket", [16, 4096])
def test_hysteresis(spark, bucket):
    rnd = random.Random(21)
    offsets = [rnd.choice([None, 0.1, 0.9, 0.9, -0.9, -0.9, 0.75]) for _ in range(400)]
    said = {}  # from the third tick of a run beyond the limit its side, from the second of a run within it none
    for beyond, run in itertools.groupby(enumerate(offsets), key=lambda x: x[1] is not None and abs(x[1]) >= 0.75):
        for t, o in list(run)[2 if beyond else 1 :]:
            said[t] = ("left" if o < 0 else "right") if beyond else "none"
    latest = [said.get(max((k for k in said if k <= t), default=-1), "none") for t in range(len(offsets))]
    want = [(t, side != "none", side) for t, side in enumerate(latest)]
    df = spark.createDataFrame([("s", t, o) for t, o in enumerate(offsets)], "s string, t int, o double")
    got = sorted((r.t, r.active, r.direction) for r in E.hysteresis(df, "s", "t", "o", 0.75, 3, 2, bucket=bucket).collect())
    assert got == want


@pytest.mark.parametrize("bucket", [16, 4096])
def test_one_per_tick(spark, bucket):
    rnd = random.Random(23)
    ticks = [(t, rnd.random() < 0.4) for t in range(300)]
    events = [(t, n) for t in range(300) for n in ("a", "b") if rnd.random() < 0.2]
    want, queue = set(), []
    for t, blocked in ticks:
        queue += [(n, t) for x, n in events if x == t]
        if not blocked and queue:
            want.add((t, *queue.pop(0)))
    e = spark.createDataFrame([("s", *x) for x in events], "s string, t int, n string")
    k = spark.createDataFrame([("s", *x) for x in ticks], "s string, t int, blocked boolean")
    got = {(r.t, r.n, r.since) for r in E.one_per_tick(e, k, "s", "t", "n", bucket).collect()}
    assert got == want


def test_smoothing(spark):
    rnd = random.Random(25)
    values = [rnd.random() * 50 for _ in range(200)]
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(values)], "s string, t int, v double")
    got = {r.t: r.smooth for r in E.smoothed(df, "s", "t", "v", bucket=16).collect()}
    s = 0.0
    for t, v in enumerate(values):
        s = 0.9 * s + 0.1 * v
        assert got[t] == pytest.approx(s)


def test_merge_tracks_to_a_fixed_point(spark):
    def det(track, frame, x, size):
        return (0, track, frame, x, 0.0, x + size, size, size, 0, 0.9)

    rows = [det(1, f, 0.0 + f, 20.0 + f) for f in range(5)]
    rows += [det(2, f, 0.0 + f, 22.0 + f) for f in range(7, 12)]  # handed over from 1
    rows += [det(3, f, 0.0 + f, 30.0 + f) for f in range(20, 24)]  # handed over from 2
    rows += [det(4, f, 1.0 + f, 20.0 + f) for f in range(5)]  # the same sign as 1 at the same time
    rows += [det(9, f, 500.0, 20.0) for f in range(5)]
    df = spark.createDataFrame(rows, "clip int, track int, frame int, x1 double, y1 double, x2 double, y2 double, size double, cls int, conf double")
    got = {(r.track, r.n) for r in T.merge_tracks(df).groupBy("track").agg(F.count("*").alias("n")).collect()}
    assert got == {(3, 14), (9, 5)}


def test_clips_merged_by_a_task_and_in_rounds(spark, monkeypatch):
    """Clips of ordinary size need no rounds of the driver, and come out as they do from rounds over all clips."""
    rnd = random.Random(31)
    rows = []
    for clip in (0, 1, None):
        for track in range(9):
            x, start = rnd.choice([0.0, 10.0, 60.0]), rnd.randint(0, 20)
            rows += [(clip, track, start + k, x + k, 0.0, x + k + 20 + rnd.randint(0, 6), 20.0 + rnd.randint(0, 3), 20.0 + rnd.randint(0, 9), None if k else 2**60 + track) for k in range(rnd.randint(1, 6))]
    df = spark.createDataFrame(rows, "clip int, track int, frame int, x1 double, y1 double, x2 double, y2 double, size double, note bigint")
    named = df.filter("clip IS NOT NULL")
    rounds = sorted(map(tuple, T._merged_in_rounds(T.one_per_frame(named, ["clip", "track"])).collect()), key=repr)
    assert 2 < len({r[:2] for r in rounds}) < 18
    assert sorted(map(tuple, T.merge_tracks(df).filter("clip IS NOT NULL").collect()), key=repr) == rounds
    assert T.merge_tracks(df).filter("clip IS NULL").count() == len([r for r in rows if r[0] is None])
    monkeypatch.setattr(T, "_merged_in_rounds", None)
    assert sorted(map(tuple, T.merge_tracks(named).collect()), key=repr) == rounds


def test_boxes_of_a_frame_are_numbered_in_one_window(spark):
    rng = random.Random(8)
    sizes = {"a": 3, None: 4, "full": 60}
    rows = [(f, float(rng.randrange(90)), float(i)) for f, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "f string, x double, y double")
    want = {r: sum(o < r[1:] for g, *xy in rows if g == r[0] for o in [tuple(xy)]) for r in rows}
    plain, cut = box_numbers(df, "f", ["x", "y"]), box_numbers(df, "f", ["x", "y"], crowded=10)
    for got in (plain, cut):
        assert {(r.f, r.x, r.y): r.box_no for r in got.collect()} == want
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "Join" not in plan


def test_formats_of_small_keys_are_compared_in_one_shuffle(spark):
    rng = random.Random(9)
    box = lambda f: (f, rng.randrange(2), *(rng.randrange(4) / 4 for _ in range(4)))
    left = [box(f) for f in range(12) for _ in range(f)] + [box(None), (12, None, 0.0, 0.0, 0.0, 0.0)]
    right = [(f, c + (rng.random() < 0.1) if c is not None else c, x + (rng.random() < 0.1) * 0.01, *rest) for f, c, x, *rest in left if f != 3 or rng.random() < 0.5]
    a, b = (spark.createDataFrame(rows, "f int, cls int, xc double, yc double, w double, h double") for rows in (left, right))
    got = [sorted(A.compare_formats(a, b, "f", crowded=n).collect(), key=str) for n in (10_000, 5, 0)]
    assert got[0] == got[1] == got[2] and {r.what for r in got[0]} == {"count", "class", "geom"}
    plan = A.compare_formats(a.filter("f IS NOT NULL"), b.filter("f IS NOT NULL"), "f")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_no_grid_where_no_frame_is_crowded(spark):
    rows = [(f, i, float(i), float(i), i + 3.0, i + 3.0) for f in range(3) for i in range(8)]
    df = spark.createDataFrame(rows, "f int, i int, x1 double, y1 double, x2 double, y2 double")
    joins = {n: V.overlapping(df, df, ["f"], 0.3, crowded=n)._jdf.queryExecution().optimizedPlan().toString().count("Join") for n in (64, 4)}
    assert joins[64] == 1 < joins[4]
