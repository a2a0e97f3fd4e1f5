"""Debounced events over ticks, as batch window forms.

A tick is the number of a frame in its stream; every stream has one row per tick
where an operator says so. Streams are cut into buckets of ticks (see
``ordered``), so one very long stream is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.taxonomy import publishable
from ..functions.text import gated_reading
from ..session import checkpointed, match
from .audit import widest_per_frame
from .ordered import NOWHERE, entries, restored, scan, solid, tick_bucket, with_halo

BUCKET = 4096


def confirm_events(
    df: DataFrame,
    stream: str,
    tick: str,
    name: str,
    confirm: int = 3,
    gap: int = 12,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(stream, tick, name)`` where a class has been seen ``confirm`` times in its session.

    A class counts once a tick. It fires once, and again only after it has been
    absent for more than ``gap`` ticks. A row is the ``confirm``-th of its session
    when as many rows chain up behind it and no more, so a look back of
    ``confirm`` gaps is enough.
    """
    reach = confirm * (gap + 1)
    seen = with_halo(df.select(stream, tick, name).distinct(), tick, bucket, reach)
    w = W.partitionBy(stream, name, "__bucket").orderBy(tick)
    chained = F.lit(True)
    for back in range(1, confirm):
        step = F.lag(tick, back - 1).over(w) - F.lag(tick, back).over(w)
        chained = chained & F.coalesce(step <= gap + 1, F.lit(False))
    opening = F.lag(tick, confirm - 1).over(w) - F.lag(tick, confirm).over(w)
    fires = chained & F.coalesce(opening > gap + 1, F.lit(True))
    return seen.withColumn("__fires", fires).filter("__own AND __fires").select(stream, tick, name)


def vote(
    df: DataFrame,
    stream: str,
    tick: str,
    value: str,
    min_votes: int = 3,
    gap: int = 12,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(stream, tick, value)`` where the first value of a session reaches ``min_votes``.

    One reading a tick; a null one counts as none. A session ends after more than
    ``gap`` ticks without a reading, and gives at most one value. Of each value only
    the first ``min_votes`` readings of a session and bucket are carried on.
    """
    read = with_halo(
        df.filter(F.col(value).isNotNull()).select(stream, tick, value), tick, bucket, gap + 1
    )
    near = F.lag(tick).over(W.partitionBy(stream, "__bucket").orderBy(tick))
    start = near.isNull() | (F.col(tick) - near > gap + 1)
    marked = read.withColumn("__start", start).filter("__own").drop("__own", "__bucket")
    placed = scan(marked, [stream], [tick], tick_bucket(tick, bucket), {
        "__session": ("highest", F.when(F.col("__start"), F.col(tick))),
    })
    part = placed.withColumn("__bucket", tick_bucket(tick, bucket))
    few = part.withColumn(
        "__k", F.row_number().over(W.partitionBy(stream, "__bucket", "__session", value).orderBy(tick))
    ).filter(F.col("__k") <= min_votes)
    votes = F.row_number().over(W.partitionBy(stream, "__session", value).orderBy(tick))
    return (
        few.withColumn("__votes", votes)
        .filter(F.col("__votes") == min_votes)
        .groupBy(stream, "__session")
        .agg(F.min(tick).alias(tick), F.min_by(value, tick).alias(value))
        .select(stream, tick, value)
    )


def hysteresis(
    df: DataFrame,
    stream: str,
    tick: str,
    offset: str,
    threshold: float = 0.75,
    up: int = 3,
    down: int = 5,
    confidence: Column | None = None,
    bucket: int = BUCKET,
) -> DataFrame:
    """``(stream, tick, active, direction, confidence)``, one row per tick.

    ``up`` ticks in a row at or over the threshold raise, ``down`` safe ones in a
    row clear; a null offset is safe. While raised, each further tick over the
    threshold that keeps the run sets the direction. Ticks follow each other by 1.
    """
    drift = F.coalesce(F.abs(F.col(offset)) >= threshold, F.lit(False))
    src = df.select(
        stream, tick, offset, drift.alias("__drift"), (F.lit(1.0) if confidence is None else confidence).alias("__conf")
    )
    cut = tick_bucket(tick, bucket)
    runs = with_halo(src, tick, bucket, max(up, down))
    w = W.partitionBy(stream, "__bucket").orderBy(tick)

    def run_of(test: Column, length: int) -> Column:
        last = w.rowsBetween(-(length - 1), 0)
        return (F.count("*").over(last) == length) & F.bool_and(test).over(last)

    over = run_of(F.col("__drift"), up)
    under = run_of(~F.col("__drift"), down)
    side = F.when(F.col(offset) < 0, F.lit("left")).otherwise(F.lit("right"))
    turned = runs.withColumn("__turn", F.when(over, side).when(under, F.lit("none"))).filter("__own")
    state = scan(turned.drop("__own", "__bucket"), [stream], [tick], cut, {
        "__state": ("latest", F.col("__turn")),
    })
    direction = F.coalesce("__state", F.lit("none"))
    active = direction != "none"
    return state.select(
        stream,
        tick,
        active.alias("active"),
        direction.alias("direction"),
        F.when(active, F.round("__conf", 2)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def one_per_tick(
    events: DataFrame,
    ticks: DataFrame,
    stream: str,
    tick: str,
    name: str,
    bucket: int = BUCKET,
) -> DataFrame:
    """Events through a queue that gives out one a tick: ``(stream, tick, name, since)``.

    ``ticks`` is ``(stream, tick, blocked)`` with every tick; a blocked one gives out
    nothing. An event goes out at its own tick (``since``) or the first later one
    that is free; events of a tick queue by name. Those still waiting when the
    ticks end do not come out.
    """
    cut = tick_bucket(tick, bucket)
    open_ = (~F.col("blocked")).cast("bigint")
    free = scan(ticks.select(stream, tick, "blocked"), [stream], [tick], cut, {"__free": ("total", open_)})
    first_free = free.select(
        stream, tick, (F.col("__free") - F.when(F.col("blocked"), F.lit(0)).otherwise(F.lit(1)) + 1).alias("__rank")
    )
    queued = match(events.select(stream, tick, name), first_free, [stream, tick]).withColumn("__bucket", cut)
    keys = [stream, "__bucket"]
    here = W.partitionBy(*keys).orderBy(tick, name)
    rows = queued.withColumn("__j", F.row_number().over(here).cast("bigint")).withColumn(
        "__m", F.max(F.col("__rank") - F.col("__j")).over(here.rowsBetween(W.unboundedPreceding, 0))
    )
    # A bucket is known to later ones by its number of events and its largest lead.
    before = W.partitionBy(stream).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("__c"), F.max("__m").alias("__lead"))
        .withColumn("__i0", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        .withColumn("__lead", F.col("__lead") - F.col("__i0"))
        .withColumn("__carry", F.max("__lead").over(before))
        .select(*keys, "__i0", "__carry")
    )
    i = F.col("__i0") + F.col("__j")
    lead = F.greatest("__carry", F.col("__m") - F.col("__i0"))
    placed = match(rows, ends, keys).withColumn("__slot", i + lead)
    slots = free.filter(~F.col("blocked")).select(
        stream, F.col(tick).alias("__out"), F.col("__free").alias("__slot")
    )
    return (
        match(placed.select(stream, tick, name, "__slot"), slots, [stream, "__slot"])
        .select(stream, F.col("__out").alias(tick), name, F.col(tick).alias("since"))
    )


def sign_stage(
    detections: DataFrame,
    ticks: DataFrame,
    stream: str = "stream_id",
    tick: str = "tick",
    confirm: int = 3,
    min_votes: int = 3,
    gap: int = 12,
    number_class: str = "speed_limit",
    bucket: int = BUCKET,
) -> DataFrame:
    """The whole stage: ``(stream, tick, sign_seen, speed_limit)``, at most one a tick.

    ``detections`` is ``(stream, tick, name, x1, y1, x2, y2, reading, conf)``; ``ticks``
    lists every tick. Catch-alls are ignored. Of the number class the widest box is
    read, through the two gates. A tick whose vote settles announces the number and
    holds the queue of confirmed signs.
    """
    shown = detections.filter(publishable(F.col("name")))
    # Confirmed signs and settled votes are few beside the ticks: kept once, used often.
    confirmed = checkpointed(confirm_events(shown, stream, tick, "name", confirm, gap, bucket))
    nearest = widest_per_frame(shown.filter(F.col("name") == number_class), [stream, tick])
    readings = nearest.select(
        stream,
        tick,
        gated_reading(F.col("reading"), F.col("conf"), F.col("x2") - F.col("x1"))["value"].alias("value"),
    )
    settled = checkpointed(vote(readings, stream, tick, "value", min_votes, gap, bucket))
    marked = match(
        ticks.select(stream, tick), settled.select(stream, tick, F.lit(True).alias("blocked")), [stream, tick], "left"
    ).withColumn("blocked", F.coalesce("blocked", F.lit(False)))
    queue = one_per_tick(confirmed, marked, stream, tick, "name", bucket)
    return queue.select(
        stream, tick, F.col("name").alias("sign_seen"), F.lit(None).cast("int").alias("speed_limit")
    ).unionByName(
        settled.select(stream, tick, F.lit(number_class).alias("sign_seen"), F.col("value").alias("speed_limit"))
    )


def heartbeat(ticks: DataFrame, announced: DataFrame, stream: str, tick: str, status: dict[str, Column]) -> DataFrame:
    """One row per tick with the module states, whether or not something was announced."""
    return ticks.join(announced, [stream, tick], "left").withColumns(status)


def shed_late(frames: DataFrame, stream: str, due: Column, arrival: Column, fps: float) -> tuple[DataFrame, DataFrame]:
    """``(frames in time, dropped per stream)``: later than one frame period is dropped."""
    late = (arrival - due) > 1.0 / fps
    return (
        frames.filter(~late),
        frames.groupBy(stream).agg(F.count_if(late).alias("dropped"), F.count("*").alias("frames")),
    )


def smoothed(
    df: DataFrame, stream: str, tick: str, value: str, keep: float = 0.9, bucket: int = 512, name: str = "smooth"
) -> DataFrame:
    """Exponential smoothing ``s = keep * s + (1 - keep) * value`` from 0, on every row.

    A bucket multiplies what enters it by ``keep`` to the number of its rows and adds
    its own part, so buckets are composed by those two numbers alone (``entries``).
    """
    slot = "__slot"
    rows, keys = solid(df.withColumn(slot, F.coalesce(tick_bucket(tick, bucket).cast("bigint"), F.lit(NOWHERE))), [stream])
    grouped = rows.groupBy(*keys, slot).agg(
        F.sort_array(F.collect_list(F.struct(F.col(tick).alias("t"), F.col(value).cast("double").alias("v")))).alias("__r")
    )

    def step(s: Column, v: Column) -> Column:
        return s * keep + v * (1 - keep)

    own = F.reduce("__r", F.lit(0.0), lambda s, r: step(s, r["v"]))
    does = F.struct(F.pow(F.lit(keep), F.size("__r")).alias("mul"), own.alias("add"))
    entry = entries(
        grouped.select(*keys, slot, does.alias("__does")),
        keys,
        slot,
        "__does",
        lambda first, second: F.struct((first["mul"] * second["mul"]).alias("mul"), (first["add"] * second["mul"] + second["add"]).alias("add")),
        lambda s, link: s * link["mul"] + link["add"],
        F.lit(0.0),
    )
    replay = F.reduce(
        "__r",
        F.struct(F.col("__entry").alias("s"), F.array().cast("array<double>").alias("out")),
        lambda a, r: F.struct(
            step(a["s"], r["v"]).alias("s"), F.array_append(a["out"], step(a["s"], r["v"])).alias("out")
        ),
        lambda a: a["out"],
    )
    done = grouped.join(entry, [*keys, slot]).select(*keys, F.explode(F.arrays_zip(F.col("__r").alias("r"), replay.alias("s"))).alias("z"))
    return done.select(*restored([stream]), F.col("z.r.t").alias(tick), F.col("z.r.v").alias(value), F.col("z.s").alias(name))
