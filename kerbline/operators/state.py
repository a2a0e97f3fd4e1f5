"""Last-known vehicle state from partial messages, its staleness, and one alert.

Message columns are those of ``sources.contract.MESSAGE`` flattened by
``flat_fields``: null means the message did not carry the key. Times are
timestamps; ages are seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import fold_states, scan, time_bucket

SPEED_STALE = 3.0
ADAS_STALE = 3.0
SIGN_SHOW = 8.0
MARGIN = 2.0

# Keys that prove the assistance system is alive.
ADAS_FIELDS = (
    "lane_warning", "lane_direction", "lane_confidence", "fcw_warning", "fcw_ttc", "lead_vehicle",
    "speed_limit", "sign_seen", "module_lane", "module_fcw", "module_signs", "module_status_sent",
    "system_fault",
)
KEPT_FIELDS = (
    "speed", "lane_warning", "lane_direction", "fcw_warning", "fcw_ttc", "lead_vehicle",
    "module_lane", "module_fcw", "module_signs", "system_fault",
)
FEATURES = ("lane", "fcw", "signs")
HIDEABLE = ("lane_right", "lane_left", "overspeed", "sign")


def _present(df: DataFrame, fields: tuple[str, ...]) -> list[str]:
    return [f for f in fields if f in df.columns]


def fold_state(
    messages: DataFrame, stream: str, ts: str, order: list[str], bucket: Column | None = None
) -> DataFrame:
    """Last-known state after each message.

    Each field keeps its last value. The limit is rounded and never expires. An
    empty ``sign_seen`` proves liveness but shows no sign. ``speed_at``, ``sign_at``
    and ``adas_at`` tell when those last arrived. ``order`` starts with ``ts`` and is
    total; rows without any field (probes) only read the state.
    """
    seconds = F.col(ts)
    steps: dict[str, tuple[str, Column]] = {
        f"last_{f}": ("latest", F.col(f)) for f in _present(messages, KEPT_FIELDS)
    }
    if "speed" in messages.columns:
        steps["speed_at"] = ("latest", F.when(F.col("speed").isNotNull(), seconds))
    if "speed_limit" in messages.columns:
        steps["last_speed_limit"] = ("latest", F.round("speed_limit").cast("int"))
    if "sign_seen" in messages.columns:
        shown = F.col("sign_seen") != ""
        steps["last_sign_seen"] = ("latest", F.when(shown, F.col("sign_seen")))
        steps["sign_at"] = ("latest", F.when(shown, seconds))
    alive = F.lit(False)
    for f in _present(messages, ADAS_FIELDS):
        alive = alive | F.col(f).isNotNull()
    steps["adas_at"] = ("latest", F.when(alive, seconds))
    return scan(messages, [stream], order, time_bucket(ts) if bucket is None else bucket, steps)


def feature_gates(
    ticks: DataFrame, control: DataFrame, stream: str, ts: str, order: list[str], features: tuple[str, ...] = FEATURES
) -> DataFrame:
    """Add ``<feature>_on``: the latest choice at or before each tick, on by default.

    ``control`` is ``(stream, ts, <feature>...)``, null where a message does not name
    the feature. At equal times control comes first.
    """
    columns = ticks.columns
    rows = ticks.withColumn("__kind", F.lit(1)).unionByName(
        control.withColumn("__kind", F.lit(0)), allowMissingColumns=True
    )
    full = [ts, "__kind", *[o for o in order if o != ts]]
    done = scan(rows, [stream], full, time_bucket(ts), {
        f"{f}_on": ("latest", F.col(f)) for f in features
    })
    return done.filter(F.col("__kind") == 1).select(
        *columns, *[F.coalesce(f"{f}_on", F.lit(True)).alias(f"{f}_on") for f in features]
    )


def probes(messages: DataFrame, stream: str, ts: str, every: float) -> DataFrame:
    """``(stream, ts)`` rows at a fixed period from a stream's first to its last message.

    They are made per stream and day, so one long stream is spread over its days.
    """
    span = messages.groupBy(stream).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    days = span.select(
        stream, "a", "b", F.explode(F.sequence(F.to_date("a"), F.to_date("b"))).alias("day")
    )
    begin = F.unix_micros(F.col("day").cast("timestamp"))
    period = int(every * 1_000_000)
    a, b = F.unix_micros("a"), F.unix_micros("b")
    low = F.greatest(F.ceil(begin / period), F.ceil(a / period))
    high = F.least(F.ceil((begin + 86_400_000_000) / period) - 1, F.floor(b / period))
    steps = days.filter(low <= high).select(stream, F.explode(F.sequence(low, high)).alias("k"))
    return steps.select(stream, F.timestamp_micros(F.col("k") * period).alias(ts))


def _age(ts: str, at: str) -> Column:
    return (F.unix_micros(F.col(ts)) - F.unix_micros(F.col(at))) / 1e6


def _column(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def alerts(
    state: DataFrame,
    ts: str,
    speed_stale: float = SPEED_STALE,
    adas_stale: float = ADAS_STALE,
    show: float = SIGN_SHOW,
    margin: float = MARGIN,
) -> DataFrame:
    """Add liveness, freshness, over-the-limit, the active alerts in order, and the first of them.

    ``active`` lists every alert that is true, highest first: collision, offline,
    fault, lane (right if so told, else left), overspeed, sign. A feature that is
    switched off shows nothing and its limit reads 0.
    """
    def fresh(at: str, limit: float) -> Column:
        return F.coalesce(_age(ts, at) < limit, F.lit(False)) if at in state.columns else F.lit(False)

    on = {f: _column(state, f"{f}_on", True) for f in FEATURES}
    base = state.withColumns({
        "online": fresh("adas_at", adas_stale),
        "has_speed": fresh("speed_at", speed_stale),
        "sign_fresh": fresh("sign_at", show) & on["signs"],
        "limit": F.when(on["signs"], _column(state, "last_speed_limit", 0)).otherwise(F.lit(0)),
    })
    online = F.col("online")
    over = F.col("has_speed") & (F.col("limit") > 0) & (_column(state, "last_speed", 0.0) > F.col("limit") + margin)
    lane = _column(state, "last_lane_warning", False) & online & on["lane"]
    side = F.when(_column(state, "last_lane_direction", "none") == "right", F.lit("lane_right")).otherwise(F.lit("lane_left"))
    chain = [
        (_column(state, "last_fcw_warning", False) & online & on["fcw"], F.lit("fcw")),
        (~online, F.lit("adas_offline")),
        (online & (_column(state, "last_system_fault", "") != ""), F.lit("fault")),
        (lane, side),
        (F.col("overspeed"), F.lit("overspeed")),
        (F.col("sign_fresh"), F.lit("sign")),
    ]
    full = base.withColumn("overspeed", over)
    active = F.array_compact(F.array(*(F.when(test, reason) for test, reason in chain)))
    return full.withColumn("active", active).withColumn(
        "reason", F.coalesce(F.get("active", F.lit(0)), F.lit("none"))
    ).withColumn("level", level_of(F.col("reason")))


def level_of(reason: Column) -> Column:
    return (
        F.when(reason == "fcw", F.lit("warning"))
        .when(reason.isin("adas_offline", "fault"), F.lit("system"))
        .when(reason.isin("lane_right", "lane_left", "overspeed"), F.lit("caution"))
        .when(reason == "sign", F.lit("info"))
        .otherwise(F.lit("none"))
    )


def _first_shown(active: Column, hidden: Column) -> Column:
    return F.coalesce(F.get(F.filter(active, lambda a: a != hidden), F.lit(0)), F.lit("none"))


def acknowledged(
    alerted: DataFrame, stream: str, order: list[str], bucket: Column, press: str = "press"
) -> DataFrame:
    """What is shown when presses hide alerts: ``(stream, order, active, press, hidden, reason, level)``.

    A press hides the caution or info shown at that moment until it clears;
    warnings and system alerts stay. ``press`` is a boolean column of the rows. The
    rows of a stream and bucket are folded together: a minute is a good bucket for
    messages at 100 a second.
    """
    def step(hidden: Column, row: Column) -> Column:
        still = F.when(F.array_contains(row["active"], hidden), hidden).otherwise(F.lit(""))
        shown = _first_shown(row["active"], still)
        return F.when(row[press] & shown.isin(*HIDEABLE), shown).otherwise(still)

    done = fold_states(
        alerted.withColumn(press, F.coalesce(press, F.lit(False))),
        [stream], order, bucket, ["", *HIDEABLE], step, ["active", press], "hidden",
    )
    reason = _first_shown(F.col("active"), F.col("hidden"))
    return done.withColumn("reason", reason).withColumn("level", level_of(F.col("reason")))


def module_state(raw: Column, enabled: Column, online: Column) -> Column:
    """What a module shows: off if switched off, paused without data, else on or paused as sent."""
    return (
        F.when(~enabled, F.lit("off"))
        .when(~online, F.lit("paused"))
        .when(raw.isin("on", "paused"), raw)
        .otherwise(F.lit("off"))
    )


def control_events(messages: DataFrame, stream: str, ts: str) -> DataFrame:
    """``(stream, ts, input)``: one-shot driver inputs, to be applied after the state they came with."""
    return messages.filter(F.col("input").isNotNull()).select(stream, ts, "input")
