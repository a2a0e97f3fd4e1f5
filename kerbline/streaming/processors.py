"""Stateful stream forms of the event and state operators.

Each is keyed by ``stream_id`` and works in event time: rows wait in state until
the watermark has passed them and are then applied in order, so any cut into
micro-batches gives the rows of the batch form. Rows that come later than the
watermark are dropped by Spark before a processor sees them; ``LateRows``, added
to the session's listeners, counts them for each query. The ``late`` of an output
row counts what came in time but behind rows already given out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.taxonomy import NEVER_PUBLISHED
from ..operators.state import ADAS_STALE, HIDEABLE, KEPT_FIELDS, MARGIN, SIGN_SHOW, SPEED_STALE
from ..sources.contract import parse_messages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows that one value of the state holds.
PACKED = 4096


class LateRows(StreamingQueryListener):
    """Rows of each streaming query that came behind its watermark: ``counts`` by the query's id."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.counts.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        dropped = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        self.counts[str(event.progress.id)] = self.counts.get(str(event.progress.id), 0) + dropped

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Nothing was read, so nothing was late."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """The counts stay."""


class _InOrder(StatefulProcessor):
    """Holds rows until the watermark passes them; subclasses apply them in order.

    A stream's state is one list of JSON texts, since each value and each call of a state costs far more than its bytes.
    The first holds the time of the last row given out, the late rows and what the subclass has in ``known``; every
    further one up to ``PACKED`` waiting rows.
    """

    fields = ""
    output = ""
    order: tuple[str, ...] = ("ts_ms",)
    known: Any = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("state", "part string")
        self.names, kinds = zip(*(f.strip().split(" ") for f in self.fields.split(",")), strict=True)
        # A column with gaps comes as floats: give every value its declared kind back.
        self.kinds = [{"int": int, "bigint": int, "double": float, "boolean": bool}.get(k, str) for k in kinds]
        self.columns = [f.strip().split(" ")[0] for f in self.output.split(",")]

    def apply(self, rows: list[dict], late: int) -> list[tuple]:
        raise NotImplementedError

    def _visit(self, key, came: list[dict], watermark: int) -> Iterator[pd.DataFrame]:
        self.key = None if key[0] is None else str(key[0])
        before = [r[0] for r in self.state.get()]
        self.done, self.late, self.known = json.loads(before[0]) if before else (-1, 0, None)
        held = [self._named(row) for part in before[1:] for row in json.loads(part)]
        out, rest = self._release(held + came, watermark)
        if rest:
            self.handle.registerTimer(min(r["ts_ms"] for r in rest))
        waiting = [[r[n] for n in self.names] for r in rest]
        parts = [[self.done, self.late, self.known], *(waiting[i : i + PACKED] for i in range(0, len(waiting), PACKED))]
        after = [json.dumps(part) for part in parts]
        if after != before:
            self.state.put([(part,) for part in after])
        if out:
            values = {n: list(v) for n, v in zip(self.columns, zip(*out, strict=True), strict=True)}
            yield pd.DataFrame({n: pd.Series(v, dtype=object) if None in v else v for n, v in values.items()})

    def _release(self, held: list[dict], watermark: int) -> tuple[list[tuple], list[dict]]:
        """What is given out, and the rows that wait on."""
        fresh = [r for r in held if r["ts_ms"] > self.done]
        self.late += len(held) - len(fresh)
        ready = sorted((r for r in fresh if r["ts_ms"] <= watermark), key=lambda r: tuple(r[c] for c in self.order))
        out = self.apply(ready, self.late) if ready else []
        self.done = max([self.done, *[r["ts_ms"] for r in ready]])
        return out, [r for r in fresh if r["ts_ms"] > watermark]

    def _named(self, row) -> dict:
        return dict(zip(self.names, row, strict=True))

    def _typed(self, batch: pd.DataFrame) -> Iterator[dict]:
        """Rows with plain values, and None for pandas' marks of absence."""
        columns = (
            [None if v is None or v != v else kind(v) for v in batch[n].tolist()]
            for n, kind in zip(self.names, self.kinds, strict=True)
        )
        return map(self._named, zip(*columns, strict=True))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        came = [r for batch in rows for r in self._typed(batch)]
        yield from self._visit(key, came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._visit(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


class SignStage(_InOrder):
    """Confirmed signs and settled limits, at most one announcement a tick, one row per tick.

    Input has one row per detection, and one with a null name for a tick without any.
    """

    fields = "ts_ms bigint, tick bigint, name string, px double, reading int, conf double"
    output = "stream_id string, tick bigint, sign_seen string, speed_limit int, late bigint"
    order = ("tick",)

    def __init__(self, confirm: int = 3, min_votes: int = 3, gap: int = 12, number_class: str = "speed_limit",
                 min_width: float = 32, min_confidence: float = 0.60,
                 settle: Callable[[dict[int, int]], int | None] | None = None) -> None:
        """``settle`` may replace the vote: it gets the readings of a session with their numbers and says which one
        they settle on, or None while they do not. By default the one that is read ``min_votes`` times."""
        self.settle = settle or (lambda votes: next((v for v, n in votes.items() if n >= min_votes), None))
        self.confirm, self.min_votes, self.gap = confirm, min_votes, gap
        self.number_class, self.min_width, self.min_confidence = number_class, min_width, min_confidence

    def apply(self, rows, late):
        sighted, voted, last_read, settled, queue = self.known or ([], [], None, False, [])
        sightings = {name: (tick, hits) for name, tick, hits in sighted}
        votes = dict(voted)
        out = []
        by_tick: dict[int, list[dict]] = {}
        for row in rows:
            by_tick.setdefault(row["tick"], []).append(row)
        for tick, seen in by_tick.items():
            shown = [r for r in seen if r["name"] and r["name"] not in NEVER_PUBLISHED]
            for name in sorted({r["name"] for r in shown}):
                before, hits = sightings.get(name, (None, 0))
                hits = 1 if before is None or tick - before > self.gap + 1 else hits + 1
                sightings[name] = (tick, hits)
                if hits == self.confirm:
                    queue.append(name)
            value = self._reading([r for r in shown if r["name"] == self.number_class])
            number = None
            if value is not None:
                if last_read is None or tick - last_read > self.gap + 1:
                    votes, settled = {}, False
                last_read = tick
                votes[value] = votes.get(value, 0) + 1
                number = None if settled else self.settle(votes)
                settled = settled or number is not None
            said = self.number_class if number is not None else queue.pop(0) if queue else None
            out.append((self.key, tick, said, number, late))
            # Sightings too old to be continued need no state.
            sightings = {n: s for n, s in sightings.items() if tick - s[0] <= self.gap}
        self.known = [[(n, *s) for n, s in sightings.items()], list(votes.items()), last_read, settled, queue]
        return out

    def _reading(self, plates):
        """The gated reading of the widest box (equal widths: the smallest reading)."""
        if not plates:
            return None
        widest = max(plates, key=lambda r: (r["px"], -(r["reading"] if r["reading"] is not None else 0)))
        wide = widest["px"] >= self.min_width and (widest["conf"] or 0.0) >= self.min_confidence
        return widest["reading"] if wide else None


class LaneDeparture(_InOrder):
    """Warning on and off with hysteresis, one row per tick."""

    fields = "ts_ms bigint, tick bigint, off double, conf double"
    output = "stream_id string, tick bigint, active boolean, direction string, confidence double, late bigint"
    order = ("tick",)

    def __init__(self, threshold: float = 0.75, up: int = 3, down: int = 5) -> None:
        self.threshold, self.up, self.down = threshold, up, down

    def apply(self, rows, late):
        drifting, length, direction = self.known or (False, 0, "none")
        out = []
        for row in rows:
            now = row["off"] is not None and abs(row["off"]) >= self.threshold
            length = length + 1 if now == drifting else 1
            drifting = now
            if length >= (self.up if now else self.down):
                direction = ("left" if row["off"] < 0 else "right") if now else "none"
            active = direction != "none"
            confidence = round(1.0 if row["conf"] is None else row["conf"], 2) if active else 0.0
            out.append((self.key, row["tick"], active, direction, confidence, late))
        self.known = [drifting, length, direction]
        return out


STATE_FIELDS = (
    "speed double, lane_warning boolean, lane_direction string, fcw_warning boolean, fcw_ttc double, "
    "lead_vehicle boolean, module_lane string, module_fcw string, module_signs string, system_fault string"
)
#: What is known of a vehicle: the fields as last sent, when, and which features are on.
KNOWN = (
    *(f.strip().split(" ")[0] for f in STATE_FIELDS.split(",")),
    "limit", "sign", "speed_at", "adas_at", "sign_at", "hidden", "on_lane", "on_fcw", "on_signs",
)
LIVE = ("lane_warning", "lane_direction", "lane_confidence", "fcw_warning", "fcw_ttc", "lead_vehicle", "speed_limit",
        "sign_seen", "module_status_sent", "system_fault")


class VehicleState(_InOrder):
    """Last-known state and the one alert: a row per message, and one when something goes stale.

    Feature choices (``enable_*``) and presses (``input``) come in the same stream.
    A press hides the caution or info shown until it clears.
    """

    fields = (
        "ts_ms bigint, msg_id bigint, " + STATE_FIELDS
        + ", lane_confidence double, speed_limit double, sign_seen string, module_status_sent boolean, input string, "
        "enable_lane boolean, enable_fcw boolean, enable_signs boolean"
    )
    output = (
        "stream_id string, ts_ms bigint, msg_id bigint, online boolean, has_speed boolean, limit int, "
        "overspeed boolean, reason string, level string, hidden string, late bigint"
    )
    order = ("ts_ms", "msg_id")

    def __init__(self, speed_stale: float = SPEED_STALE, adas_stale: float = ADAS_STALE, show: float = SIGN_SHOW,
                 margin: float = MARGIN) -> None:
        self.spans = {"speed_at": int(speed_stale * 1000), "adas_at": int(adas_stale * 1000), "sign_at": int(show * 1000)}
        self.margin = margin

    def apply(self, rows, late):
        s = self.known = self.known or dict.fromkeys(KNOWN)
        out, previous = [], None
        for row in rows:
            if previous is not None:
                out += self._expiries(s, previous, row["ts_ms"], late)
            self._fold(s, row)
            out.append(self._alert(s, row["ts_ms"], row["msg_id"], row["input"] == "press", late))
            previous = row["ts_ms"]
        return out

    def _release(self, held, watermark):
        """Expiries between the last applied row and the watermark come before the next rows."""
        until = min([watermark, *[r["ts_ms"] for r in held if r["ts_ms"] > self.done]])
        stale = self._expiries(self.known, self.done, until, self.late) if self.known else []
        if stale:
            self.done = max(self.done, stale[-1][1])
        out, rest = super()._release(held, watermark)
        if self.known:
            for name, span in self.spans.items():
                if self.known[name] is not None and self.known[name] + span > watermark:
                    self.handle.registerTimer(self.known[name] + span)
        return stale + out, rest

    def _expiries(self, s, after, until, late):
        """Rows at the moments in ``(after, until)`` when something goes stale; at ``until`` the message speaks."""
        times = sorted({s[n] + span for n, span in self.spans.items() if s[n] is not None and after < s[n] + span < until})
        return [self._alert(s, t, None, False, late) for t in times]

    def _fold(self, s, row):
        now = row["ts_ms"]
        for name in KEPT_FIELDS:
            if row[name] is not None:
                s[name] = row[name]
        if row["speed"] is not None:
            s["speed_at"] = now
        if row["speed_limit"] is not None:
            s["limit"] = int(row["speed_limit"] + 0.5)
        if row["sign_seen"]:
            s["sign"], s["sign_at"] = row["sign_seen"], now
        if any(row[name] is not None for name in LIVE):
            s["adas_at"] = now
        for feature in ("lane", "fcw", "signs"):
            if row[f"enable_{feature}"] is not None:
                s[f"on_{feature}"] = row[f"enable_{feature}"]

    def _alert(self, s, now, msg_id, press, late):
        fresh = {n: s[n] is not None and now - s[n] < span for n, span in self.spans.items()}
        on = {f: s[f"on_{f}"] is not False for f in ("lane", "fcw", "signs")}
        online, limit = fresh["adas_at"], (s["limit"] or 0) if on["signs"] else 0
        over = fresh["speed_at"] and limit > 0 and s["speed"] > limit + self.margin
        side = "lane_right" if s["lane_direction"] == "right" else "lane_left"
        tests = (
            ("fcw", "warning", s["fcw_warning"] and online and on["fcw"]),
            ("adas_offline", "system", not online),
            ("fault", "system", online and s["system_fault"]),
            (side, "caution", s["lane_warning"] and online and on["lane"]),
            ("overspeed", "caution", over),
            ("sign", "info", fresh["sign_at"] and on["signs"]),
        )
        active = [(reason, level) for reason, level, holds in tests if holds]
        hidden = s["hidden"] if s["hidden"] in [r for r, _ in active] else ""
        shown = next((a for a in active if a[0] != hidden), ("none", "none"))
        if press and shown[0] in HIDEABLE:
            hidden = shown[0]
            shown = next((a for a in active if a[0] != hidden), ("none", "none"))
        s["hidden"] = hidden
        return (self.key, now, msg_id, online, fresh["speed_at"], limit, bool(over), shown[0], shown[1], hidden, late)


def _run(df: DataFrame, processor: _InOrder, ts: str, delay: str) -> DataFrame:
    """The processor over a stream whose columns are those of ``processor.fields`` besides the time."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [f.strip().split(" ")[0] for f in processor.fields.split(",")]
    present = set(df.columns)
    typed = dict(f.strip().split(" ") for f in processor.fields.split(","))
    rows = df.withWatermark(ts, delay).withColumn("ts_ms", F.unix_millis(ts)).select(
        "stream_id", ts,
        *[(F.col(n) if n in present | {"ts_ms"} else F.lit(None)).cast(typed[n]).alias(n) for n in names],
    )
    return rows.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="EventTime"
    )


def sign_stage_stream(detections: DataFrame, ts: str = "ts", delay: str = "2 seconds", **settings) -> DataFrame:
    """Stream of ``(stream_id, ts, tick, name, px, reading, conf)`` to one row per tick."""
    return _run(detections, SignStage(**settings), ts, delay)


def hysteresis_stream(offsets: DataFrame, ts: str = "ts", delay: str = "2 seconds", **settings) -> DataFrame:
    """Stream of ``(stream_id, ts, tick, off[, conf])`` to lane warnings, one row per tick."""
    return _run(offsets, LaneDeparture(**settings), ts, delay)


def alerts_stream(messages: DataFrame, json: str = "json", ts: str = "ts", delay: str = "2 seconds", **settings) -> DataFrame:
    """Stream of ``(stream_id, ts, msg_id, json)`` to alerts, with the message contract applied."""
    return _run(parse_messages(messages, json), VehicleState(**settings), ts, delay)
