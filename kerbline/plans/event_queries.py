"""Events and vehicle state over the derived ticks and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import state as S
from ..operators.ordered import time_bucket
from ..session import shared_folder, values
from ..sources.contract import parse_messages
from ..streaming.processors import sign_stage_stream
from . import views as V
from .registry import query

CONFIRM = """seen AS (SELECT DISTINCT stream_id, tick, name FROM ticks),
st AS (SELECT *, tick - lag(tick) OVER w > 5 OR lag(tick) OVER w IS NULL AS brk FROM seen WINDOW w AS (PARTITION BY stream_id, name ORDER BY tick)),
se AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, name ORDER BY tick) AS s FROM st),
ev AS (SELECT stream_id, tick, name FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, name, s ORDER BY tick) AS rn FROM se) WHERE rn = 3)"""


def _confirmed(spark, folder):
    return E.confirm_events(V.ticks(spark, folder), "stream_id", "tick", "name", 3, 4)


@query("confirmed_events", "ticks", f"WITH {CONFIRM} SELECT * FROM ev")
def confirmed_events(spark, folder):
    return _confirmed(spark, folder)


VOTE = """rd AS (SELECT stream_id, tick, CAST(floor(value / 20) AS INT) AS v FROM ticks WHERE name <> 'error'),
vs AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY tick) AS s FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY stream_id ORDER BY tick) AS g FROM rd)),
vn AS (SELECT *, row_number() OVER (PARTITION BY stream_id, s, v ORDER BY tick) AS k FROM vs),
vt AS (SELECT stream_id, min(tick) AS tick, arg_min(v, tick) AS value FROM vn WHERE k = 3 GROUP BY stream_id, s)"""


def _readings(spark, folder):
    return V.ticks(spark, folder).select(
        "stream_id", "tick", F.when(F.col("name") != "error", F.floor(F.col("value") / 20).cast("int")).alias("v")
    )


@query("settled_votes", "ticks", f"WITH {VOTE} SELECT stream_id, tick, value AS v FROM vt")
def settled_votes(spark, folder):
    return E.vote(_readings(spark, folder), "stream_id", "tick", "v", 3, 1)


@query("lane_departure", "ticks", """
WITH d AS (SELECT stream_id, tick, off, coalesce(abs(off) >= 0.5::DOUBLE, false) AS dr FROM ticks),
r AS (SELECT *, tick - coalesce(max(CASE WHEN NOT dr THEN tick END) OVER w, 0) AS ov, tick - coalesce(max(CASE WHEN dr THEN tick END) OVER w, 0) AS un FROM d WINDOW w AS (PARTITION BY stream_id ORDER BY tick)),
t AS (SELECT *, CASE WHEN dr AND ov >= 2 THEN CASE WHEN off < 0 THEN 'left' ELSE 'right' END WHEN NOT dr AND un >= 2 THEN 'none' END AS turn FROM r),
s AS (SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY tick ROWS UNBOUNDED PRECEDING), 'none') AS direction FROM t)
SELECT stream_id, tick, direction <> 'none' AS active, direction, CASE WHEN direction <> 'none' THEN 1.0::DOUBLE ELSE 0.0 END AS confidence FROM s""")
def lane_departure(spark, folder):
    return E.hysteresis(V.ticks(spark, folder), "stream_id", "tick", "off", 0.5, 2, 2)


QUEUE = """tk AS (SELECT stream_id, tick, name = 'error' AS blocked FROM ticks),
fr AS (SELECT *, sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY tick) AS f FROM tk),
q AS (SELECT e.stream_id, e.tick, e.name, f.f - CASE WHEN blocked THEN 0 ELSE 1 END + 1 AS rk, row_number() OVER (PARTITION BY e.stream_id ORDER BY e.tick, e.name) AS i FROM ev e JOIN fr f USING (stream_id, tick)),
sl AS (SELECT *, i + max(rk - i) OVER (PARTITION BY stream_id ORDER BY i) AS slot FROM q)"""


@query("one_per_tick", "ticks", f"WITH {CONFIRM}, {QUEUE} SELECT s.stream_id, f.tick, s.name, s.tick AS since FROM sl s JOIN fr f ON f.stream_id = s.stream_id AND f.f = s.slot AND NOT f.blocked")
def one_per_tick(spark, folder):
    t = V.ticks(spark, folder).select("stream_id", "tick", (F.col("name") == "error").alias("blocked"))
    return E.one_per_tick(_confirmed(spark, folder), t, "stream_id", "tick", "name")


def _timed_detections(spark, folder):
    """Each event shows one sign; every other click also shows a number plate."""
    t = V.ticks(spark, folder)
    named = F.expr("CASE name WHEN 'view' THEN 'stop' WHEN 'click' THEN 'speed_limit' WHEN 'signup' THEN 'keep_left' WHEN 'purchase' THEN 'speed_limit' ELSE 'information' END")
    size = F.col("value") % 40 + 20
    return t.select(
        "stream_id", "ts", "tick", named.alias("name"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), size.alias("x2"), size.alias("y2"),
        (F.floor(F.col("value") / 30) * 10).cast("int").alias("reading"), ((F.col("event_id") % 10) / 10 + 0.05).alias("conf"),
    )


def _sign_detections(spark, folder):
    return _timed_detections(spark, folder).drop("ts")


@query("sign_stage", "ticks", """
WITH d AS (SELECT stream_id, tick, CASE name WHEN 'view' THEN 'stop' WHEN 'click' THEN 'speed_limit' WHEN 'signup' THEN 'keep_left' WHEN 'purchase' THEN 'speed_limit' ELSE 'information' END AS name,
  value % 40 + 20 AS px, CAST(floor(value / 30) * 10 AS INT) AS reading, (event_id % 10) / 10.0::DOUBLE + 0.05::DOUBLE AS conf FROM ticks),
st AS (SELECT *, tick - lag(tick) OVER w > 13 OR lag(tick) OVER w IS NULL AS brk FROM d WHERE name <> 'information' WINDOW w AS (PARTITION BY stream_id, name ORDER BY tick)),
se AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, name ORDER BY tick) AS s FROM st),
ev AS (SELECT stream_id, tick, name FROM (SELECT *, row_number() OVER (PARTITION BY stream_id, name, s ORDER BY tick) AS rn FROM se) WHERE rn = 3),
rd AS (SELECT stream_id, tick, reading AS v FROM d WHERE name = 'speed_limit' AND px >= 32 AND conf >= 0.6::DOUBLE),
vs AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 13 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY tick) AS s FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY stream_id ORDER BY tick) AS g FROM rd)),
vn AS (SELECT *, row_number() OVER (PARTITION BY stream_id, s, v ORDER BY tick) AS k FROM vs),
vt AS (SELECT stream_id, min(tick) AS tick, arg_min(v, tick) AS value FROM vn WHERE k = 3 GROUP BY stream_id, s),
tk AS (SELECT t.stream_id, t.tick, vt.tick IS NOT NULL AS blocked FROM ticks t LEFT JOIN vt USING (stream_id, tick)),
fr AS (SELECT *, sum(CASE WHEN blocked THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY tick) AS f FROM tk),
q AS (SELECT e.stream_id, e.tick, e.name, f.f - CASE WHEN blocked THEN 0 ELSE 1 END + 1 AS rk, row_number() OVER (PARTITION BY e.stream_id ORDER BY e.tick, e.name) AS i FROM ev e JOIN fr f USING (stream_id, tick)),
sl AS (SELECT *, i + max(rk - i) OVER (PARTITION BY stream_id ORDER BY i) AS slot FROM q)
SELECT s.stream_id, f.tick, s.name AS sign_seen, CAST(NULL AS INT) AS speed_limit FROM sl s JOIN fr f ON f.stream_id = s.stream_id AND f.f = s.slot AND NOT f.blocked
UNION ALL SELECT stream_id, tick, 'speed_limit', value FROM vt""")
def sign_stage(spark, folder):
    return E.sign_stage(_sign_detections(spark, folder), V.ticks(spark, folder).select("stream_id", "tick"))


def _first_read_twice(votes: dict[int, int]) -> int | None:
    return next((value for value, n in votes.items() if n == 2), None)


@query("replaced_vote", "ticks", """
WITH rd AS (SELECT stream_id, tick, CAST(floor(value / 30) * 10 AS INT) AS v FROM ticks
  WHERE name IN ('click', 'purchase') AND value % 40 + 20 >= 32 AND (event_id % 10) / 10.0::DOUBLE + 0.05::DOUBLE >= 0.6::DOUBLE),
vs AS (SELECT *, sum(CASE WHEN g IS NULL OR g > 13 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY tick) AS s FROM (SELECT *, tick - lag(tick) OVER (PARTITION BY stream_id ORDER BY tick) AS g FROM rd)),
vn AS (SELECT *, row_number() OVER (PARTITION BY stream_id, s, v ORDER BY tick) AS k FROM vs)
SELECT stream_id, min(tick) AS tick, arg_min(v, tick) AS speed_limit FROM vn WHERE k = 2 GROUP BY stream_id, s""")
def replaced_vote(spark, folder):
    """The sign stage as a stream with another vote plugged in: two readings settle a number."""
    out = shared_folder(spark, "signs")
    rows = _timed_detections(spark, folder).select(F.col("stream_id").cast("string").alias("stream_id"), "ts", "tick", "name", F.col("x2").alias("px"), "reading", "conf")
    # A far later row of no stream moves the watermark past all others.
    last = values(spark, [("end", "2100-01-01", 1)], "stream_id string, ts timestamp, tick bigint")
    rows.unionByName(last, allowMissingColumns=True).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{out}/in")
    said = sign_stage_stream(stream, delay="1 second", settle=_first_read_twice)
    run = said.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/progress").outputMode("append")
    run.trigger(availableNow=True).start().awaitTermination()
    numbers = spark.read.parquet(f"{out}/out").filter("speed_limit IS NOT NULL AND NOT stream_id <=> 'end'")
    return numbers.select(F.col("stream_id").cast("bigint").alias("stream_id"), "tick", "speed_limit")


@query("heartbeat", "ticks", f"""WITH {VOTE} SELECT t.stream_id, t.tick, vt.value AS v, CASE WHEN t.tick % 5 = 0 THEN 'off' ELSE 'on' END AS signs FROM ticks t LEFT JOIN vt USING (stream_id, tick)""")
def heartbeat(spark, folder):
    votes = E.vote(_readings(spark, folder), "stream_id", "tick", "v", 3, 1)
    return E.heartbeat(V.ticks(spark, folder).select("stream_id", "tick"), votes, "stream_id", "tick", {
        "signs": F.when(F.col("tick") % 5 == 0, F.lit("off")).otherwise(F.lit("on")),
    })


@query("shed_frames", "", """
SELECT user_id AS stream_id, count(*) FILTER (value / 1000.0::DOUBLE > 1 / 30.0::DOUBLE) AS dropped, count(*) AS frames FROM events GROUP BY 1""")
def shed_frames(spark, folder):
    e = V.table(spark, folder, "events").select(F.col("user_id").alias("stream_id"), "value")
    return E.shed_late(e, "stream_id", F.lit(0.0), F.col("value") / 1000, 30.0)[1]


@query("smoothed_rate", "ticks", """
WITH RECURSIVE s(stream_id, tick, value, smooth) AS (SELECT stream_id, tick, value, 0.1::DOUBLE * value FROM ticks WHERE tick = 1
 UNION ALL SELECT t.stream_id, t.tick, t.value, 0.9::DOUBLE * s.smooth + 0.1::DOUBLE * t.value FROM s JOIN ticks t ON t.stream_id = s.stream_id AND t.tick = s.tick + 1)
SELECT stream_id, tick, round(smooth + 1e-7, 4) AS smooth FROM s""")
def smoothed_rate(spark, folder):
    s = E.smoothed(V.ticks(spark, folder).select("stream_id", "tick", "value"), "stream_id", "tick", "value", bucket=16)
    return s.select("stream_id", "tick", F.round(F.col("smooth") + 1e-7, 4).alias("smooth"))


# Events of a user are hours apart, so staleness is given in hours here.
HOUR = 3600.0
SPANS = {"speed_stale": 9 * HOUR, "adas_stale": 9 * HOUR, "show": 20 * HOUR, "margin": 2.0}
ORDER = ["ts", "msg_id"]

MSG = """m AS (SELECT user_id AS stream_id, ts, event_id AS msg_id,
  CASE WHEN event_type = 'view' THEN round(value, 2) WHEN event_type = 'error' THEN -1.0::DOUBLE END AS speed,
  CASE WHEN event_type = 'click' THEN round(value, 2) END AS speed_limit,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'stop' END END AS sign_seen,
  CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'asleep' ELSE 'on' END END AS module_signs,
  CASE WHEN event_type = 'purchase' THEN value > 50 END AS lane_warning,
  CASE WHEN event_type = 'purchase' THEN ['left', 'right', 'none', 'up'][event_id % 4 + 1] END AS lane_direction,
  event_type IN ('click', 'signup', 'purchase') AS adas FROM events WHERE event_id % 50 NOT IN (7, 8)),
f AS (SELECT stream_id, ts, msg_id, last_value(speed IGNORE NULLS) OVER w AS sp, CAST(round(last_value(speed_limit IGNORE NULLS) OVER w) AS INT) AS li,
  last_value(CASE WHEN sign_seen <> '' THEN sign_seen END IGNORE NULLS) OVER w AS sg, last_value(module_signs IGNORE NULLS) OVER w AS ms,
  last_value(lane_warning IGNORE NULLS) OVER w AS lw, last_value(lane_direction IGNORE NULLS) OVER w AS ld,
  last_value(CASE WHEN speed IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS speed_at, last_value(CASE WHEN sign_seen <> '' THEN ts END IGNORE NULLS) OVER w AS sign_at,
  last_value(CASE WHEN adas THEN ts END IGNORE NULLS) OVER w AS adas_at FROM m WINDOW w AS (PARTITION BY stream_id ORDER BY ts, msg_id ROWS UNBOUNDED PRECEDING))"""


def _messages(spark, folder):
    return parse_messages(V.messages(spark, folder), "json").drop("json")


def _state(spark, folder):
    return S.fold_state(_messages(spark, folder), "stream_id", "ts", ORDER, time_bucket("ts", 86_400))


@query("last_known_state", "", f"WITH {MSG} SELECT stream_id, msg_id, sp AS speed, li AS speed_limit, sg AS sign_seen, ms AS module_signs, lw AS lane_warning, ld AS lane_direction FROM f")
def last_known_state(spark, folder):
    fields = ("speed", "speed_limit", "sign_seen", "module_signs", "lane_warning", "lane_direction")
    return _state(spark, folder).select("stream_id", "msg_id", *[F.col(f"last_{c}").alias(c) for c in fields])


@query("field_ages", "", f"""WITH {MSG} SELECT stream_id, msg_id, epoch_us(ts) - epoch_us(speed_at) AS speed_age, epoch_us(ts) - epoch_us(sign_at) AS sign_age, epoch_us(ts) - epoch_us(adas_at) AS adas_age FROM f""")
def field_ages(spark, folder):
    def age(at):
        return F.unix_micros("ts") - F.unix_micros(at)

    return _state(spark, folder).select(
        "stream_id", "msg_id", age("speed_at").alias("speed_age"), age("sign_at").alias("sign_age"), age("adas_at").alias("adas_age")
    )


def alert_sql(rows: str, extra: str = "") -> str:
    return f"""o AS (SELECT *, coalesce(epoch(ts) - epoch(adas_at) < 32400, false) AS online, coalesce(epoch(ts) - epoch(speed_at) < 32400, false) AS has_speed,
  coalesce(epoch(ts) - epoch(sign_at) < 72000, false) AND son AS sign_fresh, CASE WHEN son THEN coalesce(li, 0) ELSE 0 END AS lim FROM {rows}),
a AS (SELECT *, [x FOR x IN [CASE WHEN NOT online THEN 'adas_offline' END, CASE WHEN coalesce(lw, false) AND online AND lon THEN CASE WHEN ld = 'right' THEN 'lane_right' ELSE 'lane_left' END END,
  CASE WHEN has_speed AND lim > 0 AND coalesce(sp, 0) > lim + 2 THEN 'overspeed' END, CASE WHEN sign_fresh THEN 'sign' END] IF x IS NOT NULL] AS active FROM o),
al AS (SELECT *, coalesce(active[1], 'none') AS reason FROM a)"""


_LEVEL = "CASE WHEN reason = 'adas_offline' THEN 'system' WHEN reason IN ('lane_right', 'lane_left', 'overspeed') THEN 'caution' WHEN reason = 'sign' THEN 'info' ELSE 'none' END"


@query("alerts", "", f"WITH {MSG}, g AS (SELECT *, true AS son, true AS lon FROM f), {alert_sql('g')} SELECT stream_id, msg_id, reason, {_LEVEL} AS level, list_aggregate(active, 'string_agg', ',') AS active FROM al")
def alerts(spark, folder):
    a = S.alerts(_state(spark, folder), "ts", **SPANS)
    return a.select("stream_id", "msg_id", "reason", "level", F.when(F.size("active") > 0, F.array_join("active", ",")).alias("active"))


@query("stale_at_probes", "", f"""
WITH {MSG}, s AS (SELECT stream_id, min(ts) AS a, max(ts) AS b FROM m GROUP BY 1),
p AS (SELECT stream_id, make_timestamp(CAST(t AS BIGINT) * 21600000000) AS ts FROM (SELECT stream_id, unnest(range(CAST(ceil(epoch_us(a) / 21600000000) AS BIGINT), CAST(floor(epoch_us(b) / 21600000000) AS BIGINT) + 1)) AS t FROM s))
SELECT p.stream_id, CAST(epoch(p.ts) AS BIGINT) AS at, coalesce(epoch(p.ts) - epoch(f.adas_at) < 32400, false) AS online, coalesce(epoch(p.ts) - epoch(f.speed_at) < 32400, false) AS has_speed
FROM p ASOF LEFT JOIN (SELECT stream_id, ts, arg_max(adas_at, msg_id) AS adas_at, arg_max(speed_at, msg_id) AS speed_at FROM f GROUP BY 1, 2) f ON f.stream_id = p.stream_id AND f.ts <= p.ts""")
def stale_at_probes(spark, folder):
    m = _messages(spark, folder)
    grid = S.probes(m, "stream_id", "ts", 6 * HOUR).withColumns({"msg_id": F.lit(1 << 60), "probe": F.lit(True)})
    state = S.fold_state(m.unionByName(grid, allowMissingColumns=True), "stream_id", "ts", ORDER)
    keyed = S.alerts(state, "ts", **SPANS)
    # The fold keeps the input columns, so probe rows are told by their flag.
    return keyed.filter("probe").select(
        "stream_id", F.floor(F.unix_micros("ts") / 1_000_000).alias("at"), "online", "has_speed"
    )


GATES = """ctl AS (SELECT user_id AS stream_id, ts, event_id, CASE WHEN event_type IN ('error', 'click') THEN value > 40 END AS c_lane, CASE WHEN event_type IN ('view', 'purchase', 'signup') THEN value > 20 END AS c_signs FROM events),
gt AS (SELECT *, coalesce(last_value(c_lane IGNORE NULLS) OVER w, true) AS lon, coalesce(last_value(c_signs IGNORE NULLS) OVER w, true) AS son FROM
 (SELECT stream_id, ts, msg_id, 1 AS k, sp, li, lw, ld, speed_at, sign_at, adas_at, NULL AS c_lane, NULL AS c_signs FROM f UNION ALL SELECT stream_id, ts, event_id, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_lane, c_signs FROM ctl)
 WINDOW w AS (PARTITION BY stream_id ORDER BY ts, k, msg_id ROWS UNBOUNDED PRECEDING))"""


def _gated(spark, folder):
    e = V.timed_events(spark, folder)
    control = e.select(
        F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("msg_id"),
        F.when(F.col("event_type").isin("error", "click"), F.col("value") > 40).alias("lane"),
        F.when(F.col("event_type").isin("view", "purchase", "signup"), F.col("value") > 20).alias("signs"), F.lit(None).cast("boolean").alias("fcw"),
    )
    return S.feature_gates(_state(spark, folder), control, "stream_id", "ts", ORDER)


@query("feature_gates", "", f"WITH {MSG}, {GATES} SELECT stream_id, msg_id, lon AS lane_on, son AS signs_on FROM gt WHERE k = 1")
def feature_gates(spark, folder):
    return _gated(spark, folder).select("stream_id", "msg_id", "lane_on", "signs_on")


@query("gated_alerts", "", f"WITH {MSG}, {GATES}, g AS (SELECT * FROM gt WHERE k = 1), {alert_sql('g')} SELECT stream_id, msg_id, reason, lim AS \"limit\" FROM al")
def gated_alerts(spark, folder):
    return S.alerts(_gated(spark, folder), "ts", **SPANS).select("stream_id", "msg_id", "reason", "limit")


@query("overspeed", "", f"WITH {MSG}, g AS (SELECT *, true AS son, true AS lon FROM f), {alert_sql('g')} SELECT stream_id, msg_id, sp AS speed, lim AS \"limit\" FROM al WHERE has_speed AND lim > 0 AND sp > lim + 2")
def overspeed(spark, folder):
    a = S.alerts(_state(spark, folder), "ts", **SPANS)
    return a.filter("overspeed").select("stream_id", "msg_id", F.col("last_speed").alias("speed"), "limit")


@query("acknowledged_alerts", "", f"""
WITH RECURSIVE {MSG}, g AS (SELECT *, true AS son, true AS lon FROM f), {alert_sql('g')},
n AS (SELECT stream_id, msg_id, active, msg_id % 4 = 0 AS press, row_number() OVER (PARTITION BY stream_id ORDER BY ts, msg_id) AS rn FROM al),
h(stream_id, rn, msg_id, hidden, shown) AS (
 SELECT stream_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), '', 'none' FROM n WHERE rn = 1
 UNION ALL SELECT stream_id, rn, msg_id, hid, coalesce([x FOR x IN active IF x <> hid][1], 'none') FROM (
  SELECT stream_id, rn, msg_id, active, CASE WHEN press AND sh IN ('lane_right', 'lane_left', 'overspeed', 'sign') THEN sh ELSE still END AS hid FROM (
   SELECT stream_id, rn, msg_id, active, press, still, coalesce([x FOR x IN active IF x <> still][1], 'none') AS sh FROM (
    SELECT n.stream_id, n.rn, n.msg_id, n.active, n.press, CASE WHEN list_contains(n.active, h.hidden) THEN h.hidden ELSE '' END AS still FROM h JOIN n ON n.stream_id = h.stream_id AND n.rn = h.rn + 1))))
SELECT stream_id, msg_id, hidden, shown AS reason FROM h WHERE rn > 0""")
def acknowledged_alerts(spark, folder):
    a = S.alerts(_state(spark, folder), "ts", **SPANS).withColumn("press", F.col("msg_id") % 4 == 0)
    done = S.acknowledged(a.select("stream_id", "ts", "msg_id", "active", "press"), "stream_id", ORDER, time_bucket("ts", 86_400))
    return done.select("stream_id", "msg_id", "hidden", "reason")


@query("control_inputs", "", """
SELECT user_id AS stream_id, event_id AS msg_id, 'press' AS input FROM events WHERE event_id % 2 = 0""")
def control_inputs(spark, folder):
    text = F.when(F.col("event_id") % 2 == 0, F.lit('{"speed": 1, "input": "press"}')).otherwise(F.lit('{"speed": 1}'))
    m = V.timed_events(spark, folder).select(
        F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("msg_id"), text.alias("json")
    )
    parsed = parse_messages(m, "json")
    return S.control_events(parsed, "stream_id", "msg_id")
