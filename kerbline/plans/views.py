"""Views of the given tables as detections, ticks, messages, hashes and labels.

Each view exists twice: as a DataFrame for the queries and as text for the SQL
that checks them. Every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import difference_hash
from ..operators.ordered import numbered, time_bucket


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def timed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``ts`` as an instant (the session runs in UTC)."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _double(text: str):
    return F.expr(f"CAST({text} AS DOUBLE)")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every order is a frame of 250 x 250 px; 25 frames are a clip."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("frame_key"),
        F.floor(F.col("o_orderkey") / 25).alias("clip_no"),
        (F.col("o_orderkey") % 25).alias("frame_no"),
        F.lit(250.0).alias("width"),
        F.lit(250.0).alias("height"),
    )


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item is a box on its order's frame."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("frame_key"),
        F.floor(F.col("l_orderkey") / 25).alias("clip_no"),
        (F.col("l_orderkey") % 25).alias("frame_no"),
        (F.col("l_suppkey") % 5).cast("int").alias("track_no"),
        _double("l_partkey % 150").alias("x1"),
        _double("(l_suppkey * 7) % 150").alias("y1"),
        (_double("l_partkey % 150") + 10 + F.col("l_quantity")).alias("x2"),
        (_double("(l_suppkey * 7) % 150") + 10 + F.col("l_quantity") * (7 + 2 * F.col("l_linenumber")) / 14).alias("y2"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END").alias("cls"),
        F.round(1 - 5 * F.col("l_tax") - F.col("l_discount"), 3).alias("conf"),
        F.lit(250.0).alias("width"),
        F.lit(250.0).alias("height"),
    )


def normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Detections with ``xc, yc, w, h`` as shares of the frame."""
    return detections(spark, folder).withColumns({
        "xc": (F.col("x1") + F.col("x2")) / 2 / 250,
        "yc": (F.col("y1") + F.col("y2")) / 2 / 250,
        "w": (F.col("x2") - F.col("x1")) / 250,
        "h": (F.col("y2") - F.col("y1")) / 250,
    })


def track_detections(spark: SparkSession, folder: str) -> DataFrame:
    """Detections named as the track operators want them."""
    return detections(spark, folder).select(
        F.col("clip_no").alias("clip"), F.col("track_no").alias("track"), F.col("frame_no").alias("frame"),
        "x1", "y1", "x2", "y2",
        F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("size"), "cls", "conf",
    )


def track_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Detections as a tracker leaves them: tracks cut in pieces, some signs tracked twice."""
    cut = track_detections(spark, folder).withColumn(
        "track", (F.col("track") + 5 * F.floor(F.col("frame") / 8)).cast("int")
    )
    twice = cut.filter("clip % 3 = 0 AND track % 5 < 3").withColumns(
        {"track": F.col("track") + 100, "x1": F.col("x1") + 2, "x2": F.col("x2") + 2}
    )
    return cut.unionByName(twice)


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Every event is a tick of its user's stream, numbered in time."""
    events = timed_events(spark, folder).select("user_id", "ts", "event_id", "event_type", "value")
    placed = numbered(events, ["user_id"], ["ts", "event_id"], time_bucket("ts", 86_400), "tick")
    return placed.select(
        F.col("user_id").alias("stream_id"), "ts", "event_id", "tick", F.col("event_type").alias("name"), "value",
        F.when(F.col("event_type") != "error", (F.col("value") - 50) / 50).alias("off"),
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a JSON message, unknown keys and broken text among them."""
    value = F.round("value", 2).cast("string")
    text = (
        F.when(F.col("event_id") % 50 == 7, F.lit("{broken"))
        .when(F.col("event_id") % 50 == 8, F.lit("[1, 2]"))
        .when(F.col("event_type") == "view", F.format_string('{"speed": %s}', value))
        .when(
            F.col("event_type") == "click",
            F.format_string('{"speed_limit": %s, "lane_confidence": %s}', value, value),
        )
        .when(
            F.col("event_type") == "signup",
            F.format_string(
                '{"sign_seen": "%s", "module_status": {"signs": "%s"}}',
                F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.lit("stop")),
                F.when(F.col("event_id") % 7 == 0, F.lit("asleep")).otherwise(F.lit("on")),
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.format_string(
                '{"lane_warning": %s, "lane_direction": "%s"}',
                F.when(F.col("value") > 50, F.lit("true")).otherwise(F.lit("false")),
                F.element_at(F.array(*map(F.lit, ("left", "right", "none", "up"))), (F.col("event_id") % 4 + 1).cast("int")),
            ),
        )
        .otherwise(F.format_string('{"sped": %s, "speed": -1}', value))
    )
    return timed_events(spark, folder).select(
        F.col("user_id").alias("stream_id"), "ts", F.col("event_id").alias("msg_id"), text.alias("json")
    )


def hashes(spark: SparkSession, folder: str) -> DataFrame:
    """A 63-bit hash per vector, and of every third a copy with a few low bits turned."""
    base = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.col("vec_id").alias("vec_id"),
        difference_hash(F.col("embedding")).alias("h"),
    )
    turned = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(vec_id % 12 AS INT)) - 1")
    copies = base.filter(F.col("vec_id") % 3 == 0).select(
        (F.col("vec_id") + 10_000_000).alias("image_id"), "vec_id", F.col("h").bitwiseXOR(turned).alias("h")
    )
    return base.unionByName(copies).select("image_id", "h", (F.col("image_id") % 20).alias("clip"))


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """Two annotators and a model over every event."""
    kind = F.col("event_type")
    return table(spark, folder, "events").select(
        F.col("event_id").alias("item"),
        kind.alias("a"),
        F.when(F.col("event_id") % 11 == 0, F.lit("error")).otherwise(kind).alias("b"),
        F.when(F.col("event_id") % 4 == 0, F.lit("view")).otherwise(kind).alias("pred"),
    )


# The given tables know five kinds of event; they stand in for fine classes.
KIND_GROUPS = {"engage": ("click", "view"), "rest": ("error", "purchase", "signup")}

SQL = {
    "frames": """SELECT o_orderkey AS frame_key, CAST(floor(o_orderkey / 25) AS BIGINT) AS clip_no,
        o_orderkey % 25 AS frame_no, CAST(250 AS DOUBLE) AS width, CAST(250 AS DOUBLE) AS height FROM orders""",
    "det": """SELECT l_orderkey AS frame_key, CAST(floor(l_orderkey / 25) AS BIGINT) AS clip_no,
        l_orderkey % 25 AS frame_no, CAST(l_suppkey % 5 AS INT) AS track_no,
        CAST(l_partkey % 150 AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 150 AS DOUBLE) AS y1,
        CAST(l_partkey % 150 AS DOUBLE) + 10 + l_quantity AS x2,
        CAST((l_suppkey * 7) % 150 AS DOUBLE) + 10 + l_quantity * (7 + 2 * l_linenumber) / 14 AS y2,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls,
        round(1 - 5 * l_tax - l_discount, 3) AS conf,
        CAST(250 AS DOUBLE) AS width, CAST(250 AS DOUBLE) AS height FROM lineitem""",
    "norm": """SELECT *, (x1 + x2) / 2 / 250 AS xc, (y1 + y2) / 2 / 250 AS yc,
        (x2 - x1) / 250 AS w, (y2 - y1) / 250 AS h FROM det""",
    "geo": """SELECT *, w * width AS pw, h * height AS ph, sqrt(w * width * h * height) AS side_px,
        sqrt((w * width * (640.0::DOUBLE / greatest(width, height))) * (h * height * (640.0::DOUBLE / greatest(width, height)))) AS side_scaled,
        (w * width) / (h * height) AS aspect FROM norm""",
    "tdet": """SELECT clip_no AS clip, track_no AS track, frame_no AS frame, x1, y1, x2, y2,
        greatest(x2 - x1, y2 - y1) AS size, cls, conf FROM det""",
    "tone": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY clip, track, frame
        ORDER BY size DESC, x1, y1, x2, y2, cls, conf) AS rn FROM tdet) WHERE rn = 1""",
    "pieces": """SELECT clip, CAST(track + 5 * floor(frame / 8) AS INT) AS track, frame, x1, y1, x2, y2, size, cls, conf FROM tdet UNION ALL
        SELECT clip, CAST(track + 5 * floor(frame / 8) AS INT) + 100, frame, x1 + 2, y1, x2 + 2, y2, size, cls, conf FROM tdet WHERE clip % 3 = 0 AND track % 5 < 3""",
    "pone": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY clip, track, frame
        ORDER BY size DESC, x1, y1, x2, y2, cls, conf) AS rn FROM pieces) WHERE rn = 1""",
    "ticks": """SELECT user_id AS stream_id, ts, event_id,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS tick,
        event_type AS name, value, CASE WHEN event_type = 'error' THEN NULL ELSE (value - 50) / 50 END AS off FROM events""",
    "hashes": """SELECT image_id, h, image_id % 20 AS clip FROM (
        SELECT vec_id AS image_id, b AS h FROM base UNION ALL
        SELECT vec_id + 10000000, xor(b, (1::BIGINT << (vec_id % 12)::INT) - 1) FROM base WHERE vec_id % 3 = 0)""",
    "base": """SELECT vec_id, CAST(list_sum([CASE WHEN embedding[i + 2] > embedding[i + 1] THEN 1::BIGINT << i::INT ELSE 0 END
        FOR i IN range(0, 63)]) AS BIGINT) AS b FROM embeddings""",
    "ann": """SELECT event_id AS item, event_type AS a,
        CASE WHEN event_id % 11 = 0 THEN 'error' ELSE event_type END AS b,
        CASE WHEN event_id % 4 = 0 THEN 'view' ELSE event_type END AS pred FROM events""",
    "kinds": """SELECT * FROM (VALUES ('click', 'engage', 'view'), ('view', 'engage', 'view'), ('error', 'rest', 'signup'),
        ('purchase', 'rest', 'signup'), ('signup', 'rest', 'signup')) AS t(fine, parent, catch_all)""",
}
NEEDS = {"norm": ["det"], "geo": ["det", "norm"], "tdet": ["det"], "tone": ["det", "tdet"], "pieces": ["det", "tdet"], "pone": ["det", "tdet", "pieces"], "hashes": ["base"]}


def sql(views: str, body: str) -> str:
    """A query text with the named views in front."""
    names: list[str] = []
    for view in views.split():
        for name in [*NEEDS.get(view, []), view]:
            if name not in names:
                names.append(name)
    heads = ", ".join(f"{name} AS ({SQL[name]})" for name in names)
    body = body.strip()
    if not heads:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return f"WITH RECURSIVE {heads}, {rest[10:]}"
        return f"WITH {heads}, {rest}"
    return f"WITH {heads} {body}"
