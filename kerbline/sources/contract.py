"""The vehicle-state message: its schema, parsing, and the check against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import values

# The closed message schema.
NUMBERS = {
    "speed": (0, None), "odo": (0, None), "trip": (0, None), "oil_temp": (None, None),
    "outside_temp": (None, None), "voltage": (0, None), "lane_confidence": (0, 1),
    "fcw_ttc": (0, None), "speed_limit": (0, None),
}
BOOLEANS = ("lane_warning", "fcw_warning", "lead_vehicle")
TEXTS = ("sign_seen", "system_fault")
ENUMS = {
    "lane_direction": ("left", "right", "none"),
    "input": ("rotate_cw", "rotate_ccw", "press", "long_press"),
}
MODULES = ("lane", "fcw", "signs")
MODULE_STATES = ("on", "paused", "off")
# End of fixed values.

MESSAGE = T.StructType(
    [T.StructField(k, T.DoubleType()) for k in NUMBERS]
    + [T.StructField(k, T.BooleanType()) for k in BOOLEANS]
    + [T.StructField(k, T.StringType()) for k in (*TEXTS, *ENUMS)]
    + [
        T.StructField("module_status", T.StructType([T.StructField(m, T.StringType()) for m in MODULES])),
        T.StructField("feature_enable", T.StructType([T.StructField(m, T.BooleanType()) for m in MODULES])),
    ]
)


def is_object(json: Column) -> Column:
    """True for a readable JSON object; anything else is dropped by every reader."""
    return F.json_object_keys(json).isNotNull()


def parse_messages(df: DataFrame, json: str) -> DataFrame:
    """Add one column per known key; malformed and non-object rows go, unknown keys are ignored."""
    parsed = df.filter(is_object(F.col(json))).withColumn("__m", F.from_json(json, MESSAGE))
    return parsed.select(*df.columns, *flat_fields("__m"))


def flat_fields(message: str) -> list[Column]:
    plain = [F.col(f"{message}.{k}").alias(k) for k in (*NUMBERS, *BOOLEANS, *TEXTS, *ENUMS)]
    modules = [F.col(f"{message}.module_status.{m}").alias(f"module_{m}") for m in MODULES]
    sent = F.when(F.col(f"{message}.module_status").isNotNull(), F.lit(True)).alias("module_status_sent")
    enable = [F.col(f"{message}.feature_enable.{m}").alias(f"enable_{m}") for m in MODULES]
    return [*plain, *modules, sent, *enable]


def _rules(spark: SparkSession) -> DataFrame:
    """One row per key: its kind, range and allowed values. Nested keys have a dotted path."""
    rows = [(k, "number", low, high, None) for k, (low, high) in NUMBERS.items()]
    rows += [(k, "boolean", None, None, None) for k in BOOLEANS]
    rows += [(k, "text", None, None, None) for k in TEXTS]
    rows += [(k, "text", None, None, "|".join(allowed)) for k, allowed in ENUMS.items()]
    rows += [(k, "object", None, None, None) for k in ("module_status", "feature_enable")]
    rows += [(f"module_status.{m}", "text", None, None, "|".join(MODULE_STATES)) for m in MODULES]
    rows += [(f"feature_enable.{m}", "boolean", None, None, None) for m in MODULES]
    return values(spark, rows, "path string, kind string, low double, high double, allowed string")


def violations(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """``(keep..., fault, key)`` rows: malformed, unknown_key, wrong_type, out_of_range, bad_value.

    Each message is parsed once into key and value rows, which meet the rules by
    key. Faults of a nested key are told under its outer key.
    """
    text = "map<string,string>"
    read = df.select(*keep, is_object(F.col(json)).alias("__ok"), F.from_json(json, text).alias("__b"))
    # A message that cannot be read goes on as one entry under a path of its own.
    broken = F.create_map(F.lit(""), F.lit("malformed"))
    outer = read.select(*keep, F.explode(F.when(F.col("__ok"), F.col("__b")).otherwise(broken)).alias("key", "value"))
    nested = F.when(F.col("key").isin("module_status", "feature_enable"), F.from_json("value", text))
    entries = outer.select(
        *keep, "key",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("key").alias("path"), "value")),
                F.coalesce(
                    F.transform(
                        F.map_entries(nested),
                        lambda e: F.struct(F.concat("key", F.lit("."), e["key"]).alias("path"), e["value"].alias("value")),
                    ),
                    F.array().cast("array<struct<path:string,value:string>>"),
                ),
            )
        ).alias("e"),
    ).select(*keep, "key", "e.path", "e.value")
    ruled = entries.join(F.broadcast(_rules(df.sparkSession)), "path", "left")
    number = F.expr("try_cast(value AS DOUBLE)")
    wrong = (
        ((F.col("kind") == "number") & number.isNull())
        | ((F.col("kind") == "boolean") & ~F.col("value").isin("true", "false"))
        | ((F.col("kind") == "object") & F.json_object_keys("value").isNull())
    )
    fault = (
        F.when(F.col("path") == "", F.lit("malformed"))
        .when(F.col("kind").isNull(), F.lit("unknown_key"))
        .when(F.col("value").isNull(), F.lit(None))
        .when(wrong, F.lit("wrong_type"))
        .when((number < F.col("low")) | (number > F.col("high")), F.lit("out_of_range"))
        .when(~F.array_contains(F.split("allowed", r"\|"), F.col("value")), F.lit("bad_value"))
    )
    return ruled.select(*keep, fault.alias("fault"), "key").filter(F.col("fault").isNotNull())
