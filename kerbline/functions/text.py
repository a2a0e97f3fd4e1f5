"""Flag words, metric maps and status columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Meaning of bits 0..3 of the flag word.
FLAG_BITS = ("under-voltage", "ARM frequency capped", "throttled", "soft temperature limit")


def flag_names(word: Column) -> Column:
    """Names of the set bits 0..3 of a hex word; an unreadable word gives no names."""
    digits = F.regexp_extract(F.trim(word), r"^(?:0[xX])?([0-9a-fA-F]+)$", 1)
    value = F.conv(digits, 16, 10).cast("bigint")
    names = F.array(
        *(
            F.when(value.bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0, F.lit(name))
            for bit, name in enumerate(FLAG_BITS)
        )
    )
    return F.when(digits != "", F.array_compact(names)).otherwise(
        F.array().cast("array<string>")
    )


def metric_like(metrics: Column, needle: str) -> Column:
    """The value of the first key (in key order) that contains the needle, or null."""
    matching = F.map_filter(metrics, lambda key, _: F.contains(key, F.lit(needle)))
    first_key = F.get(F.array_sort(F.map_keys(matching)), F.lit(0))
    return F.element_at(metrics, first_key)


def first_present(stages: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first stage whose artefact exists."""
    (present, name), *rest = stages
    chain = F.when(present, F.lit(name))
    for present, name in rest:
        chain = chain.when(present, F.lit(name))
    return chain.otherwise(F.lit(otherwise))


def pick_verdict(n_boxes: Column, flipped: Column) -> Column:
    """``sign`` or ``empty``: what the detector saw, turned around when a human flipped it."""
    return F.when((n_boxes > 0) != flipped, F.lit("sign")).otherwise(F.lit("empty"))


def gated_reading(value: Column, confidence: Column, width: Column, min_width: float = 32, min_confidence: float = 0.60) -> Column:
    """Struct ``(value, confidence)`` after two gates: too narrow forgets both, too unsure only the value."""
    return F.when(
        width < min_width,
        F.struct(F.lit(None).cast("int").alias("value"), F.lit(0.0).alias("confidence")),
    ).otherwise(
        F.struct(
            F.when(confidence >= min_confidence, value.cast("int")).alias("value"),
            confidence.cast("double").alias("confidence"),
        )
    )


def wilson(hits: Column, total: Column, z: float = 1.959964) -> Column:
    """Struct ``(low, high)``: the score interval of a proportion, null for no trials."""
    n = total.cast("double")
    p = hits / n
    base = 1 + z * z / n
    middle = (p + z * z / (2 * n)) / base
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / base
    return F.when(
        total > 0, F.struct((middle - half).alias("low"), (middle + half).alias("high"))
    )
