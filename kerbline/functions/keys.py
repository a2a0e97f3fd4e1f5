"""Keys, clocks, digests and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_KEY = r"^(.*)_f(\d+)$"
UNPARSED = "UNPARSED"


def _clip(stem: Column) -> Column:
    return F.when(stem.rlike(FRAME_KEY), F.regexp_extract(stem, FRAME_KEY, 1))


def clip_of(stem: Column, strict: bool = False) -> Column:
    """The clip part of ``<clip>_f<frame>``; an error or ``UNPARSED`` for other names."""
    if strict:
        return F.coalesce(
            _clip(stem),
            F.raise_error(F.concat(F.lit("not <clip>_f<frame>: "), stem)).cast("string"),
        )
    return F.coalesce(_clip(stem), F.lit(UNPARSED))


def frame_no_of(stem: Column) -> Column:
    """The frame number of ``<clip>_f<frame>``, or -1."""
    return F.when(
        stem.rlike(FRAME_KEY), F.regexp_extract(stem, FRAME_KEY, 2).cast("int")
    ).otherwise(F.lit(-1))


def frame_id(clip: Column, frame_no: Column) -> Column:
    return F.format_string("%s_f%06d", clip.cast("string"), frame_no)


def track_crop_id(clip: Column, track: Column) -> Column:
    return F.format_string("%s_t%04d", clip.cast("string"), track)


def box_crop_id(frame: Column, index: Column) -> Column:
    return F.format_string("%s_b%d", frame.cast("string"), index)


def trusted_fps(fps: Column) -> Column:
    """A frame rate outside 1..240 is not trusted and becomes 0."""
    return F.when(fps.between(1, 240), fps).otherwise(F.lit(0.0))


def seconds_of(frame_no: Column, fps: Column) -> Column:
    """Time of a frame; 0 when the rate is unknown."""
    rate = trusted_fps(fps)
    return F.when(rate > 0, frame_no / rate).otherwise(F.lit(0.0))


def clock(seconds: Column) -> Column:
    """Whole seconds as ``mm:ss``."""
    whole = F.floor(seconds)
    return F.format_string("%02d:%02d", F.floor(whole / 60), whole % 60)


def label_line(cls: Column, xc: Column, yc: Column, w: Column, h: Column) -> Column:
    """One text line of a label file: class and four numbers with six decimals."""
    return F.format_string("%d %.6f %.6f %.6f %.6f", cls, xc, yc, w, h)


def shuffle_key(seed: int, *parts: Column) -> Column:
    """A repeatable random order: the md5 text of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def difference_hash(values: Column) -> Column:
    """Bits "next value is larger than this one" of a numeric array, as a bigint.

    The first comparison becomes the lowest bit; up to 64 comparisons fit, more are an error.
    """
    count = F.size(values) - 1
    bits = F.aggregate(
        F.zip_with(
            F.slice(values, F.lit(1), count),
            F.slice(values, F.lit(2), count),
            lambda here, following: (following > here).cast("bigint"),
        ),
        F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(0).alias("at")),
        lambda state, bit: F.struct(
            state["bits"].bitwiseOR(F.call_function("shiftleft", bit, state["at"])).alias("bits"),
            (state["at"] + 1).alias("at"),
        ),
        lambda state: state["bits"],
    )
    return F.when(count <= 64, bits).otherwise(F.when(count > 64, F.raise_error(F.lit("more than 65 values in a difference hash")).cast("bigint")))


def grid_difference_hash(rows: Column) -> Column:
    """The 64-bit hash of an 8 x 9 grey grid given as an array of eight arrays of nine."""
    bits = F.flatten(
        F.transform(
            rows,
            lambda row: F.zip_with(
                F.slice(row, 1, 8), F.slice(row, 2, 8), lambda a, b: (b > a).cast("bigint")
            ),
        )
    )
    return F.aggregate(
        bits,
        F.lit(0).cast("bigint"),
        lambda state, bit: F.call_function("shiftleft", state, F.lit(1)).bitwiseOR(bit),
    )


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def mean_of(values: Column) -> Column:
    """Mean of a numeric array."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def spread_of(values: Column) -> Column:
    """Population standard deviation of a numeric array."""
    mean = mean_of(values)
    return F.sqrt(
        F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(values)
    )
