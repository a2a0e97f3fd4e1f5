"""Column expressions on axis-aligned boxes.

A box is four columns ``(x1, y1, x2, y2)`` in pixels, or ``(xc, yc, w, h)`` as
shares of the frame.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


class Centred(NamedTuple):
    xc: Column
    yc: Column
    w: Column
    h: Column


def box(prefix: str = "") -> Box:
    """The four corner columns of a table, with an optional name prefix such as ``"a."``."""
    return Box(*(F.col(prefix + name) for name in ("x1", "y1", "x2", "y2")))


def area(b: Box) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the union is not positive."""
    zero = F.lit(0.0)
    inter = F.greatest(zero, F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(
        zero, F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    )
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(zero)


def side(b: Box) -> Column:
    """The longer side in pixels."""
    return F.greatest(b.x2 - b.x1, b.y2 - b.y1)


def centre(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def clamp(b: Box, width: Column, height: Column) -> Box:
    """Cut the box at the frame edge. May leave a box without area."""
    zero = F.lit(0.0)
    return Box(
        F.greatest(zero, b.x1), F.greatest(zero, b.y1), F.least(width, b.x2), F.least(height, b.y2)
    )


def is_degenerate(b: Box) -> Column:
    return ((b.x2 - b.x1) <= 0) | ((b.y2 - b.y1) <= 0)


def to_centred(b: Box, width: Column, height: Column) -> Centred:
    """Corner pixels to centre form, without clamping."""
    return Centred(
        (b.x1 + b.x2) / 2 / width,
        (b.y1 + b.y2) / 2 / height,
        (b.x2 - b.x1) / width,
        (b.y2 - b.y1) / height,
    )


def to_pixels(c: Centred, width: Column, height: Column) -> Box:
    return Box(
        (c.xc - c.w / 2) * width,
        (c.yc - c.h / 2) * height,
        (c.xc + c.w / 2) * width,
        (c.yc + c.h / 2) * height,
    )


def clamped_norm(b: Box, width: Column, height: Column) -> Column:
    """Clamp, then normalise: a struct ``(xc, yc, w, h)``, or null for a degenerate box."""
    cut = clamp(b, width, height)
    form = to_centred(cut, width, height)
    return F.when(
        ~is_degenerate(cut),
        F.struct(*(value.alias(name) for name, value in form._asdict().items())),
    )


def square_window(b: Box, width: Column, height: Column, scale: float = 1.2) -> Box:
    """Square around the centre, ``scale`` times the longer side, cut at the frame."""
    half = side(b) * (scale / 2)
    cx, cy = centre(b)
    return clamp(Box(cx - half, cy - half, cx + half, cy + half), width, height)


def context_window(b: Box, width: Column, height: Column, scale: float = 2.5) -> Box:
    """Whole-pixel window ``scale`` times the box about its centre, cut at the frame."""
    cx, cy = centre(b)
    half_w, half_h = (b.x2 - b.x1) * scale / 2, (b.y2 - b.y1) * scale / 2

    def whole(value: Column) -> Column:
        return value.cast("bigint").cast("double")

    return clamp(
        Box(whole(cx - half_w), whole(cy - half_h), whole(cx + half_w), whole(cy + half_h)),
        width,
        height,
    )


def geometry(df: DataFrame, image_size: int, width: str = "width", height: str = "height") -> DataFrame:
    """Add pixel size, normalised area, aspect, side and side after letterboxing.

    Needs ``xc, yc, w, h`` and the frame size. Aspect is infinite at zero height.
    """
    pw, ph = F.col("w") * F.col(width), F.col("h") * F.col(height)
    scale = F.lit(float(image_size)) / F.greatest(F.col(width), F.col(height))
    return df.withColumns(
        {
            "pw": pw,
            "ph": ph,
            "area_n": F.col("w") * F.col("h"),
            "aspect": F.when(ph != 0, pw / ph).otherwise(F.lit(float("inf"))),
            "side_px": F.sqrt(pw * ph),
            "side_scaled": F.sqrt(pw * scale * ph * scale),
            "left": F.col("xc") - F.col("w") / 2,
            "top": F.col("yc") - F.col("h") / 2,
            "right": F.col("xc") + F.col("w") / 2,
            "bottom": F.col("yc") + F.col("h") / 2,
        }
    )


def box_faults(edge: float = 1e-6) -> Column:
    """Names of the faults of a normalised box, as an array: empty means valid."""
    xc, yc, w, h = (F.col(name) for name in ("xc", "yc", "w", "h"))
    return F.array_compact(
        F.array(
            F.when((w <= 0) | (h <= 0), F.lit("zero_area")),
            F.when(
                ~(xc.between(0, 1) & yc.between(0, 1)) | (w > 1) | (h > 1), F.lit("out_of_range")
            ),
            F.when(
                (xc - w / 2 < -edge)
                | (yc - h / 2 < -edge)
                | (xc + w / 2 > 1 + edge)
                | (yc + h / 2 > 1 + edge),
                F.lit("over_edge"),
            ),
        )
    )


def ground_position(
    b: Box,
    width: float,
    height: float,
    camera_height: float = 1.15,
    pitch_deg: float = -0.5,
    hfov_deg: float = 140.0,
) -> Column:
    """Where the foot of the box meets a flat road: struct ``(forward, lateral, range)`` in metres.

    Null when the foot is at or above the horizon.
    """
    focal = F.lit(width / 2) / F.tan(F.radians(F.lit(hfov_deg)) / 2)
    foot_x, foot_y = (b.x1 + b.x2) / 2, b.y2
    depression = F.radians(F.lit(pitch_deg)) + F.atan2(foot_y - height / 2, focal)
    forward = F.lit(camera_height) / F.tan(depression)
    lateral = forward * (foot_x - width / 2) / focal
    return F.when(
        depression > 1e-3,
        F.struct(
            forward.alias("forward"), lateral.alias("lateral"), F.hypot(lateral, forward).alias("range")
        ),
    )


def frame_look(aspect: Column, luma: Column, contrast: Column, flat_below: float = 20.0) -> Column:
    """Names of what makes a crop unusual: odd shape, night, flat."""
    return F.array_compact(
        F.array(
            F.when((aspect > 1.8) | (aspect < 0.6), F.lit("odd_aspect")),
            F.when(luma < 60, F.lit("night")),
            F.when(contrast < flat_below, F.lit("flat")),
        )
    )
