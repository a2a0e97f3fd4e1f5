"""Near-duplicate frames by the distance of 64-bit hashes.

Frames with one and the same hash become one row with a count, so a group of exact
copies never forms pairs. A hash is cut into bands, each with a radius, so that two
hashes at distance ``k`` or less agree within its radius in one of them: the radii
add up to ``k`` less the number of bands but one. Each side is listed under its band
values with a few bits turned, and pairs meet on ``(band, value)``. A pair is kept
only in its first such band and under one agreed value, so no pair comes twice and
no ``distinct`` is needed. The more hashes, the fewer and wider the bands: how many
is chosen from the number of hashes, by the rows listed and the pairs that meet by
chance. Band values shared by very many hashes are joined on a second band as well,
or once more on narrower bands, which loses no pair either.
"""

from __future__ import annotations

import math
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hamming
from ..session import checkpointed
from .components import with_component

BITS = 64
#: Work of a row that is listed, which is shuffled and sorted, against that of two hashes that meet by chance.
LISTED = 10
#: Rows that one task lists.
ROWS_A_TASK = 500_000


class Band(NamedTuple):
    """Bits ``start`` to ``start + width`` of a hash, which may differ in ``radius`` of them."""

    start: int
    width: int
    radius: int

    @property
    def right(self) -> int:
        """Bits turned on the right side; the others are turned on the left."""
        return self.radius // 2

    @property
    def left(self) -> int:
        return self.radius - self.right


def cut(number: int, k: int) -> list[Band]:
    """``number`` bands whose radii add up to ``k - number + 1``: were all exceeded, the distance would be more than ``k``."""
    wide, rest = divmod(BITS, number)
    deep, more = divmod(k - number + 1, number)
    widths = [wide + (i < rest) for i in range(number)]
    return [Band(sum(widths[:i]), w, deep + (i < more)) for i, w in enumerate(widths)]


def ball(width: int, radius: int) -> int:
    """Words of ``width`` bits with at most ``radius`` of them set."""
    return sum(math.comb(width, i) for i in range(radius + 1))


def rows_of(bands: list[Band]) -> int:
    """Rows listed for a hash, on both sides."""
    return sum(ball(b.width, b.left) + ball(b.width, b.right) for b in bands)


def cost(bands: list[Band], n: int, listed: int = 1) -> float:
    """Rows listed for a hash, each counted ``listed`` times, and other hashes of ``n`` that it meets by chance."""
    return listed * rows_of(bands) + sum(ball(b.width, b.radius) * n / 2**b.width for b in bands)


def bands_for(n: int, k: int) -> list[Band]:
    """The bands that make the least work for ``n`` different hashes."""
    return min((cut(m, k) for m in range(1, min(8, k + 1) + 1)), key=lambda bands: cost(bands, n, LISTED))


def _value(h: Column, band: Band) -> Column:
    mask = (1 << band.width) - 1 if band.width < BITS else -1
    return F.shiftrightunsigned(h, band.start).bitwiseAND(F.lit(mask).cast("bigint"))


def _masks(width: int, radius: int) -> Column:
    """All words of ``width`` bits with at most ``radius`` bits set."""
    words = [sum(1 << bit for bit in bits) for size in range(radius + 1) for bits in combinations(range(width), size)]
    return F.expr("array(" + ", ".join(f"{word if word < 1 << 63 else word - (1 << 64)}L" for word in words).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)") + ")")


def _lowest_bits(word: Column, count: Column, most: int) -> Column:
    """The ``count`` lowest set bits of a word, ``count`` being at most ``most``."""
    taken, rest = F.lit(0).cast("bigint"), word
    for done in range(most):
        low = rest.bitwiseAND(-rest)
        taken = F.when(count > done, taken.bitwiseOR(low)).otherwise(taken)
        rest = rest.bitwiseXOR(low)
    return taken


def _agreed(a: Column, b: Column, band: Band) -> Column:
    """The one value under which two band values within the radius meet."""
    difference = a.bitwiseXOR(b)
    turn = F.greatest(F.bit_count(difference) - band.right, F.lit(0))
    return a.bitwiseXOR(_lowest_bits(difference, turn, band.left))


def _first_band(a: Column, b: Column, bands: dict[int, Band], skip: Column | None = None) -> Column:
    """Number of the first band, other than ``skip``, that agrees within its radius."""
    chain = None
    for i, band in bands.items():
        near = hamming(_value(a, band), _value(b, band)) <= band.radius
        if skip is not None:
            near = near & (skip != i)
        chain = F.when(near, F.lit(i)) if chain is None else chain.when(near, F.lit(i))
    return chain


def _meeting(a: Column, b: Column, bands: dict[int, Band], band: Column) -> Column:
    """The value under which a pair meets in a band."""
    out = None
    for i, own in bands.items():
        here = _agreed(_value(a, own), _value(b, own), own)
        out = F.when(band == i, here) if out is None else out.when(band == i, here)
    return out


def _listed(df: DataFrame, bands: dict[int, Band], side: str, band: str, value: str) -> DataFrame:
    """A row per band and per value within what the side turns."""

    def turned(i: int, own: Band) -> Column:
        plain = _value(F.col("h"), own)
        return F.transform(_masks(own.width, getattr(own, side)), lambda m: F.struct(F.lit(i).alias("band"), plain.bitwiseXOR(m).alias("value")))

    parts = [turned(i, own) for i, own in bands.items()]
    rows = df.select("*", F.explode(F.flatten(F.array(*parts))).alias("__l"))
    return rows.select(*df.columns, F.col("__l.band").alias(band), F.col("__l.value").alias(value))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Listed rows of both sides that share a value. Their size is not known from the hashes', so none is to be broadcast."""
    return left.withColumnRenamed("h", "h_a").join(right.withColumnRenamed("h", "h_b").hint("merge"), on)


def distinct_hashes(df: DataFrame, key: str, h: str) -> DataFrame:
    """``(h, n, first_key)``: one row per hash with its number of frames and smallest key."""
    return df.groupBy(F.col(h).alias("h")).agg(
        F.count("*").alias("n"), F.min(key).alias("first_key")
    )


def hash_pairs(hashes: DataFrame, k: int, crowded: int = 20_000, bands: list[Band] | None = None) -> DataFrame:
    """Pairs ``(h_a, h_b, distance)`` of different hashes, ``h_a < h_b``, at most ``k`` apart.

    ``hashes`` holds each ``h`` once. Band values listed for more than ``crowded``
    hashes are joined on two bands, or, where the bands are only two, all that
    are under such values once more on four.
    """
    if not 0 <= k < BITS:
        raise ValueError("k must be 0..63")
    only = checkpointed(hashes.select("h"))
    n = only.count()
    every = dict(enumerate(bands or bands_for(n, k)))
    # The hashes are few bytes and what they are listed under is not: as many tasks as the listed rows want.
    dealt = only.repartition(max(1, math.ceil(n * rows_of(list(every.values())) / ROWS_A_TASK)), "h")
    on = ["band", "value"]
    a, b = F.col("h_a"), F.col("h_b")
    values = F.array(*(F.struct(F.lit(i).alias("band"), _value(F.col("h"), own).alias("v")) for i, own in every.items()))
    many = only.select(F.explode(values).alias("x")).groupBy("x.band", "x.v").count()
    spread = None
    for i, own in every.items():
        masks = F.when(F.col("count") > max(1, crowded // ball(own.width, own.right)), _masks(own.width, own.right))
        spread = F.when(F.col("band") == i, masks) if spread is None else spread.when(F.col("band") == i, masks)
    full = checkpointed(
        many.select("band", "v", F.explode(spread).alias("m")).select("band", F.col("v").bitwiseXOR(F.col("m")).alias("value")).distinct()
    )
    left, right = (_listed(dealt, every, side, *on) for side in ("left", "right"))

    def closed(joined: DataFrame, test: Column) -> DataFrame:
        return (
            joined.filter((a < b) & (hamming(a, b) <= k))
            .filter(test)
            .select("h_a", "h_b", hamming(a, b).alias("distance"))
        )

    first = _first_band(a, b, every)
    one = (F.col("band") == first) & (F.col("value") == _meeting(a, b, every, F.col("band")))
    if full.isEmpty():
        return closed(_met(left, right, on), one)
    thin_left, thin_right = (x.join(full, on, "left_anti") for x in (left, right))
    thin = closed(_met(thin_left, thin_right, on), one)
    dense_left, dense_right = (x.join(full, on, "left_semi") for x in (left, right))
    if len(every) < 3:
        crowd = dense_left.select("h").union(dense_right.select("h")).distinct()
        again = hash_pairs(crowd, k, crowded, cut(min(4, k + 1), k)) if k >= 3 else _unbanded(dense_left, dense_right, on, k)
        met = again.withColumns({"band": first, "value": _meeting(a, b, every, first)})
        return thin.unionByName(met.join(full, on, "left_semi").select("h_a", "h_b", "distance"))
    # Agreed in one band, a pair still agrees in one of the others, within radii that add up to as much for one band less.
    deep, more = divmod(k - len(every) + 2, len(every) - 1)
    found = thin
    for i in every:
        others = {j: own._replace(radius=deep + (place < more)) for place, (j, own) in enumerate((j, own) for j, own in every.items() if j != i)}
        rows_left = _listed(dense_left.filter(F.col("band") == i), others, "left", "band_2", "value_2")
        rows_right = _listed(dense_right.filter(F.col("band") == i), others, "right", "band_2", "value_2")
        met = _met(rows_left, rows_right, [*on, "band_2", "value_2"])
        second = _first_band(a, b, others)
        twice = one & (F.col("band_2") == second) & (F.col("value_2") == _meeting(a, b, others, F.col("band_2")))
        found = found.unionByName(closed(met, twice))
    return found


def _unbanded(left: DataFrame, right: DataFrame, on: list[str], k: int) -> DataFrame:
    """Pairs that share a crowded value, for distances too small to cut a hash into more bands."""
    a, b = F.col("h_a"), F.col("h_b")
    met = _met(left, right, on)
    return met.filter((a < b) & (hamming(a, b) <= k)).select("h_a", "h_b", hamming(a, b).alias("distance")).distinct()


def near_duplicates(df: DataFrame, key: str, h: str, k: int) -> DataFrame:
    """Near pairs between groups of equal hashes.

    ``(key_a, key_b, n_a, n_b, distance)``, each group named by its smallest key.
    Groups themselves are in ``distinct_hashes``: together they hold every pair.
    """
    hashes = distinct_hashes(df, key, h)
    pairs = hash_pairs(hashes, k)
    a = hashes.select(F.col("h").alias("h_a"), F.col("n").alias("n_a"), F.col("first_key").alias("key_a"))
    b = hashes.select(F.col("h").alias("h_b"), F.col("n").alias("n_b"), F.col("first_key").alias("key_b"))
    return pairs.join(a, "h_a").join(b, "h_b").select("key_a", "key_b", "n_a", "n_b", "distance")


def pair_counts(
    df: DataFrame, h: str, clip: str, thresholds: tuple[int, ...] = (3, 5, 8, 10)
) -> DataFrame:
    """Frame pairs at each threshold: all, within one clip, across clips.

    Pairs are counted from the sizes of equal-hash groups, never listed.
    """
    per_clip = df.groupBy(F.col(h).alias("h"), F.col(clip).alias("clip")).agg(F.count("*").alias("n"))
    whole = per_clip.groupBy("h").agg(F.sum("n").alias("n"))
    pairs = hash_pairs(whole.select("h"), max(thresholds))

    def inside(table: DataFrame) -> Column:
        return (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")

    zero = F.lit(0).cast("int")
    all_rows = (
        pairs.join(whole.select(F.col("h").alias("h_a"), F.col("n").alias("n_a")), "h_a")
        .join(whole.select(F.col("h").alias("h_b"), F.col("n").alias("n_b")), "h_b")
        .select("distance", (F.col("n_a") * F.col("n_b")).alias("pairs"), F.lit(0).alias("within"))
        .unionByName(whole.select(zero.alias("distance"), inside(whole).alias("pairs"), F.lit(0).alias("within")))
    )
    same_clip = (
        pairs.join(per_clip.select(F.col("h").alias("h_a"), "clip", F.col("n").alias("n_a")), "h_a")
        .join(per_clip.select(F.col("h").alias("h_b"), "clip", F.col("n").alias("n_b")), ["h_b", "clip"])
        .select("distance", F.lit(0).alias("pairs"), (F.col("n_a") * F.col("n_b")).alias("within"))
        .unionByName(per_clip.select(zero.alias("distance"), F.lit(0).alias("pairs"), inside(per_clip).alias("within")))
    )
    by_distance = all_rows.unionByName(same_clip).groupBy("distance").agg(
        F.sum("pairs").alias("pairs"), F.sum("within").alias("within")
    )
    counted = by_distance.select(
        F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: t >= F.col("distance"))).alias("threshold"),
        "pairs",
        "within",
    )
    return counted.groupBy("threshold").agg(
        F.sum("pairs").cast("bigint").alias("pairs"),
        F.sum("within").cast("bigint").alias("within_clip"),
        (F.sum("pairs") - F.sum("within")).cast("bigint").alias("cross_clip"),
    )


def scenes(df: DataFrame, h: str, k: int = 5) -> DataFrame:
    """``(h, n, component)``: hashes joined into scenes by chains of near duplicates."""
    hashes = df.groupBy(F.col(h).alias("h")).agg(F.count("*").alias("n"))
    edges = hash_pairs(hashes, k).select(F.col("h_a").alias("u"), F.col("h_b").alias("v"))
    return with_component(hashes, "h", edges)


def scene_sizes(df: DataFrame, h: str, k: int = 5) -> DataFrame:
    """One row per scene: its smallest hash, its hashes and its frames."""
    return scenes(df, h, k).groupBy(F.col("component").alias("scene")).agg(
        F.count("*").alias("n_hashes"), F.sum("n").alias("n_frames")
    )
