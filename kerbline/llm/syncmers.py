"""Document fingerprints by closed syncmers, with DataFrame operations only.

Tokens are runs without white space, cut after sixteen characters. Of each run of K tokens the hashes
of its inner runs of S tokens are compared; if the smallest stands first or last the run is an anchor.
Whether it is depends on its own tokens alone, so two texts that share a stretch share its anchors,
wherever it stands. A fingerprint is the anchors in their order, eight hexadecimal digits each; likeness
matches the different anchors of two fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2  #: tokens of a run and of its inner runs
TOKEN = r"[^\x20\x09-\x0D]{1,16}"
BUCKET_BYTES = 8 << 20
BUCKETS = 4096  #: most buckets; beyond, they grow


def anchors(text: Column) -> Column:
    """The anchors of a text as numbers below 2**32, in order; of a text with tokens but no anchor, all tokens as one."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))

    def inner(tokens: Column) -> Column:
        return F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    def chosen(h: Column, i: Column) -> Column:
        return F.least(F.get(h, i), F.get(h, i + 3)) <= F.least(F.get(h, i + 1), F.get(h, i + 2))

    def found(h: Column) -> Column:
        runs = F.sequence(F.lit(0), F.size(h) - (K - S + 2))
        kept = F.filter(runs, lambda i: chosen(h, i))
        whole = F.transform(kept, lambda i: F.shiftrightunsigned(F.xxhash64(F.get(h, i), F.get(h, i + 2), F.get(h, i + 3)), 32))
        return F.when(F.size(h) >= K - S + 2, whole)

    def fallback(tokens: Column) -> Column:
        return F.when(F.size(tokens) > 0, F.array(F.shiftrightunsigned(F.xxhash64(tokens), 32))).otherwise(F.array().cast("array<bigint>"))

    # Each step is bound to a name by a one-element transform, so nothing is worked out twice.
    def bind(value: Column, body) -> Column:  # noqa: ANN001
        return F.get(F.transform(F.array(value), body), F.lit(0))

    return bind(
        F.coalesce(tokens, F.array().cast("array<string>")),
        lambda t: bind(inner(t), lambda h: bind(found(h), lambda a: F.when(F.size(a) > 0, a).otherwise(fallback(t)))),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared different anchors by all different anchors; 1 for two texts without any."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, both / every).otherwise(F.lit(1.0))


def written(a: Column) -> Column:
    return F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and anchors of every row, with next: text and anchors of the row after it in descending doc_id, of the last the first's.

    Rows are dealt into ranges of doc_id of about equal bytes; the first row of a range is also lent to the range before,
    so texts move once. Nulls count as the smallest doc_id and as empty texts; rows of one doc_id are ordered by text.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(BUCKETS, max(1, math.ceil(size / BUCKET_BYTES)))
    shares = [k / parts for k in range(1, parts)]
    edges = sorted(set(rows.agg(F.percentile_approx("place", shares, 100_000)).first()[0] or [])) if shares else []

    def range_of(place: Column) -> Column:
        if not edges:
            return F.lit(0)
        bounds = F.array(*[F.lit(e).cast("long") for e in edges])
        return F.size(F.filter(bounds, lambda e: e < place))

    dealt = rows.withColumn("part", range_of(F.col("place")))
    # At most one row a range: its highest place. Descending, the range with the next lower number follows.
    heads = sorted((r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.max("place").alias("head")).collect())
    lent = {heads[i][1]: heads[(i + 1) % len(heads)][0] for i in range(len(heads))}
    if len(heads) > 1:
        also = F.create_map(*[F.lit(x) for pair in lent.items() for x in pair])
        to = F.get(F.array(F.try_element_at(also, F.col("place"))), F.lit(0))
        is_head = F.col("place").isin(list(lent))
        homes = F.when(is_head, F.array("part", to)).otherwise(F.array("part"))
    else:
        homes = F.array("part")
    moved = dealt.select("place", "doc_id", "text", "part", F.explode(homes).alias("home"))
    moved = moved.withColumn("guest", F.col("home") != F.col("part")).repartition("home")
    moved = moved.withColumn("anchors", anchors(F.col("text")))
    order = Window.partitionBy("home").orderBy("guest", F.desc("place"), "text")
    following = F.lead(F.struct("text", "anchors")).over(order)
    if len(heads) < 2:  # the only range is followed by itself
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        following = F.coalesce(following, F.first(F.struct("text", "anchors")).over(whole))
    return moved.withColumn("next", following).filter("NOT guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, one row for each input row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document.
    Empty texts have an empty fingerprint; two empty ones are alike (1), an empty and another one are not (0).
    """
    edited = F.concat(F.expr("left(text, char_length(text) - char_length(text) div 2)"), F.expr("left(next.text, cast(char_length(text) div 2 as int))"))
    rows = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        written(F.col("anchors")).alias("fingerprint"),
        written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next.anchors")).alias("near_next"),
    )
