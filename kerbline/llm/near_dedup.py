"""Near-duplicate documents by b-bit MinHash over word shingles, confirmed on the full sets.

Documents with equal shingle sets are one class from the start. Classes meet when all minima of a
band agree. Of every minimum only its low bits are kept for the signature; a signature is a few
longs, and the similarity of two is their number of equal lanes, corrected for lanes that agree by
chance. What passes is confirmed on the whole sets. A class whose own shingles, those of no other
candidate, are too many to leave room for a similar one takes no part. In a band with many members each class is first
compared with two of them, which joins what belongs together in a linear number of pairs. Classes of a
band that are still in different components are then compared only where they can be linked: two similar
sets, ordered by how few of these classes hold a shingle, share one among their rarest, and so early that
what follows leaves room for the rest. So no link is lost and no group is spelled out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import checkpointed
from .arrays import U64, Hashes, Texts, forget, lowered, mix, pieces, texts_of, words_of
from .segments import pack, unpacked, with_rid

BITS = 2  #: low bits kept of each minimum
LANES = 0x5555555555555555  #: the low bit of each lane of a long


def shingle_sets(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each row, ordered, and where each row's begin (one more at the end)."""
    data = lowered(texts.data)
    start, end, first = words_of(texts)
    hashes = Hashes(Hashes.of_bytes(data).apart(start, end))
    grams = hashes.grams(words)
    out, size = [], np.zeros(len(first), np.int64)
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if n >= words:
            own = np.sort(grams[first[i] : first[i + 1] - words + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif n:
            own = hashes.between(first[i : i + 1], first[i + 1 : i + 2])
        else:
            continue
        out.append(own)
        size[i + 1] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(size)


def minima(sets: np.ndarray, first: np.ndarray, number: int) -> np.ndarray:
    """``number`` minima of each non-empty row under as many orders of the hashes."""
    at = first[:-1][np.diff(first) > 0]
    seeds = mix(np.arange(1, 2 * number + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
    out = np.empty((len(at), number), U64)
    if len(at):
        for k in range(number):
            out[:, k] = np.minimum.reduceat((sets ^ seeds[2 * k]) * (seeds[2 * k + 1] | U64(1)), at)
    return out


def sketches(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, rid, n_shingles, cls (one value for equal sets), bands (a hash for each) and sig (packed low bits)."""
    per_long = 64 // BITS
    longs = -(-bands * rows // per_long)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            sets, first = shingle_sets(texts_of(batch.column("text")), words)
            n = np.diff(first)
            some = np.flatnonzero(n)
            low = minima(sets, first, bands * rows)
            cls = np.zeros(len(n), U64)
            if len(some):
                at = first[:-1][some]
                cls[some] = mix(np.add.reduceat(mix(sets), at) + mix(np.bitwise_xor.reduceat(mix(~sets), at)) + n[some].astype(U64))
            keys = np.zeros((len(some), bands), U64)
            for band in range(bands):
                for row in range(rows):
                    keys[:, band] = mix(keys[:, band] * U64(3) + low[:, band * rows + row] + U64(band + 1))
            bits = mix(low) & U64((1 << BITS) - 1)
            signature = np.zeros((len(some), longs), U64)
            for k in range(bands * rows):
                signature[:, k // per_long] |= bits[:, k] << U64(BITS * (k % per_long))
            size_of = np.zeros(len(n) + 1, np.int32)
            size_of[1:] = np.cumsum(n > 0)

            def lists(matrix: np.ndarray, size_of: np.ndarray = size_of) -> pa.Array:
                flat = pa.array(np.ascontiguousarray(matrix).view(np.int64).ravel())
                return pa.ListArray.from_arrays(pa.array((size_of * matrix.shape[1]).astype(np.int32)), flat)

            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "rid": batch.column("rid"),
                    "n_shingles": n,
                    "cls": cls.view(np.int64),
                    "bands": lists(keys),
                    "sig": lists(signature),
                }
            )

    schema = "doc_id long, rid long, n_shingles long, cls long, bands array<long>, sig array<long>"
    return with_rid(docs).mapInArrow(work, schema)


def estimate(a: Column, b: Column, lanes: int) -> Column:
    """Similarity of two signatures: the share of equal lanes, less those that agree by chance."""
    pairs = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    differ = F.transform(pairs, lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(LANES))).cast("int"))
    equal = 1 - F.aggregate(differ, F.lit(0), lambda s, x: s + x) / lanes
    chance = 1 / (1 << BITS)
    return (equal - chance) / (1 - chance)


def similar_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(u, v)`` whose sets, looked up in ``(cls, items)``, are similar enough."""
    n, m = F.size("items_u").cast("long"), F.size("items_v").cast("long")
    both = F.size(F.array_intersect("items_u", "items_v")).cast("long")
    return (
        pairs.join(sets.select(F.col("cls").alias("u"), F.col("items").alias("items_u")), "u")
        .join(sets.select(F.col("cls").alias("v"), F.col("items").alias("items_v")), "v")
        .filter(100 * both >= percent * (n + m - both))
        .select("u", "v")
    )


def meeting(sets: DataFrame, percent: int, step: float = 1.03) -> DataFrame:
    """Pairs ``(u, v)`` of different parts among ``(cls, part, items)`` that may be similar enough; all that are, are there.

    Each set is ordered by how few of the sets hold a shingle. Sets of n and m shingles that are similar enough share at
    least ``need(n, m)``; at their first common shingle, so many must still be left in both. A set is listed
    under a shingle once for every range of sizes (``step`` from one to the next) its partners may have, as far as it can
    be the first common one; a partner is listed under its own range. So a shingle that very many hold is split by size,
    and is met only by those that have few rarer ones before it.
    """
    words = sets.select("cls", F.explode("items").alias("item"))
    held = words.groupBy("item").agg(F.count("*").alias("holders"))
    ordered = (
        words.join(held, "item")
        .groupBy("cls")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "item"))).alias("words"))
        .join(sets.select("cls", "part"), "cls")
        .select("cls", "part", F.size("words").cast("long").alias("n"), F.posexplode("words").alias("at", "w"))
        .select("cls", "part", "n", (F.col("n") - F.col("at")).alias("left"), F.col("w.item").alias("item"))
    )

    def need(n: Column, m: Column) -> Column:
        """Shared shingles that make sets of n and m similar enough."""
        return F.ceil(percent * (n + m) / F.lit(100 + percent))

    def range_of(n: Column) -> Column:
        return F.floor(F.log(n.cast("double")) / F.log(F.lit(step))).cast("int")

    least, most = F.ceil(F.col("n") * percent / 100), F.floor(F.col("n") * 100 / percent)
    # ``left`` counts the shingle itself; one set a range lower makes up for rounding.
    ranges = F.sequence(range_of(F.greatest(least, F.lit(1))) - 1, range_of(most) + 1)
    low = F.greatest(least, F.floor(F.pow(F.lit(step), F.col("range")) * (1 - 1e-9)))
    early = ordered.filter(F.col("left") >= need(F.col("n"), least))
    one = early.withColumn("range", F.explode(ranges)).filter(F.col("left") >= need(F.col("n"), low))
    u = one.select("item", "range", F.col("cls").alias("u"), F.col("part").alias("part_u"), F.col("n").alias("n_u"), F.col("left").alias("left_u"))
    v = early.select("item", range_of(F.col("n")).alias("range"), F.col("cls").alias("v"), F.col("part").alias("part_v"), F.col("n").alias("n_v"), F.col("left").alias("left_v"))
    room = F.least("left_u", "left_v") >= need(F.col("n_u"), F.col("n_v"))
    return u.join(v, ["item", "range"]).filter((F.col("u") < F.col("v")) & (F.col("part_u") != F.col("part_v")) & room).select("u", "v")


def linked(docs: DataFrame, words: int, percent: int, bands: int = 24, rows: int = 4, slack: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """The sketches of all documents, and for each class the first row (doc_id and rid) of its group.

    A pair at the limit misses every band with probability (1 - (percent / 100)**rows)**bands: 2e-8 at 85 and 3e-6 at
    80 with 24 bands of 4. ``slack`` is how far below the limit an estimate may lie and still be confirmed on the full
    sets (six standard deviations at 85, five at 80).
    """
    docs = docs.select("doc_id", "text")
    rows_ = checkpointed(sketches(docs, words, bands, rows))
    classes = checkpointed(
        rows_.filter("n_shingles > 0")
        .groupBy("cls")
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("least"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    ).withColumns({"first_doc": F.col("least.doc_id"), "rid": F.col("least.rid")})
    every = classes.select(F.explode("bands").alias("band"), F.col("cls"))
    met = every.groupBy("band").count().filter("count > 1").select("band")
    carriers = classes.join(every.join(met, "band").select("cls").distinct(), "cls").select("rid", "cls")
    facts = classes.select("cls", "n", "sig")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs that sizes and signatures do not rule out."""
        near = percent / 100 - slack
        u = facts.select(F.col("cls").alias("u"), F.col("n").alias("n_u"), F.col("sig").alias("sig_u"))
        v = facts.select(F.col("cls").alias("v"), F.col("n").alias("n_v"), F.col("sig").alias("sig_v"))
        return (
            pairs.distinct()
            .join(u, "u")
            .join(v, "v")
            .filter((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (estimate(F.col("sig_u"), F.col("sig_v"), bands * rows) >= near))
            .select("u", "v")
        )

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            sets, first = shingle_sets(texts_of(batch.column("text")), words)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
            yield pa.record_batch({"cls": batch.column("cls"), "items": lists})

    sets = checkpointed(
        pack(docs).join(carriers, "rid").select("cls", "text").dropDuplicates(["cls"]).mapInArrow(items, "cls long, items array<long>")
    )
    # Shingles that no other candidate has bound what a class can share with any: too many, and it has no link.
    alone = (
        sets.select("cls", F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("holders"), F.min("cls").alias("cls"))
        .filter("holders = 1")
        .groupBy("cls")
        .agg(F.count("*").alias("alone"))
    )
    told = facts.join(sets.select("cls"), "cls").join(alone, "cls", "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    live = told.filter(100 * (F.col("n") - F.col("alone")) >= percent * F.col("n")).select("cls", (F.col("alone") / F.col("n")).alias("alone"))
    members = checkpointed(every.join(live, "cls"))
    # The class with the fewest shingles of its own is the likeliest to be linked with many.
    crowds = members.groupBy("band").agg(
        F.count("*").alias("size"), F.min_by("cls", F.struct("alone", "cls")).alias("one"), F.max_by("cls", F.xxhash64("cls")).alias("other")
    ).filter("size > 1")
    met = checkpointed(members.join(crowds.select("band", "one", "other"), "band"))
    stars = met.select(F.explode(F.array("one", "other")).alias("w"), "cls").filter("w != cls")
    ordered = stars.select(F.least("w", "cls").alias("u"), F.greatest("w", "cls").alias("v"))
    edges = checkpointed(similar_pairs(plausible(ordered), sets, percent))
    parts = components(edges).withColumnsRenamed({"node": "cls", "component": "part"})
    placed = checkpointed(met.select("band", "cls").join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls")))
    apart = placed.groupBy("band").agg((F.min("part") != F.max("part")).alias("apart")).filter("apart").select("band")
    open_ = checkpointed(placed.join(apart, "band").select("cls", "part").distinct())
    across = meeting(open_.join(sets, "cls"), percent)
    more = similar_pairs(plausible(across), sets, percent)
    whole = components(checkpointed(edges.unionByName(more))).withColumnsRenamed({"node": "cls", "component": "part"})
    named = classes.join(whole, "cls", "left").select("cls", "least", F.coalesce("part", "cls").alias("part"))
    lowest = named.groupBy("part").agg(F.min("least").alias("least"))
    return rows_, named.join(lowest.withColumnRenamed("least", "first"), "part").select("cls", "first")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each input row.

    A-Z count as lower case; words are ``[^\\x20\\x09-\\x0D]+``. A document's set are its different runs of ``words``
    words, or all its words as one run where they are fewer. Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id a document reaches, kept says whether that is its own. Null and empty
    texts have no set and no link. A null doc_id is smallest only where there is no other.
    """
    rows, groups = linked(docs, words, percent)
    named = rows.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(groups, "cls", "left")
    component = F.coalesce("first.doc_id", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest doc_id, with all its columns; texts without words all stay."""
    rows, groups = linked(docs, words, percent)
    stay = groups.select(F.col("first.rid").alias("__rid")).distinct()
    some = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.withColumn("__rid", F.xxhash64("doc_id", "text"))
    chosen = marked.filter(some).join(stay, "__rid", "left_semi").dropDuplicates(["__rid"])
    return chosen.unionByName(marked.filter(~some)).drop("__rid")
