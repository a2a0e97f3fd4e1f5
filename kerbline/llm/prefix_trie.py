"""Conversations as a prefix trie: one node for each different sequence of first turns, with sums over its subtree.

A prefix is named by two 64-bit digests: the exclusive or of hashes of its turns together with their
positions, so digests of all prefixes are running values, found in two levels. Grouping by digest gives
the nodes, and checks that every member agrees on the last turn (and so, going up, on all of them).

Subtree sums are worked out in shards. A shard is whole subtrees of at most so many turns; inside it every
node gets a slot of a minimal perfect hash over the digests, checked against the stored ones; counts are
scattered into flat arrays by slot and added up through an array of parent slots, deepest nodes first. What
hangs together above the shards is a far smaller trie, on whose nodes the shards' sums are put; it goes
the same way with a larger bound, until the root is done.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrays import U64, mix
from .segments import grouped

#: Turns below a subtree that is worked out in one piece, and by how much the bound grows from level to level.
SUBTREE, WIDER = 4096, 4096
#: Turns of a conversation that are ordered together.
STRETCH = 4096
WORD = r"[^\x20\x09-\x0D]+"
SUMS = ("n_children", "n_leaves", "saved_tokens")
#: What a node brings along, with its type.
FIELDS = {"d1": "long", "d2": "long", "depth": "int", "conv_id": "long", "n_convs": "long", "words": "long", "p1": "long", "p2": "long"}


def running(rows: DataFrame, order: list, slot: Column, values: dict[str, tuple[Callable[[str], Column], Column]]) -> DataFrame:
    """Running values of each conversation up to each row: within slots of the order, and of earlier slots (``<name>_before``)."""
    here = W.partitionBy("conv_id", "slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("conv_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("slot", slot).withColumns({f"__{n}": v for n, (_, v) in values.items()})
    ends = local.groupBy("conv_id", "slot").agg(*[f(f"__{n}").alias(n) for n, (f, _) in values.items()])
    before = ends.select("conv_id", "slot", *[f(n).over(earlier).alias(f"{n}_before") for n, (f, _) in values.items()])
    done = local.withColumns({n: f(f"__{n}").over(here) for n, (f, _) in values.items()})
    return done.join(before, ["conv_id", "slot"]).drop("slot", *[f"__{n}" for n in values])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), a and b (two hashes of role and text), words. Null roles and texts are empty.

    By turn, null first; turns with the same number by their hashes. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit("b"), text, role).alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    slot = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 60))).cast("long")
    numbered = running(turns, [F.asc_nulls_first("turn"), "a", "b"], slot, {"n": (F.sum, F.lit(1).cast("long"))})
    return numbered.select("conv_id", (F.col("n") + F.coalesce("n_before", F.lit(0))).alias("pos"), "a", "b", "words")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: their turns (conv_id, pos, a, b, words), and all of them (conv_id, length).

    Conversation c begins with the first h turns of conversation c - c % every (all if it has fewer, none if there is no
    such one) and goes on with its own after its first h; h is the unsigned CRC-32 of c's decimal digits modulo ``most``.
    """
    turns = checkpointed(turns)  # a few numbers a turn, read by everything that follows
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    first = turns.filter((c % every == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "g")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"g": c - c % every, "h": h})
    taken = convs.join(first, "g").filter(F.col("pos") <= F.col("h"))
    sizes = first.groupBy("g").agg(F.count("*").alias("heads"))
    lengths = convs.join(sizes, "g", "left").select(
        "conv_id", F.least("h", F.coalesce("heads", F.lit(0))).alias("shared"), "h", F.greatest(F.col("own") - F.col("h"), F.lit(0)).alias("rest")
    )
    own = turns.filter(F.col("pos") > h).join(lengths, "conv_id").withColumn("pos", F.col("pos") - F.col("h") + F.col("shared"))
    columns = ["conv_id", "pos", "a", "b", "words"]
    return taken.select(columns).unionByName(own.select(columns)), lengths.select("conv_id", (F.col("shared") + F.col("rest")).alias("length"))


def step_of(depth: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """What a turn at a depth adds to the two digests."""
    return F.xxhash64(depth.cast("long"), a, b), F.xxhash64(b, a, depth.cast("long"), F.lit(2))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """All prefixes of all conversations, the empty one too: conv_id, depth, d1, d2, a, b, words, length."""
    one, two = step_of(F.col("pos"), F.col("a"), F.col("b"))
    walked = running(turns, ["pos"], F.floor((F.col("pos") - 1) / STRETCH), {"x": (F.bit_xor, one), "y": (F.bit_xor, two)})
    digest = {"d1": F.col("x").bitwiseXOR(F.coalesce("x_before", F.lit(0))), "d2": F.col("y").bitwiseXOR(F.coalesce("y_before", F.lit(0)))}
    some = walked.withColumns(digest).withColumn("depth", F.col("pos").cast("int")).join(convs, "conv_id")
    zero = F.lit(0).cast("long")
    none = convs.select("conv_id", F.lit(0).alias("depth"), *[zero.alias(n) for n in ("d1", "d2", "a", "b", "words")], "length")
    return some.select(none.columns).unionByName(none)


def nodes_of(paths: DataFrame) -> DataFrame:
    """One row for each different prefix: digests, depth, conv_id (smallest member), n_convs, words, the parent's digests, turns below."""
    found = paths.groupBy("d1", "d2").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth")).alias("below"),
        F.max("words").alias("words"), F.max("depth").alias("depth"), F.max("a").alias("a"), F.max("b").alias("b"),
        (F.min("depth") < F.max("depth")).alias("other_depth"), ((F.min("a") < F.max("a")) | (F.min("b") < F.max("b"))).alias("other_turn"),
    )
    up1, up2 = step_of(F.col("depth"), F.col("a"), F.col("b"))
    same = F.when(F.col("other_depth") | F.col("other_turn"), F.raise_error(F.lit("two different prefixes have one digest"))).otherwise(F.col("n_convs"))
    root = F.col("depth") == 0
    return found.select(
        "d1", "d2", "depth", "conv_id", same.cast("long").alias("n_convs"), "words",
        F.when(root, F.lit(0)).otherwise(F.col("d1").bitwiseXOR(up1)).alias("p1"), F.when(root, F.lit(0)).otherwise(F.col("d2").bitwiseXOR(up2)).alias("p2"), "below",
    )


class Slots:
    """A minimal perfect hash: in each level keys that fall on a place alone keep it, the others go to the next level."""

    def __init__(self, d1: np.ndarray, d2: np.ndarray):
        n = len(d1)
        self.d1, self.d2, self.salt = np.zeros(n, U64), np.zeros(n, U64), 0
        while True:
            self.levels, left = [], self._key(d1, d2)
            placed = 0
            while len(left) and len(self.levels) < 64:
                size = 2 * len(left) + 1
                place = self._place(left, len(self.levels), size)
                alone = np.bincount(place, minlength=size) == 1
                self.levels.append((alone, placed + np.cumsum(alone) - 1))
                placed += int(alone.sum())
                left = left[~alone[place]]
            if not len(left):
                break
            self.salt += 1  # two digests gave one key: take other keys
        at = self._slots(d1, d2)
        self.d1[at], self.d2[at] = d1, d2

    def _key(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        return mix(d1 + U64(self.salt)) ^ d2

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = U64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
        return (mix(keys + salt) % U64(size)).astype(np.int64)

    def _slots(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        keys, out = self._key(d1, d2), np.full(len(d1), -1, np.int64)
        open_ = np.arange(len(d1))
        for level, (alone, rank) in enumerate(self.levels):
            place = self._place(keys[open_], level, len(alone))
            hit = alone[place]
            out[open_[hit]] = rank[place[hit]]
            open_ = open_[~hit]
        return out

    def find(self, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        """The slot of each digest, -1 where the table holds another one there or none."""
        at = self._slots(d1, d2)
        return np.where((at >= 0) & (self.d1[at] == d1) & (self.d2[at] == d2), at, -1) if len(self.d1) else at


def accumulated(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Of whole subtrees the rows with n_children, n_leaves and saved_tokens, to which what their fields hold already is added."""
    column = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in rows.schema.names if c != "cut"}
    digest = [column[c].view(np.uint64) for c in ("d1", "d2", "p1", "p2")]
    slots = Slots(*digest[:2])
    at = slots.find(*digest[:2])
    if (at < 0).any() or len(np.unique(at)) < len(at):
        raise ValueError("a node has no slot of its own")
    n = len(at)
    depth, parent = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    children, leaves, saved = (np.zeros(n, np.int64) for _ in SUMS)
    depth[at] = column["depth"]
    parent[at] = np.where(column["depth"] > 0, slots.find(*digest[2:]), -1)
    children[at], leaves[at] = column["n_children"], column["n_leaves"]
    saved[at] = column["saved_tokens"] + (column["n_convs"] - 1) * column["words"]
    inner = parent >= 0
    children += np.bincount(parent[inner], minlength=n)
    leaves[children == 0] = 1
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    for same in np.split(order, cuts):
        same = same[inner[same]]
        np.add.at(leaves, parent[same], leaves[same])
        np.add.at(saved, parent[same], saved[same])
    sums = {"n_children": children[at], "n_leaves": leaves[at], "saved_tokens": saved[at]}
    return pa.record_batch({**{c: rows.column(c) for c in FIELDS}, **{c: pa.array(x) for c, x in sums.items()}, "top": pa.array(parent[at] < 0)})


def shard_sums(nodes: DataFrame) -> DataFrame:
    """``accumulated`` over whole shards; rows of one ``cut`` come together, many small ones in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "cut", 4 << 20):
            yield accumulated(batch)

    fields = ", ".join(f"{name} {kind}" for name, kind in [*FIELDS.items(), *((s, "long") for s in SUMS), ("top", "boolean")])
    return nodes.repartition("cut").sortWithinPartitions("cut").mapInArrow(work, fields)


def trie_nodes(paths: DataFrame) -> DataFrame:
    """All nodes with their sums over subtrees, the parent's smallest member, and the digest of the members that end there."""
    paths = checkpointed(paths)
    nodes = checkpointed(nodes_of(paths))
    turns = nodes.agg(F.max("below")).first()[0] or 0
    bounds = [SUBTREE]
    while bounds[-1] < turns:
        bounds.append(bounds[-1] * WIDER)
    # The top of the subtree a node is worked out in is the first place on its path with few enough turns below.
    size = paths.select("conv_id", "d1", "d2").join(nodes.select("d1", "d2", "depth", "below"), ["d1", "d2"])
    tops = [F.min(F.when(F.col("below") <= most, F.struct("depth", "d1"))).getField("d1").alias(f"top_{k}") for k, most in enumerate(bounds)]
    left = nodes.join(size.groupBy("conv_id").agg(*tops), "conv_id").withColumns({s: F.lit(0).cast("long") for s in SUMS})
    done = []
    for k, most in enumerate(bounds):
        low = (F.col("below") <= most) & (F.col("below") > (bounds[k - 1] if k else -1))
        names = [c for c in left.columns if not c.startswith("top_")]
        part = checkpointed(shard_sums(left.filter(low).select(*names, F.col(f"top_{k}").alias("cut"))))
        done.append(part)
        if k + 1 == len(bounds):
            break
        hung = part.filter("top AND depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"))
        given = hung.agg(F.count("*").alias("add_n_children"), *[F.sum(s).alias(f"add_{s}") for s in SUMS[1:]])
        above = left.filter(F.col("below") > most).join(given, ["d1", "d2"], "left")
        left = checkpointed(above.withColumns({s: F.col(s) + F.coalesce(f"add_{s}", F.lit(0)) for s in SUMS}).select(left.columns))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    parents = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).alias("at"))
    ends = end_digests(paths.filter("depth = length").select("d1", "d2", "conv_id"))
    with_ends = whole.join(ends, ["d1", "d2"], "left")
    return with_ends.withColumn("at", F.when(F.col("depth") > 0, F.lit(1))).join(parents, ["p1", "p2", "at"], "left").select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", *SUMS, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """d1, d2, SHA-256 of the conv_ids that end there, in numerical order, joined by commas; fed to the hash as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = digest = None
        for batch in batches:
            ids = batch.column("conv_id")
            d1, d2 = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
            new = np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])) if len(d1) else np.zeros(0, bool)
            begins = np.flatnonzero(new)
            out = []
            for begin, stop in zip(begins.tolist(), [*begins[1:].tolist(), len(d1)], strict=True):
                text = ",".join(map(str, ids.slice(begin, stop - begin).to_pylist())).encode()
                now = (int(d1[begin]), int(d2[begin]))
                if now == key:
                    digest.update(b"," + text)
                    continue
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text)
            yield rows(out)
        yield rows([(*key, digest.hexdigest())] if key is not None else [])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch({"d1": pa.array([r[0] for r in out], pa.int64()), "d2": pa.array([r[1] for r in out], pa.int64()), "ends_sha256": pa.array([r[2] for r in out], pa.string())})

    return ends.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(work, "d1 long, d2 long, ends_sha256 string")


def shared_prefix_trie(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations, one row a node (the textless root is depth 0).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Rows without conv_id are left out; null turns come first; null roles and texts are empty; repeated rows
    are turns of their own. An empty table has no nodes.
    """
    return trie_nodes(prefixes(*with_shared_starts(ordered_turns(conversations), every, most)))
