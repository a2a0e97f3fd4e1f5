"""Byte-level BPE by overlapping chunks: pre-tokenise chunks side by side, stitch, encode the pieces, decode.

A long text is cut into chunks that overlap. Each chunk is searched for pre-tokens on its own, from its
first character on, so a chunk may begin in the middle of one. What the pattern finds from a place on
depends on nothing before that place; so as soon as two neighbouring chunks both have a boundary at the
same place of their overlap, they agree from there on, and the text is cut there. The pieces between
such places begin and end at true boundaries and are encoded one by one, wherever they lie. A text with
an overlap in which no boundary agrees (one endless word) is put together again and encoded whole.

Short texts are one chunk and one piece and do not move. Rows of one long text, repeated, are computed once.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import pieces, put, spread, worker_store
from .wordsplit import bounds, gather

#: Words a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Longest word, in bytes, that is merged side by side with others of its length.
SIDE_BY_SIDE = 32
#: Words of pieces that are encoded together.
WORDS_AT_ONCE = 200_000
NONE = np.iinfo(np.int32).max


class Merges:
    """Tokens and which pairs of them merge: ``labels[i]`` are token i's bytes, ``pairs`` (left, right) -> (rank, token)."""

    def __init__(self, labels: list[bytes], pairs: dict[tuple[int, int], tuple[int, int]], whole: dict[bytes, int]):
        self.labels, self.whole, self.size = labels, whole, len(labels)
        self.label_bytes, self.label_first = np.frombuffer(b"".join(labels), np.uint8), bounds(labels)
        self.byte = np.zeros(256, np.int64)
        for token, label in enumerate(labels):
            if len(label) == 1:
                self.byte[label[0]] = token
        keys = np.array([a * self.size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        found = np.array(list(pairs.values()), np.int32).reshape(-1, 2)[order]
        self.rank, self.made = np.append(found[:, 0], NONE), np.append(found[:, 1], 0)
        self.pairs = pairs
        self.byte_pair = self._pair(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        self._forget()

    @classmethod
    def of_ranks(cls, file: bytes) -> Merges:
        """From a file of base64 tokens and ranks: any two tokens merge whose bytes together are a token, in order of its rank."""
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}
        labels = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for label, rank in ranks.items():
            labels[rank] = label
            for cut in range(1, len(label)):
                left, right = ranks.get(label[:cut]), ranks.get(label[cut:])
                if left is not None and right is not None:
                    pairs[left, right] = (rank, rank)
        return cls(labels, pairs, ranks)

    def _pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Where each pair stands in the table; its last entry, with no rank, if it does not."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, at, len(self.keys) - 1)

    def _same_length(self, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``n`` bytes, all of them one merge further in each round: the leftmost pair of the lowest rank.

        All their ids, and how many each word has.
        """
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        tokens = self.byte[raw]
        size = np.full(len(words), n)
        pair = self.byte_pair[raw[:, :-1], raw[:, 1:]]
        rows = np.arange(len(words))
        while n > 1 and len(rows):
            ranks = self.rank[pair[rows]]
            ranks[np.arange(n - 1) >= (size[rows] - 1)[:, None]] = NONE
            at = ranks.argmin(axis=1)
            some = ranks[np.arange(len(rows)), at] < NONE
            rows, at = rows[some], at[some]
            if not len(rows):
                break
            new = self.made[pair[rows, at]]
            columns = np.arange(n)
            columns = np.minimum(columns + (columns > at[:, None]), n - 1)
            moved = np.take_along_axis(tokens[rows], columns, axis=1)
            moved[np.arange(len(rows)), at] = new
            tokens[rows] = moved
            size[rows] -= 1
            columns = np.arange(n - 1)
            kept = np.take_along_axis(pair[rows], np.minimum(columns + (columns > at[:, None]), n - 2), axis=1)
            left = at > 0
            kept[left, at[left] - 1] = self._pair(moved[left, at[left] - 1], new[left])
            right = at + 1 < size[rows]
            kept[right, at[right]] = self._pair(new[right], moved[right, at[right] + 1])
            pair[rows] = kept
        return tokens[np.arange(n) < size[:, None]], size

    def _long(self, word: bytes) -> np.ndarray:
        """One long word, its pairs in a heap by rank and place."""
        tokens = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(tokens)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs, alive = self.pairs, [True] * n
        heap = [(found[0], i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (found := pairs.get((tokens[i], tokens[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or tokens[i] != left or tokens[j] != right:
                continue
            tokens[i] = pairs[left, right][1]
            alive[j] = False
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := pairs.get((tokens[i], tokens[k])):
                    heapq.heappush(heap, (found[0], i, tokens[i], tokens[k]))
            h = before[i]
            if h >= 0 and (found := pairs.get((tokens[h], tokens[i]))):
                heapq.heappush(heap, (found[0], h, tokens[h], tokens[i]))
        return np.array([t for t, lives in zip(tokens, alive, strict=True) if lives], np.int32)

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before, those of one length together, and number them."""
        by_length: dict[int, list[str]] = {}
        order, tokens = [], []
        for word in words:
            raw = word.encode()
            token = self.whole.get(raw)
            if token is not None:
                order.append(word)
                tokens.append(token)
            else:
                by_length.setdefault(len(raw), []).append(word)
        paths, sizes = [np.array(tokens, np.int32)], [np.ones(len(tokens), np.int64)]
        for n, same in by_length.items():
            order += same
            if n <= SIDE_BY_SIDE:
                ids, size = self._same_length([w.encode() for w in same], n)
            else:
                long = [self._long(w.encode()) for w in same]
                ids, size = np.concatenate(long), np.array([len(x) for x in long])
            paths.append(ids.astype(np.int32))
            sizes.append(size)
        begin = len(self.numbers)
        self.numbers.update(zip(order, range(begin, begin + len(order)), strict=True))
        ends = self.first[begin] + np.cumsum(np.concatenate(sizes))
        self.paths = put(self.paths, int(self.first[begin]), np.concatenate(paths))
        self.first = put(self.first, begin + 1, ends)

    def _forget(self) -> None:
        """No words: numbers of words, the ids of all of them one after the other, and where each word's begin."""
        self.numbers: dict[str, int] = {}
        self.paths, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as their words, and where each text's begin (one more at the end)."""
        flat = list(chain.from_iterable(texts))
        new = set(flat).difference(self.numbers)
        if new:
            if len(self.numbers) + len(new) > REMEMBERED:
                self._forget()
                new = set(flat)
            self._learn(list(new))
        which = np.fromiter(map(self.numbers.__getitem__, flat), np.int64, len(flat))
        start = self.first[which]
        size = self.first[which + 1] - start
        return self.paths[spread(start, size)], np.append(0, np.cumsum(size))[bounds(texts)]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The bytes of each text's tokens, one after the other."""
        body, at = gather(self.label_bytes, self.label_first, ids)
        whole, ends = body.tobytes(), at[first].tolist()
        return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def merges_of(kind: str, definition: bytes, build) -> Merges:
    """The worker's own compiled tables of a tokenizer file."""
    store, name = worker_store(), (kind, hashlib.sha256(definition).digest())
    if name not in store:
        store[name] = build(definition)
    return store[name]


def packed(ids: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each text's ids as unsigned 32-bit integers, little-endian, as token files have them."""
    whole, ends = ids.astype("<u4").tobytes(), (4 * first).tolist()
    return [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def boundaries(pattern: regex.Pattern, text: str) -> list[int]:
    """Where matches end: the places from which the search goes on."""
    return [m.end() for m in pattern.finditer(text)]


def within(pattern: regex.Pattern, text: str, size: int) -> list[str]:
    """The matches of a piece that ends at a boundary after ``size`` characters; the text goes on a little."""
    return [m.group() for m in pattern.finditer(text) if m.end() <= size]


def encode_and_decode(docs: DataFrame, path: str, pattern: str, chunk: int = 16_384, overlap: int = 512, reach: int = 3) -> DataFrame:
    """Every whole text as ids and back: doc_id, ids (binary: unsigned 32-bit, little-endian), decoded (binary), a row for each input row.

    ``path`` names a rank file, read by the driver and sent to the tasks (its size does not depend on the documents).
    ``pattern`` cuts texts into words that are encoded separately; it must not look behind a word, nor at more than ``reach``
    characters after it. Texts of more than ``chunk`` characters are cut into chunks that overlap by ``overlap``.
    No string is a special token. A null text is empty: no ids, no bytes. Null and repeated ids and repeated rows stay as they are.
    """
    if not reach < overlap < chunk // 2:
        raise ValueError("chunks must be more than twice their overlap, and that more than the reach")
    with open(path, "rb") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def tables() -> Merges:
        return merges_of("ranks", definition.value, Merges.of_ranks)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, words = tables(), regex.compile(pattern)
        for batch in pieces(batches):
            ids, first = merges.encode([words.findall(x or "") for x in batch.column("text").to_pylist()])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": pa.array(packed(ids, first), pa.binary()), "decoded": pa.array(merges.decode(ids, first), pa.binary())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text, step = row["text"], chunk - overlap
                count = -(-(len(text) - overlap) // step)
                for begin in range(0, count, 64):
                    part = range(begin, min(count, begin + 64))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "k1": [row["k1"]] * len(part), "k2": [row["k2"]] * len(part), "doc_id": pa.array([row["doc_id"]] * len(part), pa.int64()),
                            "chunk": pa.array(part, pa.int32()), "last": [i == count - 1 for i in part], "body": [text[i * step : i * step + chunk] for i in part],
                        }
                    )

    def seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for last, body in zip(batch.column("last").to_pylist(), batch.column("body").to_pylist(), strict=True):
                found = [0, *boundaries(words, body)]
                heads.append([b for b in found if b <= overlap])
                # A boundary too near the end may be one only because the chunk ends; places are counted from the next chunk's start.
                tails.append([] if last else [b - (chunk - overlap) for b in found if chunk - overlap <= b <= len(body) - reach])
            keys = {c: batch.column(c) for c in ("k1", "k2", "chunk", "last")}
            yield pa.record_batch({**keys, "heads": pa.array(heads, pa.list_(pa.int32())), "tails": pa.array(tails, pa.list_(pa.int32()))})

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, words = tables(), regex.compile(pattern)
        kinds = {"k1": pa.int64(), "k2": pa.int64(), "part": pa.int32(), "doc_id": pa.int64(), "copies": pa.int64()}

        def out(held: list[tuple[dict, list[str]]]) -> pa.RecordBatch:
            ids, first = merges.encode([found for _, found in held])
            return pa.record_batch({**{c: pa.array([r[c] for r, _ in held], t) for c, t in kinds.items()}, "ids": pa.array(packed(ids, first), pa.binary())})

        held, size = [], 0
        for rows in runs(batches, ("k1", "k2", "part")):
            found = words.findall("".join(r["body"] for r in rows)) if rows[0]["size"] is None else within(words, rows[0]["body"], rows[0]["size"])
            held.append(({c: rows[0][c] for c in kinds}, found))
            size += len(found)
            if size >= WORDS_AT_ONCE:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = tables()
        for rows in runs(batches, ("k1", "k2")):
            ids = np.frombuffer(b"".join(r["ids"] for r in rows), "<u4")
            decoded = merges.decode(ids.astype(np.int64), np.array([0, len(ids)]))
            yield pa.record_batch({"doc_id": pa.array([rows[0]["doc_id"]], pa.int64()), "copies": [rows[0]["copies"]], "ids": pa.array([ids.tobytes()], pa.binary()), "decoded": pa.array(decoded, pa.binary())})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long = F.length("text") > chunk
    short = source.filter(~long).mapInArrow(whole, "doc_id long, ids binary, decoded binary")

    key = ["k1", "k2", "chunk"]
    named = source.filter(long).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("chunk"), "text", "doc_id").alias("k2"))
    chunks = (
        named.mapInArrow(cut, "k1 long, k2 long, doc_id long, chunk int, last boolean, body string")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("doc_id"), F.first("last").alias("last"), F.first("body").alias("body"), F.count("*").alias("copies"))
    )
    along = W.partitionBy("k1", "k2").orderBy("chunk")
    common = F.array_min(F.array_intersect("heads", F.lag("tails").over(along)))
    found = chunks.select(*key, "last", "body").mapInArrow(seams, "k1 long, k2 long, chunk int, last boolean, heads array<int>, tails array<int>")
    places = (
        found.withColumn("begin", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(common))
        .withColumn("after", F.lead("begin").over(along))
        .withColumn("lost", F.max(F.col("begin").isNull()).over(W.partitionBy("k1", "k2")))
        .select(*key, "begin", "after", "lost")
    )
    step = chunk - overlap
    begin = F.when(F.col("lost"), 0).otherwise(F.col("begin"))
    end = F.when(F.col("last"), F.length("body")).when(F.col("lost"), step).otherwise(F.col("after") + step)
    seen = end - begin + F.when(F.col("lost"), 0).otherwise(reach)  # what follows a piece decides how its last word ends
    parts = chunks.join(places, key).select(
        "k1", "k2", F.when(F.col("lost"), 0).otherwise(F.col("chunk")).alias("part"), "chunk", "doc_id", "copies",
        F.when(~F.col("lost"), end - begin).alias("size"), F.substring(F.col("body"), begin + 1, seen).alias("body"),
    )
    placed = parts.repartition("k1", "k2", "part").sortWithinPartitions("k1", "k2", "part", "chunk")
    done = placed.mapInArrow(encoded, "k1 long, k2 long, part int, doc_id long, copies long, ids binary")
    ordered = done.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part")
    joined = ordered.mapInArrow(together, "doc_id long, copies long, ids binary, decoded binary")
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return short.unionByName(joined.withColumn("copy", every).select("doc_id", "ids", "decoded"))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[dict]]:
    """Neighbouring rows with equal keys, as lists."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and any(held[0][k] != row[k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held
