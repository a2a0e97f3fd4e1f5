"""Best-fit packing of token sequences by minimum bin slack.

Documents are encoded where they lie; only lengths travel. How many pieces there are of each length
(at most as many lengths as a sequence holds tokens) decides the packing: a bin takes the longest
length left and then the combination of the others that fills it best, found by a subset-sum over
bits. The same combination is used as often as the counts allow, so the plan's size follows from
the number of lengths, not from the number of documents. Pieces then take their places by their
rank among the pieces of their length.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrays import pieces, put, spread, worker_store
from .wordsplit import bounds, split

REMEMBERED = 300_000  #: words a worker remembers before it starts anew
CELLS = 256  #: parts in which the pieces of one length are numbered


class Encoder:
    """Ids of whole texts as the file's own tokenizer gives them; each different word of a batch is encoded once."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        """No words: numbers of words, the ids of all of them one after the other, and where each word's begin."""
        self.words: dict[str, int] = {}
        self.paths, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Words follow each other in one text; each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            single = [self.tokenizer.encode(word, add_special_tokens=False).ids for word in words]
            ids, cuts = np.array([i for own in single for i in own], np.uint32), bounds(single)[1:]
        begin = len(self.words)
        self.words.update(zip(words, range(begin, begin + len(words)), strict=True))
        end = self.first[begin] + cuts
        self.paths = put(self.paths, int(self.first[begin]), ids)
        self.first = put(self.first, begin + 1, end)

    def _odd(self, text: str) -> bool:
        """Texts whose normal form is not a matter of single letters go to the tokenizer as they are."""
        return not text.isascii() and ("Σ" in text or not unicodedata.is_normalized("NFC", text)) or any(x in text for x in self.special)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more at the end)."""
        odd = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if self._odd(t)}
        first, which, words = split(["" if i in odd else t.lower() for i, t in enumerate(texts)], keep_white=False)
        if new := [w for w in words if w not in self.words]:
            if len(self.words) + len(new) > REMEMBERED:
                self._forget()
                new = words
            self._learn(new)
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))[which]
        start = self.first[number]
        size = self.first[number + 1] - start
        ids = self.paths[spread(start, size)]
        first = np.append(0, np.cumsum(size))[first]
        if odd:
            parts = [odd.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(first, first[1:], strict=False))]
            ids, first = np.concatenate(parts), bounds(parts)
        return ids, first


def encoder_of(definition: str) -> Encoder:
    store, name = worker_store(), ("words", hashlib.sha256(definition.encode()).digest())
    if name not in store:
        store[name] = Encoder(definition)
    return store[name]


def cut(docs: DataFrame, path: str, capacity: int, end: int) -> DataFrame:
    """doc_id, piece, start, length and ids of every document's pieces; a document is its ids and then ``end``."""
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(definition.value)
        for batch in pieces(batches):
            ids, first = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
            n = np.diff(first)
            ids = np.insert(ids, first[1:], end)
            first = first + np.arange(len(first))
            parts = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            at = first[row] + start
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").take(pa.array(row)),
                    "piece": piece.astype(np.int32),
                    "start": start,
                    "length": np.minimum(capacity, n[row] + 1 - start),
                    "ids": lists,
                }
            )

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, piece int, start long, length long, ids array<int>")


class Place(NamedTuple):
    """Ranks ``rank`` to ``rank + used * bins - 1`` of a length go, ``used`` to a bin, to the bins from ``bin`` on."""

    length: int
    rank: int
    used: int
    bin: int
    offset: int
    bins: int


def fullest(first: int, lengths: list[int], left: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the fullest bin that holds ``first``; as many bits as tokens say what is reachable."""
    space = capacity - first
    target, full = 1 << space, (1 << (space + 1)) - 1
    reach, seen = 1, []
    for length in lengths:
        number = min(left[length] - (length == first), space // length)
        if number <= 0:
            continue
        seen.append((length, number, reach))
        step = 1
        while number > 0:  # 1, 2, 4 ... copies and the rest
            step = min(step, number)
            reach |= (reach << (length * step)) & full
            number -= step
            step *= 2
        if reach & target:
            break
    total = reach.bit_length() - 1
    taken = {first: 1}
    for length, number, before in reversed(seen):
        copies = next(k for k in range(number + 1) if total >= k * length and before >> (total - k * length) & 1)
        if copies:
            taken[length] = taken.get(length, 0) + copies
            total -= copies * length
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[Place]:
    """Bins for all pieces, longest lengths first; ``counts``: how many pieces each length has."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left, reverse=True)
    rank = dict.fromkeys(lengths, 0)
    places, bins = [], 0
    while lengths:
        taken = fullest(lengths[0], lengths, left, capacity)
        times = min(left[n] // k for n, k in taken.items())
        offset = 0
        for n, k in taken.items():
            places.append(Place(n, rank[n], k, bins, offset, times))
            rank[n] += k * times
            left[n] -= k * times
            offset += n * k
        bins += times
        if any(not left[n] for n in taken):
            lengths = [n for n in lengths if left[n]]
    return places


def pack(docs: DataFrame, path: str, capacity: int = 4096, end: int = 1) -> DataFrame:
    """All documents in as few sequences of at most ``capacity`` tokens as minimum bin slack finds.

    Returns doc_id, piece, start, length, ids_crc32 (of the piece's ids as little-endian 32-bit numbers), sequence_id and
    offset (its place in the sequence). Only documents longer than a sequence are cut, into whole sequences and a rest.
    A null or empty text is the end id alone. ``cut`` gives the ids themselves.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            body, at = lists.values.to_numpy().view(np.uint8), (lists.offsets.to_numpy() * 4).tolist()
            crc = [zlib.crc32(body[a:b]) for a, b in zip(at, at[1:], strict=False)]
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length")}
            yield pa.record_batch({**columns, "ids_crc32": pa.array(crc, pa.int64())})

    slim = "doc_id long, piece int, start long, length long, ids_crc32 long"
    found = checkpointed(
        cut(docs, path, capacity, end).mapInArrow(sums, slim).withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS)))
    )
    cells = found.groupBy("length", "cell").count()
    places = plan({r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).toLocalIterator()}, capacity)
    by_length: dict[int, list[Place]] = {}
    for place in places:
        by_length.setdefault(place.length, []).append(place)
    table = docs.sparkSession.sparkContext.broadcast({n: np.array([p[1:] for p in ps], np.int64) for n, ps in by_length.items()})
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    begins = cells.select("length", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("begins"))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("nth", F.row_number().over(inside)).join(begins, ["length", "cell"])

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                own = table.value[int(n)]
                row = own[np.searchsorted(own[:, 0], rank[at], "right") - 1]
                nth = rank[at] - row[:, 0]
                sequence[at] = row[:, 2] + nth // row[:, 1]
                offset[at] = row[:, 3] + nth % row[:, 1] * n
            columns = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch({**columns, "sequence_id": sequence, "offset": offset})

    wide = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("begins") + F.col("nth") - 1).alias("rank"))
    return wide.mapInArrow(seat, slim + ", sequence_id long, offset long")
