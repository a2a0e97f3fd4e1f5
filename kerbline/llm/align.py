"""Tokens of two tokenizers side by side: which overlap, where both have a boundary, and how usual each link is.

Documents are walked in lockstep. A document's tokens are dealt into lanes of so many A tokens; a lane starts
at its first A token and at the B token that covers its first byte. One state vector holds where all lanes
of a batch stand in A and in B: in each step every lane gives one link, the side whose token ends first moves
on, both move where they end together, which is a cut, and lanes that are through leave the vector. The links
of different lanes are different links, so lanes only shorten the walk.

How often an id pair is linked is counted over all documents: the different pairs of a block of documents
are counted together, added up over the blocks, and the totals go back to the blocks that asked for them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrays import pieces, spread, texts_of, worker_store
from .bpe_automaton import byte_letters
from .chunked_bpe import Merges, merges_of
from .wordsplit import bounds, gather

#: A tokens of a lane.
LANE = 256
#: Links of a block of documents whose different pairs are counted together.
BLOCK_LINKS = 4_000_000
#: A pair is one number: the A id times this, plus the B id.
PAIR = 1 << 31


def merges_of_file(definition: bytes) -> Merges:
    """A byte-level BPE file with its merges in order; special tokens are not looked for."""
    model = json.loads(definition)["model"]
    letters, vocabulary = byte_letters(), model["vocab"]
    labels = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        if all(c in letters for c in token):
            labels[i] = bytes(letters[c] for c in token)
    pairs: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        pairs.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
    return Merges(labels, pairs, {})


class Pieces:
    """A sentencepiece model, and the bytes of its pieces: a blank for U+2581, one byte for <0xHH>."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        labels = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            labels.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        self.label_bytes, self.label_first = np.frombuffer(b"".join(labels), np.uint8), bounds(labels)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.model.encode(texts, num_threads=1) if texts else []
        first = bounds(ids)
        return np.fromiter((i for x in ids for i in x), np.int64, int(first[-1])), first


class Side(NamedTuple):
    """Tokens of some texts: text i has the tokens first[i]:first[i + 1]; ``end`` counts bytes over all texts."""

    ids: np.ndarray
    first: np.ndarray
    end: np.ndarray


def side_of(ids: np.ndarray, first: np.ndarray, label_first: np.ndarray) -> Side:
    return Side(ids.astype(np.int64), first, np.cumsum(np.diff(label_first)[ids]))


def without(side: Side, texts: np.ndarray, label_first: np.ndarray) -> Side:
    """The same without the tokens of some texts."""
    size = np.where(texts, 0, np.diff(side.first))
    return side_of(side.ids[spread(side.first[:-1], size)], np.append(0, np.cumsum(size)), label_first)


def walk(a_end: np.ndarray, b_end: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token) of lanes walked in lockstep, and whether both tokens of a link end together (a cut)."""
    i, j, stop = a_from.copy(), b_from.copy(), a_to
    links = []
    going = i < stop
    i, j, stop = i[going], j[going], stop[going]
    while len(i):
        ea, eb = a_end[i], b_end[j]
        links.append((i, j, ea == eb))
        i, j = i + (ea <= eb), j + (eb <= ea)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    if not links:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, bool)
    left, right, cut = (np.concatenate(x) for x in zip(*links, strict=True))
    order = np.lexsort((right, left))
    return left[order], right[order], cut[order]


def links_of(a: Side, b: Side, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All links of some texts whose tokens cover the same bytes on both sides, in order, and which are cuts."""
    size = np.diff(a.first)
    lanes = -(-size // lane)
    start = np.repeat(a.first[:-1], lanes) + spread(np.zeros(len(lanes), np.int64), lanes) * lane
    stop = np.minimum(start + lane, np.repeat(a.first[1:], lanes))
    byte = np.append(0, a.end)[start]
    return walk(a.end, b.end, start, stop, np.searchsorted(b.end, byte, "right"))


def digit_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below n, set to the right, with a place for a sign after them; and how many there are."""
    width = len(str(max(1, n - 1)))
    numbers = np.arange(n)
    digits = np.stack([numbers // 10 ** (width - 1 - k) % 10 for k in range(width)], axis=1).astype(np.uint8) + np.uint8(48)
    count = np.maximum(1, np.sum(numbers[:, None] >= 10 ** np.arange(width), axis=1))
    return np.concatenate([digits, np.zeros((n, 1), np.uint8)], axis=1), count


def written(a: Side, b: Side, a_cut: np.ndarray, b_cut: np.ndarray) -> list[bytes]:
    """Groups of each text: A ids, a bar, B ids; commas inside, semicolons between. ``*_cut``: the token ends a group."""
    n = max(int(a.ids.max(initial=0)), int(b.ids.max(initial=0))) + 1
    store = worker_store()
    if store.get("digits", (np.zeros((0, 0)),))[0].shape[0] < n:
        store["digits"] = digit_table(max(n, 1 << 16))
    table, count = store["digits"]
    group_a, group_b = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
    a_after, b_after = np.cumsum(np.bincount(group_a, minlength=1)), np.cumsum(np.bincount(group_b, minlength=1))
    at_a = np.arange(len(a.ids)) + np.append(0, b_after)[group_a]  # B tokens of earlier groups stand before
    at_b = np.arange(len(b.ids)) + a_after[group_b] if len(b.ids) else np.zeros(0, np.int64)
    ids, sign = np.empty(len(at_a) + len(at_b), np.int64), np.empty(len(at_a) + len(at_b), np.uint8)
    ids[at_a], ids[at_b] = a.ids, b.ids
    sign[at_a], sign[at_b] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
    body = table[ids]
    body[:, -1] = sign
    width = body.shape[1]
    flat = body[np.arange(width) >= (width - 1 - count[ids])[:, None]].tobytes()
    ends = np.append(0, np.cumsum(count[ids] + 1))[a.first + b.first].tolist()
    return [flat[x : max(x, y - 1)] for x, y in zip(ends, ends[1:], strict=False)]


def equal_bytes(sides: tuple[tuple[np.ndarray, np.ndarray], ...], ids: np.ndarray, first: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text whether its tokens' bytes are the given ones."""
    label_bytes, label_first = sides
    body, at = gather(label_bytes, label_first, ids)
    ends = at[first]
    same = np.diff(ends) == np.diff(starts)
    if same.all():
        wrong = body != data
        total = np.append(0, np.cumsum(wrong))
        return total[ends[1:]] == total[ends[:-1]]
    return np.array([same[k] and np.array_equal(body[ends[k] : ends[k + 1]], data[starts[k] : starts[k + 1]]) for k in range(len(same))], bool)


SCHEMA = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, counts binary"
COUNTED = "block long, pair long, n long, best boolean"


def numbers(values: np.ndarray) -> bytes:
    """Whole numbers, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def read_numbers(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def steps(values: np.ndarray) -> np.ndarray:
    """The first value and the differences that follow; ``cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def digest(groups: bytes) -> str:
    return hashlib.sha256(groups).hexdigest() if groups else ""


def aligned(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, hashed: bool) -> DataFrame:
    """Documents with their alignment, and blocks with their different pairs (``groups`` null): the columns of SCHEMA."""
    keep = digest if hashed else bytes.decode
    context = docs.sparkSession.sparkContext
    with open(byte_file, "rb") as file:
        bytewise = context.broadcast(file.read())
    with open(piece_file, "rb") as file:
        piecewise = context.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of("merges", bytewise.value, merges_of_file)
        pieces_ = merges_of("pieces", piecewise.value, Pieces)
        words = regex.compile(pattern)
        number = TaskContext.get().partitionId() << 32
        held, links = [], 0
        for batch in pieces(batches):
            ids = batch.column("doc_id")
            texts = [x or "" for x in batch.column("text").to_pylist()]
            spaced = [" " + t if t else "" for t in texts]
            plain = texts_of(pa.array(spaced, pa.large_string()))
            a_ids, a_first = merges.encode([words.findall(t) for t in spaced])
            b_ids, b_first = pieces_.encode(texts)
            good = equal_bytes((merges.label_bytes, merges.label_first), a_ids, a_first, *plain)
            good &= equal_bytes((pieces_.label_bytes, pieces_.label_first), b_ids, b_first, *plain)
            a = without(side_of(a_ids, a_first, merges.label_first), ~good, merges.label_first)
            b = without(side_of(b_ids, b_first, pieces_.label_first), ~good, pieces_.label_first)
            left, right, cut = links_of(a, b)
            a_cut, b_cut = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
            a_cut[left[cut]] = b_cut[right[cut]] = True
            row = np.searchsorted(a.first, left, "right") - 1
            n_groups = np.bincount(row[cut], minlength=len(texts))
            at = np.append(0, np.cumsum(np.bincount(row, minlength=len(texts))))
            pair = a.ids[left] * PAIR + b.ids[right]
            some = [np.unique(pair[x:y], return_counts=True) for x, y in zip(at.tolist(), at[1:].tolist(), strict=False)]
            yield pa.record_batch(
                {
                    "block": pa.array(np.full(len(texts), number)), "doc_id": ids,
                    "n_a": pa.array(np.diff(a.first)), "n_b": pa.array(np.diff(b.first)), "n_groups": pa.array(n_groups), "n_links": pa.array(np.diff(at)),
                    "groups": pa.array([keep(w) for w in written(a, b, a_cut, b_cut)], pa.string()),
                    "pairs": pa.array([numbers(steps(p)) for p, _ in some], pa.binary()), "counts": pa.array([numbers(c.astype(np.uint32)) for _, c in some], pa.binary()),
                }
            )
            held.append(np.unique(pair, return_counts=True))
            links += len(pair)
            if links >= BLOCK_LINKS:
                yield block_row(number, held)
                number, held, links = number + 1, [], 0
        if held:
            yield block_row(number, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SCHEMA)


def listed(blocks: DataFrame) -> DataFrame:
    """The different pairs of each block, a row each: block, pair, n."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "counts")), strict=True):
                pair, count = np.cumsum(read_numbers(pairs, np.int64)), read_numbers(counts, np.int64)
                for at in range(0, len(pair), 1 << 16):
                    part = pair[at : at + (1 << 16)]
                    yield pa.record_batch({"block": pa.array(np.full(len(part), block)), "pair": pa.array(part), "n": pa.array(count[at : at + (1 << 16)])})

    return blocks.select("block", "pairs", "counts").mapInArrow(work, "block long, pair long, n long")


def alignment(docs: DataFrame, byte_file: str, piece_file: str, pattern: str, hashed: bool = False) -> DataFrame:
    """Each document's tokens under both tokenizers, aligned: one row for each input row.

    doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is linked most often of all pairs with its B id), count_sum
    (how often the pairs of all links are linked in all documents), groups (``a1,a2|b1;a3|b2,b3``: ids between places where
    both have a boundary; with ``hashed`` its SHA-256).

    A is a byte-level BPE file over a blank and the text, cut into words by ``pattern``; B a sentencepiece model that adds the
    blank itself; strings of special tokens are plain text. Null and empty texts, and those whose tokens do not spell the
    blank and the text (the model reads U+2581 as a blank), have no tokens: zeros and ''. Null and repeated ids and rows
    stay as they are; repeated rows count.
    """
    found = checkpointed(aligned(docs, byte_file, piece_file, pattern, hashed))
    pairs = listed(found.filter("groups IS NULL"))
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    # At most as many pairs as A has tokens share a B id.
    most = F.max("total").over(W.partitionBy(F.col("pair") % PAIR))
    marked = totals.withColumn("best", F.col("total") == most)
    answers = pairs.select("block", "pair").join(marked, "pair").select("block", "pair", F.col("total").alias("n"), "best")

    def sums(rows: pa.Table, told: pa.Table) -> pa.Table:
        pair, n, best = (told.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order]
        n_best, count_sum = [], []
        for own, times in zip(rows.column("pairs").to_pylist(), rows.column("counts").to_pylist(), strict=True):
            at = np.searchsorted(pair, np.cumsum(read_numbers(own, np.int64)))
            times = read_numbers(times, np.uint32).astype(np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * n[at]).sum()))
        return rows.drop_columns(["block", "pairs", "counts"]).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))

    own = found.filter("groups IS NOT NULL").groupBy("block")
    done = own.cogroup(answers.groupBy("block")).applyInArrow(
        sums, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long"
    )
    return done.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def block_row(number: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    pair, count = added(held)
    none = pa.array([None], pa.int64())
    return pa.record_batch(
        {
            "block": pa.array([number], pa.int64()), **{c: none for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "groups": pa.array([None], pa.string()),
            "pairs": pa.array([numbers(steps(pair))], pa.binary()), "counts": pa.array([numbers(count)], pa.binary()),
        }
    )


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of several lists, and their counts added up."""
    which, pair = pd.factorize(np.concatenate([p for p, _ in held]))
    count = np.bincount(which, np.concatenate([c for _, c in held]), len(pair)).astype(np.int64)
    order = np.argsort(pair)
    return pair[order], count[order]
