"""Exact substring deduplication over bytes by two-stage suffix sorting.

Spark finds the stretches of text whose windows may occur twice (``segments``) and brings those that
share a gram together. A task then builds one suffix array over its stretches: it sorts directly only
the suffixes smaller than their successors, induces all others by one scan over the buckets of first
bytes, and compares neighbours for a common prefix of the full length. Equal stretches are sorted
once, with the number of their copies, so thousands of copies cost what one costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import joined, rows_of, texts_of
from .segments import Kind, by_group, candidates, contents, grouped, pack, unpacked


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; ``data`` ends with eight spare bytes."""
    return np.ndarray(len(data) - 7, ">u8", data, strides=(1,))


def _sorted_directly(eights: np.ndarray, at: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """``at`` ordered by their texts up to ``depth`` bytes; ``left``: bytes before the stretch ends, which sorts first."""
    shift = np.array([64, 56, 48, 40, 32, 24, 16, 8, 0], np.uint64)

    def word(i: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        rest = np.clip(left[i] - step, 0, 8)
        value = eights[at[i] + np.minimum(step, left[i])].astype(np.uint64)
        cut = shift[rest]
        return np.where(rest == 0, 0, (value >> np.minimum(cut, 63)) << np.minimum(cut, 63)), rest

    value, rest = word(np.arange(len(at)), 0)
    order = np.lexsort((rest, value))
    value, rest = value[order], rest[order]
    tied = np.zeros(len(at), bool)  # equal to the one before
    tied[1:] = (value[1:] == value[:-1]) & (rest[1:] == 8) & (rest[:-1] == 8)
    for step in range(8, depth, 8):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        slots = np.flatnonzero(inside)
        if not len(slots):
            break
        items, joins = order[slots], tied[slots]
        value, rest = word(items, step)
        differs = joins.copy()
        differs[1:] &= (value[1:] != value[:-1]) | (rest[1:] != rest[:-1])
        group = np.cumsum(~joins)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        if mixed.any():  # only groups whose next eight bytes are not all the same are sorted again
            pick = np.flatnonzero(mixed[group])
            again = pick[np.lexsort((rest[pick], value[pick], group[pick]))]
            items[pick], value[pick], rest[pick] = items[again], value[again], rest[again]
            order[slots] = items
        same = joins & (rest == 8)
        same[1:] &= (value[1:] == value[:-1]) & (rest[:-1] == 8)
        tied[slots] = same
    return at[order]


def suffix_order(data: np.ndarray, first: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The places first[i] .. first[i] + starts[i] - 1 of each stretch i, ordered by their text up to ``depth`` bytes.

    Stretch i is ``data[first[i]:first[i + 1]]`` and ends before anything; ``data`` has eight spare bytes at its end.
    Two-stage sorting: a place whose suffix is smaller than the next one's is sorted directly, any other is found
    by scanning the sorted places bucket by bucket and taking the place before each.
    """
    n = int(first[-1])
    body = data[:n]
    last = np.zeros(n, bool)
    last[first[1:] - 1] = True
    up = np.zeros(n, np.int8)  # 1: smaller than the next, -1: greater, 0: same byte as the next
    np.sign(body[1:].astype(np.int16) - body[:-1].astype(np.int16), out=up[:-1], casting="unsafe")
    up[last] = -1
    known = np.where(up != 0, np.arange(n), n)
    known = np.minimum.accumulate(known[::-1])[::-1]
    small = up[known] > 0
    # Needed: the starts, and what follows them up to the first place that is sorted directly.
    row_end = first[1:] - 1
    next_small = np.minimum.accumulate(np.where(small, np.arange(n), n)[::-1])[::-1]
    until = np.minimum(next_small[first[:-1] + starts - 1], row_end)
    wanted = np.zeros(n + 1, np.int32)
    wanted[first[:-1]] += 1
    np.subtract.at(wanted, until + 1, 1)
    wanted = np.cumsum(wanted[:-1]) > 0
    direct = np.flatnonzero(wanted & small)
    end_of = np.repeat(first[1:], np.diff(first))
    direct = _sorted_directly(_words_at(data), direct, end_of[direct] - direct, depth)
    direct_by_byte = np.split(direct, np.searchsorted(body[direct], np.arange(1, 256)))
    seeds = np.flatnonzero(wanted & last & ~small)
    seeds = seeds[np.argsort(body[seeds], kind="stable")]
    begins = np.zeros(n, bool)
    begins[first[:-1]] = True
    pending: list[list[np.ndarray]] = [[x] for x in np.split(seeds, np.searchsorted(body[seeds], np.arange(1, 256)))]
    out: list[np.ndarray] = []

    def induce(found: np.ndarray, byte: int) -> np.ndarray:
        """File the greater places before ``found`` under their bytes; returns those of this bucket."""
        before = found[~begins[found]] - 1
        before = before[~small[before]]
        heads = body[before]
        far = before[heads > byte]
        if len(far):
            by = body[far]
            order = np.argsort(by, kind="stable")
            far, by = far[order], by[order]
            cuts = np.flatnonzero(np.diff(by)) + 1
            for part in np.split(far, cuts):
                pending[body[part[0]]].append(part)
        return before[heads == byte]

    for byte in range(256):
        now = np.concatenate(pending[byte])
        while len(now):
            out.append(now)
            now = induce(now, byte)
        if len(direct_by_byte[byte]):
            out.append(direct_by_byte[byte])
            induce(direct_by_byte[byte], byte)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def equal_runs(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For places in suffix order, whether each has a common prefix of ``length`` bytes with the one before."""
    eights = _words_at(data)
    same = np.zeros(len(order), bool)
    left = np.arange(1, len(order))
    for step in [*range(0, length - 7, 8), length - 8]:
        left = left[eights[order[left] + step] == eights[order[left - 1] + step]]
    same[left] = True
    return same


def repeated_windows(texts_data: np.ndarray, first: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For each place whether a window of ``length`` bytes starts there that occurs twice or more."""
    data = np.append(texts_data, np.zeros(8, np.uint8))
    starts = np.diff(first) - length + 1
    order = suffix_order(data, first, starts, length)
    row = rows_of(first)
    window = order[order - first[row[order]] < starts[row[order]]]
    same = equal_runs(data, window, length)
    head = np.flatnonzero(~same)
    total = np.add.reduceat(copies[row[window]], head) if len(head) else np.zeros(0, np.int64)
    flags = np.zeros(len(texts_data), bool)
    flags[window] = np.repeat(total > 1, np.diff(np.append(head, len(window))))
    return flags


def _mark(kind: Kind, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "group", most):
            texts = texts_of(batch.column("tokens"))
            flags = repeated_windows(texts.data, texts.starts, batch.column("copies").to_numpy(), kind.length)
            edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            row = rows_of(texts.starts)[begin]  # a run never leaves its stretch: the last places of one start no window
            took = pa.array(row)
            yield pa.record_batch(
                {
                    "key": batch.column("key").take(took),
                    "seg": batch.column("seg").take(took),
                    "from": (begin - texts.starts[row] + batch.column("off").to_numpy()[row]).astype(np.int32),
                    "number": (end - begin).astype(np.int32),
                }
            )

    return work


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64, memory: int = 2 << 20) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts anywhere else.

    Strings are judged on the input, all occurrences go, and they never cross documents.
    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: what is left), one row
    for each input row. Null and empty texts have no bytes; a row repeated in full is two occurrences.
    """
    kind = Kind("byte", length, min(gram, length), 256)
    docs = docs.select("doc_id", "text")
    found = candidates(docs, kind, across=False)
    packed = pack(docs)
    rows, windows = contents(packed, found, kind)
    marks = by_group(rows).mapInArrow(_mark(kind, memory), "key long, seg long, from int, number int")
    if windows is not None:
        marks = marks.unionByName(windows.drop("low"))
    spans = (
        found.join(marks, ["key", "seg"])
        .select("rid", (F.col("place") + F.col("from")).alias("at"), F.col("number"))
        .distinct()
        .groupBy("rid")
        .agg(F.collect_list(F.struct("at", (F.col("at") + F.col("number") + F.lit(length - 1)).alias("to"))).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            texts = texts_of(batch.column("text"))
            out: dict[str, list] = {"n_removed": [], "n_spans": [], "kept": []}
            for i, spans in enumerate(batch.column("spans")):
                body = texts.data[texts.starts[i] : texts.starts[i + 1]]
                removed = spanned = 0
                if spans.is_valid:
                    at, to = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("at", "to"))
                    order = np.argsort(at, kind="stable")
                    at, to = joined(at[order], to[order])
                    edge = np.zeros(len(body) + 1, np.int8)
                    edge[at] += 1
                    edge[to] -= 1
                    body = body[np.cumsum(edge[:-1]) == 0]
                    removed, spanned = int((to - at).sum()), len(at)
                for name, value in zip(out, (removed, spanned, body.tobytes()), strict=True):
                    out[name].append(value)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_bytes": np.diff(texts.starts), **out})

    return packed.join(spans, "rid", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
