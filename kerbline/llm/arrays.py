"""Vector work on the texts of an Arrow batch: words, rolling hashes and windows as numpy arrays.

Everything here looks at UTF-8 bytes. Words are runs without the six ASCII white-space
characters; a null text is an empty one. Hashes have 64 bits: stretches are sums of their values
times a random number for each place, grams are built from two shorter ones that overlap or
meet. Neither is a polynomial, whose powers regular texts can cancel out.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
PIECE_BYTES = 1 << 20


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, for tables built once in it."""
    name = "kerbline_worker_store"
    if name not in sys.modules:
        module = types.ModuleType(name)
        module.values = {}
        sys.modules[name] = module
    return sys.modules[name].values


def forget() -> None:
    """Drop the words and tokenizers that earlier work left in this worker; small tables stay.

    Workers live on from stage to stage, and what they remember would add up.
    """
    store = worker_store()
    large = [name for name in store if not isinstance(name, str)]
    for name in large:
        del store[name]
    if large:
        gc.collect()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library keeps what is freed to itself
            pass


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finalizer of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Texts(NamedTuple):
    """The bytes of some rows, one after the other; row i is ``data[starts[i]:starts[i + 1]]``."""

    data: np.ndarray
    starts: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[ends[0] : ends[-1]], ends - ends[0])


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that a piece holds about ``most`` bytes of text or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = texts_of(batch.column(text)).starts
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def byte_values() -> np.ndarray:
    """A random 64-bit value for each of the 256 bytes."""
    store = worker_store()
    if "bytes" not in store:
        store["bytes"] = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
    return store["bytes"]


def multipliers(n: int) -> np.ndarray:
    """A random odd number for each of the first ``n`` places of a stretch."""
    store = worker_store()
    have = store.get("multipliers")
    if have is None or len(have) < n:
        have = store["multipliers"] = mix(np.arange(1, max(n, 4096) + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
    return have


def put_together(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One hash of two, in their order."""
    x = left * U64(0xA24BAED4963EE407) + right
    x ^= x >> U64(32)
    x *= U64(0x9FB21C651E98DF25)
    return x


class Hashes:
    """Hashes of stretches of a sequence of 64-bit values that are themselves hashes."""

    def __init__(self, values: np.ndarray):
        self.values = values

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Hashes:
        return cls(byte_values()[data])

    def between(self, start: np.ndarray, end: np.ndarray, step: int = 1) -> np.ndarray:
        """Hash of each stretch, from every ``step``-th of its values; the work is in proportion to what is read."""
        size = end - start
        out = size.astype(U64) * U64(0xA24BAED4963EE407)
        some = np.flatnonzero(size > 0)
        if len(some):
            count = -(-size[some] // step)
            begin = np.cumsum(count) - count
            place = np.arange(int(count.sum())) - np.repeat(begin, count)
            at = place * step + np.repeat(start[some], count) if step > 1 else place + np.repeat(start[some], count)
            out[some] += np.add.reduceat(self.values[at] * multipliers(int(count.max()))[place], begin)
        return mix(out)

    def apart(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for stretches in order that do not overlap: one pass over the values, whatever the stretches."""
        size = end - start
        n = len(self.values)
        begin = np.zeros(n, np.int64)
        inner = start[start < n]
        begin[inner] = inner
        place = np.arange(n)
        place -= np.maximum.accumulate(begin)
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.values * multipliers(int(size.max(initial=0))).take(place, mode="clip"), out=sums[1:])
        return mix(size.astype(U64) * U64(0xA24BAED4963EE407) + sums[end] - sums[start])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k values from each place on, as far as there are k."""
        n = len(self.values) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        made, size = self.values, 1
        while 2 * size <= k:
            made = put_together(made[: len(made) - size], made[size:])
            size *= 2
        if size < k:
            made = put_together(made[:n] + U64(1), made[k - size : k - size + n])
        return mix(made[:n].copy())


def covered(grams: np.ndarray, k: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each stretch of ``size`` values, at least k, from the k-grams that cover it."""
    last = grams[start + size - k]
    return mix(Hashes(grams).between(start, start + size - k + 1, k) + last * U64(3) + size.astype(U64))


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


class Words(NamedTuple):
    start: np.ndarray  #: first byte of each word
    end: np.ndarray  #: byte after it
    first: np.ndarray  #: row i has the words first[i]:first[i + 1]


def words_of(texts: Texts) -> Words:
    data, starts = texts
    inside = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, starts))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, where row i has the items first[i]:first[i + 1]."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of x[i:i + w] for each i: minima of blocks from both ends, met in the middle."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    ahead = np.minimum.accumulate(padded.reshape(blocks, w), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def joined(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching stretches, ordered by start, as few longest ones."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], np.maximum.reduceat(end, at)


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... length[i] of them, for each i."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    return np.arange(total) - np.repeat(begin - start, length)


def put(held: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """The array with ``values`` from ``at`` on; it grows by doubling, so that adding little costs little."""
    need = at + len(values)
    if need > len(held):
        held = np.concatenate([held[:at], np.zeros(max(need, 2 * len(held)) - at, held.dtype)])
    held[at:need] = values
    return held
