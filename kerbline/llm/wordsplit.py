"""Where a tokenizer's words begin, for whole batches of texts at once, and each different word once.

The two patterns are those of the public byte-level and word-end BPE files. They are followed by
rules on classes of code points (letter, number, white space, other) instead of a search, so a batch
costs a few passes over arrays.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import regex

from .arrays import U64, Hashes, spread, worker_store

LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0
# The white space of Unicode, as first and last code points.
WHITE_RANGES = ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point."""
    store = worker_store()
    table = store.get("classes")
    if table is None:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for found in regex.finditer(pattern, every):
                table[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] = kind
        for low, high in WHITE_RANGES:
            table[low : high + 1] = WHITE
        store["classes"] = table
    return table[codes]


class Split(NamedTuple):
    """Words of some texts: text i has the words first[i]:first[i + 1]; ``which`` names each word's text in ``words``."""

    first: np.ndarray
    which: np.ndarray
    words: list[str]


def split(texts: list[str], keep_white: bool) -> Split:
    """The words of each text.

    ``keep_white``: runs of a class, with one blank before them taken in; white space is kept (byte-level files).
    Without it: runs of letters or others and single numbers; white space is left out (word-end files).
    A quote that begins a word, followed by s, t, m, d, re, ve or ll, is a word with these letters.
    """
    whole = "".join(texts)
    n = len(whole)
    ends = bounds(texts)
    if not n:
        return Split(np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), [])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes(codes)
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[ends] = True
    begins = edge.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    if keep_white:
        last = np.flatnonzero((kind[:-1] == WHITE) & (kind[1:] != WHITE) & ~edge[1:n])
        begins[last] = True
        begins[last[codes[last] == 32] + 1] = False
    else:
        begins[:n] |= kind == NUMBER
    quotes = np.flatnonzero((codes == 39) & begins[:n])
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~edge[quotes + 1]]
    for size, letters in ((1, "s"), (1, "t"), (1, "m"), (1, "d"), (2, "re"), (2, "ve"), (2, "ll")):
        at = quotes[quotes + size < n]
        for k, letter in enumerate(letters):
            at = at[(codes[at + 1 + k] == ord(letter)) & ~edge[at + 1 + k]]
        begins[at + 1] = False
        begins[at + 1 + size] = True
    start = np.flatnonzero(begins[:n])
    end = np.append(start[1:], n)
    if not keep_white:
        some = kind[start] != WHITE
        start, end = start[some], end[some]
    hashes = Hashes(codes.astype(U64) + U64(1)).apart(start, end)
    which, different = pd.factorize(hashes)
    at = np.empty(len(different), np.int64)
    at[which[::-1]] = np.arange(len(which))[::-1]
    return Split(np.searchsorted(start, ends), which, [whole[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])


def bounds(items: list) -> np.ndarray:
    """Where each item begins if all stand one after the other, and the end."""
    return np.cumsum([0] + [len(x) for x in items], dtype=np.int64)


def gather(values: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[i]:first[i + 1]] for each i of ``which``, one after the other, and where each begins."""
    size = np.diff(first)[which]
    return values[spread(first[:-1][which], size)], np.append(0, np.cumsum(size))
