"""The leading digits of very many md5 texts at once, as numbers, by numpy."""

from __future__ import annotations

import math

import numpy as np

#: Messages that go through the steps together: few calls, and arrays that stay in a core's cache.
LANES = 32_768
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def _word(value: int) -> np.ndarray:
    return np.array([value & 0xFFFFFFFF], np.uint32)


_START = [_word(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SINES = [_word(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_LEFT = [_word(s) for s in _TURNS]
_RIGHT = [_word(32 - s) for s in _TURNS]


def text_words(texts: np.ndarray, shift: int) -> np.ndarray:
    """Texts of one length, ``(n, bytes)``, and the bit behind them as rows of words, ``shift`` bytes into the first."""
    n, length = texts.shape
    raw = np.zeros((n, (shift + length) // 4 * 4 + 4), np.uint8)
    raw[:, shift : shift + length] = texts
    raw[:, shift + length] = 0x80
    return np.ascontiguousarray(raw.view("<u4").astype(np.uint32, copy=False).T)


def leading(heads: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """``(heads, texts)``: the first eight hex digits of the md5 of every head followed by every text.

    ``heads`` is ``(m, bytes)``; ``words`` are those of texts of ``length`` bytes, as ``text_words`` makes them with a
    shift of the heads' length modulo 4.
    """
    m, size = heads.shape
    n = words.shape[1]
    whole, rest = divmod(size, 4)
    padded = np.zeros((m, (whole + 1) * 4), np.uint8)
    padded[:, :size] = heads
    front = padded.view("<u4").astype(np.uint32, copy=False).T
    blocks = (size + length + 8) // 64 + 1
    out = np.empty((m, n), np.uint32)
    # Either some heads with all texts or one head with some texts at a time.
    at_once = max(1, LANES // n)
    step = math.ceil(n / math.ceil(n / LANES))
    for top in range(0, m, at_once):
        some = front[:, top : top + at_once]
        k = some.shape[1]
        for low in range(0, n, step):
            part = words[:, low : low + step]
            w = part.shape[1]
            spread = (lambda v: np.repeat(v, w)) if k > 1 else (lambda v: v)
            message = [_word(0)] * (16 * blocks)
            message[:whole] = [spread(np.ascontiguousarray(v)) for v in some[:whole]]
            message[whole : whole + len(part)] = [np.tile(v, k) for v in part] if k > 1 else list(part)
            if rest:
                message[whole] = message[whole] | spread(np.ascontiguousarray(some[whole]))
            message[-2], message[-1] = _word((size + length) * 8), _word((size + length) >> 29)
            state = _START
            for b in range(blocks):
                state = _block(state, message[16 * b : 16 * b + 16], k * w, b == blocks - 1)
            out[top : top + k, low : low + w] = state[0].byteswap().reshape(k, w)
    return out


def _block(state: list[np.ndarray], message: list[np.ndarray], lanes: int, last: bool) -> list[np.ndarray]:
    """The state after a block; words of one entry are the same for all lanes. Of the last block only the first word is worked out."""
    a, b, c, d = state
    f, t = np.empty(lanes, np.uint32), np.empty(lanes, np.uint32)
    wide = 0  # registers made here that are as long as the lanes, so may be written over
    for i in range(61 if last else 64):
        word = message[_WORD[i]]
        if wide < 4:
            wide += wide > 0 or max(map(len, (a, b, c, d, word))) > 1
            mix = d ^ (b & (c ^ d)) if i < 16 else c ^ (d & (b ^ c)) if i < 32 else b ^ c ^ d if i < 48 else c ^ (b | ~d)
            mixed = mix + a + _SINES[i] + word
            a, b, c, d = d, ((mixed << _LEFT[i]) | (mixed >> _RIGHT[i])) + b, b, c
            if wide and len(b) < lanes:
                b = np.repeat(b, lanes)
            continue
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if len(word) == 1:
            np.add(f, _SINES[i] + word, f)
        else:
            np.add(f, word, f)
            np.add(f, _SINES[i], f)
        np.left_shift(f, _LEFT[i], t)
        np.right_shift(f, _RIGHT[i], f)
        np.bitwise_or(f, t, f)
        np.add(f, b, a)
        a, b, c, d = d, a, b, c
    # After 61 steps the first register of the end is still the second.
    return [b + state[0]] if last else [x + y for x, y in zip((a, b, c, d), state, strict=True)]
