"""Byte-level BPE encoding and decoding with a tokenization automaton.

A state is the token read last; an arc is the next token. At first every token may follow every
token. Each merge ``u v -> w``, in order of priority, is one gadget: whatever could go on with ``u``
may now go on with ``w``; ``w`` goes on as ``v`` did; and ``v`` may no longer follow ``u``. The
automaton is deterministic and has exactly one path whose labels spell a given word, which is the
word's encoding. Its arcs are not written out (there are billions): the gadgets are kept as tables
(left part, right part, order), and an arc is looked up through the gadgets that made it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import pieces, worker_store
from .wordsplit import bounds, gather, split

#: Words a worker remembers before it starts anew.
REMEMBERED = 300_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file: itself where printable, else from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    def __init__(self, definition: str):
        file = json.loads(definition)
        vocabulary, merges = file["model"]["vocab"], file["model"]["merges"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.labels = [b""] * size
        for token, i in vocabulary.items():
            if token not in self.special:
                self.labels[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.labels[i] = token.encode()
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.gadget: dict[int, int] = {}  # (u, v) as one number: when v stopped to follow u
        self.size = size
        self.trie: dict = {}
        self.known: dict[int, bool] = {}
        for i, label in enumerate(self.labels):
            if len(label) == 1:
                self._file(label, i)
        for order, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges):
            u, v, w = vocabulary[a], vocabulary[b], vocabulary[a + b]
            usable = self._open(u, v, order) and self.born[w] < 0
            self.gadget.setdefault(u * size + v, order)
            if usable:
                self.left[w], self.right[w], self.born[w] = u, v, order
                self._file(self.labels[w], w)

    def _file(self, label: bytes, token: int) -> None:
        node = self.trie
        for byte in label:
            node = node.setdefault(byte, {})
        node[-1] = token

    def _open(self, a: int, b: int, before: int) -> bool:
        """Whether b may follow a once the gadgets up to ``before`` (not included) are built in."""
        size, gadget, born = self.size, self.gadget, self.born
        while True:
            order = gadget.get(a * size + b)
            if order is not None and order < before:
                return False
            made_a, made_b = born[a], born[b]
            if made_a < 0 and made_b < 0:
                return True
            if made_b > made_a:
                b, before = self.left[b], made_b + 1
            elif made_a > made_b:
                a, before = self.right[a], made_a
            else:
                a, b, before = self.right[a], self.left[b], made_a

    def follows(self, a: int, b: int) -> bool:
        arc = a * self.size + b
        known = self.known.get(arc)
        if known is None:
            known = self._open(a, b, len(self.labels) + 1)
            if len(self.known) < 2_000_000:
                self.known[arc] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The one path that spells ``word``: from each place reached, every arc whose label fits is followed."""
        n = len(word)
        last = [-1] * (n + 1)
        follows = self.follows
        for i in range(n):
            state = last[i]
            if i and state < 0:
                continue
            node = self.trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                token = node.get(-1)
                if token is not None and last[j + 1] < 0 and (not i or follows(state, token)):
                    last[j + 1] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(self.labels[last[at]])
        return out[::-1]


class Codec:
    """Texts to ids and back. Each different word of a batch takes its path through the automaton once."""

    def __init__(self, definition: str):
        self.automaton = Automaton(definition)
        names = sorted(self.automaton.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.words: dict[str, np.ndarray] = {}
        labels = self.automaton.labels
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_first = bounds(labels)

    def _word(self, word: str) -> np.ndarray:
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        made = self.words[word] = np.array(self.automaton.encode(word.encode()), np.int32)
        return made

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more at the end)."""
        if self.special and any(map(self.special.search, texts)):
            return self._with_special(texts)
        first, which, words = split(texts, keep_white=True)
        get, make = self.words.get, self._word
        paths = [x if (x := get(w)) is not None else make(w) for w in words]
        ids, at = gather(np.concatenate(paths or [np.zeros(0, np.int32)]), bounds(paths), which)
        return ids, at[first]

    def _with_special(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for text in texts:
            parts = self.special.split(text)
            ids, first = self.encode(parts[::2])
            own = [ids[first[0] : first[1]]]
            for k, name in enumerate(parts[1::2]):
                own += [np.array([self.automaton.special[name]], np.int32), ids[first[k + 1] : first[k + 2]]]
            out.append(np.concatenate(own))
        return np.concatenate(out), bounds(out)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """The labels of each text's arcs, one after the other."""
        body, at = gather(self.label_bytes, self.label_first, ids)
        whole, ends = body.tobytes(), at[first].tolist()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]


def codec_of(definition: str) -> Codec:
    """The worker's own compiled automaton of a tokenizer file."""
    store, name = worker_store(), ("bpe", hashlib.sha256(definition.encode()).digest())
    if name not in store:
        store[name] = Codec(definition)
    return store[name]


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Every whole text as ids and back: doc_id, ids (array) and decoded (string), one row for each input row.

    ``path`` names a byte-level BPE file, read by the driver and sent to the tasks (its size does not depend on the
    documents). Special tokens' strings in a text are those tokens. A null text is empty: no ids, empty text.
    """
    with open(path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(definition.value)
        for batch in pieces(batches):
            ids, first = codec.encode([x or "" for x in batch.column("text").to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "ids": lists, "decoded": codec.decode(ids, first)})

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>, decoded string")
