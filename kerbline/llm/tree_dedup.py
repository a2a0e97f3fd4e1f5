"""Removal of long repeated word passages by prefix-partitioned suffix trees.

Spark brings together the stretches of text whose windows may repeat (``segments``): windows that are
equal are always in one group; those of crowded groups are combined by their hashes instead. A task divides
its suffixes by prefixes that are lengthened until each part is small enough, orders each part into a
subtree (suffixes in order with the words that neighbours share), and reads the repeats off the nodes
at the depth of a whole window: all leaves below such a node start with the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import joined, rows_of, spread, texts_of, words_of
from .segments import Kind, by_group, candidates, contents, grouped, pack, unpacked


def prefix_parts(tokens: np.ndarray, at: np.ndarray, length: int, most: int) -> Iterator[np.ndarray]:
    """``at`` in parts of at most ``most`` suffixes, where those that share a whole window stay together.

    A part that is too large is split by its suffixes' next token; small neighbours are put together again.
    """
    waiting = [(at, 0)]
    while waiting:
        part, depth = waiting.pop()
        if len(part) <= most or depth == length:
            yield part
            continue
        value = tokens[part + depth]
        order = np.argsort(value, kind="stable")
        part, value = part[order], value[order]
        edge = np.append(np.flatnonzero(np.append(True, value[1:] != value[:-1])), len(part))
        size = np.diff(edge)
        for i in np.flatnonzero(size > most):
            waiting.append((part[edge[i] : edge[i + 1]], depth + 1))
        begin = 0
        for i, n in enumerate(size):
            if n > most or edge[i + 1] - edge[begin] > most:
                if edge[i] > edge[begin]:
                    yield part[edge[begin] : edge[i]]
                begin = i + 1 if n > most else i
        if edge[-1] > edge[begin]:
            yield part[edge[begin] :]


def subtree(tokens: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of ``at`` down to ``length`` tokens: its leaves in order, and the depth of the node
    that joins each leaf with the one before."""
    order = at[np.argsort(tokens[at], kind="stable")]
    value = tokens[order]
    tied = np.zeros(len(at), bool)
    tied[1:] = value[1:] == value[:-1]
    depth = tied.astype(np.int16)
    for step in range(1, length):
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        slots = np.flatnonzero(inside)
        if not len(slots):
            break
        items, joins = order[slots], tied[slots]
        value = tokens[items + step]
        differs = joins.copy()
        differs[1:] &= value[1:] != value[:-1]
        group = np.cumsum(~joins)
        mixed = np.zeros(group[-1] + 1, bool)
        mixed[group[differs]] = True
        if mixed.any():
            pick = np.flatnonzero(mixed[group])
            again = pick[np.lexsort((value[pick], group[pick]))]
            items[pick], value[pick] = items[again], value[again]
            order[slots] = items
        same = joins
        same[1:] &= value[1:] == value[:-1]
        tied[slots] = same
        depth[slots[same]] += 1
    return order, depth


def first_documents(tokens: np.ndarray, first: np.ndarray, docs: np.ndarray, length: int, most: int = 1 << 18) -> np.ndarray:
    """For each place the smallest document of all windows equal to the one there; -1 where none starts.

    Stretch i is ``tokens[first[i]:first[i + 1]]`` of document ``docs[i]``.
    """
    size = np.diff(first) - length + 1
    at = spread(first[:-1], size)
    row = np.zeros(len(tokens), np.int64)
    row[at] = np.repeat(np.arange(len(size)), size)
    out = np.full(len(tokens), -1, np.int64)
    for part in prefix_parts(tokens, at, length, most):
        leaves, depth = subtree(tokens, part, length)
        head = np.flatnonzero(depth < length)
        least = np.minimum.reduceat(docs[row[leaves]], head)
        out[leaves] = np.repeat(least, np.diff(np.append(head, len(leaves))))
    return out


def _mark(kind: Kind, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, "group", most):
            texts = texts_of(batch.column("tokens"))
            first = texts.starts // 8
            low = first_documents(np.ascontiguousarray(texts.data).view(np.uint64), first, batch.column("first_doc").to_numpy(), kind.length)
            row = rows_of(first)
            inner = np.zeros(len(low), bool)
            inner[spread(first[:-1], np.diff(first) - kind.length + 1)] = True
            begin = inner.copy()
            begin[1:] &= ~inner[:-1] | (low[1:] != low[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(begin)
            stop = np.minimum(np.append(begin[1:], len(low)), (first[1:] - kind.length + 1)[row[begin]])
            row = row[begin]
            took = pa.array(row)
            yield pa.record_batch(
                {
                    "key": batch.column("key").take(took),
                    "seg": batch.column("seg").take(took),
                    "from": (begin - first[row] + batch.column("off").to_numpy()[row]).astype(np.int32),
                    "number": (stop - begin).astype(np.int32),
                    "low": low[begin],
                }
            )

    return work


def kept_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words joined by one space."""
    size = end - start + 1
    body = np.append(data, np.uint8(32))[spread(start, size)]
    body[np.cumsum(size) - 1] = 32
    return body[:-1].tobytes()


def remove_passages(docs: DataFrame, length: int = 50, gram: int = 10, memory: int = 4 << 20) -> DataFrame:
    """Remove every word covered by ``length`` consecutive words that also start in a document of smaller doc_id.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared unchanged; windows are judged on the input. Returns rid (of doc_id
    and text), doc_id, n_words, n_removed and kept (the kept words joined by one space), one row for each input row. Null and
    empty texts have no words. A null doc_id is smaller than any; rows of one doc_id do not remove each other's words.
    """
    gram = min(gram, length)
    kind = Kind("word", length, gram, 128, (length - gram) // 2)
    docs = docs.select("doc_id", "text")
    found = candidates(docs, kind, across=True)
    packed = pack(docs)
    rows, windows = contents(packed, found, kind)
    marks = by_group(rows).mapInArrow(_mark(kind, memory), "key long, seg long, from int, number int, low long")
    if windows is not None:
        marks = marks.unionByName(windows)
    spans = (
        found.join(marks, ["key", "seg"])
        .filter("low < doc_id")
        .select("rid", (F.col("place") + F.col("from")).alias("at"), F.col("number"))
        .distinct()
        .groupBy("rid")
        .agg(F.collect_list(F.struct("at", (F.col("at") + F.col("number") + F.lit(length - 1)).alias("to"))).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            texts = texts_of(batch.column("text"))
            start, end, first = words_of(texts)
            out: dict[str, list] = {"n_removed": [], "kept": []}
            for i, spans in enumerate(batch.column("spans")):
                begins, ends = start[first[i] : first[i + 1]], end[first[i] : first[i + 1]]
                removed = 0
                if spans.is_valid:
                    at, to = (spans.values.field(c).to_numpy().astype(np.int64) for c in ("at", "to"))
                    order = np.argsort(at, kind="stable")
                    at, to = joined(at[order], to[order])
                    removed = int((to - at).sum())
                    edge = np.zeros(len(begins) + 1, np.int8)
                    edge[at] += 1
                    edge[to] -= 1
                    keep = np.cumsum(edge[:-1]) == 0
                    begins, ends = begins[keep], ends[keep]
                base = texts.starts[i]
                kept = kept_words(texts.data[base : texts.starts[i + 1]], begins - base, ends - base)
                for name, value in zip(out, (removed, kept.decode()), strict=True):
                    out[name].append(value)
            yield pa.record_batch({"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "n_words": np.diff(first), **out})

    return packed.join(spans, "rid", "left").select("rid", "doc_id", "text", "spans").mapInArrow(
        cut, "rid long, doc_id long, n_words long, n_removed long, kept string"
    )


def without_passages(docs: DataFrame) -> DataFrame:
    """The documents with the words left by ``remove_passages`` as their text; a text that loses nothing stays as it is."""
    cut = remove_passages(docs).filter("n_removed > 0").select(F.col("rid").alias("__rid"), F.col("kept").alias("__kept")).dropDuplicates(["__rid"])
    text = F.coalesce("__kept", "text")
    joined_ = docs.withColumn("__rid", F.xxhash64("doc_id", "text")).join(cut, "__rid", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        joined_ = joined_.withColumn("n_chars", F.when(F.col("__kept").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return joined_.select(*docs.columns)
