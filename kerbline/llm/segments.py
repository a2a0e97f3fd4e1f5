"""Where long windows may repeat: runs of windows that share their smallest gram.

A window is ``length`` consecutive tokens of one document (bytes, or words). Its key is the
smallest hash among the grams inside it, or the hash of that gram with ``reach`` tokens beside it, on the side
where the window has them; so equal windows have equal keys, wherever they stand, and a gram
that different passages share does not make candidates of them unless its neighbourhood is shared too.
Neighbouring windows mostly have the same key; such a run of windows is one segment, kept as
``(key, seg, rid, doc_id, place, n)``: hash of the segment's tokens, the document, the first
window's place and the number of windows. Only segments whose key occurs elsewhere are looked
at token by token, and equal segments are looked at once.

``rid`` is a hash of doc_id and text, so repeated or null ids do no harm: rows equal in both are
told apart by counting only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrays import U64, Hashes, Texts, byte_values, covered, forget, pieces, rows_of, sliding_min, spread, texts_of, words_of


#: Single windows of a batch.
WINDOWS = 1 << 14
#: Bits of a hash that hold a place.
PLACE = U64((1 << 31) - 1)


class Kind(NamedTuple):
    unit: str  #: "byte" or "word"
    length: int  #: tokens of a window
    gram: int  #: tokens of the grams whose smallest hash is the key
    run: int  #: most windows of a segment
    reach: int = 0  #: tokens beside the gram that the key also depends on; at most half of what a window has beside it


def with_rid(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid"))


def tokens_of(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the tokens, and the first token of each row (one more at the end)."""
    if unit == "byte":
        return byte_values()[texts.data], texts.starts
    words = words_of(texts)
    return Hashes.of_bytes(texts.data).apart(words.start, words.end), words.first


def runs_of(values: np.ndarray, first: np.ndarray, kind: Kind) -> dict[str, np.ndarray]:
    """The segments of some rows: row, key, seg, place in the row, number of windows.

    ``twice``: the smallest gram stands in the segment more than once, so its windows may be equal to each other.
    """
    grams = Hashes(values).grams(kind.gram)
    # The low bits of a hash give way to its place, so that the smallest is also the leftmost of equal ones.
    placed = (grams & ~PLACE) | np.arange(len(grams), dtype=U64)
    least = sliding_min(placed, kind.length - kind.gram + 1) & PLACE
    size = np.maximum(np.diff(first) - kind.length + 1, 0)
    at = spread(first[:-1], size)
    row = np.repeat(np.arange(len(size)), size)
    held = least[at].astype(np.int64)
    if kind.reach:
        # A window holds ``reach`` tokens more after its smallest gram or, if that stands late in it, before.
        late = held - at > kind.length - kind.gram - kind.reach
        key = Hashes(values).grams(kind.gram + kind.reach)[held - late * kind.reach] ^ late.astype(U64)
    else:
        key = grams[held]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    long = np.diff(np.append(begin, len(at)))
    parts = -(-long // kind.run)  # a run over many equal grams is cut, from its start on
    begin = np.repeat(begin, parts) + spread(np.zeros(len(parts), np.int64), parts) * kind.run
    n = np.diff(np.append(begin, len(at)))
    start = at[begin]
    seg = covered(grams, kind.gram, start, n + kind.length - 1)
    twice = held[begin] != held[begin + n - 1]
    return {"row": row[begin], "key": key[begin], "seg": seg, "place": start - first[row[begin]], "n": n, "twice": twice}


def segments(docs: DataFrame, kind: Kind) -> DataFrame:
    """All segments of all documents: key, seg, rid, doc_id, place, n, twice. A null doc_id is the smallest number."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            values, first = tokens_of(texts_of(batch.column("text")), kind.unit)
            run = runs_of(values, first, kind)
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                {
                    "key": run["key"].view(np.int64),
                    "seg": run["seg"].view(np.int64),
                    "rid": batch.column("rid").to_numpy(zero_copy_only=False)[run["row"]],
                    "doc_id": ids[run["row"]],
                    "place": run["place"].astype(np.int32),
                    "n": run["n"].astype(np.int32),
                    "twice": run["twice"],
                }
            )

    return with_rid(docs).mapInArrow(work, "key long, seg long, rid long, doc_id long, place int, n int, twice boolean")


def candidates(docs: DataFrame, kind: Kind, across: bool) -> DataFrame:
    """The segments whose key occurs twice or more (``across``: in two documents or more), cut by a checkpoint.

    Keys are counted with a combine before the shuffle; the join by key leaves crowded keys to AQE.
    """
    found = segments(docs, kind)
    often = F.min("doc_id") != F.max("doc_id") if across else (F.count("*") > 1) | F.max("twice")
    keys = found.groupBy("key").agg(often.alias("often")).filter("often").select("key")
    columns = ["key", "seg", "rid", "doc_id", "place", "n"] if across else ["key", "seg", "rid", "place", "n"]
    return checkpointed(found.select(*columns).join(keys, "key"))


def contents(packed: DataFrame, found: DataFrame, kind: Kind, crowded: int = 20_000) -> tuple[DataFrame, DataFrame | None]:
    """The tokens of each different candidate segment once (group, key, seg, off, copies, first_doc, tokens), and the
    repeated windows of crowded keys (key, seg, from, number, low), None if there is no such key.

    Windows that are equal are in the same ``group``, that of their key. Keys with more than ``crowded`` different
    segments have no group: their windows are told apart by two 64-bit hashes of their tokens and combined before they
    move, so neither a key nor a passage that very many documents share meets in one task.
    """
    first = F.min("doc_id") if "doc_id" in found.columns else F.lit(0).cast("long")
    different = found.groupBy("key", "seg").agg(F.count("*").alias("copies"), first.alias("first_doc"), F.min(F.struct("rid", "place", "n")).alias("at"))
    many = found.groupBy("key").count().filter(F.col("count") > crowded).select("key")
    segs = found.join(many, "key", "left_semi").select("key", "seg").distinct()
    keys = checkpointed(segs.groupBy("key").count().filter(F.col("count") > crowded).select("key"))
    if keys.isEmpty():
        return stretches(packed, different, kind, False), None
    rows = stretches(packed, different.join(keys, "key", "left_anti"), kind, False)
    return rows, repeated(stretches(packed, different.join(keys, "key", "left_semi"), kind, True))


def repeated(windows: DataFrame) -> DataFrame:
    """Of single windows those that occur twice or more, as key, seg, from, number, low (the smallest first_doc)."""
    same = ["key", "group", "check"]
    # The tokens stay behind: the second hash is of all of them, by another function.
    hashed = checkpointed(windows.select("key", "group", F.xxhash64("tokens").alias("check"), "seg", "off", "copies", "first_doc"))
    # Cut by a checkpoint, so that AQE can split a crowded window in the join.
    totals = checkpointed(hashed.groupBy(*same).agg(F.sum("copies").alias("total"), F.min("first_doc").alias("low")).filter("total > 1").drop("total"))
    return hashed.join(totals, same).select("key", "seg", F.col("off").alias("from"), F.lit(1).alias("number"), "low")


def stretches(packed: DataFrame, different: DataFrame, kind: Kind, split: bool) -> DataFrame:
    """The tokens of different segments: group, key, seg, off, copies, first_doc, tokens.

    ``split``: window by window (``off``: the window's number in its segment), with a hash of the window as its group.
    """
    wanted = different.select("key", "seg", "copies", "first_doc", "at.*")
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("key", "seg", "copies", "first_doc", "place", "n")).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in unpacked(batches):
            values, first = raw_tokens(texts_of(batch.column("text")), kind.unit)
            lists = batch.column("parts")
            parts = lists.flatten()
            row = rows_of(lists.offsets.to_numpy() - lists.offsets[0].as_py())
            place, n = (parts.field(c).to_numpy().astype(np.int64) for c in ("place", "n"))
            reps = n if split else np.ones(len(n), np.int64)
            every = np.repeat(np.arange(len(n)), reps)
            offs = spread(np.zeros(len(n), np.int64), reps)
            windows = Hashes(values if values.dtype == U64 else byte_values()[values]).grams(kind.length) if split else None
            step = WINDOWS if split else max(1, len(every))
            for begin in range(0, len(every), step):
                part, off = every[begin : begin + step], offs[begin : begin + step]
                start = first[row[part]] + place[part] + off
                size = (np.ones(len(part), np.int64) if split else n[part]) + kind.length - 1
                group = parts.field("key").to_numpy()[part] if windows is None else windows[start].view(np.int64)
                body = values[spread(start, size)].view(np.uint8)
                ends = np.append(0, np.cumsum(size * values.itemsize)).astype(np.int64)
                tokens = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])
                took = {c: parts.field(c).take(pa.array(part)) for c in ("key", "seg", "copies", "first_doc")}
                yield pa.record_batch({"group": group, **took, "off": off.astype(np.int32), "tokens": tokens.cast(pa.binary())})

    return packed.join(lists, "rid").select("text", "parts").mapInArrow(work, "group long, key long, seg long, copies long, first_doc long, off int, tokens binary")


def by_group(rows: DataFrame) -> DataFrame:
    """Rows of ``contents`` so that a task has whole groups, ordered."""
    return rows.repartition("group").sortWithinPartitions("group")


def raw_tokens(texts: Texts, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as they are, words as their hashes; and the first token of each row."""
    return (texts.data, texts.starts) if unit == "byte" else tokens_of(texts, unit)


def pack(docs: DataFrame) -> DataFrame:
    """Documents with their texts compressed, for joins that must move them: rid, doc_id, text (binary)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [squeeze(x.as_buffer()) if x.is_valid else None for x in batch.column("text").cast(pa.large_binary())]
            yield pa.record_batch({"rid": batch.column("rid"), "doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.binary())})

    return with_rid(docs).mapInArrow(work, "rid long, doc_id long, text binary")


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of packed texts with the texts as they were, ``most`` packed bytes at a time."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    for batch in pieces(batches, most=most):
        plain = pa.array([expand(x.as_py()) if x.is_valid else b"" for x in batch.column("text")], pa.large_binary())
        columns = [plain if name == "text" else batch.column(name) for name in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def grouped(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows ordered by ``key``, dealt anew: whole keys together, about ``most`` token bytes at a time."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < most:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = whole.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left"))
        if last:
            yield whole.slice(0, last)
        held, size = [whole.slice(last)], (whole.num_rows - last) * whole.nbytes // max(1, whole.num_rows)
        if not last and size >= most:
            most *= 2
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
