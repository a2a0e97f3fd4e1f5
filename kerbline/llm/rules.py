"""Quality rules: statistics of whole texts, and a decision list learned from labelled ones.

The list is learned by sequential covering. A rule grows by the threshold that gains most on two
thirds of the remaining labelled rows, is pruned on the other third, and is kept while it is precise
there; rows it covers are set aside and the next rule is sought. The list becomes one ordered
conditional expression of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from .arrays import Hashes, Texts, forget, pieces, rows_of, texts_of, words_of
from .sampling import fitting_sample

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_different", "n_marks")


def per_row(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many flags each row has."""
    sums = np.append(0, np.cumsum(flags, dtype=np.int64))
    return sums[starts[1:]] - sums[starts[:-1]]


def later_equals(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether an item equals an earlier one of its row, and whether it equals any other one."""
    order = np.lexsort((value, row))  # stable: equal items stay in order
    same = np.zeros(len(row), bool)
    same[1:] = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    any_other = same.copy()
    any_other[:-1] |= same[1:]
    later, shared = np.zeros(len(row), bool), np.zeros(len(row), bool)
    later[order], shared[order] = same, any_other
    return later, shared


def counts_of(texts: Texts) -> dict[str, np.ndarray]:
    data, starts = texts
    words = words_of(texts)
    size = np.diff(words.first)
    plain = Hashes.of_bytes(data)
    hashes = plain.apart(words.start, words.end)
    row = rows_of(words.first)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    # lines: between line feeds and the ends of rows
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([starts[:-1][np.diff(starts) > 0], feeds + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(
        np.append(feeds, len(data))[np.searchsorted(feeds, begin)], starts[np.minimum(np.searchsorted(starts, begin, "right"), len(starts) - 1)]
    )
    with_word = np.searchsorted(words.start, stop) > np.searchsorted(words.start, begin)
    begin, stop = begin[with_word], stop[with_word]
    line_row = np.searchsorted(starts, begin, "right") - 1
    again, _ = later_equals(line_row, plain.apart(begin, stop))
    lines = np.append(np.searchsorted(line_row, np.arange(len(size))), len(line_row))
    # windows of three words
    threes = Hashes(hashes).grams(3)
    valid = np.zeros(len(hashes), bool)
    valid[: len(threes)] = row[: len(threes)] == row[2:] if len(threes) else False
    at = np.flatnonzero(valid)
    _, shared = later_equals(row[at], threes[at])
    repeated = np.zeros(len(hashes) + 2, bool)
    for k in range(3):
        repeated[at[shared] + k] = True
    seen, _ = later_equals(row, hashes)
    return {
        "n_words": size,
        "word_chars": per_row(inside & ((data & 0xC0) != 0x80), starts),
        "n_symbols": per_row(SYMBOLS[data], starts),
        "n_dup_lines": per_row(again, lines),
        "n_repeat_words": per_row(repeated[: len(hashes)], words.first),
        "n_lines": np.diff(lines),
        "n_capitals": per_row((data >= 65) & (data <= 90), starts),
        "n_different": size - per_row(seen, words.first),
        "n_marks": per_row((data == 33) | (data == 63), starts),
    }


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS and base_failed, one row for each input row. A null or empty text counts nothing and fails."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            counts = counts_of(texts_of(batch.column("text")))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), **{c: counts[c].astype(np.int64) for c in COUNTS}})

    rows = docs.select("doc_id", "text").mapInArrow(work, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.withColumn("base_failed", base_failed())


#: What conditions are about: shares of the counts, each a pair of counts.
SHARES = {
    "chars_of_word": ("word_chars", "n_words"),
    "symbols_of_word": ("n_symbols", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals_of_chars": ("n_capitals", "word_chars"),
    "different_words": ("n_different", "n_words"),
    "marks_of_word": ("n_marks", "n_words"),
    "words_of_line": ("n_words", "n_lines"),
}


def share(name: str, at: str = "") -> Column:
    """A share as a column; ``at`` is what the names of the counts begin with."""
    top, below = SHARES[name]
    return F.col(at + top) / F.greatest(F.col(at + below), F.lit(1))


def base_failed(at: str = "") -> Column:
    """Fewer than fifty words, or more than half of them in repeated windows."""
    return (F.col(at + "n_words") < 50) | (100 * F.col(at + "n_repeat_words") > 50 * F.col(at + "n_words"))


class Condition(NamedTuple):
    share: str
    above: bool
    limit: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.share] > self.limit if self.above else x[self.share] < self.limit

    def column(self, at: str = "") -> Column:
        return share(self.share, at) > self.limit if self.above else share(self.share, at) < self.limit


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, limits: int) -> Rule:
    """Add the condition of most information gain until only bad rows are covered."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while bad[inside].sum() < inside.sum():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        best, most = None, 1e-9
        for name, values in x.items():
            own = values[inside]
            edges = np.unique(np.quantile(own, np.linspace(0, 1, limits)))
            for limit in (edges[1:] + edges[:-1]) / 2:
                for above in (True, False):
                    hit = own > limit if above else own < limit
                    pos = (hit & bad[inside]).sum()
                    if pos:
                        gain = pos * (np.log2(pos / hit.sum()) - np.log2(p / (p + n)))
                        if gain > most:
                            best, most = Condition(name, above, float(limit)), gain
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is best on rows it has not seen."""

    def worth(part: Rule) -> float:
        hit = covered(part, x)
        return (int((hit & bad).sum()) - int((hit & ~bad).sum())) / max(1, int(hit.sum()))

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda part: (worth(part), -len(part)), default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.97, support: int = 5, limits: int = 48, most: int = 24) -> list[Rule]:
    """An ordered list of rules that find bad rows, from shares and labels; learned on a few thousand rows."""
    rules: list[Rule] = []
    shuffled = np.random.default_rng(7).permutation(len(bad))
    x, bad = {n: v[shuffled] for n, v in x.items()}, bad[shuffled]
    while len(rules) < most and bad.sum() >= support:
        third = np.arange(len(bad)) % 3 == 2
        rule = _grow({n: v[~third] for n, v in x.items()}, bad[~third], limits)
        rule = _prune(rule, {n: v[third] for n, v in x.items()}, bad[third]) if third.any() else rule
        if not rule:
            break
        hit = covered(rule, x)
        judged = hit & third
        if hit.sum() < support or bad[judged].sum() < precision * judged.sum() or bad[hit].sum() < precision * hit.sum():
            break
        rules.append(rule)
        x, bad = {n: v[~hit] for n, v in x.items()}, bad[~hit]
    return rules


def verdict(rules: list[Rule], at: str = "") -> Column:
    """True for rows that no rule rejects, as one ordered conditional."""
    out: Column | None = None
    for rule in rules:
        holds = rule[0].column(at)
        for condition in rule[1:]:
            holds &= condition.column(at)
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def taught_ids(labels: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` labelled doc_ids at most, with their quality."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return fitting_sample(known, sample)


def fit(rows: DataFrame, labels: DataFrame, sample: int) -> list[Rule]:
    """Rules from about ``sample`` labelled rows of ``statistics`` at most; rows that fail the base teach nothing.

    Of a sampled id that stands in several rows, the row with the least counts teaches.
    """
    taught = (
        rows.filter("NOT base_failed")
        .join(F.broadcast(taught_ids(labels, sample)), "doc_id")
        .groupBy("doc_id", "quality")
        .agg(F.min(F.struct(*[share(n).alias(n) for n in SHARES])).alias("s"))
        .orderBy("doc_id")
        .select("s.*", (F.col("quality") == 0).alias("bad"))
        .toPandas()
    )
    return learn({n: taught[n].to_numpy(float) for n in SHARES}, taught["bad"].to_numpy(bool)) if len(taught) else []


def judge(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """statistics of every document with kept: false if base_failed, else what the learned rules say.

    The rules see a bounded sample of labelled rows, for fitting only; quality 0 is bad. Rows without a label, or with a
    null one, teach nothing; without any bad label there are no rules and the base alone decides.
    """
    rows = checkpointed(statistics(docs))
    return rows.withColumn("kept", ~F.col("base_failed") & verdict(fit(rows, labels, sample)))


def keep(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns; the texts are counted where they lie.

    Null and repeated ids are judged by their own texts; repeated rows all stay or all go.
    """
    sampled = docs.select("doc_id", "text").join(F.broadcast(taught_ids(labels, sample).select("doc_id")), "doc_id", "left_semi")
    rules = fit(statistics(sampled), labels, sample)
    name = "__counts"
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in pieces(batches):
            counts = counts_of(texts_of(batch.column("text")))
            own = pa.StructArray.from_arrays([pa.array(counts[c].astype(np.int64)) for c in COUNTS], list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, name])

    counted = docs.mapInArrow(work, schema)
    return counted.filter(~base_failed(f"{name}.") & verdict(rules, f"{name}.")).drop(name)
