"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

An n-gram of a lower-case text is present or not. How many labelled texts of either class have it
gives its log-count ratio; the n-grams that tell the classes apart best, so scaled, are the features
of a logistic regression. N-grams are counted in Spark; only the counts of a fixed number of hash
buckets and the chosen features of a bounded sample come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Hashes, lowered, pieces, texts_of
from .sampling import fitting_sample


class Settings(NamedTuple):
    sizes: tuple[int, ...] = (4, 5, 6, 7)  #: bytes of the n-grams
    bits: int = 20  #: of the hash buckets
    features: int = 4_000  #: buckets that take part
    least: int = 5  #: texts that must have a bucket's n-gram
    sample: int = 20_000  #: labelled texts that are read
    fitted: int = 4_000  #: of these, texts of the last fit


class Model(NamedTuple):
    weights: np.ndarray  #: of each bucket
    bias: float


def buckets_of(data: np.ndarray, starts: np.ndarray, settings: Settings) -> list[np.ndarray]:
    """The buckets of each row's n-grams, with repeats. A row is taken with a blank at both ends."""
    n = len(starts) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    first = starts + 2 * np.arange(n + 1)
    inner = np.ones(len(padded), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    padded[inner] = lowered(data)
    plain = Hashes.of_bytes(padded)
    shift = np.uint64(64 - settings.bits)
    grams = [(plain.grams(k) >> shift).astype(np.int32) for k in settings.sizes]
    return [np.concatenate([g[a : max(a, b - k + 1)] for g, k in zip(grams, settings.sizes, strict=True)]) for a, b in zip(first, first[1:], strict=False)]


def counts(taught: DataFrame, settings: Settings) -> np.ndarray:
    """Rows of bucket, clean and toxic texts that have it; the last bucket counts the texts. Rare buckets are left out."""
    size = 1 << settings.bits

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros((2, size + 1), np.int32)
        for batch in pieces(batches):
            toxic = batch.column("toxic").to_numpy()
            for own, label in zip(buckets_of(*texts_of(batch.column("text")), settings), toxic, strict=True):
                have[label, np.unique(own)] += 1
                have[label, size] += 1
        at = np.flatnonzero(have.sum(axis=0))
        yield pa.record_batch({"bucket": at.astype(np.int32), "clean": have[0, at], "toxic": have[1, at]})

    rows = taught.select("text", "toxic").mapInArrow(work, "bucket int, clean int, toxic int").groupBy("bucket")
    summed = rows.agg(F.sum("clean").cast("int").alias("clean"), F.sum("toxic").cast("int").alias("toxic"))
    found = summed.filter((F.col("clean") + F.col("toxic") >= settings.least) | (F.col("bucket") == size)).toArrow()
    return np.stack([found.column(c).to_numpy() for c in ("bucket", "clean", "toxic")])


def fit(taught: DataFrame, settings: Settings) -> Model:
    """A model from rows of text, toxic (0 or 1) and first (those are fitted). Without both classes the score is the share of toxic rows."""
    bucket, clean, toxic = counts(taught, settings)
    texts = bucket == 1 << settings.bits
    n_clean, n_toxic = int(clean[texts].sum()), int(toxic[texts].sum())
    weights = np.zeros(1 << settings.bits, np.float32)
    if not n_clean or not n_toxic:
        part = (n_toxic + 0.5) / (n_clean + n_toxic + 1)
        return Model(weights, float(np.log(part / (1 - part))))
    bucket, clean, toxic = bucket[~texts], clean[~texts], toxic[~texts]
    p, q = (toxic + 1) / (n_toxic + 2), (clean + 1) / (n_clean + 2)
    common = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    telling = (p - q) ** 2 / (common * (1 - common))  # in order of chi-squared
    best = np.lexsort((bucket, -telling))[: settings.features]
    chosen, ratio = bucket[best], np.log(p[best] / q[best])
    slot = np.full(1 << settings.bits, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))
    shared = taught.sparkSession.sparkContext.broadcast(slot)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = [np.unique(s[s >= 0]) for s in (shared.value[b] for b in buckets_of(*texts_of(batch.column("text")), settings))]
            yield pa.record_batch({"toxic": batch.column("toxic"), "have": pa.array(own, pa.list_(pa.int32()))})

    rows = taught.filter("first").select("text", "toxic").mapInArrow(work, "toxic int, have array<int>").toArrow().combine_chunks()
    lists = rows.column("have").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.int32()))
    beta, bias = regression(lists.value_lengths().to_numpy(), lists.flatten().to_numpy(), rows.column("toxic").to_numpy().astype(float), ratio)
    weights[chosen] = (beta * ratio).astype(np.float32)
    return Model(weights, bias)


def regression(size: np.ndarray, column: np.ndarray, y: np.ndarray, ratio: np.ndarray, ridge: float = 0.5, rounds: int = 12, inner: int = 20) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on present features times their ratios: Newton steps, solved by conjugate gradients.

    Row i has ``size[i]`` features, named one after the other in ``column``.
    """
    row = np.repeat(np.arange(len(size)), size)
    column = column.astype(np.int64)
    value = ratio[column]
    n, m = len(y), len(ratio)
    pull = np.append(np.full(m, ridge), 1e-3)  # the last place is the bias

    def forward(v: np.ndarray) -> np.ndarray:
        return v[m] + np.bincount(row, value * v[column], n)

    def back(u: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, value * u[row], m), u.sum())

    def loss(v: np.ndarray) -> float:
        z = forward(v)
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (pull * v * v).sum())

    w = np.zeros(m + 1)
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(w), -40, 40)))
        residual = -(back(p - y) + pull * w)
        curve, step, way = p * (1 - p), np.zeros(m + 1), residual.copy()
        norm = start = float(residual @ residual)
        for _ in range(inner):
            bent = back(curve * forward(way)) + pull * way
            rate = norm / max(float(way @ bent), 1e-300)
            step += rate * way
            residual = residual - rate * bent
            norm, old = float(residual @ residual), norm
            if norm < 1e-6 * start:
                break
            way = residual + norm / old * way
        length = 1.0
        while length > 1e-3 and (then := loss(w + length * step)) > now:
            length /= 2
        if then > now - 1e-6 * abs(now):
            break
        w, now = w + length * step, then
    return w[:m], float(w[m])


def score(docs: DataFrame, model: Model, settings: Settings) -> DataFrame:
    """doc_id and score (0 to 1) of every text; a null or empty one is scored by the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        seen = np.zeros(len(weights), bool)
        for batch in pieces(batches):
            z = []
            for own in buckets_of(*texts_of(batch.column("text")), settings):
                told = own[weights[own] != 0]
                told = told[~seen[told]]
                seen[told] = True
                told = np.unique(told)
                z.append(bias + float(weights[told].sum(dtype=np.float64)))
                seen[told] = False
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(z), -40, 40)))})

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """doc_id, held_out, score and predicted, one row for each input row.

    Rows whose crc32(doc_id as text) leaves 0 when divided by 5 are held out: their labels are never read. Of the others
    the model sees about ``settings.sample`` at most for its counts and ``settings.fitted`` for its last fit, by a hash of
    doc_id (a bounded sample for fitting only). Only the text is scored. Labels that are null teach nothing; a doc_id labelled twice counts as toxic if one label says so.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().filter(~fold & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # About ``sample`` ids at most: small enough for every task, so the texts stay where they are.
    # Of an id that stands in several rows, the least text teaches, so the bound holds for rows too.
    rows = docs.select("doc_id", "text").join(F.broadcast(fitting_sample(known, settings.sample, settings.fitted)), "doc_id")
    taught = rows.groupBy("doc_id", "toxic", "first").agg(F.min("text").alias("text"))
    model = fit(taught, settings)
    return score(docs, model, settings).select(
        "doc_id", fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
