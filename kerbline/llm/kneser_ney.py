"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters.

The model is trained on texts labelled as good. Texts lie in blocks of bounded size. A block counts its
n-grams and sends each different one, with its count in trusted texts, to a shard chosen by the two
characters before the last: every context and every shorter n-gram that its probability needs is in the
same shard, but for pairs and single characters, which are few and go to all. A shard joins the counts of
all blocks, works out the log-probability of every n-gram asked for and answers each block, which then
adds them up document by document. What moves is a block's different n-grams, not its characters, and
both the counts and the questions grow with the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .arrays import U64, forget, mix, rows_of

ORDER, BITS = 5, 10
SYMBOLS = 1 << BITS
#: Blocks whose questions a shard answers in one task.
BLOCKS_OF_SALT = 256
#: Counts of trusted texts that are added up in one step.
COMBINED = 64
#: Bytes that a row counts beside its text when blocks are measured.
ROW_BYTES = 64
#: Ids with more than a quarter of a block that may go to every task; more are joined by a shuffle of the rows.
HEAVY_TO_ALL = 100_000
MASKS = [(1 << (BITS * k)) - 1 for k in range(ORDER + 1)]


def symbols(codes: np.ndarray) -> np.ndarray:
    """Code points as one of SYMBOLS: the first three quarters stand for themselves, the others share the rest."""
    plain = SYMBOLS * 3 // 4
    return np.where(codes < plain, codes, plain + codes % (SYMBOLS - plain)).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character of each text, and where each text's begin. Before a text stand zeros."""
    pad = "\0" * (ORDER - 1)
    size = np.array([len(t) for t in texts])
    codes = symbols(np.frombuffer((pad + pad.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32))
    out = np.zeros(len(codes), np.int64)
    for k in range(ORDER):
        out[k:] |= codes[: len(codes) - k] << (BITS * k)
    first = np.append(0, np.cumsum(size))
    at = np.ones(len(codes), bool)
    heads = first[:-1] + (ORDER - 1) * np.arange(len(texts))
    for k in range(ORDER - 1):
        at[heads + k] = False
    return out[at], first


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    middle = (codes >> BITS) & MASKS[2]
    return (mix(middle.astype(U64)) % U64(shards)).astype(np.int64)


def runs(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts again, about ``most`` characters at a time, with the number of the first."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= most):
            size += len(texts[to])
            to += 1
        yield at, texts[at:to]
        at = to


class Discounts(NamedTuple):
    """What is taken off a count of one, of two and of more."""

    values: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray) -> Discounts:
        """From how many n-grams have a count of one, two, three and four."""
        n = np.maximum(np.asarray(n, float), 1e-9)
        y = n[0] / (n[0] + 2 * n[1])
        found = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
        return cls(np.array([0.0] + [f if 0 < f < k else 0.5 * k for k, f in zip((1, 2, 3), found, strict=True)]))

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return self.values[np.minimum(counts, 3)]


class Level:
    """The n-grams of one order with their (continuation) counts, and the sums of their contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, discounts: Discounts):
        self.codes, self.counts, self.discounts = codes, counts, discounts
        self.contexts, which = np.unique(codes >> BITS, return_inverse=True)
        self.total = np.bincount(which, counts, len(self.contexts))
        self.spare = np.bincount(which, discounts(counts), len(self.contexts))

    def over(self, asked: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of the n-grams ``asked``, whose shorter ones have the probabilities ``lower``."""
        if not len(self.codes):
            return lower
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        counts = np.where(self.codes[at] == asked, self.counts[at], 0)
        context = asked >> BITS
        of = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        seen = self.contexts[of] == context
        total = np.where(seen, self.total[of], 1)
        return np.where(seen, (counts - self.discounts(counts)) / total + self.spare[of] / total * lower, lower)


def shorter(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The different last ``order`` characters of different n-grams, and by how many characters each goes on to the left."""
    return np.unique(codes & MASKS[order], return_counts=True)


def tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of some rows in order, with the sums of their counts."""
    codes = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("codes")])
    counts = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("counts")])
    every, which = np.unique(codes, return_inverse=True)
    return every, np.bincount(which, counts, len(every)).astype(np.int64)


def facts_of(table: pa.Table) -> pa.Table:
    """Of a shard: how many n-grams of each order have a count of one to four, and the left neighbours of each pair."""
    kinds, keys, numbers = [], [], []
    if table.column("salt")[0].as_py() == 0:
        codes, counts = merged(table)
        codes, counts = codes[counts > 0], counts[counts > 0]
        for order in range(ORDER, 2, -1):
            if order < ORDER:
                codes, counts = shorter(codes, order)
            kinds += [order] * 4
            keys += [0, 1, 2, 3]
            numbers += tally(counts)
        pairs, counts = shorter(codes, 2)
        kinds += [2] * len(pairs)
        keys += pairs.tolist()
        numbers += counts.tolist()
    return pa.table({"kind": pa.array(kinds, pa.int32()), "key": pa.array(keys, pa.int64()), "number": pa.array(numbers, pa.int64())})


def combined(table: pa.Table) -> pa.Table:
    """Counts of several blocks as one row."""
    codes, counts = merged(table)
    shard, part = (table.column(c)[0].as_py() for c in ("shard", "part"))
    return pa.table(
        {
            "shard": pa.array([shard], pa.int64()),
            "salt": pa.array([-1], pa.int32()),
            "block": pa.array([part], pa.int64()),
            "codes": pa.array([codes.tobytes()], pa.binary()),
            "counts": pa.array([counts.astype(np.int32).tobytes()], pa.binary()),
        }
    )


def answer(table: pa.Table, common: pa.Table) -> pa.Table:
    """Log-probabilities of all n-grams that the blocks of a shard ask for."""
    every, counts = merged(table)
    kind, key, number = (np.array(common.column(c)[0].as_py(), np.int64) for c in ("kinds", "keys", "numbers"))
    discounts = {}
    for order in range(3, ORDER + 1):
        own = kind == order
        discounts[order] = Discounts.of(np.bincount(key[own], number[own], 4))
    pairs, of_pairs = key[kind == 2], number[kind == 2]
    order = np.argsort(pairs)
    pairs, of_pairs = pairs[order], of_pairs[order]
    singles, of_singles = shorter(pairs, 1)
    one = Discounts.of(tally(of_singles))
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    if len(singles):
        p *= one(of_singles).sum() / of_singles.sum()
        p[singles] += (of_singles - one(of_singles)) / of_singles.sum()
    levels = [Level(pairs, of_pairs, Discounts.of(tally(of_pairs)))]
    grams_, n = every[counts > 0], counts[counts > 0]
    upper = []
    for k in range(ORDER, 2, -1):
        if k < ORDER:
            grams_, n = shorter(grams_, k)
        upper.append(Level(grams_, n, discounts[k]))
    levels += upper[::-1]
    prob = p[every & MASKS[1]]
    for k, level in enumerate(levels, 2):
        prob = level.over(every & MASKS[k], prob)
    logs = np.log(np.maximum(prob, 1e-12)).astype(np.float32)
    blocks, codes, out = [], [], []
    for block, own in zip(table.column("block").to_pylist(), table.column("codes"), strict=True):
        if block >= 0:
            asked = np.frombuffer(own.as_py(), np.int64)
            blocks.append(block)
            codes.append(own.as_py())
            out.append(logs[np.searchsorted(every, asked)].tobytes())
    return pa.table({"block": pa.array(blocks, pa.int64()), "codes": pa.array(codes, pa.binary()), "logs": pa.array(out, pa.binary())})


def block_texts(table: pa.Table) -> tuple[pa.Table, list[str], np.ndarray]:
    """The documents of a block, their texts, and 1 for those to train on, 2 for those to set the limits by."""
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    good = table.filter(table.column("label"))
    docs = table.filter(pa.compute.invert(table.column("label")))
    texts = [expand(x).decode() if x is not None else "" for x in docs.column("text").to_pylist()]
    ids = docs.column("doc_id").to_pandas().to_numpy(float, na_value=np.nan) if docs.column("doc_id").null_count else docs.column("doc_id").to_numpy()
    trusted = np.isin(ids, good.column("doc_id").to_numpy())
    fold = mix(np.nan_to_num(ids).astype(np.int64).astype(U64)) % U64(10) == 0
    return docs, texts, np.where(trusted, np.where(fold, 2, 1), 0)


def rid() -> Column:
    """What a document's verdict follows from, as one number."""
    return F.xxhash64("doc_id", "lang", "text").alias("rid")


def placed(docs: DataFrame, ids: DataFrame, blocks: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` and the rows ``ids`` (one a doc_id) with the block of each: all documents of an id meet it.

    An id with more than a quarter of a block is dealt out row by row, and its row of ``ids`` goes to all its parts.
    Documents without an id meet nothing and are dealt out over all blocks.
    """
    most = max(1, block_bytes // 4)
    sizes = docs.groupBy("doc_id").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).alias("bytes"))
    # At most four of these a block: they grow with the data, so they are counted before they go to every task.
    heavy = checkpointed(sizes.filter(F.col("doc_id").isNotNull() & (F.col("bytes") > most)).select("doc_id", F.ceil(F.col("bytes") / most).alias("fan")))
    heavy = F.broadcast(heavy) if heavy.count() <= HEAVY_TO_ALL else heavy
    block = lambda part: F.pmod(F.xxhash64("doc_id", part), F.lit(blocks)).alias("block")
    place = F.xxhash64(F.monotonically_increasing_id())
    fan = F.when(F.col("doc_id").isNull(), F.lit(blocks).cast("long")).otherwise(F.coalesce("fan", F.lit(1).cast("long")))
    rows = docs.withColumn("place", place).join(heavy, "doc_id", "left").select(*docs.columns, F.pmod("place", fan).alias("part"))
    told = ids.join(heavy, "doc_id", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("fan", F.lit(1).cast("long")) - 1)))
    return rows.select(*docs.columns, block(F.col("part"))), told.select(*ids.columns, block(F.col("part")))


def scores(docs: DataFrame, labels: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """rid, doc_id, lang, n_chars, perplexity (of a character; null for a text without any) and trusted (0, 1 or 2)."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    # Their product, and with it the copies of what all shards get, grows with the blocks.
    shards, salts = max(16, 2 * min(blocks, BLOCKS_OF_SALT)), math.ceil(blocks / BLOCKS_OF_SALT)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = [squeeze(x.as_buffer()) if x.is_valid else None for x in batch.column("text").cast(pa.large_binary())]
            columns = {c: batch.column(c) for c in ("rid", "doc_id", "lang", "block")}
            yield pa.record_batch({**columns, "text": pa.array(texts, pa.binary())})

    good = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    dealt, told = placed(docs.select(rid(), "doc_id", "lang", "text"), good.select("doc_id"), blocks, block_bytes)
    packed = dealt.mapInArrow(squeezed, "rid long, doc_id long, lang string, block long, text binary").withColumn("label", F.lit(False))
    nothing = {n: F.lit(None).cast(kind) for n, kind in (("rid", "long"), ("lang", "string"), ("text", "binary"))}
    rows = packed.unionByName(told.withColumns({**nothing, "label": F.lit(True)}))

    def ask(table: pa.Table) -> pa.Table:
        forget()
        block = table.column("block")[0].as_py()
        _, texts, trusted = block_texts(table)
        found, counted = [np.zeros(0, np.int64)], [np.zeros(0)]
        for at, some in runs(texts):
            codes, first = grams(some)
            which, different = pd.factorize(codes)
            found.append(different)
            counted.append(np.bincount(which, (trusted[at : at + len(some)] == 1)[rows_of(first)], len(different)))
        codes, which = np.unique(np.concatenate(found), return_inverse=True)
        counts = np.bincount(which, np.concatenate(counted), len(codes)).astype(np.int32)
        shard = shard_of(codes, shards)
        order = np.argsort(shard, kind="stable")
        out: dict[str, list] = {"shard": [], "salt": [], "block": [], "codes": [], "counts": []}
        edges = np.flatnonzero(np.diff(shard[order])) + 1
        for own in np.split(order, edges) if len(order) else []:
            taught = own[counts[own] > 0]
            asks = (block % salts, codes[own].tobytes(), (counts[own] if salts == 1 else np.zeros(len(own), np.int32)).tobytes())
            tells = (-1, codes[taught].tobytes(), counts[taught].tobytes())
            for salt, some, n in [asks, tells] if salts > 1 and len(taught) else [asks]:
                for name, value in zip(out, (int(shard[own[0]]), salt, block, some, n), strict=True):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)})

    schema = "shard long, salt int, block long, codes binary, counts binary"
    asked = rows.groupBy("block").applyInArrow(ask, schema)
    if salts > 1:  # the counts of trusted texts are added up before they go to every salt
        known, left = asked.filter("salt = -1"), blocks
        while left > 1:
            known = known.withColumn("part", F.floor(F.col("block") / COMBINED)).groupBy("shard", "part").applyInArrow(combined, schema)
            left = math.ceil(left / COMBINED)
        known = known.withColumn("block", F.lit(-1).cast("long")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        asked = asked.filter("salt >= 0").unionByName(known)
    facts = asked.groupBy("shard", "salt").applyInArrow(facts_of, "kind int, key long, number long")
    facts = facts.groupBy("kind", "key").agg(F.sum("number").alias("number"))
    # At most SYMBOLS squared pairs and a few counts: one row, which every shard gets.
    common = facts.agg(F.collect_list(F.struct("kind", "key", "number")).alias("f")).select(
        F.col("f.kind").alias("kinds"), F.col("f.key").alias("keys"), F.col("f.number").alias("numbers")
    )
    common = common.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def reply(table: pa.Table, common: pa.Table) -> pa.Table:
        return answer(table, common) if table.num_rows else pa.table({"block": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()), "logs": pa.array([], pa.binary())})

    replies = asked.groupBy("shard", "salt").cogroup(common.groupBy("shard", "salt")).applyInArrow(reply, "block long, codes binary, logs binary")

    def add(table: pa.Table, replies: pa.Table) -> pa.Table:
        docs, texts, trusted = block_texts(table)
        n = np.array([len(t) for t in texts], np.int64)
        total = np.zeros(len(texts))
        if replies.num_rows:
            known = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in replies.column("codes")])
            logs = np.concatenate([np.frombuffer(x.as_py(), np.float32) for x in replies.column("logs")])
            order = np.argsort(known)
            known, logs = known[order], logs[order].astype(np.float64)
            for at, some in runs(texts):
                codes, first = grams(some)
                which, different = pd.factorize(codes)
                at_known = np.minimum(np.searchsorted(known, different), len(known) - 1)
                if (known[at_known] != different).any():
                    raise ValueError("a block was dealt out anew between its questions and their answers")
                own = logs[at_known]
                total[at : at + len(some)] = np.bincount(rows_of(first), own[which], len(some))
        perplexity = np.exp(-total / np.maximum(n, 1))
        return pa.table(
            {
                "rid": docs.column("rid"),
                "doc_id": docs.column("doc_id"),
                "lang": docs.column("lang"),
                "n_chars": n,
                "perplexity": pa.array(perplexity, mask=n == 0),
                "trusted": trusted.astype(np.int32),
            }
        )

    return rows.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        add, "rid long, doc_id long, lang string, n_chars long, perplexity double, trusted int"
    )


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.98, short: int = 100, enough_texts: int = 50) -> DataFrame:
    """rid, doc_id, lang, n_chars, perplexity, threshold and kept, one row for each input row.

    Nine in ten trusted documents (quality 1) train the model; by the others of ``short`` characters or more (all, if
    none is as long) the thresholds are set: the median perplexity of a language times the ``quantile`` of how far its
    texts lie from that. With fewer than ``enough_texts`` of them, this quantile is drawn towards the one of all languages
    together, the more the fewer there are, so that one odd text does not move it. A language without such documents has
    the median and the quantile of all. A document is kept up to its threshold. Null and empty
    texts have no perplexity and are not kept; without any trusted document every other text is kept. Null languages
    are one language.
    """
    scored = checkpointed(scores(docs, labels)).withColumn("language", F.coalesce("lang", F.lit("")))
    held = scored.filter("trusted = 2 AND perplexity IS NOT NULL")
    enough = held.filter(F.col("n_chars") >= short)
    held = held if enough.isEmpty() else enough
    middle = F.percentile_approx("perplexity", 0.5, 10_000).alias("middle")
    by_language = held.groupBy("language").agg(middle, F.count("*").alias("held"))
    overall = held.agg(middle).first()["middle"]
    far = F.percentile_approx(F.col("perplexity") / F.col("middle"), quantile, 10_000).alias("far")
    ratios = checkpointed(held.join(by_language, "language").select("language", "perplexity", "middle", "held"))
    spread = ratios.agg(far).first()[0]
    own = F.least(F.col("held") / enough_texts, F.lit(1.0))
    limits = ratios.groupBy("language").agg(far, F.first("middle").alias("middle"), F.first("held").alias("held"))
    limits = limits.select("language", (F.col("middle") * (own * F.col("far") + (1 - own) * F.lit(spread or 0.0))).alias("limit"))
    threshold = F.lit(float("inf")) if overall is None else F.coalesce("limit", F.lit(overall * spread))
    return (
        scored.join(limits, "language", "left")
        .withColumn("threshold", threshold)
        .select("rid", "doc_id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
    )


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns.

    Null and repeated ids are judged by their own texts and languages; repeated rows all stay or all go.
    """
    kept = classify(docs, labels).filter("kept").select(F.col("rid").alias("__rid")).distinct()
    return docs.withColumn("__rid", rid()).join(kept, "__rid", "left_semi").drop("__rid")
