"""Splits that keep a group on one side, and the checks that they do."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.digests import leading, text_words
from ..functions.keys import shuffle_key
from ..session import beside, checkpointed, match, values
from .build import numbered_globally

#: Groups times trials of one task: at least where there would be fewer than LEAST_TASKS tasks, and at most.
ROWS_OF_TASK, MOST_OF_TASK, LEAST_TASKS = 1_000_000, 32_000_000, 64
#: Groups and class counts together, and bytes of names, of which one task runs whole trials, and groups times trials it runs at most.
IN_TASK, NAMES_IN_TASK, KEYS_OF_TASK = 10_000_000, 200_000_000, 1_000_000_000
#: Keys a task holds at a time, so that the few groups with short names are not hashed in runs of few.
KEYS_AT_ONCE = 1 << 22
#: Standard deviations on either side of a cut's expected place that are looked at in fine steps.
REACH = 4
SPLITS = ("train", "val", "test")
TARGET = {"train": 0.7, "val": 0.2, "test": 0.1}


def index_split(index: Column, cut: int = 600) -> Column:
    """Contiguous: before the cut is train, the rest val."""
    return F.when(index < cut, F.lit("train")).otherwise(F.lit("val"))


def directory_split(path: Column, anchor: str) -> Column:
    """The directory after ``anchor`` in a path, or null when files lie right in it."""
    return F.nullif(F.regexp_extract(path, rf"(?i)(?:^|/){anchor}/([^/]+)/[^/]+", 1), F.lit(""))


def _ranked(df: DataFrame, groups: list[str], order: list[str], most: int) -> DataFrame:
    """Add ``__rank``, a row's number from 1 in its group in an md5 order.

    ``order[0]`` is md5 text. Rows are counted per leading hex digits, and ranked inside those: as many digits
    as leave a few thousand rows of a group of ``most`` rows together.
    """
    digits = min(8, max(0, math.ceil(math.log(max(1, most) / 4096, 16))))
    head = F.substring(F.col(order[0]), 1, digits)
    inside = W.partitionBy(*groups, "__head").orderBy(*order)
    rows = df.withColumn("__head", head).withColumn("__rank", F.row_number().over(inside))
    if not digits:
        return rows.drop("__head")
    parts = df.groupBy(*groups, head.alias("__head")).agg(F.count("*").alias("__n"))
    prior = W.partitionBy(*groups).orderBy("__head").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    return match(rows, starts, [*groups, "__head"]).withColumn("__rank", F.col("__before") + F.col("__rank")).drop("__head", "__before")


def _first_of_each(df: DataFrame, groups: list[str], order: list[str], wanted: str) -> DataFrame:
    """Rows among the first ``wanted`` (a column, per group) of their group in an md5 order.

    ``order[0]`` is md5 text. Rows are counted per leading hex digits, and only the
    digits where the boundary falls are ranked row by row: a group with very many
    rows is spread over 4,096 parts.
    """
    head = F.substring(F.col(order[0]), 1, 3)
    parts = df.groupBy(*groups, head.alias("__head")).agg(F.count("*").alias("__n"))
    prior = W.partitionBy(*groups).orderBy("__head").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.withColumn("__before", F.coalesce(F.sum("__n").over(prior), F.lit(0))).drop("__n")
    inside = W.partitionBy(*groups, "__head").orderBy(*order)
    ranked = match(df.withColumn("__head", head), starts, [*groups, "__head"]).withColumn(
        "__rank", F.col("__before") + F.row_number().over(inside)
    )
    return ranked.withColumn("__first", F.col("__rank") <= F.col(wanted)).drop("__head", "__before")


def group_split(df: DataFrame, group: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """``(group, split)``: ``max(1, round(n * fraction))`` groups to val, none if there is only one."""
    groups = df.select(group).distinct().withColumns(
        {"__key": shuffle_key(seed, F.col(group)), "__all": F.lit(1)}
    )
    n = groups.agg(F.count("*").alias("n")).select(
        F.when(F.col("n") > 1, F.greatest(F.lit(1), F.bround(F.col("n") * fraction)))
        .otherwise(F.lit(0))
        .alias("__want")
    )
    ranked = _first_of_each(beside(groups, n), ["__all"], ["__key", group], "__want")
    return ranked.select(
        group, F.when(F.col("__first"), F.lit("val")).otherwise(F.lit("train")).alias("split")
    )


def stratified_split(df: DataFrame, key: str, cls: str, fraction: float = 0.2, seed: int = 0) -> DataFrame:
    """``(key, cls, split)``: in each class ``round(n * fraction)`` keys to val."""
    rows = df.select(key, cls).distinct().withColumn("__key", shuffle_key(seed, F.col(key)))
    want = rows.groupBy(cls).agg(F.bround(F.count("*") * fraction).alias("__want"))
    ranked = _first_of_each(match(rows, want, [cls]), [cls], ["__key", key], "__want")
    return ranked.select(
        key, cls, F.when(F.col("__first"), F.lit("val")).otherwise(F.lit("train")).alias("split")
    )


def nested_subsets(order: DataFrame, percents: tuple[int, ...] = (25, 50, 75), position: str = "pos") -> DataFrame:
    """``(percent, ...)`` rows of the first ``max(1, round(n * pct / 100))`` of a fixed order from 1."""
    n = order.agg(F.count("*").alias("__n"))
    wide = beside(order, n).withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    keep = F.greatest(F.lit(1), F.bround(F.col("__n") * F.col("percent") / 100))
    return wide.filter(F.col(position) <= keep).drop("__n")


def balanced_group_split(
    counts: DataFrame, group: str, trials: int = 40_000, seed: int = 0, target: dict[str, float] | None = None
) -> DataFrame:
    """``(group, split)`` of the random trial whose class shares come nearest the target.

    ``counts`` is ``(group, cls, n)`` with every group, ``cls`` null for one without
    boxes; those are dealt round-robin. Every trial orders the groups by an md5 of
    seed, trial and group, and cuts the order twice. Trials are dealt out in blocks, very
    many groups too (``trial_sums``), and only class sums of trials move.
    """
    target = target or TARGET
    filled = counts.filter(F.col("cls").isNotNull() & (F.col("n") > 0)).groupBy(group).agg(F.collect_list(F.struct("cls", "n")).alias("__boxes"))
    # Read for every step below.
    filled = checkpointed(filled)
    boxes = filled.select(group, F.inline("__boxes"))
    size = filled.count()
    n_val = max(1, round(size * target["val"]))
    n_test = max(1, round(size * target["test"]))
    sums = trial_sums(filled, group, trials, seed, n_val, n_test)
    totals = boxes.groupBy("cls").agg(F.sum("n").alias("total"))
    shares = sums.groupBy("trial", "cls").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in target])
    off = sum((F.abs(F.col(s) / F.col("total") - F.lit(share)) for s, share in target.items()), F.lit(0.0))
    error = shares.join(totals, "cls").groupBy("trial").agg(F.round(F.sum(off), 9).alias("error"))
    best = error.agg(F.min_by("trial", F.struct("error", "trial"))).first()[0]
    one = filled.select(group, F.lit(best or 0).alias("trial")).withColumn("__key", shuffle_key(seed, F.col("trial"), F.col(group)))
    ranked = _ranked(one, ["trial"], ["__key", group], size)
    chosen = ranked.select(group, _side(F.col("__rank"), n_val, n_test).alias("split"))
    empty = numbered_globally(match(counts.select(group).distinct(), filled.select(group), [group], "left_anti"), [group], "__no")
    names = F.array(*map(F.lit, SPLITS))
    return chosen.unionByName(
        empty.select(group, F.get(names, ((F.col("__no") - 1) % len(SPLITS)).cast("int")).alias("split"))
    )


def _side(rank: Column, n_val: int, n_test: int) -> Column:
    """The split of a rank from 1: validation first, then test, the rest is for training."""
    return F.when(rank <= n_val, F.lit("val")).when(rank <= n_val + n_test, F.lit("test")).otherwise(F.lit("train"))


def _bins(place: Column, size: int, ranks: tuple[int, ...], classes: int) -> Column:
    """A number that never falls along the md5 order (``place`` from 0 to 1), with fine steps only where the given ranks of ``size`` groups can lie.

    The place of a rank varies by the standard deviation of a binomial share; within ``REACH`` of them on either side there
    are steps, as many as leave the fewest rows of a trial to move. Beyond them a step is wide, which costs more and changes nothing.
    """
    number = F.lit(0).cast("bigint")
    for rank in ranks:
        share = min(1.0, rank / max(1, size))
        spread = max(math.sqrt(share * (1 - share) / max(1, size)), 1 / max(1, size))
        step = spread * min(1.0, math.sqrt(2 * REACH * (classes + 1) / (4 * max(1, size) * spread)))
        most = math.ceil(2 * REACH * spread / step)
        number = number + F.least(F.greatest(F.floor((place - (share - REACH * spread)) / step), F.lit(-1)), F.lit(most))
    return number


def _spread(filled: DataFrame, group: str, size: int, trials: int, bins: int) -> DataFrame:
    """Every group with every ``trial``, dealt out in blocks of groups times blocks of trials, so that a task adds up what it deals.

    There are so many blocks of each that copies of groups and sums of blocks, which both move, are about as many.
    """
    tasks = max(1, math.ceil(size * trials / MOST_OF_TASK), min(LEAST_TASKS, math.ceil(size * trials / ROWS_OF_TASK)))
    trial_blocks = max(1, min(trials, tasks, math.ceil(math.sqrt(tasks * trials * bins / max(1, size)))))
    group_blocks = math.ceil(tasks / trial_blocks)
    each = math.ceil(trials / trial_blocks)
    block = F.explode(F.sequence(F.lit(0), F.lit(trial_blocks - 1)))
    dealt = filled.withColumn("__block", block).withColumn("__task", F.col("__block") * group_blocks + F.pmod(F.xxhash64(group), F.lit(group_blocks)))
    first = F.col("__block") * each
    some = dealt.repartitionById(trial_blocks * group_blocks, F.col("__task").cast("int")).filter(first < trials)
    return some.withColumn("trial", F.explode(F.sequence(first, F.least(first + each, F.lit(trials)) - 1))).drop("__block", "__task")


def trial_sums(
    filled: DataFrame, group: str, trials: int, seed: int, n_val: int, n_test: int, digits: int | None = None, in_task: int = IN_TASK
) -> DataFrame:
    """``(trial, cls, split, n)``, to be added up: the class sums of both sides of the cuts of every trial.

    ``filled`` is ``(group, __boxes)`` with an array of (cls, n). Where groups and their class counts are at most
    ``in_task``, a task holds them all and runs trial after trial (``_whole_trials``). More are dealt out too: a task adds
    up the groups and class sums of each trial by bins of the md5 order, fine ones about where the cuts must fall, before
    anything moves; that settles all but the two bins a cut falls into, and only the groups in those are ranked one by
    one. So what moves is trials times bins times classes, not trials times groups. A group's head is its bin (``_bins``),
    or, where ``digits`` is given, so many leading digits of its md5.
    """
    whole = _whole_trials(filled, group, trials, seed, n_val, n_test, in_task) if digits is None else None
    if whole is not None:
        return whole
    size = filled.count()
    classes = filled.select(F.explode("__boxes.cls")).distinct().count()
    every = _spread(filled, group, size, trials, 64 * (classes + 1))
    # What comes out of an explode is worked out once; an alias would be once for every use of it.
    for name, value in {
        "__key": shuffle_key(seed, F.col("trial"), F.col(group)),
        "__place": F.conv(F.substring("__key", 1, 8), 16, 10).cast("double") / float(1 << 32),
    }.items():
        every = every.withColumn(name, F.explode(F.array(value)))
    head = _bins(F.col("__place"), size, (n_val, n_val + n_test), classes) if digits is None else F.floor(F.col("__place") * 16**digits)
    every = every.withColumn("__head", head).drop("__place")
    # One entry more, of no class, counts the groups.
    kind = filled.schema["__boxes"].dataType.elementType
    itself = F.struct(F.lit(None).cast(kind["cls"].dataType).alias("cls"), F.lit(1).cast(kind["n"].dataType).alias("n"))
    parts = (
        every.select("trial", "__head", F.explode(F.concat("__boxes", F.array(itself))).alias("b"))
        .groupBy("trial", "__head", F.col("b.cls").alias("cls"))
        .agg(F.sum("b.n").alias("n"))
    )
    groups = F.when(F.col("cls").isNull(), F.col("n"))
    upto = F.sum(groups).over(W.partitionBy("trial").orderBy("__head").rangeBetween(W.unboundedPreceding, W.currentRow))
    here = F.sum(groups).over(W.partitionBy("trial", "__head"))
    first, last = F.col("__before") + 1, F.col("__upto")
    side = F.when(_side(first, n_val, n_test) == _side(last, n_val, n_test), _side(last, n_val, n_test))
    placed = parts.withColumn("__upto", upto).withColumn("__before", F.col("__upto") - here).withColumn("split", side)
    # Of each trial stay the sums of a side and class, and the heads a cut falls into.
    needed = placed.filter(F.col("cls").isNull() == F.col("split").isNull())
    of_cut = [F.when(F.col("split").isNull(), F.col(c)).alias(c) for c in ("__head", "__before")]
    told = checkpointed(needed.select("trial", "cls", "split", "n", *of_cut).groupBy("trial", "cls", "split", "__head", "__before").agg(F.sum("n").alias("n")))
    whole = told.filter("split IS NOT NULL").select("trial", "cls", "split", "n")
    # At most two rows a trial: the number of trials bounds what is broadcast.
    cut = F.broadcast(told.filter("split IS NULL").select("trial", "__head", "__before"))
    order = W.partitionBy("trial", "__head").orderBy("__key", group)
    ranked = every.join(cut, ["trial", "__head"]).withColumn("__key", F.unhex("__key")).withColumn("__rank", F.col("__before") + F.row_number().over(order))
    single = ranked.select("trial", _side(F.col("__rank"), n_val, n_test).alias("split"), F.explode("__boxes").alias("b"))
    return whole.unionByName(single.select("trial", F.col("b.cls").alias("cls"), "split", F.col("b.n").alias("n")))


def _whole_trials(filled: DataFrame, group: str, trials: int, seed: int, n_val: int, n_test: int, in_task: int) -> DataFrame | None:
    """The sums of ``trial_sums``, each trial by one task; none if a task cannot hold the groups, or some have no name of their own."""
    kind = {f.name: f.dataType.simpleString() for f in filled.schema["__boxes"].dataType.elementType}
    numbers = ("tinyint", "smallint", "int", "bigint")
    if kind["n"] not in numbers or kind["cls"] not in (*numbers, "string"):
        return None
    # What follows seed and trial in the text whose md5 orders the groups: nothing for null.
    named = filled.select(F.concat_ws("|", F.lit(""), F.col(group).cast("string")).alias("tail"), F.col("__boxes").alias("boxes"))
    most = F.aggregate("boxes", F.lit(0.0), lambda s, b: s + F.abs(b["n"].cast("double")))
    told = named.agg(
        F.count("*").alias("size"), F.count_distinct("tail").alias("names"), F.sum(F.size("boxes")).alias("counts"),
        F.sum(F.octet_length("tail")).alias("bytes"), F.sum(most).alias("most"),
    ).first()
    size = told["size"]
    if not size or told["names"] < size or size + told["counts"] > in_task or told["bytes"] > NAMES_IN_TASK or told["most"] > 2**52:
        return None
    blocks = min(trials, max(math.ceil(size * trials / KEYS_OF_TASK), min(LEAST_TASKS, math.ceil(size * trials / ROWS_OF_TASK))))
    each = math.ceil(trials / blocks)
    packed = named.mapInArrow(_packed, "groups binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {}
        for batch in batches:
            for block, groups in zip(batch.column("block").to_pylist(), batch.column("groups"), strict=True):
                held.setdefault(block, []).append(pa.ipc.open_stream(groups.as_buffer()).read_all())
        while held:
            block, tables = held.popitem()
            yield from _sums_of_trials(pa.concat_tables(tables), seed, range(block * each, min(trials, (block + 1) * each)), n_val, n_test)

    return packed.repartitionById(blocks, F.col("block")).mapInArrow(run, f"trial int, cls {kind['cls']}, split string, n bigint")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every batch as one binary value."""
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["groups"])


def _sums_of_trials(groups: pa.Table, seed: int, trials: range, n_val: int, n_test: int) -> Iterator[pa.RecordBatch]:
    """Class sums of both sides of the cuts, trial by trial, from ``(tail, boxes)`` of all groups."""
    groups = groups.take(pa.array(np.argsort(pc.binary_length(groups["tail"]).to_numpy(), kind="stable"))).combine_chunks()
    tails = groups["tail"].cast(pa.binary()).combine_chunks()
    tails = tails.chunk(0) if isinstance(tails, pa.ChunkedArray) else tails
    size = len(tails)
    ends = np.frombuffer(tails.buffers()[1], np.int32)[tails.offset : tails.offset + size + 1]
    letters = np.frombuffer(tails.buffers()[2], np.uint8)
    lengths = np.diff(ends)
    starts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])).tolist()
    alike = [(low, high, letters[ends[low] : ends[high]].reshape(high - low, -1)) for low, high in zip(starts, [*starts[1:], size], strict=True)]
    owner = np.repeat(np.arange(size), pc.list_value_length(groups["boxes"]).to_numpy())
    boxes = pc.list_flatten(groups["boxes"]).combine_chunks()
    boxes = boxes.chunk(0) if isinstance(boxes, pa.ChunkedArray) else boxes
    names = pc.struct_field(boxes, "cls").dictionary_encode()
    code, n = names.indices.to_numpy().astype(np.int64), pc.struct_field(boxes, "n").to_numpy().astype(np.float64)
    classes = len(names.dictionary)
    totals = np.bincount(code, n, classes)
    ranks = [min(n_val, size), min(n_val + n_test, size)]

    def lowest(keys: np.ndarray, cut: int, rank: int, head: bytes) -> np.ndarray:
        """Which groups are the first ``rank``; of those with the same leading digits, by whole keys."""
        among = keys <= cut
        over = int(np.count_nonzero(among)) - rank
        if over:
            ties = sorted(np.flatnonzero(keys == cut).tolist(), key=lambda i: hashlib.md5(head + tails[i].as_py()).digest())
            among[ties[-over:]] = False
        return among

    out: list[tuple[int, np.ndarray]] = []
    at_once = max(1, KEYS_AT_ONCE // size)
    at, words, shift = trials.start, [], -1
    while at < trials.stop:
        upto = min(trials.stop, at + at_once, 10 ** len(str(at)))
        heads = [f"{seed}|{trial}".encode() for trial in range(at, upto)]
        rows = np.frombuffer(b"".join(heads), np.uint8).reshape(len(heads), -1)
        if shift != rows.shape[1] % 4:
            shift = rows.shape[1] % 4
            words = [text_words(texts, shift) for _, _, texts in alike]
        keys = np.empty((len(heads), size), np.uint32)
        for (low, high, texts), own in zip(alike, words, strict=True):
            keys[:, low:high] = leading(rows, own, texts.shape[1])
        for trial, head, own in zip(range(at, upto), heads, keys, strict=True):
            cuts = np.partition(own, sorted({r - 1 for r in ranks}))
            first, both = (lowest(own, cuts[r - 1], r, head) for r in ranks)
            side = (first.view(np.uint8) + both.view(np.uint8)).take(owner)
            held = np.flatnonzero(side)
            test, val = np.bincount((side[held].astype(np.int64) - 1) * classes + code[held], n[held], 2 * classes).reshape(2, classes)
            out.append((trial, np.concatenate([totals - val - test, val, test])))
        at = upto
        if len(out) * classes > 10_000 or at == trials.stop:
            sums = np.concatenate([s for _, s in out]).astype(np.int64)
            there = np.flatnonzero(sums)
            split = pa.DictionaryArray.from_arrays(pa.array(there // classes % 3, pa.int32()), pa.array(["train", "val", "test"])).cast(pa.string())
            trial = np.repeat(np.array([t for t, _ in out], np.int32), 3 * classes)[there]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trial), names.dictionary.take(pa.array(there % classes)), split, pa.array(sums[there])], ["trial", "cls", "split", "n"]
            )
            out = []


def split_error(counts: DataFrame, assigned: DataFrame, group: str, target: dict[str, float] | None = None) -> DataFrame:
    """One row: summed distance of class shares from the target."""
    target = target or TARGET
    joined = counts.filter(F.col("n") > 0).join(assigned, group)
    sums = joined.groupBy("cls").agg(
        F.sum("n").alias("total"),
        *[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(s) for s in target],
    )
    off = sum((F.abs(F.col(s) / F.col("total") - F.lit(share)) for s, share in target.items()), F.lit(0.0))
    return sums.agg(F.sum(off).alias("error"))


def split_conflicts(df: DataFrame, key: list[str], split: str = "split") -> DataFrame:
    """Keys that hold rows of more than one split."""
    return (
        df.groupBy(*key)
        .agg(F.min(split).alias("a"), F.max(split).alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select(*key)
    )


def manifest_faults(manifest: DataFrame, groups: DataFrame, group: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """``(fault, what)``: groups in two splits, groups in none, splits with nothing."""
    twice = split_conflicts(manifest, [group]).select(
        F.lit("two_splits").alias("fault"), F.col(group).cast("string").alias("what")
    )
    none = groups.select(group).distinct().join(manifest, group, "left_anti").select(
        F.lit("unassigned").alias("fault"), F.col(group).cast("string").alias("what")
    )
    used = manifest.join(groups.select(group), group, "left_semi").select("split").distinct()
    wanted = values(manifest.sparkSession, [(s,) for s in splits], "split string")
    empty = wanted.join(used, "split", "left_anti").select(
        F.lit("empty_split").alias("fault"), F.col("split").alias("what")
    )
    return twice.unionByName(none).unionByName(empty)


def assert_no_leak(manifest: DataFrame, groups: DataFrame, group: str, splits: tuple[str, ...] = SPLITS) -> None:
    """Refuse a manifest with faults, naming some of them."""
    found = manifest_faults(manifest, groups, group, splits).take(5)
    if found:
        raise ValueError(f"split refused: {[tuple(r) for r in found]}")


def shared_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys on both sides; empty when train and val do not leak."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi")


def provenance_note(runs: DataFrame) -> DataFrame:
    """One row ``(verdict, cuts)``: official, not_official or unknown, from ``split_at`` and ``official``."""
    cuts = F.array_sort(F.collect_set("split_at"))
    return runs.agg(
        cuts.alias("cuts"),
        F.count_if(F.col("split_at").isNull()).alias("__none"),
        F.coalesce(F.bool_and(F.coalesce("official", F.lit(False))), F.lit(True)).alias("__all"),
    ).select(
        F.when(F.size("cuts") == 0, F.lit("unknown"))
        .when(
            F.col("__all") & (F.size("cuts") == 1) & (F.get("cuts", F.lit(0)) == 600) & (F.col("__none") == 0),
            F.lit("official"),
        )
        .otherwise(F.lit("not_official"))
        .alias("verdict"),
        "cuts",
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 0, by: list[str] | None = None) -> DataFrame:
    """``n`` rows, of each ``by`` group if given, in an md5 order of the key."""
    groups = by or ["__all"]
    rows = df.withColumn("__key", shuffle_key(seed, F.col(key))).withColumn("__want", F.lit(n))
    if not by:
        rows = rows.withColumn("__all", F.lit(1))
    ranked = _first_of_each(rows, groups, ["__key", key], "__want")
    return ranked.filter("__first").select(df.columns)
