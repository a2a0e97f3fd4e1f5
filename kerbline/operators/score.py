"""Scoring of labels, models and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import metric_like, wilson
from ..session import beside


def _graded(key: DataFrame, pred: DataFrame, dimension: DataFrame, item: str) -> DataFrame:
    """``(item, label, pred, parent)`` over key items of a real class; no prediction is null."""
    real = key.select(item, "label").join(
        dimension.select(F.col("fine").alias("label"), "parent"), "label"
    )
    return real.join(pred.select(item, "pred"), item, "left")


def per_class(key: DataFrame, pred: DataFrame, dimension: DataFrame, item: str = "item") -> DataFrame:
    """``(label, parent, n, hits, recall, is_blind)``: one row per class of the key.

    ``is_blind`` marks the parent's commonest class (ties: the smallest name), the
    answer of a guesser that never looks.
    """
    counts = _graded(key, pred, dimension, item).groupBy("parent", "label").agg(
        F.count("*").alias("n"), F.count_if(F.col("pred") == F.col("label")).alias("hits")
    )
    blind = counts.groupBy("parent").agg(
        F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("blind")
    )
    return counts.join(F.broadcast(blind), "parent").select(
        "label",
        "parent",
        "n",
        "hits",
        (F.col("hits") / F.col("n")).alias("recall"),
        (F.col("label") == F.col("blind")).alias("is_blind"),
    )


def score(
    key: DataFrame, pred: DataFrame, dimension: DataFrame, item: str = "item", min_support: int = 5
) -> DataFrame:
    """One row: accuracy, macro recall over classes with enough items, both for the blind guess, verdict.

    Items without a prediction count as wrong.
    """
    classes = per_class(key, pred, dimension, item)
    enough = F.col("n") >= min_support
    blind = F.col("is_blind").cast("double")
    zero = F.lit(0.0)
    grades = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(F.sum("hits") / F.sum("n"), zero).alias("accuracy"),
        F.coalesce(F.sum(F.col("n") * blind) / F.sum("n"), zero).alias("blind_accuracy"),
        F.coalesce(F.avg(F.when(enough, F.col("recall"))), zero).alias("macro_recall"),
        F.coalesce(F.avg(F.when(enough, blind)), zero).alias("blind_macro_recall"),
        F.count_if(enough).alias("n_scored_classes"),
    )
    lost = _graded(key, pred, dimension, item).agg(
        F.count_if(F.col("pred").isNull()).alias("n_missing"),
        F.count_if(F.col("pred") == "unclear").alias("n_abstained"),
        F.count_if(F.col("pred") == "unparsed").alias("n_unparsed"),
    )
    return beside(grades, lost).withColumn(
        "verdict", verdict(F.col("macro_recall"), F.col("blind_macro_recall"))
    )


def verdict(macro: Column, blind: Column) -> Column:
    return (
        F.when(macro <= blind, F.lit("no_better_than_blind"))
        .when(macro <= 0.50, F.lit("reads_some"))
        .otherwise(F.lit("usable"))
    )


def confusion(key: DataFrame, pred: DataFrame, dimension: DataFrame, item: str = "item", k: int = 8) -> DataFrame:
    """The ``k`` commonest mistakes ``(label, pred, n)``; no prediction reads ``MISSING``."""
    wrong = _graded(key, pred, dimension, item).withColumn("pred", F.coalesce("pred", F.lit("MISSING")))
    counts = wrong.filter(F.col("pred") != F.col("label")).groupBy("label", "pred").agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "label", "pred").limit(k)


def contingency(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def proportion(df: DataFrame, hit: Column) -> DataFrame:
    """One row: hits, trials, rate and the 95 % score interval."""
    counts = df.agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"))
    interval = wilson(F.col("hits"), F.col("n"))
    return counts.select(
        "hits", "n", (F.col("hits") / F.col("n")).alias("rate"),
        interval["low"].alias("low"), interval["high"].alias("high"),
    )


def reading_score(readings: DataFrame, truth: str = "label", min_width: float = 32, min_confidence: float = 0.60) -> DataFrame:
    """One row: how gated readings ``(label, value, conf, px)`` fare against their labels.

    A label that is not a number is junk: declining it is right.
    """
    number = F.expr(f"try_cast(`{truth}` AS INT)")
    is_number = number.isNotNull()
    wide = F.col("px") >= min_width
    answered = wide & (F.col("conf") >= min_confidence)
    right = F.coalesce(F.col("value") == number, F.lit(False))
    return readings.agg(
        F.count_if(is_number).alias("n_numbers"),
        F.count_if(is_number & wide).alias("n_above_size"),
        F.count_if(is_number & answered & right).alias("n_right"),
        F.count_if(is_number & answered & ~right).alias("n_wrong"),
        F.count_if(is_number & ~answered).alias("n_declined"),
        F.count_if(~is_number).alias("n_junk"),
        F.count_if(~is_number & ~answered).alias("n_junk_declined"),
        F.count_if(is_number & right).alias("n_right_ungated"),
        (F.count_if(is_number & answered & right) / F.count_if(is_number)).alias("gated_accuracy"),
        (F.count_if(is_number & right) / F.count_if(is_number)).alias("ungated_accuracy"),
    )


def reading_score_by_value(readings: DataFrame, truth: str = "label") -> DataFrame:
    number = F.expr(f"try_cast(`{truth}` AS INT)")
    return (
        readings.withColumn("number", number)
        .filter(F.col("number").isNotNull())
        .groupBy("number")
        .agg(F.count("*").alias("n"), F.count_if(F.col("value") == F.col("number")).alias("n_right"))
    )


# ---- runs and benchmarks ---------------------------------------------------------------


def fastest_variant(benchmarks: DataFrame) -> DataFrame:
    """Per run: the variant of least total time among those that ran, and all flag words seen."""
    ran = benchmarks.filter(F.col("status") == "ok")
    return ran.groupBy("run").agg(
        F.min_by(F.struct("variant", "total_ms", "fps"), F.struct("total_ms", "variant")).alias("b"),
        F.array_sort(F.collect_set("throttled")).alias("flags"),
    ).select("run", "b.variant", "b.total_ms", "b.fps", "flags")


def learning_rates(epochs: DataFrame) -> DataFrame:
    """Per run: the highest and the last learning rate; blanks are skipped."""
    rate = F.expr("try_cast(lr AS DOUBLE)")
    return epochs.withColumn("rate", rate).filter(F.col("rate").isNotNull()).groupBy("run").agg(
        F.max("rate").alias("lr_peak"), F.max_by("rate", "epoch").alias("lr_last")
    )


def stage_latency(timings: DataFrame, by: list[str], stages: list[str], target_fps: float = 18.0) -> DataFrame:
    """Mean milliseconds per stage, frames a second from the mean total, and whether the target is met."""
    total = sum((F.col(s) for s in stages), F.lit(0.0))
    mean = timings.groupBy(*by).agg(
        *[F.avg(s).alias(f"mean_{s}") for s in stages], F.avg(total).alias("mean_total")
    )
    fps = F.lit(1000.0) / F.col("mean_total")
    return mean.withColumn("fps", fps).withColumn("target_met", F.col("fps") >= target_fps)


def run_table(runs: DataFrame, rates: DataFrame, best: DataFrame) -> DataFrame:
    """Runs ``(run, label_set, imgsz, metrics)`` with their metrics, rates and fastest variant, sorted."""
    flat = runs.select(
        "run",
        "label_set",
        "imgsz",
        metric_like(F.col("metrics"), "mAP50(").alias("map50"),
        metric_like(F.col("metrics"), "mAP50-95(").alias("map"),
        metric_like(F.col("metrics"), "precision(").alias("precision"),
        metric_like(F.col("metrics"), "recall(").alias("recall"),
        *[c for c in ("digest",) if c in runs.columns],
    )
    return (
        flat.join(rates, "run", "left").join(best, "run", "left").orderBy("label_set", "imgsz", "run")
    )


def scaling_curve(tally: DataFrame, runs: DataFrame) -> DataFrame:
    """Per data fraction: size of the subset beside the metrics trained on it."""
    return tally.join(runs, "percent").orderBy("percent")
