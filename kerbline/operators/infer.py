"""Running a model that the caller brings, on what it has not seen yet."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .review import only_new


def detect_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows to any number of detections each. ``load`` runs once per task and returns the detector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = load()
        for batch in batches:
            yield detector(batch)

    return df.mapInPandas(run, schema)


def reader_udf(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]):
    """A column function of a struct to ``(value, conf)``. ``load`` runs once per worker task."""

    @F.pandas_udf("value int, conf double")
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = load()
        for batch in batches:
            yield reader(batch)

    return read


def run_model(
    df: DataFrame,
    load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
    key: str,
    done: DataFrame | None = None,
    model_id: str | None = None,
) -> DataFrame:
    """Results of the rows this model has not been run on.

    ``done`` is ``(key, model_id)``: a record of its own, since a row may well have
    no detection. Records of another model do not count.
    """
    todo = df if done is None else only_new(df, done.filter(F.col("model_id") == model_id), [key])
    found = detect_with(todo, load, schema)
    return found if model_id is None else found.withColumn("model_id", F.lit(model_id))
