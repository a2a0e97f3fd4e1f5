"""Writers of label texts, cards, merged documents and sorted CSV."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .archive import write_archives
from .files import write_text_files

#: Files that one archive of labels holds.
FILES_OF_ARCHIVE = 50_000


def write_label_texts(texts: DataFrame, path: str) -> None:
    """Label texts ``(frame, split, text)`` as a table, one folder per split, replacing what was there."""
    texts.write.mode("overwrite").partitionBy("split").parquet(path)


def write_label_files(texts: DataFrame, path: str) -> None:
    """Label texts ``(frame, split, text)`` as files ``<split>/<frame>.txt``, empty ones for frames without boxes.

    What was there is replaced when all files are written (``files.write_text_files``).
    """
    name = F.concat(F.col("frame").cast("string"), F.lit(".txt"))
    write_text_files(texts.select(F.col("split").alias("folder"), name.alias("name"), "text"), path)


def write_label_archives(texts: DataFrame, path: str, n_files: int) -> DataFrame:
    """The same files as members of zip archives ``labels-<number>.zip``; returns ``(archive, members)``.

    A file of its own takes a block of some 4 KB for a text of a few lines, and a place in the file system's listing. For
    millions of frames the named files are kept in archives, about ``FILES_OF_ARCHIVE`` of ``n_files`` in each.
    """
    number = F.pmod(F.xxhash64("frame"), F.lit(max(1, math.ceil(n_files / FILES_OF_ARCHIVE))))
    member = F.concat(F.col("split"), F.lit("/"), F.col("frame").cast("string"), F.lit(".txt"))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return write_archives(texts.select(F.format_string("labels-%06d.zip", number).alias("archive"), member.alias("member"), text.alias("bytes")), path)


def write_text_archives(files: DataFrame, path: str, n_files: int) -> DataFrame:
    """Files ``(folder, name, text)`` as members of zip archives ``files-<number>.zip``, a folder in one; returns ``(archive, members)``.

    About ``FILES_OF_ARCHIVE`` of ``n_files`` are in each, for the same reason.
    """
    number = F.pmod(F.xxhash64("folder"), F.lit(max(1, math.ceil(n_files / FILES_OF_ARCHIVE))))
    text = F.coalesce("text", F.lit("")).cast("binary")
    return write_archives(files.select(F.format_string("files-%06d.zip", number).alias("archive"), F.concat_ws("/", "folder", "name").alias("member"), text.alias("bytes")), path)


def write_sorted_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, globally sorted: files follow each other in the order."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)


def write_card(card: DataFrame, path: str) -> None:
    """The one-row dataset card as a text file."""
    card.coalesce(1).write.mode("overwrite").text(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """A merged dataset as three JSON-lines tables under one folder.

    Three tables rather than one document, so no task holds the whole dataset.
    """
    for name, table in (("images", images), ("annotations", annotations), ("categories", categories)):
        table.write.mode("overwrite").json(f"{path}/{name}")


def coco_annotations(annotations: DataFrame) -> DataFrame:
    """Annotation rows in document form: contiguous ids and ``bbox`` as an array."""
    return annotations.select(
        F.col("new_annotation_id").alias("id"),
        F.col("new_image_id").alias("image_id"),
        (F.col("idx") + 1).alias("category_id"),
        F.array("x", "y", "w", "h").alias("bbox"),
    )
