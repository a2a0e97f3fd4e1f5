"""Readers of annotation files, catalogues, notebooks and run records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import metric_like
from ..operators.score import learning_rates
from ..session import values
from .files import system_of, with_scheme

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "ppm")
#: What a run leaves: its record, the rates by epoch and its arguments.
RUN_FILES = ("run_meta.json", "results.csv", "args.yaml")
#: The metrics of a run's record, and what the names they go by contain.
METRICS = {"map50": "mAP50(", "map": "mAP50-95(", "precision": "precision(", "recall": "recall("}
BOX_ARRAY = "array<struct<frame:int,xyxy:array<double>,cls:int,conf:double,size:double>>"
TRACKS = (
    "clip string, track_id int, coarse string, labelable boolean, crop_id string, n_dets int, "
    "flips_class boolean, peak struct<frame:int,xyxy:array<double>,cls:int,conf:double,size:double>, "
    f"members {BOX_ARRAY}"
)
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,"
    "attributes:map<string,string>>>, categories array<struct<id:int,name:string>>"
)


def stem_of(path: Column) -> Column:
    """File name without directories and suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def directory_of(path: Column) -> Column:
    """Name of the folder a file lies in."""
    return F.element_at(F.split(path, "/"), -2)


def is_litter(path: Column) -> Column:
    """Hidden files and what archive tools of one system leave behind."""
    return path.rlike(r"(^|/)(__MACOSX(/|$)|\.DS_Store$|\.[^/]*$)")


def _once(value: Column) -> Column:
    """A value that is worked out once a row: filters over what comes out of an explode are not moved below it, where they repeat it."""
    return F.explode(F.array(value))


def split_gt_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines ``name;left;top;right;bottom;class`` to ``(boxes, bad lines)``; blank lines go.

    A box is keyed by the stem, so that copies saved under another suffix match.
    """
    parts = lines.withColumn("__text", _once(F.trim(F.col(value)))).filter("__text != ''").withColumn("__p", _once(F.split("__text", ";")))
    numbers = {
        name: F.expr(f"try_cast(trim(get(__p, {i})) AS INT)")
        for i, name in enumerate(("left", "top", "right", "bottom", "class_id"), start=1)
    }
    wide = parts.withColumn("__n", _once(F.struct(*[c.alias(name) for name, c in numbers.items()])))
    good = F.size("__p") == 6
    for name in numbers:
        good = good & F.col(f"__n.{name}").isNotNull()
    keep = [c for c in lines.columns if c != value]
    boxes = wide.filter(good).select(*keep, stem_of(F.get("__p", F.lit(0))).alias("stem"), *[F.col(f"__n.{name}").alias(name) for name in numbers])
    bad = wide.filter(~good).select(
        *keep, value, F.when(F.size("__p") != 6, F.lit("field-count")).otherwise(F.lit("parse")).alias("reason")
    )
    return boxes, bad


def read_gt(spark: SparkSession, path: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The annotation file(s) of a sign benchmark; ``strict`` makes a bad line an error when read."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    boxes, bad = split_gt_lines(lines)
    if strict:
        number = r"\s*[+-]?[0-9]{1,10}\s*"
        checked = lines.filter(F.trim("value") != "").withColumn(
            "value",
            F.when(F.size(F.split("value", ";")) != 6, F.raise_error(F.concat(F.col("file"), F.lit(": not 6 fields: "), F.col("value"))).cast("string"))
            .when(
                ~F.col("value").rlike(rf"^[^;]*(;{number}){{5}}$"),
                F.raise_error(F.concat(F.col("file"), F.lit(": not five whole numbers: "), F.col("value"))).cast("string"),
            )
            .otherwise(F.col("value")),
        )
        boxes, _ = split_gt_lines(checked)
    return boxes, bad


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of all files under a folder, empty ones too (file scans skip those).

    The folders right under the root are walked by tasks of their own.
    """

    def walk(recursive: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyarrow import fs

            for batch in batches:
                for folder in batch["path"]:
                    system, inside = system_of(folder)
                    found = system.get_file_info(fs.FileSelector(inside, recursive=recursive))
                    rows = [(i.path, i.type == fs.FileType.Directory, i.size or 0) for i in found]
                    yield pd.DataFrame(rows, columns=["path", "is_dir", "length"])

        return run

    schema = "path string, is_dir boolean, length bigint"
    top = values(spark, [(with_scheme(spark, root),)], "path string").mapInPandas(walk(False), schema)
    deep = top.filter("is_dir").select("path").repartition("path").mapInPandas(walk(True), schema)
    return top.unionByName(deep).filter("NOT is_dir").select("path", "length")


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, dir, stem, length)`` of the images under a folder; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    return only_images(files)


def only_images(files: DataFrame) -> DataFrame:
    """Image files of a list with ``path``, with their ``dir`` and ``stem``; litter goes."""
    return files.filter(
        F.lower("path").rlike(r"\.(" + "|".join(IMAGE_SUFFIXES) + r")$") & ~is_litter(F.col("path"))
    ).withColumns({"dir": F.regexp_replace("path", "/[^/]*$", ""), "stem": stem_of(F.col("path"))})


def rank_annotation_dirs(annotation_dirs: DataFrame, images: DataFrame) -> DataFrame:
    """Folders that hold annotations, best first: with images, then shallow, then by path."""
    counts = images.groupBy("dir").agg(F.count("*").alias("n_images"))
    ranked = annotation_dirs.select("dir").distinct().join(counts, "dir", "left").select(
        "dir", F.coalesce("n_images", F.lit(0)).cast("bigint").alias("n_images"), F.size(F.split("dir", "/")).alias("depth")
    )
    return ranked.orderBy((F.col("n_images") > 0).cast("int").desc(), "depth", "dir")


def split_label_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Label lines ``cls xc yc w h`` to ``(boxes, malformed with a reason)``; blank lines go."""
    parts = lines.withColumn("__text", _once(F.trim(F.col(value)))).filter("__text != ''").withColumn("__p", _once(F.split("__text", r"\s+")))
    fields = {"cls": "INT", "xc": "DOUBLE", "yc": "DOUBLE", "w": "DOUBLE", "h": "DOUBLE"}
    numbers = [F.expr(f"try_cast(get(__p, {i}) AS {kind})").alias(name) for i, (name, kind) in enumerate(fields.items())]
    wide = parts.withColumn("__n", _once(F.struct(*numbers)))
    parsed = F.lit(True)
    for name in fields:
        parsed = parsed & F.col(f"__n.{name}").isNotNull()
    reason = F.when(F.size("__p") != 5, F.lit("field-count")).when(~parsed, F.lit("parse"))
    marked = wide.withColumn("reason", reason)
    keep = [c for c in lines.columns if c != value]
    return (
        marked.filter(F.col("reason").isNull()).select(*keep, *[F.col(f"__n.{name}").alias(name) for name in fields]),
        marked.filter(F.col("reason").isNotNull()).select(*keep, value, "reason"),
    )


def read_labels_of(spark: SparkSession, images: DataFrame, label_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(frames, boxes, malformed)``: the image list decides the frames, so empty label files survive.

    ``has_file`` in frames tells a background frame (an empty file) from a missing file.
    """
    files = (
        list_files(spark, label_path).filter(F.lower("path").endswith(".txt"))
        .select(stem_of(F.col("path")).alias("stem")).distinct().withColumn("has_file", F.lit(True))
    )
    lines = spark.read.option("recursiveFileLookup", "true").text(label_path, pathGlobFilter="*.txt").select(
        "value", stem_of(F.col("_metadata.file_path")).alias("stem")
    )
    boxes, bad = split_label_lines(lines)
    frames = images.join(files, "stem", "left").withColumn("has_file", F.coalesce("has_file", F.lit(False)))
    return frames, boxes, bad


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(images, annotations, categories)``; boxes as ``x, y, w, h`` in pixels, attributes as a map."""
    doc = spark.read.schema(COCO).json(path, multiLine=True).withColumn("source", F.col("_metadata.file_path"))
    return coco_tables(doc)


def coco_tables(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables of parsed documents that also carry ``source``."""
    images = doc.select("source", F.inline("images")).withColumnRenamed("id", "image_id")
    notes = doc.select("source", F.inline("annotations")).select(
        "source", F.col("id").alias("annotation_id"), "image_id", "category_id",
        *[F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate("xywh")], "attributes",
    )
    categories = doc.select("source", F.inline("categories")).withColumnRenamed("id", "category_id")
    return images, notes, categories


def read_tracks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(tracks, members)``: one row per track, and one per detection of a track."""
    return track_tables(spark.read.schema(TRACKS).json(path, multiLine=True))


def track_tables(tracks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed track documents as ``(tracks, members)``."""
    members = tracks.select(
        "clip", F.col("track_id").alias("track"), "crop_id", "labelable", F.explode("members").alias("m")
    ).select(
        "clip", "track", "crop_id", "labelable", F.col("m.frame").alias("frame"),
        *[F.get("m.xyxy", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        "m.cls", "m.conf", "m.size",
    )
    return tracks.drop("members"), members


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV table with a header; a missing file is an empty table."""
    try:
        return spark.read.schema(schema).csv(path, header=True, enforceSchema=False)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def read_label_csv(spark: SparkSession, path: str, key: str = "crop_id") -> DataFrame:
    """``(key, label)`` from a CSV whose label column is called ``pred`` or ``label``."""
    table = spark.read.csv(path, header=True, inferSchema=False)
    return label_column(table, key)


def label_column(table: DataFrame, key: str) -> DataFrame:
    found = [c for c in ("pred", "label") if c in table.columns]
    if not found or key not in table.columns:
        raise ValueError(f"expected {key} and a 'pred' or 'label' column, got {table.columns}")
    return table.select(key, F.coalesce(*found).alias("label"))


def notebook_rows(df: DataFrame, json: str) -> DataFrame:
    """A picks notebook ``{clips: {clip: {selected, flipped}}}`` to ``(clip, frame_id, flipped)``.

    Unreadable JSON gives no rows, missing lists are empty.
    """
    doc = F.from_json(
        json,
        "version int, clips map<string,struct<selected:array<string>,flipped:array<string>>>",
        {"mode": "PERMISSIVE"},
    )
    clips = df.select(F.explode(F.coalesce(doc["clips"], F.create_map().cast(
        "map<string,struct<selected:array<string>,flipped:array<string>>>"))).alias("clip", "r"))
    none = F.array().cast("array<string>")
    return clips.select(
        "clip", F.coalesce("r.flipped", none).alias("f"), F.explode(F.coalesce("r.selected", none)).alias("frame_id")
    ).select("clip", "frame_id", F.array_contains("f", F.col("frame_id")).alias("flipped"))


def catalogue_rows(df: DataFrame, json: str) -> DataFrame:
    """A video notebook ``{videos: {name: record}}`` to one row per video with its derived state."""
    record = (
        "struct<selected:array<string>,downloads:array<struct<at:string,count:int>>,"
        "extract:struct<interval_s:double>,meta:struct<duration_s:double,fps:double>,archived:boolean>"
    )
    doc = F.from_json(json, f"videos map<string,{record}>", {"mode": "PERMISSIVE"})
    rows = df.select(F.explode(doc["videos"]).alias("video", "r"))
    last = F.try_element_at("r.downloads", F.lit(-1))
    n_downloads = F.coalesce(F.size("r.downloads"), F.lit(0))
    return rows.select(
        "video",
        F.greatest(F.coalesce(F.size("r.selected"), F.lit(0)), F.lit(0)).alias("n_selected"),
        F.greatest(n_downloads, F.lit(0)).alias("n_downloads"),
        last["at"].alias("last_download"),
        last["count"].alias("last_count"),
        F.col("r.extract.interval_s").alias("interval_s"),
        F.col("r.meta.duration_s").alias("duration_s"),
        F.coalesce("r.archived", F.lit(False)).alias("archived"),
        F.when(F.col("r.extract").isNull(), F.lit("untouched"))
        .when(n_downloads > 0, F.lit("done"))
        .otherwise(F.lit("in_progress"))
        .alias("state"),
    )


def describe_catalogue(videos: DataFrame, notebook: DataFrame, index: DataFrame) -> DataFrame:
    """One row per video: file facts, progress and derived state.

    ``videos`` is ``(video, size_bytes)``, ``index`` is ``(video, n_frames, index_duration_s)``.
    """
    return (
        videos.join(notebook, "video", "left").join(index, "video", "left").select(
            "video",
            F.round(F.col("size_bytes") / 1e6, 1).alias("size_mb"),
            F.coalesce("state", F.lit("untouched")).alias("state"),
            F.coalesce("n_frames", F.lit(0)).alias("extracted"),
            F.coalesce("duration_s", "index_duration_s", F.lit(0.0)).alias("duration_s"),
            F.coalesce("n_selected", F.lit(0)).alias("selected"),
            "last_download",
            F.coalesce("n_downloads", F.lit(0)).alias("downloads"),
            (F.col("interval_s").isNotNull() & F.col("n_frames").isNull()).alias("stale"),
        )
    )


def frame_index(df: DataFrame, json: str) -> DataFrame:
    """A frame index ``{fps, ..., frames: [{id, index, time_s}]}`` or one with a map by name: ``(frame_id, index, time_s)`` a frame.

    The other columns stay, but for the JSON. Unreadable JSON gives no rows; frames of a map are named by their keys.
    """
    record = "struct<id:string,index:bigint,time_s:double>"
    listed = F.from_json(json, f"frames array<{record}>", {"mode": "PERMISSIVE"})["frames"]
    mapped = F.from_json(json, f"frames map<string,{record}>", {"mode": "PERMISSIVE"})["frames"]
    named = F.transform(F.map_entries(mapped), lambda e: e["value"].withField("id", F.coalesce(e["value"]["id"], e["key"])))
    keep = [c for c in df.columns if c != json]
    rows = df.select(*keep, F.explode(F.coalesce(F.filter(listed, lambda r: r.isNotNull()), named)).alias("__f"))
    return rows.select(*keep, F.col("__f.id").alias("frame_id"), F.col("__f.index").alias("index"), F.col("__f.time_s").alias("time_s"))


def frame_scores(df: DataFrame, json: str) -> DataFrame:
    """Scores ``{frames: {name: {score, ...}}}``: ``(frame_id, kind, score)``, one row for each number of a frame.

    The other columns stay, but for the JSON. Unreadable JSON, and one without frames, gives no rows; what is not a number goes.
    """
    frames = F.from_json(json, "frames map<string,map<string,string>>", {"mode": "PERMISSIVE"})["frames"]
    keep = [c for c in df.columns if c != json]
    frame = df.select(*keep, F.explode(frames).alias("frame_id", "__s"))
    kinds = frame.select(*keep, "frame_id", F.explode("__s").alias("kind", "__v"))
    return kinds.withColumn("score", F.expr("try_cast(__v AS DOUBLE)")).filter("score IS NOT NULL").drop("__v")


def read_json_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``(folder, json)`` of all files of a name below a folder, each as one text; a missing folder has none."""
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True, pathGlobFilter=name)
    return files.select(folder.alias("folder"), F.col("value").alias("json"))


def run_texts(spark: SparkSession, root: str) -> DataFrame:
    """``(folder, name, text)`` of the files that runs leave below a folder, listed and read once."""
    path = F.col("_metadata.file_path")
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True, pathGlobFilter="{" + ",".join(RUN_FILES) + "}")
    return files.select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def _runs(texts: DataFrame) -> DataFrame:
    """One row a run with the texts of its files; what its meta says is parsed."""
    kinds = "label_set string, imgsz int, metrics map<string,double>, dataset struct<split_at:int,official_split:boolean>"
    beside = [F.max(F.when(F.col("name") == file, F.col("text"))).alias(f"__{i}") for i, file in enumerate(RUN_FILES)]
    run = texts.groupBy("folder").agg(*beside).filter("__0 IS NOT NULL").withColumn("__m", F.from_json("__0", kinds))
    return run.select(
        "folder", F.regexp_extract("folder", r"([^/]+)$", 1).alias("run"), "__m.label_set", "__m.imgsz", "__m.metrics",
        F.col("__m.dataset.split_at").alias("split_at"), F.col("__m.dataset.official_split").alias("official"),
        F.col("__1").alias("results"), F.col("__2").alias("args"),
    )


def _epochs(runs: DataFrame) -> DataFrame:
    """``(folder, run, epoch, lr)`` of the lines of the runs' results; each file is read by its own header."""
    lines = runs.select("folder", "run", _once(F.split("results", r"\r?\n")).alias("__lines"))
    named = lines.withColumn("__head", _once(F.transform(_csv_fields(F.get("__lines", F.lit(0))), lambda name: F.trim(name))))
    rows = named.filter(F.array_contains("__head", "epoch") & F.array_contains("__head", "lr/pg0")).select(
        "folder", "run", "__head", F.explode(F.slice("__lines", 2, F.greatest(F.size("__lines") - 1, F.lit(0)))).alias("__line")
    )
    fields = rows.filter(F.trim("__line") != "").withColumn("__f", _once(_csv_fields(F.col("__line"))))
    value = {n: F.nullif(F.get("__f", F.array_position("__head", n) - 1), F.lit("")) for n in ("epoch", "lr/pg0")}
    return fields.select("folder", "run", value["epoch"].try_cast("int").alias("epoch"), value["lr/pg0"].alias("lr"))


def _csv_fields(line: Column) -> Column:
    """The fields of a line of CSV, without the white space before them and the quotes around them."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',[ \t]*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    bare = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), bare(f)).otherwise(f))


def read_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, epochs)`` of a folder of training runs; a folder without a record is skipped.

    A run is a folder with ``run_meta.json``; ``results.csv`` beside it gives the epochs.
    """
    runs = _runs(run_texts(spark, root))
    return runs.select("run", "label_set", "imgsz", "metrics", "split_at", "official"), _epochs(runs).select("run", "epoch", "lr")


def collect_runs(spark: SparkSession, root: str) -> DataFrame:
    """One flat record a run: what its meta says, the highest and the last learning rate, four metrics, two of its arguments.

    A run is a folder with ``run_meta.json``. ``results.csv`` gives the rates by epoch, ``args.yaml`` the optimizer and
    the share of mirrored images as ``key: value`` lines; either may be missing. Metrics are found by the start of their names.
    """
    return collect_run_texts(run_texts(spark, root))


def collect_run_texts(texts: DataFrame) -> DataFrame:
    """The records of ``collect_runs`` from ``(folder, name, text)``, wherever the files are kept."""
    runs = _runs(texts)
    epochs = _epochs(runs).select(F.col("folder").alias("run"), "epoch", F.trim("lr").alias("lr"))
    rates = learning_rates(epochs).withColumnRenamed("run", "folder")
    lines = runs.select("folder", F.explode(F.split("args", r"\r?\n")).alias("value"))
    pair = lines.select("folder", F.regexp_extract("value", r"^([A-Za-z0-9_]+):", 1).alias("key"), F.trim(F.regexp_extract("value", r"^[A-Za-z0-9_]+:([^#]*)", 1)).alias("v"))
    given = F.nullif(F.nullif(F.regexp_replace("v", r"""^['"]|['"]$""", ""), F.lit("null")), F.lit(""))
    args = pair.groupBy("folder").agg(
        F.max(F.when(F.col("key") == "optimizer", given)).alias("optimizer"),
        F.expr("try_cast(max(CASE WHEN key = 'fliplr' THEN v END) AS DOUBLE)").alias("fliplr"),
    )
    metrics = {name: metric_like(F.col("metrics"), text) for name, text in METRICS.items()}
    return (
        runs.join(rates, "folder", "left").join(args, "folder", "left")
        .select("run", "label_set", "imgsz", "split_at", "official", "lr_peak", "lr_last", "optimizer", "fliplr", *[m.alias(n) for n, m in metrics.items()])
    )
