"""Readers and writers on real files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from kerbline.operators import build as U
from kerbline.sources import archive, contract, readers, writers


def test_gt_reader(spark, tmp_path):
    path = tmp_path / "gt.txt"
    path.write_text("00000.ppm;10;10;30;30;1\n\n00002.png;40;10;70;30;11\n")
    boxes, bad = readers.read_gt(spark, str(path))
    assert {(r.stem, r.left, r.class_id) for r in boxes.collect()} == {("00000", 10, 1), ("00002", 40, 11)} and bad.count() == 0
    path.write_text("00000.ppm;10;10;30\n")
    with pytest.raises(Exception, match="not 6 fields"):
        readers.read_gt(spark, str(path))[0].collect()
    path.write_text("00000.ppm;10;10;30;30;1\n00001.ppm;10;ten;30;30;1\n")
    with pytest.raises(Exception, match="not five whole numbers"):
        readers.read_gt(spark, str(path))[0].collect()
    boxes, bad = readers.read_gt(spark, str(path), strict=False)
    assert boxes.count() == 1 and [r.reason for r in bad.collect()] == ["parse"]


def test_lines_are_made_once(spark):
    """What a line is made of is not worked out again for every field and filter."""
    lines = spark.range(4).select(F.concat_ws(";", F.md5(F.col("id").cast("string")), *map(F.lit, "11111")).alias("value"))
    spaced = lines.select(F.concat(F.lit("0 0 0 0 "), F.col("value")).alias("value"))
    for table in (*readers.split_gt_lines(lines), *readers.split_label_lines(spaced)):
        assert table._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
    assert [t.count() for t in (*readers.split_gt_lines(lines), *readers.split_label_lines(spaced))] == [4, 0, 0, 4]
    blank = spark.createDataFrame([("",), ("  ",), ("\t",), (None,), ("0 1 2 3 4",)], "value string")
    assert [t.count() for t in (*readers.split_gt_lines(blank), *readers.split_label_lines(blank))] == [0, 2, 1, 1]


def test_empty_label_files_survive(spark, tmp_path):
    images, labels = tmp_path / "images", tmp_path / "labels"
    images.mkdir(), labels.mkdir()
    for name in ("a", "b", "c", "._a"):
        (images / f"{name}.jpg").write_bytes(b"x")
    (labels / "a.txt").write_text("0 0.5 0.5 0.1 0.1\n1 0.5\n2 x 0 0 0\n")
    (labels / "b.txt").write_text("")
    files = readers.image_files(spark, str(images))
    frames, boxes, bad = readers.read_labels_of(spark, files, str(labels))
    assert {(r.stem, r.has_file) for r in frames.collect()} == {("a", True), ("b", True), ("c", False)}
    assert [(r.stem, r.cls, r.w) for r in boxes.collect()] == [("a", 0, 0.1)]
    assert sorted(r.reason for r in bad.collect()) == ["field-count", "parse"]


def test_coco_and_tracks(spark, tmp_path):
    coco = tmp_path / "c.json"
    coco.write_text(json.dumps({
        "images": [{"id": 1, "file_name": "a.jpg", "width": 10, "height": 5}], "categories": [{"id": 1, "name": "Warning"}],
        "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [1, 2, 3, 4], "attributes": {"occluded": True, "rotation": 4.5}}],
    }, indent=1))
    images, notes, categories = readers.read_coco(spark, str(coco))
    r = notes.first()
    assert (r.x, r.h, r.attributes["occluded"]) == (1.0, 4.0, "true") and images.count() == 1 and categories.first().name == "Warning"
    tracks = tmp_path / "t.json"
    tracks.write_text(json.dumps([{"clip": "c", "track_id": 1, "crop_id": None, "labelable": False, "members": [{"frame": 3, "xyxy": [1, 2, 3, 4], "cls": 0, "conf": 0.5, "size": 2}]}]))
    t, members = readers.read_tracks(spark, str(tracks))
    assert t.first().crop_id is None and (members.first().frame, members.first().y2) == (3, 4.0)


def test_csv_forms(spark, tmp_path):
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), "a int, b string").count() == 0
    for column in ("pred", "label"):
        path = tmp_path / f"{column}.csv"
        path.write_text(f"crop_id,{column}\nx,stop\n")
        assert [tuple(r) for r in readers.read_label_csv(spark, str(path)).collect()] == [("x", "stop")]
    path.write_text("crop_id,other\nx,stop\n")
    with pytest.raises(ValueError, match="'pred' or 'label'"):
        readers.read_label_csv(spark, str(path))


def test_runs(spark, tmp_path):
    for name, lrs in (("r1", ["0.1", "", "0.3", "0.2"]), ("r2", ["0.5"])):
        d = tmp_path / name
        d.mkdir()
        (d / "run_meta.json").write_text(json.dumps({"label_set": "1class", "imgsz": 640, "metrics": {"metrics/mAP50(B)": 0.9}, "dataset": {"split_at": 600, "official_split": True}}))
        (d / "results.csv").write_text("epoch,   lr/pg0\n" + "".join(f"{i},  {v}\n" for i, v in enumerate(lrs)))
    other = tmp_path / "no_meta"
    other.mkdir()
    (other / "results.csv").write_text("epoch,   lr/pg0\n0,  9\n")
    runs, epochs = readers.read_runs(spark, str(tmp_path))
    from kerbline.operators.score import learning_rates

    got = {r.run: (r.lr_peak, r.lr_last) for r in learning_rates(epochs).collect()}
    assert got == {"r1": (0.3, 0.2), "r2": (0.5, 0.5)} and {r.run for r in runs.collect()} == {"r1", "r2"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("obj/train/a.txt", "0 0.5 0.5 0.1 0.1\n1 0.2 0.2 0.1 0.1\n")
        z.writestr("__MACOSX/obj/._a.txt", "junk")
        z.writestr("obj/.DS_Store", "junk")
        z.writestr("obj/a.jpg", b"\xff\xd8")
    members = archive.archive_members(spark, str(tmp_path))
    assert {r.base for r in members.select("base").collect()} == {"a.txt", "a.jpg"}
    only = archive.archive_members(spark, str(tmp_path), r"\.txt$")
    boxes, _ = readers.split_label_lines(archive.text_lines(only))
    assert sorted(r.cls for r in boxes.collect()) == [0, 1]


def test_written_labels_are_rebuilt(spark, tmp_path):
    frames = spark.createDataFrame([("a", "train"), ("b", "val")], "frame string, split string")
    boxes = spark.createDataFrame([("a", 0, 0.2, 0.4, 0.2, 0.4)], "frame string, cls int, xc double, yc double, w double, h double")
    out = str(tmp_path / "labels")
    for _ in range(2):
        writers.write_label_texts(U.label_texts(frames, boxes, "frame", ["split"]), out)
    got = {(r.frame, r["split"], r.text) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "train", "0 0.200000 0.400000 0.200000 0.400000\n"), ("b", "val", "")}


def test_sorted_csv_and_card(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, s string").repartition(3)
    writers.write_sorted_csv(df, str(tmp_path / "csv"), ["n"])
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert [line for p in parts for line in p.read_text().splitlines() if not line.startswith("n,")] == ["1,a", "2,b", "3,c"]
    stats = spark.createDataFrame([("train", 2)], "split string, images int")
    card = U.dataset_card(stats, stats, df, {"rule": "by clip"})
    writers.write_card(card, str(tmp_path / "card"))
    assert json.loads(next((tmp_path / "card").glob("part-*")).read_text())["dropped"] == 3


def test_merged_document(spark, tmp_path):
    images = spark.createDataFrame([(1, 10, "a", 4, 3), (2, 20, "a", 4, 3), (2, 21, "b", 8, 6), (2, 22, "gone", 8, 6)], "source int, image_id bigint, name string, width int, height int")
    pictures = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "extra")], "source int, name string")
    notes = spark.createDataFrame([(1, 1, 10, 0), (2, 1, 20, 1), (2, 2, 21, 2), (2, 3, 22, 2)], "source int, annotation_id bigint, image_id bigint, idx int")
    every, fresh, said = U.merge_sessions(images, notes, pictures)
    assert [(r.name, r.width, r.new_image_id) for r in every.orderBy("new_image_id").collect()] == [("a", 4, 1), ("b", 8, 2), ("extra", 8, 3)]
    assert {(r.new_annotation_id, r.new_image_id, r.idx) for r in fresh.collect()} == {(1, 1, 0), (2, 2, 2)}
    assert {r.note for r in said.collect()} == {"came from an earlier source", "listed, no file", "file, not listed"}
    rows = fresh.withColumns({c: F.lit(1.0) for c in "xywh"})
    writers.write_coco(every, writers.coco_annotations(rows), spark.createDataFrame([(1, "R")], "id int, name string"), str(tmp_path / "coco"))
    assert spark.read.json(str(tmp_path / "coco/annotations")).count() == 2


def test_images_and_notes_need_no_annotations(spark, monkeypatch):
    """Notes number nothing, images only themselves: the boxes of a dataset are not sorted for them."""
    from kerbline.plans import build_queries as Q

    numbered, plain = [], U.numbered_globally
    monkeypatch.setattr(U, "numbered_globally", lambda df, order, name: numbered.append(name) or plain(df, order, name))
    assert Q.merge_notes(spark, "/root/testdata/sf0.001").count() == 3 and numbered == []
    assert Q.merged_images(spark, "/root/testdata/sf0.001").count() > 0 and numbered == ["new_image_id"]


@pytest.mark.parametrize("text, want", [
    ('{"speed": 10}', set()), ('{"sped": 10}', {("unknown_key", "sped")}), ("{oops", {("malformed", "")}), ("[1]", {("malformed", "")}), ("7", {("malformed", "")}),
    ('{"lane_direction": "up"}', {("bad_value", "lane_direction")}), ('{"speed": "fast"}', {("wrong_type", "speed")}), ('{"lane_confidence": 2}', {("out_of_range", "lane_confidence")}),
    ('{"module_status": {"lane": "asleep", "radar": "on"}}', {("bad_value", "module_status"), ("unknown_key", "module_status")}),
])
def test_contract(spark, text, want):
    df = spark.createDataFrame([(text,)], "json string")
    assert {(r.fault, r.key) for r in contract.violations(df, "json", []).collect()} == want
    malformed = any(f == "malformed" for f, _ in want)
    assert contract.parse_messages(df, "json").count() == (0 if malformed else 1)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for i in range(40):
            z.writestr(f"texts/{i}.txt", str(i) * 2000)
        with pytest.warns(UserWarning):
            z.writestr("texts/7.txt", "again")  # a name may stand twice
    members = archive.archive_members(spark, str(tmp_path), span=20_000)
    got = members.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.base, bytes(r.bytes).decode()) for r in got) == sorted([*((f"{i}.txt", str(i) * 2000) for i in range(40)), ("7.txt", "again")])
    assert len({r.task for r in got}) > 1
    assert archive.archive_index(spark, str(tmp_path), "/3").count() == 11


def test_members_are_read_without_the_directory(spark, tmp_path):
    """Every way to pack, and a directory that is gone once it was listed: reading needs none of it again."""
    path = tmp_path / "one.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i, method in enumerate((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2)):
            z.writestr(f"d/{i}", b"ab" * 1000 * (i + 1), method)
        z.writestr("empty", b"")
        end = z.fp.tell()
    with zipfile.ZipFile(tmp_path / "rare.zip", "w") as z:
        z.writestr("lzma", b"ab" * 9, zipfile.ZIP_LZMA)
    members = archive.archive_members(spark, str(tmp_path))
    whole = path.read_bytes()
    path.write_bytes(whole[:end])
    assert {r.member: len(r.bytes) for r in members.collect()} == {"d/0": 2000, "d/1": 4000, "d/2": 6000, "empty": 0, "lzma": 18}
    path.write_bytes(whole.replace(b"abab", b"abba", 1))
    with pytest.raises(Exception, match="checksum"):
        members.collect()


def test_archives_are_written_whole(spark, tmp_path):
    rows = [(f"{a}.zip", f"d/{i}", bytes([i])) for a in "ab" for i in range(5)] + [("a.zip", "d/empty", b"")]
    told = archive.write_archives(spark.createDataFrame(rows, "archive string, member string, bytes binary"), str(tmp_path / "out")).collect()
    assert {(r.archive, r.members) for r in told} == {("a.zip", 6), ("b.zip", 5)}
    got = archive.archive_members(spark, str(tmp_path / "out")).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.member, bytes(r.bytes)) for r in got) == sorted(rows)
    assert not list((tmp_path / "out").glob("*.part"))


def test_label_files_replace_what_was_there(spark, tmp_path):
    out = tmp_path / "labels"
    schema = "frame string, split string, text string"
    writers.write_label_files(spark.createDataFrame([("a", "train", "0 1 1 1 1\n"), ("b", "val", ""), ("old", "test", "x")], schema), str(out))
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.txt")} == {"train/a.txt": "0 1 1 1 1\n", "val/b.txt": "", "test/old.txt": "x"}
    writers.write_label_files(spark.createDataFrame([("a", "train", "new\n"), ("c", "val", None)], schema), str(out))
    assert {str(p.relative_to(out)): p.read_text() for p in out.rglob("*.txt")} == {"train/a.txt": "new\n", "val/c.txt": ""}
    broken = spark.createDataFrame([("d", "train", "1")], schema).withColumn("text", F.when(F.col("frame") == "d", F.raise_error(F.lit("no text"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no text"):
        writers.write_label_files(broken, str(out))
    # A job that fails leaves the old files, and nothing of its own.
    assert {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file() and not p.name.endswith(".crc")} == {"train/a.txt", "val/c.txt"}
    files = readers.list_files(spark, str(out))
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in files.collect()} == {("a.txt", 4), ("c.txt", 0)}


def test_label_files_in_archives(spark, tmp_path, monkeypatch):
    """All files of many frames, empty ones too, in a few archives."""
    monkeypatch.setattr(writers, "FILES_OF_ARCHIVE", 100)
    texts = spark.range(250).select(
        F.col("id").alias("frame"), F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.when(F.col("id") % 3 != 0, F.lit("0 1 1 1 1\n")).alias("text")
    )
    told = writers.write_label_archives(texts, str(tmp_path), 250).collect()
    assert sum(r.members for r in told) == 250 and len(list(tmp_path.iterdir())) == len(told) == 3
    got = {r.member: bytes(r.bytes).decode() for r in archive.archive_members(spark, str(tmp_path)).collect()}
    assert got == {f"{'train' if i % 5 else 'val'}/{i}.txt": "0 1 1 1 1\n" if i % 3 else "" for i in range(250)}


def test_run_records(spark, tmp_path):
    for name, args in (("r1", "task: x\noptimizer: 'AdamW'\nfliplr: 0.5\n"), ("r2", None), ("r3", "optimizer: null\nfliplr: none\n")):
        d = tmp_path / name
        d.mkdir()
        (d / "run_meta.json").write_text(json.dumps({"label_set": "l", "imgsz": 640, "metrics": {"metrics/mAP50(B)": 0.9, "metrics/mAP50-95(B)": 0.5, "metrics/recall(B)": 0.25}}))
        if args:
            (d / "args.yaml").write_text(args)
    (tmp_path / "r1" / "results.csv").write_text("epoch,   lr/pg0\n0,  0.5\n1,  \n2, 0.25\n")
    other = tmp_path / "no_meta"
    other.mkdir()
    (other / "args.yaml").write_text("optimizer: SGD\n")
    got = {r.run: tuple(r[c] for c in ("lr_peak", "lr_last", "optimizer", "fliplr", "map50", "map", "precision", "recall")) for r in readers.collect_runs(spark, str(tmp_path)).collect()}
    rest = (0.9, 0.5, None, 0.25)
    assert got == {"r1": (0.5, 0.25, "AdamW", 0.5, *rest), "r2": (None, None, None, None, *rest), "r3": (None, None, None, None, *rest)}


def test_run_records_in_archives(spark, tmp_path, monkeypatch):
    """The files of many runs lie in a few archives, and each file of results is read by its own header."""
    monkeypatch.setattr(writers, "FILES_OF_ARCHIVE", 100)
    meta = json.dumps({"label_set": "l", "imgsz": 640, "metrics": {"metrics/mAP50(B)": 0.5}})
    results = ["epoch,lr/pg0\n0,0.5\n1,0.25\n", 'lr/pg0, "epoch"\r\n"0.75", 1\r\n\r\n,2\r\n0.5,0', "epoch,loss\n0,9\n", ""]
    files = [(f"{'ab'[i % 2]}/run{i // 2}", name, text) for i in range(100) for name, text in (("run_meta.json", meta), ("results.csv", results[i % 4]), ("args.yaml", f"fliplr: 0.{i % 10}\n"))]
    told = writers.write_text_archives(spark.createDataFrame(files, "folder string, name string, text string"), str(tmp_path), 300).collect()
    assert sum(r.members for r in told) == 300 and len(list(tmp_path.iterdir())) == len(told) == 3
    kept = archive.archive_members(spark, str(tmp_path))
    texts = kept.select(F.regexp_extract("member", "^(.*)/", 1).alias("folder"), F.col("base").alias("name"), F.decode("bytes", "UTF-8").alias("text"))
    rates = [(0.5, 0.25), (0.75, 0.75), (None, None), (None, None)]
    got = sorted(((r.run, r.lr_peak, r.lr_last, r.fliplr, r.map50) for r in readers.collect_run_texts(texts).collect()), key=str)
    assert got == sorted(((f"run{i // 2}", *rates[i % 4], i % 10 / 10, 0.5) for i in range(100)), key=str)


def test_frame_json(spark):
    rows = [
        (1, '{"fps": 3, "frames": [{"id": "a", "index": 1, "time_s": 0.5}, {"id": "b"}]}'), (2, '{"frames": {"c": {"index": 2}, "d": {"id": "e", "time_s": 1}}}'),
        (3, "{oops"), (4, None), (5, "{}"), (6, '{"frames": []}'), (7, "[]"),
    ]
    df = spark.createDataFrame(rows, "n int, json string")
    got = {(r.n, r.frame_id, r["index"], r.time_s) for r in readers.frame_index(df, "json").collect()}
    assert got == {(1, "a", 1, 0.5), (1, "b", None, None), (2, "c", 2, None), (2, "e", None, 1.0)}
    rows = [(1, '{"frames": {"a": {"score": 0.5, "note": "x"}, "b": {}}}'), (2, "{oops"), (3, '{"version": 1}'), (4, None)]
    scores = readers.frame_scores(spark.createDataFrame(rows, "n int, json string"), "json")
    assert [tuple(r) for r in scores.collect()] == [(1, "a", "score", 0.5)]


def test_json_texts(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    (tmp_path / "v1" / "frames.json").write_text('{"frames":\n {"f": {"index": 3}}}')
    texts = readers.read_json_texts(spark, str(tmp_path), "frames.json")
    assert [tuple(r) for r in readers.frame_index(texts, "json").collect()] == [("v1", "f", 3, None)]
