"""A small table of documents with every odd case, and the same as Python rows."""

import random

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rid long, n_words int, kept boolean, shard string, label string"


def odd_rows() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(90))
    base = [word() for _ in range(120)]
    near = [w if k not in (40, 80) else "other" for k, w in enumerate(base)]
    texts = [
        (1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One two three"), (1005, "one TWO three"),
        (1006, " ".join(base)), (1007, " ".join(near)), (1008, " ".join(base).upper()), (1009, " ".join(base)),
        (1010, "before " + passage + " after"), (1011, "x y z " + passage), (1012, passage + "\n" + passage),
        (1013, "e" * 3000), (1014, "Erti " * 400), (1015, "é日本" * 300), (1016, "x" * 50_000),
        (1017, " ".join(word() for _ in range(9000))),
        (None, "a text whose row has no number " * 9), (1018, "same id, first text"), (1018, "same id, second text"),
        (1019, passage), (1019, passage), (-5, passage + " tail"), (1020, "<|endoftext|> it's we'll 'sx  \n 's \x85 end"),
        (1021, "Σίσυφος ΟΔΟΣ é İstanbul ǅ"), (1022, "\x00nul \x1f sep"), (1023, "line\nline\nline\n  \nLine"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", "src0", None, "k", 7, 3, True, "s", "l") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    given = spark.read.parquet(f"{FOLDER}/documents.parquet")
    extra = {"key": F.lit("k"), "rid": F.lit(7), "n_words": F.lit(3), "kept": F.lit(True), "shard": F.lit("s"), "label": F.lit("l")}
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    return given.withColumns(extra).select(*names).unionByName(spark.createDataFrame(odd_rows(), SCHEMA)).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
