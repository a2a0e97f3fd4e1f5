"""Session settings used by the tests and the benchmark, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: str = "*", partitions: int = 8, name: str = "kerbline") -> SparkSession:
    """A session for one machine. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors and the driver share, below the one named by ``spark.checkpoint.dir``.

    Only when none is named (a test on one machine) is it a temporary one.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='kerbline-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterative job in reliable storage.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only when
    none is named (a test on one machine) is a temporary folder chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get(CHECKPOINT_SETTING, None) or shared_folder(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys`` where null equals null, so that rows with a null key stay."""
    other = right.select(*[F.col(k).alias(f"__match_{k}") if k in keys else F.col(k) for k in right.columns])
    same = [left[k].eqNullSafe(other[f"__match_{k}"]) for k in keys]
    return left.join(other, same, how).drop(*[f"__match_{k}" for k in keys])


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row of ``df`` with the columns of a one-row table, as a scalar subquery.

    The row is read twice per column, which keeps the optimizer from moving the
    subquery into a higher-order function, where it is not allowed.
    """
    names = one_row.columns
    row = F.col("__row")
    wide = df.withColumn("__row", one_row.select(F.struct(*names)).scalar())
    return wide.select(*df.columns, *[F.when(row.isNotNull(), row[n]).alias(n) for n in names])


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as a literal relation, whose size the planner knows."""

    def text(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(value)

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    body = ", ".join("(" + ", ".join(map(text, row)) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")
