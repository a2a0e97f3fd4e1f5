"""Plans of the pair-finding operators and the scans."""

import pytest

from kerbline.plans import registry

registry.load_all()
FOLDER = "/root/testdata/sf0.001"
PAIRS = ["near_duplicate_pairs", "near_duplicate_counts", "same_sign_pairs", "overlap_counts", "patched_labels", "format_agreement", "class_table"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PAIRS)
def test_no_pair_of_everything(spark, name):
    text = plan_of(registry.QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_asked(spark):
    text = plan_of(registry.QUERIES["class_filters"](spark, FOLDER))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema
    text = plan_of(registry.QUERIES["accept_rate"](spark, FOLDER))
    assert "props" not in text.split("ReadSchema: struct<")[1].split(">")[0]


def test_filter_reaches_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_linenumber), " in plan_of(registry.QUERIES["orphans"](spark, FOLDER))


def test_running_values_deal_their_rows_out_once(spark):
    """Rows by key and bucket, summaries by both and by key, entered values back: null keys add nothing to that."""
    from pyspark.sql import functions as F

    from kerbline.operators.ordered import scan, tick_bucket

    rows = spark.createDataFrame([(1, 1, 2.0), (None, 2, 3.0)], "g int, tick int, v double")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        done = scan(rows, ["g"], ["tick"], tick_bucket("tick", 4), {"sum": ("total", F.col("v"))})
        text = plan_of(done)
        assert text.count("Exchange hashpartitioning") <= 4 and text.count("<=>") == 0
        assert sorted((r.g or 0, r["sum"]) for r in done.collect()) == [(0, 3.0), (1, 2.0)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(spark, folder, frames: int):
    """Tables of a few boxes a frame, some frames without."""
    rows = [
        (k, 7 * k + 3 * i, k % 4 + i, i + 1, float(5 + (k * i) % 40), 0.01 * (i % 9), 0.02 * (k % 4), "ANR"[(k + i) % 3])
        for k in range(frames) if k % 9 for i in range(1 + k % 4)
    ]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(frames)], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in range(1, 8)], "p_partkey long").write.parquet(f"{folder}/part.parquet")


def _of_sql(folder, name: str):
    import duckdb
    from compare import rows_of

    con = duckdb.connect()
    for table in ("lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    cur = con.execute(registry.ORACLES[name])
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def test_tracks_are_reviewed_from_what_is_kept(spark, tmp_path):
    """Peaks and the reviews of their frames are worked out once: nothing after them reads or groups the boxes again."""
    from compare import rows_of

    _written(spark, tmp_path, 200)
    got = registry.QUERIES["reviewed_track_labels"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by" not in plan and "parquet" not in plan and "row_number" not in plan
    assert rows_of(got.columns, got.collect()) == _of_sql(tmp_path, "reviewed_track_labels")


def test_counts_of_a_balanced_split_are_read_once(spark, tmp_path):
    from compare import rows_of

    _written(spark, tmp_path, 500)
    got = registry.QUERIES["balanced_split_error"](spark, str(tmp_path))
    assert "parquet" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows_of(got.columns, got.collect()) == _of_sql(tmp_path, "balanced_split_error")
