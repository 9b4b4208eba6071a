"""Sink / source round trips: CSV marts (2 dp), gzip CSV, parquet facts, JSON metrics."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillpoint.sources.extract import RAW_SCHEMA, read_csv_extract
from tillpoint.sources.io import read_csv_typed, read_metrics_json, write_mart, write_metrics_json
from tillpoint.sources.publish import read_published


def test_csv_mart_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="tp-io-")
    df = spark.createDataFrame([("2011-01", 1.005, 3), ("2011-02", 2.5, 4)], "month string, revenue double, orders bigint")
    write_mart(df, os.path.join(d, "csv"), fmt="csv", money_digits=2)
    back = read_csv_typed(spark, os.path.join(d, "csv"), "month string, revenue double, orders bigint")
    assert sorted(back.collect()) == sorted(spark.createDataFrame(
        [("2011-01", 1.01, 3), ("2011-02", 2.5, 4)], back.schema).collect())
    write_mart(df, os.path.join(d, "gz"), fmt="csv", compression="gzip")
    assert any(n.endswith(".gz") for n in os.listdir(os.path.join(d, "gz")))


def test_parquet_and_json(spark):
    d = tempfile.mkdtemp(prefix="tp-io-")
    df = spark.range(10).select(F.col("id").alias("k"), F.to_date(F.lit("2011-11-07")).alias("origin"))
    write_mart(df, os.path.join(d, "pq"))
    assert spark.read.parquet(os.path.join(d, "pq")).count() == 10
    one = spark.createDataFrame([(384721, 6066105.88)], "rows bigint, revenue double")
    write_metrics_json(one, os.path.join(d, "m"))
    r = read_metrics_json(spark, os.path.join(d, "m")).first()
    assert r.rows == 384721 and r.revenue == 6066105.88


HEADER = "InvoiceNo,StockCode,Description,Quantity,UnitPrice,CustomerID,Country,InvoiceDate"


def csv_file(folder, name, *lines):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")
    return path


def test_csv_extract_is_read_by_header(spark, tmp_path):
    first = csv_file(tmp_path, "a.csv", HEADER + ",Y,M,W,D,WD", "501,A7,BLUE JUG,6,2.55,17,Norway,2018-03-12 08:26:00,2018,3,2,12,1")
    swapped = csv_file(tmp_path, "b.csv", HEADER.replace("InvoiceNo", "x").replace("CustomerID", "InvoiceNo").replace("x", "CustomerID"),
                       "17,A7,BLUE JUG,6,2.55,501,Norway,2018-03-12 08:26:00")
    for path in (first, swapped):
        r = read_csv_extract(spark, path).first()
        assert (r.invoice_no, r.customer_id, str(r.unit_price)) == (501, 17, "2.55") and len(r) == len(RAW_SCHEMA.fields)


def test_csv_extract_with_a_missing_header_or_a_bad_value_is_refused(spark, tmp_path):
    missing = csv_file(tmp_path, "a.csv", HEADER.replace("CustomerID", "Client"), "501,A7,JUG,6,2.55,17,Norway,2018-03-12 08:26:00")
    with pytest.raises(ValueError, match="CustomerID"):
        read_csv_extract(spark, missing)
    bad = csv_file(tmp_path, "b.csv", HEADER, "501,A7,JUG,abc,2.55,17,Norway,2018-03-12 08:26:00")
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            with pytest.raises(Exception, match="abc"):
                read_csv_extract(spark, bad).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_stream_refuses_a_bad_quantity(spark, tmp_path):
    from tillpoint.streaming import repaired_line_stream, write_repaired_lines

    source = tmp_path / "in"
    source.mkdir()
    csv_file(source, "a.csv", HEADER + ",Y,M,W,D,WD", "1,A,x,abc,1.50,7,UK,2010-01-12 08:26:00,2010,1,2,12,1")
    q = write_repaired_lines(repaired_line_stream(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck"), once=True)
    with pytest.raises(Exception):
        q.awaitTermination(120)


def test_exported_files_read_back_as_their_queries(spark, tmp_path):
    from conftest import SF001
    from tillpoint.plans import exports, registry

    files = exports.export_analytics(spark, SF001, str(tmp_path), fmt="parquet")
    assert set(files) == {*exports.ANALYTICS, "verified_metrics"}
    queries = registry.queries()
    for name, query in exports.ANALYTICS.items():
        back, want = read_published(spark, str(tmp_path), name), queries[query](spark, SF001)
        assert back.columns == want.columns and back.count() == want.count()
        doubles = [f.name for f in want.schema.fields if f.dataType.typeName() == "double"]
        for c in doubles:
            a, b = back.agg(F.sum(c)).first()[0], want.agg(F.sum(c)).first()[0]
            assert abs(float(a or 0) - (b or 0)) <= 0.01 * want.count()
    metrics = read_published(spark, str(tmp_path), "verified_metrics").first()
    assert metrics.rows == queries["headline_metrics"](spark, SF001).first()["rows"]
    assert exports.export_bi_marts(spark, SF001, str(tmp_path / "bi"), ("sales", "cohort_month1")) == ["sales", "cohort_month1"]
    sales = read_published(spark, str(tmp_path / "bi"), "sales")
    assert sales.count() == queries["mart_sales"](spark, SF001).count()


def test_metrics_document_is_one_row(spark, tmp_path):
    with pytest.raises(ValueError):
        write_metrics_json(spark.range(2), str(tmp_path / "m"))


def test_stream_repairs_like_batch(spark):
    from tillpoint.streaming import repaired_line_stream, write_repaired_lines

    d = tempfile.mkdtemp(prefix="tp-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("InvoiceNo,StockCode,Description,Quantity,UnitPrice,CustomerID,Country,InvoiceDate,Y,M,W,D,WD\n")
        f.write("1,A,x,2,1.50,7,UK,2010-01-12 08:26:00,2010,1,2,12,1\n")
        f.write("2,B,y,1,3.00,8,UK,2011-11-15 09:10:00,2011,11,46,15,1\n")
    q = write_repaired_lines(repaired_line_stream(spark, src), os.path.join(d, "out"), os.path.join(d, "ck"), once=True)
    q.awaitTermination(120)
    rows = {r.invoice_no: r for r in spark.read.parquet(os.path.join(d, "out")).collect()}
    assert str(rows[1].invoice_date) == "2010-12-01 08:26:00" and rows[1].revenue == 3.0
    assert str(rows[2].invoice_date) == "2011-11-15 09:10:00"


def test_a_scan_task_reads_a_bounded_split(spark):
    """Grouping the lines holds ten times what their files take."""
    from tillpoint.session import apply_sql_conf

    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.unset(key)
        apply_sql_conf(spark)
        assert spark.conf.get(key) == "32m"
        spark.conf.set(key, "1m")
        apply_sql_conf(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)
