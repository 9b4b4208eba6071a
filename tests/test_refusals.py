"""What is refused, and that nothing is lost by it: repeated join keys,
quarantined rows, streams with another header, half-published sets."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from test_io import HEADER, csv_file
from tillpoint.plans.context import Ctx
from tillpoint.sources import adapter
from tillpoint.sources import publish as pub
from tillpoint.sources import quarantine as qr
from tillpoint.streaming import judged_line_stream, repaired_line_stream, write_repaired_lines

TABLES = adapter.KEYS


@pytest.mark.parametrize("table", TABLES)
def test_a_repeated_key_fails_the_load(spark, tmp_path, table):
    for t in (*TABLES, "lineitem"):
        shutil.copytree(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet") if os.path.isdir(f"{SF001}/{t}.parquet") else \
            shutil.copy(f"{SF001}/{t}.parquet", tmp_path / f"{t}.parquet")
    assert adapter.read_extract(spark, str(tmp_path), many_to_one=True).count() == Ctx(spark, SF001).extract.count()
    twice = spark.read.parquet(f"{SF001}/{table}.parquet")
    twice = twice.unionByName(twice.limit(1))
    path = tmp_path / f"{table}.parquet"
    os.rename(path, tmp_path / "before")
    twice.write.parquet(str(path))
    with pytest.raises(Exception, match=f"Not many-to-one, {TABLES[table]} repeats"):
        Ctx(spark, str(tmp_path)).extract


def test_the_check_keeps_the_join_open_to_skew(spark):
    """Sort-merge sides read their exchanges directly, so a hot key can be split."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapter.read_extract(spark, SF001, many_to_one=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = [x.strip(" :+-") for x in plan.splitlines()]
    sides = [lines[k + 1] for k, x in enumerate(lines) if x.startswith("Sort [invoice_no") or x.startswith("Sort [partkey")]
    assert sides and all(x.startswith("Exchange hashpartitioning") for x in sides)


GOOD = ["1,A,x,2,1.50,7,UK,2010-01-12 08:26:00", "2,B,y,1,3.00,8,UK,2011-11-15 09:10:00", "3,C,,4,0.10,9,,2011-11-15 09:10:00"]
BAD = {
    "4,A,x,abc,1.50,7,UK,2010-01-12 08:26:00": ["quantity: not a int"],
    "5,A,x,2,1.50,,UK,2010-01-12 08:26:00": ["customer_id: missing"],
    "6,A,x,2,1.50,7,UK,2010-31-12 08:26:00": ["invoice_date_text: not a timestamp"],
    "7,A,x,-2,0,7,UK,2010-01-12 08:26:00": ["quantity: not positive", "unit_price: not positive"],
    "x8,A,x,2,free,7,UK,": ["invoice_no: not a bigint", "unit_price: not a decimal(14,2)", "invoice_date_text: missing"],
    "9,A,x": ["broken record", "customer_id: missing", "invoice_date_text: missing"],
    "10,A,x,2,1.50,7,UK,2010-01-12 08:26:00,2010,more": ["broken record"],
}


def deliver(folder):
    folder.mkdir()
    rows = list(BAD)
    csv_file(folder, "a.csv", HEADER, *GOOD[:2], *rows[:4])
    csv_file(folder, "b.csv", HEADER, *rows[4:], GOOD[2])
    return str(folder)


def check_split(spark, path):
    accepted, refused = qr.read_split(spark, path)
    assert sorted(r.invoice_no for r in accepted.collect()) == [1, 2, 3]
    assert str(accepted.where("invoice_no = 1").first().unit_price) == "1.50"
    found = {tuple(json.loads(r.record).values())[0]: r for r in refused.collect()}
    assert len(found) == len(BAD) == refused.count()
    for row, reasons in BAD.items():
        own = found[row.split(",")[0]]
        assert own.reasons == reasons, row
        assert own.file.endswith("a.csv" if row in list(BAD)[:4] else "b.csv")


def test_batch_split(spark, tmp_path):
    rows = qr.judged(qr.read_texts(spark, deliver(tmp_path / "in")))
    counts = qr.counts(rows).first()
    assert (counts.rows, counts.accepted, counts.refused) == (10, 3, 7)
    qr.write_split(rows, str(tmp_path / "out"))
    check_split(spark, str(tmp_path / "out"))


def test_stream_split(spark, tmp_path):
    rows = judged_line_stream(spark, deliver(tmp_path / "in"))
    qr.write_split_stream(rows, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    check_split(spark, str(tmp_path / "out"))


def test_split_of_nothing(spark, tmp_path):
    texts = spark.createDataFrame([], ", ".join(f"{c} string" for c in HEADER.split(",")))
    assert tuple(qr.counts(qr.judged(texts)).first()) == (0, 0, 0, 0)
    qr.write_split(qr.judged(texts), str(tmp_path / "out"))
    assert [x.count() for x in qr.read_split(spark, str(tmp_path / "out"))] == [0, 0]
    with pytest.raises(ValueError, match="customer_id"):
        qr.judged(texts.drop("CustomerID"))


def test_stream_refuses_swapped_columns(spark, tmp_path):
    """A later file with two columns swapped loads nowhere."""
    folder = tmp_path / "in"
    folder.mkdir()
    csv_file(folder, "a.csv", HEADER, GOOD[0])
    out = str(tmp_path / "out")
    stream = repaired_line_stream(spark, str(folder))
    write_repaired_lines(stream, out, str(tmp_path / "ck"), once=True).awaitTermination(120)
    swapped = HEADER.replace("InvoiceNo", "x").replace("CustomerID", "InvoiceNo").replace("x", "CustomerID", 1)
    csv_file(folder, "b.csv", swapped, GOOD[1])
    with pytest.raises(Exception):
        write_repaired_lines(stream, out, str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert [r.invoice_no for r in spark.read.parquet(out).collect()] == [1]
    with pytest.raises(ValueError, match="CustomerID"):
        repaired_line_stream(spark, os.path.dirname(csv_file(tmp_path, "c.csv", HEADER.replace("CustomerID", "Who"), GOOD[0])))


def test_a_failed_publish_leaves_the_old_set(spark, tmp_path):
    out = str(tmp_path / "pub")
    with pytest.raises(FileNotFoundError):
        pub.manifest(spark, out)
    first = {"a": pub.Table(spark.range(10)), "m": pub.Table(spark.range(1), "json"),
             "b": pub.Table(spark.range(5).select("id", (F.col("id") / 3).alias("v")), "csv", "gzip", 2)}
    assert pub.publish(spark, first, out) == 1
    pub.verify(spark, out)
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("half-way")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        pub.publish(spark, {"a": pub.Table(spark.range(99)), "b": pub.Table(broken)}, out)
    assert pub.read_published(spark, out, "a").count() == 10 and pub.manifest(spark, out)["tables"]["b"]["rows"] == 5
    pub.verify(spark, out)
    assert pub.publish(spark, {"a": pub.Table(spark.range(3))}, out) == 2
    assert pub.read_published(spark, out, "a").count() == 3
    assert pub.read_published(spark, out, "a", number=1).count() == 10
    pub.publish(spark, {"a": pub.Table(spark.range(4))}, out)
    pub.prune(spark, out, keep=1)
    assert len(os.listdir(f"{out}/sets")) == 1 and pub.read_published(spark, out, "a").count() == 4


def test_changed_files_are_noticed(spark, tmp_path):
    out = str(tmp_path)
    pub.publish(spark, {"a": pub.Table(spark.range(10)), "e": pub.Table(spark.range(0))}, out)
    pub.verify(spark, out)
    entry = pub.manifest(spark, out)["tables"]["a"]
    spark.range(1, 11).write.mode("overwrite").parquet(f"{out}/{entry['path']}")
    with pytest.raises(ValueError, match="a changed"):
        pub.verify(spark, out)


def test_concurrent_jobs_get_numbers_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(lambda k: pub.publish(spark, {"a": pub.Table(spark.range(k))}, str(tmp_path)), range(4)))
    assert sorted(numbers) == [1, 2, 3, 4]
