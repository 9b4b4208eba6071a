"""Date repair: ambiguous and unambiguous texts, involution, strict parse."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillpoint.functions.columns import swap_day_month
from tillpoint.operators.repair import repair_dates


def test_only_ambiguous_dates_are_swapped(spark):
    """Every day of two years, as the extract would hold it, comes back."""
    days = [dt.datetime(2018, 1, 1, 7, 5, 9) + dt.timedelta(days=k) for k in range(730)]
    held = [d.replace(month=d.day, day=d.month) if d.day <= 12 else d for d in days]
    df = spark.createDataFrame([(k, h.strftime("%Y-%m-%d %H:%M:%S")) for k, h in enumerate(held)], "k int, invoice_date_text string")
    rows = repair_dates(df).orderBy("k").collect()
    assert [r.invoice_date for r in rows] == days
    assert [r.was_swapped for r in rows] == [d.day <= 12 and d.day != d.month for d in days]


def test_swap_is_an_involution_on_orders(spark):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    bad = o.where(swap_day_month(swap_day_month("o_orderdate")) != F.col("o_orderdate")).count()
    assert bad == 0


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("text", ["2018-02-30 10:00:00", "yesterday", "2018-13-45 99:00:00", ""])
def test_malformed_timestamp_raises_with_and_without_ansi(spark, ansi, text):
    df = spark.createDataFrame([(text,)], "invoice_date_text string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="(?i)malformed|parse|timestamp"):
            repair_dates(df).select("invoice_date").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
