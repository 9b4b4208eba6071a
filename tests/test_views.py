"""SQL over the registered views, and the roll-ups: results against the
DataFrame keys, and what their plans read."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from oracle_compare import _rows
from tillpoint.operators import grains, rollups
from tillpoint.plans import registry, views
from tillpoint.plans.context import Ctx


def plan(df) -> str:
    df.collect()  # subqueries and stages are final then
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def scans(df) -> set[str]:
    """The scans of a plan; text that Spark prints twice counts once."""
    return set(re.findall(r"FileScan parquet \S*\[[^\]]*\]", df._jdf.queryExecution().executedPlan().toString()))


@pytest.mark.parametrize("name", views.ANALYSES)
def test_analysis_equals_its_dataframe_key(spark, name):
    q = registry.queries()
    text, frame = q[name](spark, SF001), q[views.EQUALS[name]](spark, SF001)
    assert sorted(text.columns) == sorted(frame.columns)
    assert _rows(text.toPandas()) == _rows(frame.toPandas())


def test_views_serve_queries_of_ones_own(spark):
    names = views.register_views(spark, SF001, "shop_")
    assert names == ["shop_raw_extract", "shop_lines", "shop_invoices"]
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} >= set(names)
    one = spark.sql("SELECT count(*) AS n, sum(revenue) AS r FROM shop_lines WHERE invoice_month = DATE'2000-03-01'")
    assert "PartitionFilters: [isnotnull(invoice_month" in one._jdf.queryExecution().executedPlan().toString()
    c = Ctx(spark, SF001)
    want = c.lines.where("invoice_month = DATE'2000-03-01'").agg(F.count("*").alias("n"), F.sum("revenue").alias("r"))
    assert one.collect() == want.collect() and one.first().n > 0
    both = spark.sql("""SELECT l.country, count(*) AS n FROM shop_lines l JOIN shop_invoices i USING (invoice_no)
                        WHERE i.revenue > 100 GROUP BY l.country""")
    assert both.agg(F.sum("n")).first()[0] > 0
    views.drop_views(spark, "shop_")
    assert not {t.name for t in spark.catalog.listTables()} & set(names)


def test_two_inputs_do_not_share_views(spark):
    from conftest import SF01
    a, b = (views.run(Ctx(spark, d), "SELECT count(*) AS n FROM {invoices}") for d in (SF001, SF01))
    assert a.first().n < b.first().n


INVOICES = "invoice_no long, customer_id long, country string, month date, revenue_cents long, items long"


def test_rollups_count_customers_exactly(spark):
    """Many customers, one with a third of all invoices, and invoices without one."""
    inv = spark.range(60_000).select(
        F.col("id").alias("invoice_no"), F.expr("if(id % 3 = 0, 7, if(id % 50 = 1, null, id * 7919 % 40009 * 1000003))").alias("customer_id"),
        F.expr("concat('c', id % 5)").alias("country"), F.expr("add_months(DATE'2020-01-01', int(id % 14))").alias("month"),
        (F.col("id") % 100).alias("revenue_cents"), F.lit(2).cast("long").alias("items"))
    act = rollups.activity(inv).cache()
    assert act.select("bucket").distinct().count() >= 2
    for keys in ({}, {"month": F.col("month")}, {"country": F.col("country")}, {"half": F.floor((F.month("month") - 1) / 6)},
                 {"month": F.col("month"), "country": F.col("country")}):
        ours = rollups.rolled_up(act, **keys)
        want = inv.groupBy(*[e.alias(k) for k, e in keys.items()]).agg(
            F.countDistinct("customer_id").alias("active_customers"), F.sum("revenue_cents").alias("revenue_cents"),
            F.count("*").alias("orders"), F.sum("items").alias("units"))
        assert sorted(map(repr, ours.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    split = rollups.rolled_up(act).first()
    assert split.first_revenue_cents + split.later_revenue_cents <= split.revenue_cents
    act.unpersist()
    assert rollups.sales_cube(rollups.activity(spark.createDataFrame([], INVOICES))).collect() == []


def test_cube_is_one_scan_of_the_activity(spark):
    df = registry.queries()["sales_rollup"](spark, SF001)
    text = plan(df)
    assert len(scans(df)) == 1 and "Expand" in text and "revenue_cents" in next(iter(scans(df)))


@pytest.mark.parametrize("key,most", [("dq_reconcile", 3), ("headline_metrics", 5), ("quarterly_customers", 1), ("product_summary", 1)])
def test_scans(spark, key, most):
    df = registry.queries()[key](spark, SF001)
    df.collect()
    assert len(scans(df)) <= most


def test_headline_reads_the_invoice_grain_once(spark):
    from tillpoint.operators.metrics import invoice_metrics
    df = invoice_metrics(Ctx(spark, SF001).invoice_facts)
    df.collect()
    assert len(scans(df)) == 1


def test_headline_of_few_and_no_invoices(spark):
    from tillpoint.operators.metrics import invoice_metrics
    schema = grains.invoice_full(Ctx(spark, SF001).lines).schema
    none = invoice_metrics(spark.createDataFrame([], schema)).first()
    assert none.customers is None or none.customers == 0
    assert none.home_country is None and none.focus_from_orders == 0


def test_week_window_reads_its_months_alone(spark):
    from tillpoint.operators import forecast as fc
    from tillpoint.plans import forecasting as pf
    c = Ctx(spark, SF001)
    everything = len(c.extract.inputFiles())
    cal = pf.cal(c)
    window = fc._in_window(c.series_lines, cal.first_week, cal.last_week, hi_inclusive=True)
    assert "PartitionFilters: [isnotnull(invoice_month" in window._jdf.queryExecution().executedPlan().toString()
    read = window.select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read <= 14 < everything
    # The month bounds leave no line of the weeks out.
    weeks = (F.col("week_start") >= F.lit(cal.first_week)) & (F.col("week_start") <= F.lit(cal.last_week))
    assert window.count() == c.series_lines.where(weeks).count()


def test_a_hot_month_is_split_over_files(spark, tmp_path):
    """Rebalancing goes by size: a month with nearly all rows is not one file."""
    from tillpoint.sources.staging import _write
    rows = spark.range(0, 400_000, 1, 16).select(
        F.expr("if(id % 20 = 0, DATE'2020-02-01', DATE'2020-01-01')").alias("invoice_month"),
        F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
    try:
        _write(rows, str(tmp_path / "t"), "invoice_month")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 400_000
    files = [f for f in back.inputFiles() if "2020-01-01" in f]
    assert len(files) >= 3


def test_labels(spark):
    from tillpoint.functions.columns import label_number, plain_label, relabelled
    rows = spark.createDataFrame([(" 2011-09 ",), ("x",), (None,), ("a_b_c",)], "t string").select(
        label_number("t", 1, 4).alias("y"), label_number("t", -2, 2).alias("m"), plain_label("t").alias("p"),
        relabelled("t", {"x": "known"}).alias("r")).collect()
    assert [tuple(r) for r in rows] == [(2011, 9, "2011-09", " 2011-09 "), (None, None, "x", "known"), (None,) * 4,
                                        (None, None, "a b c", "a_b_c")]
