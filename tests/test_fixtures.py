"""Hand-made extract fixtures for the edge cases of the analytics rules:
multi-country customers, tied modes, exact duplicate lines, an invoice
across a month end, a zero-unit week, the RFM day bounds, and hot keys
(one invoice with a third of the lines, one customer with a third of the
invoices) checked against a pandas brute force."""

import datetime as dt
import random
from decimal import Decimal

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tillpoint.functions.columns import (SEG_AT_RISK, SEG_CHAMPIONS, SEG_DEVELOPING, SEG_DORMANT,
                                         SEG_LOYAL, SEG_RECENT)
from tillpoint.operators import customers as cu
from tillpoint.operators import forecast as fc
from tillpoint.operators import grains, products, quality, repair, revenue
from tillpoint.sources import adapter
from tillpoint.sources.extract import RAW_SCHEMA


def _raw_text(ts: dt.datetime) -> dt.datetime:
    """The extract's corruption: day and month swapped where ambiguous."""
    if ts.day <= 12 and ts.month <= 12 and ts.day != ts.month:
        return ts.replace(month=ts.day, day=ts.month)
    return ts


def raw_frame(spark, rows):
    """rows: (invoice, stock, description, quantity, price, customer, country, true timestamp)."""
    out = []
    for inv, code, desc, q, price, cust, country, ts in rows:
        r = _raw_text(ts)
        out.append((inv, code, desc, q, Decimal(str(price)).quantize(Decimal("0.01")), cust, country,
                    r.strftime("%Y-%m-%d %H:%M:%S"), r.year, r.month, r.isocalendar()[1], r.day, r.weekday()))
    return spark.createDataFrame(out, RAW_SCHEMA)


T0 = dt.datetime(2011, 3, 15, 10, 0)


def test_multi_country_customer_and_tied_country(spark):
    raw = raw_frame(spark, [
        (1, "S1", "d", 1, 10, 1, "Alpha", T0), (2, "S1", "d", 1, 30, 1, "Beta", T0),
        (3, "S1", "d", 1, 10, 2, "Beta", T0), (4, "S1", "d", 1, 10, 2, "Alpha", T0),
        (5, "S1", "d", 1, 10, 3, "Gamma", T0)])
    inv = grains.invoices(repair.lines(raw))
    assert cu.multi_country_customers(inv).first()[0] == 2
    got = {r.customer_id: r.country for r in cu.customer_country(inv).collect()}
    assert got == {1: "Beta", 2: "Alpha", 3: "Gamma"}


def test_tied_modal_description_takes_smallest(spark):
    descs = [("S1", "x"), ("S1", "y"), ("S1", "x"), ("S1", "y"), ("S1", "z"), ("S2", "b"), ("S2", "a")]
    raw = raw_frame(spark, [(i, c, d, 1, 1, 1, "A", T0) for i, (c, d) in enumerate(descs)])
    got = {r.stock_code: r.description for r in products.product_modal_description(repair.lines(raw)).collect()}
    assert got == {"S1": "x", "S2": "a"}


def test_exact_duplicate_line(spark):
    line = (1, "S1", "d", 2, 1.25, 1, "A", T0)
    raw = raw_frame(spark, [line, line, line, (1, "S2", "e", 1, 4.00, 1, "A", T0)])
    r = quality.duplicate_sensitivity(raw).first()
    assert r.possible_duplicate_rows == 2
    assert r.sensitivity_value == 5.0
    assert r.revenue_if_duplicates_dropped == 6.5


def test_invoice_with_two_timestamps_across_month_end(spark):
    raw = raw_frame(spark, [
        (10, "S1", "d", 1, 5, 1, "A", dt.datetime(2011, 1, 31, 23, 50)),
        (10, "S2", "e", 1, 7, 1, "A", dt.datetime(2011, 2, 1, 0, 10)),
        (11, "S1", "d", 1, 3, 2, "A", dt.datetime(2011, 2, 15, 9, 0))])
    lines = repair.lines(raw)
    multi = quality.multi_timestamp_invoices(grains.invoice_full(lines), lines).collect()
    assert [(r.invoice_no, r.distinct_timestamps) for r in multi] == [(10, 2)]
    # Line month (growth decomposition) splits the invoice; invoice month does not.
    by_line = {r.month: (r.revenue, r.orders) for r in revenue.revenue_decomposition(lines).collect()}
    assert by_line == {dt.date(2011, 1, 1): (5.0, 1), dt.date(2011, 2, 1): (10.0, 2)}
    by_inv = {r.month: (r.revenue, r.orders) for r in revenue.monthly_summary(grains.invoices(lines)).collect()}
    assert by_inv == {"2011-01": (12.0, 1), "2011-02": (3.0, 1)}


def test_zero_unit_week_is_filled(spark):
    raw = raw_frame(spark, [
        (1, "S1", "d", 5, 1, 1, "A", dt.datetime(2011, 1, 3, 9)),
        (2, "S1", "d", 2, 1, 1, "A", dt.datetime(2011, 1, 19, 9)),
        (3, "S2", "e", 1, 1, 2, "A", dt.datetime(2011, 1, 28, 9))])
    weeks = [dt.date(2011, 1, 3) + dt.timedelta(days=7 * i) for i in range(4)]
    cal = fc.Calendar(weeks[0], weeks[-1], weeks[-1], (weeks[-1],))
    w = fc.weekly_units(repair.lines(raw), cal).orderBy("series", "week_start").collect()
    series = {}
    for r in w:
        series.setdefault(r.series, []).append((r.week_start, r.units))
    assert series == {fc.ALL_SERIES: list(zip(weeks, [5, 0, 2, 1])),
                      "S1": list(zip(weeks, [5, 0, 2, 0])),
                      "S2": list(zip(weeks, [0, 0, 0, 1]))}


def test_rfm_day_bounds(spark):
    as_of = dt.date(2011, 12, 10)
    # (recency days, orders) -> segment, from the rule ladder.
    cases = {(30, 5): SEG_CHAMPIONS, (31, 5): SEG_LOYAL, (90, 5): SEG_LOYAL, (91, 5): SEG_AT_RISK,
             (91, 3): SEG_AT_RISK, (91, 2): SEG_DORMANT, (30, 1): SEG_RECENT, (31, 1): SEG_DEVELOPING,
             (90, 4): SEG_DEVELOPING, (91, 1): SEG_DORMANT, (30, 4): SEG_RECENT}
    rows, inv = [], 0
    expected = {99: SEG_RECENT}
    rows.append((0, "S1", "d", 1, 1, 99, "A", dt.datetime(2011, 12, 9, 10)))  # fixes the as-of date
    for cust, ((recency, orders), seg) in enumerate(cases.items(), start=1):
        last = dt.datetime.combine(as_of - dt.timedelta(days=recency), dt.time(12))
        for k in range(orders):
            inv += 1
            rows.append((inv, "S1", "d", 1, 1, cust, "A", last - dt.timedelta(days=k)))
        expected[cust] = seg
    lines = repair.lines(raw_frame(spark, rows))
    got = {r.customer_id: r.segment for r in grains.customers(grains.invoices(lines), lines).collect()}
    assert got == expected


def test_hot_invoice_and_hot_customer_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        # a third of all lines on invoice 1; a third of the other invoices on customer 7
        inv = 1 if i % 3 == 0 else rnd.randint(2, 400)
        cust = 7 if inv == 1 or inv % 3 == 0 else 1000 + inv % 50
        day = dt.datetime(2011, 1, 1) + dt.timedelta(days=inv % 200, hours=inv % 7)
        rows.append((inv, f"S{rnd.randint(1, 9)}", "d", rnd.randint(1, 20), rnd.randint(100, 999) / 100,
                     cust, "A", day))
    raw = raw_frame(spark, rows).repartition(8)
    inv = grains.invoices(repair.lines(raw))
    got = inv.select("invoice_no", "customer_id", "revenue_cents", "items").toPandas()
    pdf = pd.DataFrame(rows, columns=["invoice_no", "stock", "desc", "q", "price", "customer_id", "country", "ts"])
    pdf["cents"] = pdf["q"] * (pdf["price"] * 100).round().astype("int64")
    exp = pdf.groupby("invoice_no").agg(customer_id=("customer_id", "min"), revenue_cents=("cents", "sum"),
                                        items=("q", "sum")).reset_index()
    got = got.sort_values("invoice_no").reset_index(drop=True)
    assert got.astype("int64").equals(exp.astype("int64"))
    orders = {r.customer_id: r.orders for r in grains.customers(inv, repair.lines(raw)).collect()}
    exp_orders = pdf.groupby("customer_id")["invoice_no"].nunique().to_dict()
    assert orders == exp_orders
    # Cohort sizes add up to the customers however the hot customer falls.
    ret = cu.cohort_retention(inv).where(F.col("month_index") == 0)
    assert ret.agg(F.sum("cohort_size")).first()[0] == len(exp_orders)


def test_rows_that_differ_by_a_null_are_not_duplicates(spark):
    raw = raw_frame(spark, [(1, "x", None, 1, 1.0, 1, "A", T0), (1, None, "x", 1, 1.0, 1, "A", T0)])
    r = quality.duplicate_sensitivity(raw).first()
    assert (r.possible_duplicate_rows, r.sensitivity_value, r.revenue_if_duplicates_dropped) == (0, None, 2.0)


def test_customers_and_orders_are_distinct_ids_of_lines(spark):
    """An invoice of two customers counts both; a NULL invoice is no order."""
    lines = repair.lines(raw_frame(spark, [
        (1, "S1", "d", 1, 5, 1, "A", T0), (1, "S1", "d", 1, 5, 2, "A", T0), (2, "S1", "d", 1, 5, 1, "A", T0),
        (None, "S1", "d", 1, 5, None, "A", T0)]))
    r = revenue.revenue_decomposition(lines).first()
    assert (r.revenue, r.orders, r.active_customers) == (20.0, 2, 2)
    grain = grains.invoice_full(lines)
    s = quality.repair_summary(grain, lines).first()
    assert (s["rows"], s.distinct_invoices, s.distinct_customers) == (4, 2, 2)
    assert quality.functional_dependency(grain).first().invoices_multi_customer == 1


BREAKS = {
    "null_customer_id": (1, "S1", "d", 1, 5, None, "A", T0),
    "null_invoice_no": (None, "S1", "d", 1, 5, 1, "A", T0),
    "non_positive_quantity": (1, "S1", "d", 0, 5, 1, "A", T0),
    "non_positive_price": (1, "S1", "d", 1, 0, 1, "A", T0),
    "invoices_multi_customer": (9, "S1", "d", 1, 5, 77, "A", T0),
    "invoices_multi_country": (9, "S1", "d", 1, 5, 1, "B", T0),
}


@pytest.mark.parametrize("breach", BREAKS)
def test_validate_refuses_each_breach(spark, breach):
    good = (9, "S1", "d", 1, 5, 1, "A", T0)
    raw = raw_frame(spark, [good, BREAKS[breach]])
    with pytest.raises(ValueError, match=breach):
        quality.validate(raw, grains.invoice_full(repair.lines(raw)))
    fine = raw_frame(spark, [good])
    quality.validate(fine, grains.invoice_full(repair.lines(fine)))


def test_validate_refuses_missing_columns_and_empty_extracts(spark):
    raw = raw_frame(spark, [(9, "S1", "d", 1, 5, 1, "A", T0)])
    grain = grains.invoice_full(repair.lines(raw))
    with pytest.raises(ValueError, match="country"):
        quality.validate(raw.drop("country"), grain)
    with pytest.raises(ValueError, match="no rows"):
        quality.validate(raw.limit(0), grain.limit(0))
    rows = {r.required_column: (r.present, r["values"]) for r in quality.required_columns(raw.drop("country")).collect()}
    assert rows["country"] == (False, 0) and rows["quantity"] == (True, 1)


def test_many_to_one_join_refuses_repeated_keys(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert quality.many_to_one(left, spark.createDataFrame([(1, "x"), (2, "y")], "k int, w string"), "k").count() == 3
    with pytest.raises(Exception, match="Not many-to-one"):
        quality.many_to_one(left, spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string"), "k").collect()


def write_tables(spark, folder, lines, orders):
    """Test tables for the adapter: two parts, one customer, one nation."""
    frames = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_quantity double"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        "part": ([(1, "p", "b", "t", 2.0), (2, "q", "b", "u", 3.0)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double"),
        "customer": ([(7, 3), (8, 99)], "c_custkey long, c_nationkey long"),
        "nation": ([(3, "NORWAY")], "n_nationkey long, n_name string"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_orphan_lines_are_counted_and_repeated_keys_found(spark, tmp_path):
    sf = write_tables(spark, tmp_path, [(1, 1, 1.0), (1, 5, 1.0), (4, 1, 1.0), (2, 2, 1.0), (3, 1, 1.0)],
                      [(1, 7, T0), (2, 8, T0), (3, 55, T0), (3, 55, T0)])
    assert adapter.orphan_lines(spark, sf).first().asDict() == {
        "lines": 5, "without_order": 1, "without_part": 1, "without_customer": 1, "without_nation": 1, "left_out": 4}
    assert adapter.read_extract(spark, sf).count() == 1
    assert {r.right_table: r.repeated_keys for r in adapter.key_counts(spark, sf).collect()} == {
        "orders": 1, "part": 0, "customer": 0, "nation": 0}


def test_rows_move_narrow_and_a_rebalance_changes_none(spark, tmp_path):
    """What follows from a row is derived after the last exchange."""
    swapped, late = dt.datetime(2010, 3, 4, 5, 6, 7), dt.datetime(2010, 5, 31, 23, 59, 59)
    sf = write_tables(spark, tmp_path, [(1, 1, 1.0), (1, 1, 1.0), (2, 2, None), (3, 1, 4.0), (None, 1, 1.0), (4, None, 1.0), (5, 1, 1.0)],
                      [(1, 7, swapped), (2, 7, late), (3, 7, None), (4, 7, late), (5, 8, late)])
    plain, dealt = (adapter.read_extract(spark, sf, many_to_one=True, by_month=m) for m in (False, True))
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    assert {(r.invoice_no, r.stock_code, r.invoice_date_text, r.original_month, r.country) for r in dealt.collect()} == {
        (1, "1", "2010-04-03 05:06:07", 4, "NORWAY"), (2, "2", "2010-05-31 23:59:59", 5, "NORWAY"), (3, "1", None, None, "NORWAY")}
    moved = plan[plan.index("REBALANCE_PARTITIONS_BY_COL"):]
    assert "date_format" in plan and "date_format" not in moved and "weekofyear" not in moved


def test_fingerprint_sees_moved_values(spark, tmp_path):
    from tillpoint.plans.analytics import _fingerprint

    class Only:
        def __init__(self, raw):
            self.raw = raw

    a = raw_frame(spark, [(1, "x", None, 1, 1.0, 1, "A", T0), (2, "y", "z", 1, 1.0, 1, "A", T0)])
    b = raw_frame(spark, [(1, None, "x", 1, 1.0, 1, "A", T0), (2, "y", "z", 1, 1.0, 1, "A", T0)])
    same = a.orderBy(F.desc("invoice_no"))
    assert _fingerprint(Only(a)).first() == _fingerprint(Only(same)).first() != _fingerprint(Only(b)).first()


def test_staged_tables_are_found_by_a_later_application_and_refused_when_invalid(spark, tmp_path, monkeypatch):
    from tillpoint.plans.context import Ctx
    from tillpoint.sources import staging

    sf = write_tables(spark, tmp_path / "good", [(1, 1, 1.0)], [(1, 7, T0)])
    first = Ctx(spark, sf).invoice_facts.inputFiles()
    for kept in (staging._STAGED, staging._SHARED, staging._FINGERPRINTS):
        monkeypatch.setattr(staging, f"_{'STAGED' if kept is staging._STAGED else 'SHARED' if kept is staging._SHARED else 'FINGERPRINTS'}", {})
    again = Ctx(spark, sf)
    monkeypatch.setattr(grains, "invoice_full", lambda lines: 1 / 0)  # must not be built anew
    assert again.invoice_facts.inputFiles() == first
    monkeypatch.undo()
    bad = write_tables(spark, tmp_path / "bad", [(1, 1, -1.0)], [(1, 7, T0)])
    with pytest.raises(ValueError, match="non_positive_quantity"):
        Ctx(spark, bad).invoice_facts


def test_queries_give_the_same_rows_without_staging(spark, monkeypatch):
    import __spark_entry__ as E
    from conftest import SF001

    keys = ("monthly_summary", "top_products", "holdout_weeks", "dq_repair_summary")
    staged = {k: sorted(map(str, E.queries()[k](spark, SF001).collect())) for k in keys}
    monkeypatch.setenv("TILLPOINT_STAGE", "0")
    assert {k: sorted(map(str, E.queries()[k](spark, SF001).collect())) for k in keys} == staged


def test_hot_copies_match_brute_force(spark):
    rnd = random.Random(11)
    hot = (5, "S1", "d", 3, 2.5, 9, "A", T0)
    rows = [hot] * 1000 + [(rnd.randint(1, 50), f"S{rnd.randint(1, 5)}", "d", rnd.randint(1, 3), 1.0,
                            rnd.randint(1, 4), "A", T0) for _ in range(2000)]
    r = quality.duplicate_sensitivity(raw_frame(spark, rows).repartition(8)).first()
    counts = pd.Series(rows).value_counts()
    extra = counts - 1
    cents = {row: row[3] * int(round(row[4] * 100)) for row in counts.index}
    dup_cents = sum(int(extra[row]) * cents[row] for row in counts.index)
    total_cents = sum(row[3] * int(round(row[4] * 100)) for row in rows)
    assert r.possible_duplicate_rows == int(extra.sum())
    assert r.sensitivity_value == dup_cents / 100
    assert r.revenue_if_duplicates_dropped == (total_cents - dup_cents) / 100
