"""Headline metrics: one row of scalars.

All that the invoice grain tells comes from one pass over it: invoices shrink
to (customer, country, month) cells, cells to customers that keep theirs, and
customers to (month, country) cells that also carry the sums of the customers
counted there.  A customer's cells and the final ones are bounded by the
calendar and the countries, so the last step holds them in one row and picks
the home market and the focus months from it.

What other tables or an order tell (distinct products, exact duplicates,
chronology) enters as one uncorrelated scalar subquery each.  There is no
join between the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, money, month_label, safe_div
from tillpoint.functions.ordering import count_order_inversions
from tillpoint.operators import quality as q

_SUMS = ("n_lines", "n_swapped", "n_same_day_month", "several_times", "invoices")


def _total(cells: Column, value, where=lambda x: F.lit(True)) -> Column:
    """Sum of ``value`` over the array ``cells``; NULL where there are none, as SQL's."""
    some = F.filter(cells, where)
    return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0).cast("bigint"), lambda a, x: a + value(x)))


def invoice_metrics(inv: DataFrame) -> DataFrame:
    """One row from one scan of the invoice grain (``grains.invoice_full``)."""
    cells = inv.groupBy("customer_id", "country", "month").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("revenue_cents").alias("rc"), F.count("invoice_no").alias("invoices"),
        F.sum("n_lines").alias("n_lines"), F.sum("n_swapped").alias("n_swapped"),
        F.sum("n_same_day_month").alias("n_same_day_month"),
        F.count_if(F.col("invoice_date") != F.col("last_ts")).alias("several_times"),
        F.min("invoice_date").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    customers = cells.groupBy("customer_id").agg(
        F.collect_list(F.struct("country", "month", "orders", "rc")).alias("cells"), F.sum("orders").alias("orders"),
        F.sum("rc").alias("rc"), (F.min("country") != F.max("country")).alias("several_countries"),
        *[F.sum(c).alias(c) for c in _SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    # A customer's own sums stand on the first of its cells.
    spread = customers.select("*", F.posexplode("cells").alias("at", "cell"))
    own, repeat = F.col("at") == 0, F.col("orders") >= 2

    def once(value: Column) -> Column:
        return F.sum(F.when(own, value).otherwise(0))

    by_cell = spread.groupBy("cell.country", "cell.month").agg(
        F.sum("cell.orders").alias("orders"), F.sum("cell.rc").alias("rc"),
        once(F.col("customer_id").isNotNull().cast("bigint")).alias("customers"),
        once(repeat.cast("bigint")).alias("repeat"), once(F.when(repeat, F.col("rc")).otherwise(0)).alias("repeat_rc"),
        once((F.col("orders") == 1).cast("bigint")).alias("single"),
        once(F.coalesce(F.col("several_countries"), F.lit(False)).cast("bigint")).alias("several_countries"),
        *[once(F.col(c)).alias(c) for c in _SUMS], F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    extra = ("customers", "repeat", "repeat_rc", "single", "several_countries", *_SUMS, "rc")
    one = by_cell.agg(F.collect_list(F.struct("country", "month", "orders", "rc")).alias("cells"),
                      *[F.sum(c).cast("bigint").alias(c) for c in extra],
                      F.min("first_ts").alias("date_min"), F.max("last_ts").alias("date_max"), F.max("month").alias("last_month"))
    cells_ = F.col("cells")
    places = F.array_distinct(F.transform(cells_, lambda x: x.country))
    # Of all countries the one with the most revenue; ties go by name.
    ranked = F.array_sort(F.transform(places, lambda p: F.struct(
        (-_total(cells_, lambda x: x.rc, lambda x: x.country.eqNullSafe(p))).alias("less"), p.alias("country"))))
    one = one.select("*", F.get(ranked, F.lit(0)).getField("country").alias("home"),
                     F.add_months("last_month", -3).alias("from_m"), F.add_months("last_month", -1).alias("to_m"))

    def in_month(name: str, value) -> Column:
        return _total(cells_, value, lambda x: x.month == F.col(name))

    home_rc = F.coalesce(_total(cells_, lambda x: x.rc, lambda x: x.country == F.col("home")), F.lit(0))
    one = one.select("*", F.size(F.array_compact(places)).cast("bigint").alias("countries"), home_rc.alias("home_rc"), *[
        in_month(m, value).alias(f"{m}_{n}") for m in ("from_m", "to_m") for n, value in (
            ("rc", lambda x: x.rc), ("n", lambda x: x.orders))])
    focus = [e for m, n in (("from_m", "from"), ("to_m", "to")) for e in (
        month_label(m).alias(f"focus_{n}_month"), money(f"{m}_rc").alias(f"focus_{n}_sales"),
        F.coalesce(f"{m}_n", F.lit(0)).cast("bigint").alias(f"focus_{n}_orders"),
        dround(safe_div(money(f"{m}_rc"), f"{m}_n"), 2).alias(f"focus_{n}_aov"))]
    return one.select(
        F.col("n_lines").alias("rows"), "customers", "invoices", "countries", money("rc").alias("revenue"),
        dround(safe_div(money("rc"), "invoices"), 2).alias("aov"), F.col("n_swapped").alias("date_swapped_rows"),
        F.col("n_same_day_month").alias("date_same_day_month_rows"),
        F.coalesce("several_times", F.lit(0)).alias("invoices_with_multiple_corrected_timestamps"),
        F.coalesce("several_countries", F.lit(0)).alias("customer_multiple_country_count"), "date_min", "date_max",
        F.coalesce("repeat", F.lit(0)).alias("repeat_customers_multi_invoice"),
        money("repeat_rc").alias("repeat_customers_multi_invoice_revenue"),
        F.coalesce("single", F.lit(0)).alias("single_invoice_customers"), F.col("home").alias("home_country"),
        dround(F.lit(100.0) * safe_div("home_rc", "rc"), 2).alias("home_revenue_share_pct"), *focus,
        F.date_add(F.to_date("date_max"), 1).alias("asof_date"))


def headline_metrics(raw: DataFrame, lines: DataFrame, inv: DataFrame) -> DataFrame:
    """``inv`` is ``invoice_full(lines)``, ideally materialised once."""
    products = lines.agg(F.countDistinct("stock_code").alias("products"))
    inversions = count_order_inversions(inv, "invoice_no", ["first_raw_ts", "invoice_date"]).select(
        F.col("first_raw_ts").alias("invoice_date_inversions_raw"),
        F.col("invoice_date").alias("invoice_date_inversions_corrected"))
    dup = q.duplicate_sensitivity(raw).select(
        F.col("possible_duplicate_rows").alias("duplicate_exact_rows"),
        F.col("revenue_if_duplicates_dropped").alias("revenue_if_exact_duplicates_dropped"),
        F.coalesce(F.col("sensitivity_value"), F.lit(0.0)).alias("duplicate_revenue_sensitivity"))
    parts = {"p": products, "i": inversions, "d": dup}
    row = invoice_metrics(inv)
    packed = row.select("*", *[df.select(F.struct(*df.columns).alias("s")).scalar().alias(name) for name, df in parts.items()])
    return packed.select(*row.columns, *[f"{name}.{c}" for name, df in parts.items() for c in df.columns])
