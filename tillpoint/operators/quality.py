"""Data-quality operators: contract checks, repair summary, duplicates,
multi-timestamp invoices, chronology inversions, reconciliation, and the
checks that refuse an extract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, money, segment_expr
from tillpoint.functions.joins import many_to_one, unique_key  # noqa: F401  (checks that refuse, beside the others)
from tillpoint.functions.ordering import count_order_inversions
from tillpoint.sources.extract import RAW_SCHEMA, REQUIRED_COLUMNS

# A segment only asks whether a customer has 3 or 5 orders.
ORDERS_THAT_MATTER = 5


def required_columns(raw: DataFrame) -> DataFrame:
    """One row per required column: whether the table has it, and how many
    values it holds there."""
    present = [c for c in REQUIRED_COLUMNS if c in raw.columns]
    counts = raw.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in present])
    rows = [F.struct(F.lit(c).alias("required_column"), F.lit(c in present).alias("present"),
                     (F.col(c) if c in present else F.lit(0)).cast("bigint").alias("values")) for c in REQUIRED_COLUMNS]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def assert_required_columns(raw: DataFrame) -> None:
    missing = sorted(set(REQUIRED_COLUMNS) - set(raw.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def violations(raw: DataFrame, invoices: DataFrame) -> DataFrame:
    """One row: the counts that ``validate`` wants to be zero, and the rows."""
    no_date = F.count_if(F.col("invoice_date_text").isNull()).cast("bigint").alias("null_invoice_date")
    lines = raw.agg(F.count(F.lit(1)).alias("rows"), no_date,
                    *[e for part in (_null_counts(), _non_positive_counts()) for e in part])
    fd = functional_dependency(invoices)
    packed = fd.select(F.struct(*fd.columns).alias("s")).scalar()
    return lines.select("*", *[packed.getField(c).alias(c) for c in fd.columns])


def validate(raw: DataFrame, invoices: DataFrame) -> None:
    """Refuse an extract with missing columns, no rows, missing ids or dates,
    non-positive quantities or prices, or invoices of several customers or
    countries.  ``invoices`` is the invoice grain (``grains.invoice_full``)."""
    assert_required_columns(raw)
    found = violations(raw, invoices).first().asDict()
    if not found.pop("rows"):
        raise ValueError("The extract has no rows")
    if bad := {k: v for k, v in found.items() if v}:
        raise ValueError(f"The extract breaks its contract: {bad}")


def _null_counts() -> list:
    return [F.count_if(F.col("invoice_no").isNull()).cast("bigint").alias("null_invoice_no"),
            F.count_if(F.col("customer_id").isNull()).cast("bigint").alias("null_customer_id")]


def _non_positive_counts() -> list:
    return [F.count_if(F.col("quantity") <= 0).cast("bigint").alias("non_positive_quantity"),
            F.count_if(F.col("unit_price") <= 0).cast("bigint").alias("non_positive_price")]


def not_null(raw: DataFrame) -> DataFrame:
    return raw.agg(*_null_counts())


def positive(raw: DataFrame) -> DataFrame:
    return raw.agg(*_non_positive_counts())


def non_empty(raw: DataFrame) -> DataFrame:
    """True when the extract has at least one row (reads one row at most)."""
    return raw.limit(1).agg((F.count(F.lit(1)) > 0).alias("non_empty"))


def functional_dependency(invoices: DataFrame) -> DataFrame:
    """Invoices of several customers or countries, from the invoice grain:
    its ``min <> max`` witnesses replace ``count(distinct) > 1``."""
    return invoices.agg(F.count_if("multi_customer").cast("bigint").alias("invoices_multi_customer"),
                        F.count_if("multi_country").cast("bigint").alias("invoices_multi_country"))


def date_bounds(lines: DataFrame) -> DataFrame:
    return lines.agg(F.min("invoice_date").alias("date_min"), F.max("invoice_date").alias("date_max"))


def repair_summary(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows, repaired dates, same day-month rows, distinct invoices/customers.

    Sums of the invoice grain, but for the customers: an invoice may hold
    lines of several, so they are counted over the lines.  NULL ids are not
    counted."""
    customers = lines.select("customer_id").distinct().agg(F.count("customer_id").alias("n")).scalar()
    return invoices.agg(
        F.coalesce(F.sum("n_lines"), F.lit(0)).cast("bigint").alias("rows"),
        F.coalesce(F.sum("n_swapped"), F.lit(0)).cast("bigint").alias("repaired_dates"),
        F.coalesce(F.sum("n_same_day_month"), F.lit(0)).cast("bigint").alias("same_day_month_rows"),
        F.count("invoice_no").alias("distinct_invoices")).select(
        "*", customers.alias("distinct_customers"))


def duplicate_sensitivity(raw: DataFrame) -> DataFrame:
    """Exact duplicate rows over all 13 columns and their revenue.

    One scan and one shuffle: rows are counted by all columns, and copies
    combine in their own task before the exchange, so a row copied a billion
    times moves once for each task."""
    cols = [f.name for f in RAW_SCHEMA.fields]
    cents = F.col("quantity").cast("bigint") * (F.col("unit_price") * 100).cast("bigint")
    groups = raw.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).select("n", cents.alias("one"))
    extra = F.col("n") - 1
    agg = groups.agg(F.sum(extra).alias("dup_rows"), F.sum(F.col("n") * F.col("one")).alias("rc"),
                     F.sum(F.when(extra > 0, extra * F.col("one"))).alias("dup_rc"))
    return agg.select(
        F.col("dup_rows").cast("bigint").alias("possible_duplicate_rows"),
        money("dup_rc").alias("sensitivity_value"),
        money(F.col("rc") - F.coalesce(F.col("dup_rc"), F.lit(0))).alias("revenue_if_duplicates_dropped"))


def multi_timestamp_invoices(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices with several timestamps: the grain names them, and only their
    lines are counted."""
    several = invoices.where(F.col("invoice_date") != F.col("last_ts")).select("invoice_no")
    return (lines.join(several, "invoice_no", "left_semi").groupBy("invoice_no")
            .agg(F.countDistinct("invoice_date").alias("distinct_timestamps")))


def chronology_inversions(invoices: DataFrame) -> DataFrame:
    """Backward jumps of each invoice's first timestamp in invoice-number
    order, before and after repair (distributed, see ``ordering``)."""
    inv = count_order_inversions(invoices, "invoice_no", ["first_raw_ts", "invoice_date"])
    return inv.select(F.col("first_raw_ts").alias("inversions_raw"),
                      F.col("invoice_date").alias("inversions_corrected"))


def reconcile(lines: DataFrame, activity_df: DataFrame, invoices: DataFrame) -> DataFrame:
    """Five pairs of totals that must agree, across the three stores the marts
    are made of; each is read once.

    The lines give the total; the activity table, by grouping sets, the
    monthly and the month x country totals; and the invoice grain, by customer
    and then by grouping sets, the segments and the cohorts.  Money is cents
    until the last step, so no order of summation shows."""
    total = lines.agg(F.sum("revenue_cents").alias("total"))
    level = F.when(F.grouping("country") == 1, "month").otherwise("month_country")
    months = (activity_df.groupingSets([["month"], ["month", "country"]], "month", "country")
              .agg(level.alias("level"), *[F.sum(c).alias(c) for c in (
                  "revenue_cents", "orders", "first_revenue_cents", "later_revenue_cents")]))

    def of(which: str, value: Column) -> Column:
        return F.sum(F.when(F.col("level") == which, value))

    split = F.col("first_revenue_cents") + F.col("later_revenue_cents")
    monthly = months.agg(of("month", F.col("revenue_cents")).alias("monthly"), of("month", F.col("orders")).alias("monthly_orders"),
                         of("month_country", F.col("orders")).alias("country_orders"), of("month", split).alias("status"),
                         of("month_country", split).alias("pivot"))
    people = customer_groups(invoices).agg(
        F.sum(F.when(F.col("segment").isNotNull(), F.col("revenue_cents"))).alias("segments"),
        F.sum(F.when(F.col("segment").isNotNull(), F.col("customers"))).alias("customers"),
        F.sum(F.when(F.col("segment").isNull(), F.col("customers"))).alias("cohorts"))
    packed = {name: df.select(F.struct(*df.columns).alias("s")).scalar() for name, df in (("m", monthly), ("p", people))}
    one = total.select("total", *[e.alias(name) for name, e in packed.items()]).select(
        "total", *[f"m.{c}" for c in monthly.columns], *[f"p.{c}" for c in people.columns])
    checks = {"monthly_revenue_vs_total": (money("monthly"), money("total")),
              "country_orders_vs_monthly_orders": (F.col("country_orders"), F.col("monthly_orders")),
              "segment_revenue_vs_total": (money("segments"), money("total")),
              "status_revenue_vs_country_pivot": (money("status"), money("pivot")),
              "cohort_sizes_vs_customers": (F.col("cohorts"), F.col("customers"))}
    rows = [F.struct(F.lit(name).alias("check_name"), dround(detail.cast("double"), 2).alias("detail_total"),
                     dround(summary.cast("double"), 2).alias("summary_total")) for name, (detail, summary) in checks.items()]
    return (one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
            .withColumn("difference", F.round(F.col("detail_total") - F.col("summary_total"), 6)))


def customer_groups(invoices: DataFrame) -> DataFrame:
    """``customers`` and ``revenue_cents`` by segment (``segment``), and again by
    cohort (``first_month``, with a NULL segment), from one scan.

    A segment needs the day after the last timestamp, which is known only when
    all is read; so customers are first counted by the two numbers that decide
    it, the last day and the orders up to ``ORDERS_THAT_MATTER``, whose groups
    are bounded by the calendar, and the labels are given to those."""
    customer = invoices.groupBy("customer_id").agg(
        F.sum("revenue_cents").alias("revenue_cents"), F.least(F.count(F.lit(1)), F.lit(ORDERS_THAT_MATTER)).alias("orders"),
        F.to_date(F.max("invoice_date")).alias("last_day"), F.min("month").alias("first_month"), F.max("last_ts").alias("last_ts"))
    groups = (customer.groupingSets([["last_day", "orders"], ["first_month"]], "last_day", "orders", "first_month")
              .agg(F.grouping("first_month").alias("by_day"), F.count(F.lit(1)).alias("customers"),
                   F.sum("revenue_cents").alias("revenue_cents"), F.max("last_ts").alias("last_ts")))
    as_of = F.date_add(F.to_date(F.max("last_ts").over(Window.partitionBy(F.lit(1)))), 1)
    recency = F.datediff(as_of, "last_day")
    return (groups.select("first_month", F.when(F.col("by_day") == 1, segment_expr(recency, "orders")).alias("segment"),
                          "customers", "revenue_cents")
            .groupBy("first_month", "segment")
            .agg(F.sum("customers").alias("customers"), F.sum("revenue_cents").alias("revenue_cents")))
