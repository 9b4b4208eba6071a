"""Registered analytic and data-quality queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillpoint.functions.columns import money
from tillpoint.operators import customers as cu
from tillpoint.operators import products as pr
from tillpoint.operators import quality as q
from tillpoint.operators import repair
from tillpoint.operators import revenue as rv
from tillpoint.operators import rollups as ru
from tillpoint.operators.metrics import headline_metrics
from tillpoint.plans.context import Ctx
from tillpoint.sources import quarantine
from tillpoint.sources.adapter import key_counts, orphan_lines


def _invoices_out(c: Ctx):
    return c.invoices.select("invoice_no", "customer_id", "country", "invoice_date", "month",
                             money("revenue_cents").alias("revenue"), "items")


def _fingerprint(c: Ctx):
    """Order-insensitive fingerprint of the raw extract.  A row is hashed with
    the place of each value, and a NULL is told from an empty text, so a value
    that moves to another column or row changes the sum."""
    cells = [F.coalesce(F.concat(F.lit("="), F.col(x).cast("string")), F.lit("-")) for x in c.raw.columns]
    digest = F.md5(F.concat_ws("|", *cells).cast("binary"))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    nulls = sum((F.col(x).isNull().cast("bigint") for x in c.raw.columns), F.lit(0).cast("bigint"))
    return c.raw.select(h.alias("h"), nulls.alias("nulls")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("nulls").alias("null_values"), F.bit_xor("h").alias("xor_hash"),
        F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def _headline(c: Ctx):
    return headline_metrics(c.raw, c.lines, c.invoice_facts)


def _quarantine(c: Ctx):
    """The split of the extract as it would be delivered, all values as texts."""
    return quarantine.counts(quarantine.judged(c.raw.select(*[F.col(x).cast("string").alias(x) for x in c.raw.columns])))


QUERIES = {
    "lines_repaired": lambda c: repair.public_view(c.lines),
    "invoices": _invoices_out,
    "invoice_status": lambda c: c.status.select(
        "invoice_no", "customer_id", "country", "invoice_date", "month",
        money("revenue_cents").alias("revenue"), "items", "first_observed_month", "status"),
    "revenue_decomposition": lambda c: rv.revenue_decomposition(c.lines),
    "monthly_summary": lambda c: rv.monthly_summary(c.invoices),
    "focus_range": lambda c: rv.months_between(rv.monthly_summary(c.invoices), *rv.focus_labels(c.invoices)),
    "focus_months_listed": lambda c: rv.months_in(rv.monthly_summary(c.invoices), rv.focus_labels(c.invoices)),
    "labelled_months": lambda c: rv.labelled_months(rv.monthly_summary(c.invoices)),
    "period_comparison": lambda c: rv.period_comparison(c.invoices),
    "returning_revenue": lambda c: rv.returning_revenue(c.status),
    "status_by_month": lambda c: rv.status_by_month(c.status),
    "monthly_country": lambda c: rv.monthly_country(c.status),
    "sales_rollup": lambda c: ru.sales_rollup(c.activity),
    "quarterly_customers": lambda c: ru.quarterly_customers(c.activity),
    "cohort_retention": lambda c: cu.cohort_retention(c.invoices),
    "cohort_matrix": lambda c: cu.cohort_matrix(cu.cohort_retention(c.invoices)),
    "cohort_next_month": lambda c: cu.cohort_next_month(cu.cohort_retention(c.invoices)),
    "rfm_segments": lambda c: cu.rfm_segments(c.customers),
    "customer_metrics": lambda c: cu.customer_metrics(c.customers, c.invoices),
    "customer_surrogate_key": lambda c: cu.surrogate_key(c.invoices),
    "multi_country_customers": lambda c: cu.multi_country_customers(c.invoices),
    "segment_share_long": lambda c: cu.segment_share_long(c.customers),
    "frequency_bands": lambda c: cu.frequency_bands(c.invoices),
    "repeat_customer_share": lambda c: cu.repeat_customer_share(c.customers),
    "top_products": lambda c: pr.top_products(c.lines),
    "product_summary": lambda c: pr.product_summary(c.lines),
    "product_modal_description": lambda c: pr.product_modal_description(c.lines),
    "country_share": lambda c: pr.country_share(c.invoices),
    "non_home_market_mix": lambda c: pr.non_home_market_mix(c.invoices),
    "headline_metrics": _headline,
    "dq_required_columns": lambda c: q.required_columns(c.raw),
    "dq_not_null": lambda c: q.not_null(c.raw),
    "dq_positive": lambda c: q.positive(c.raw),
    "dq_non_empty": lambda c: q.non_empty(c.raw),
    "dq_functional_dependency": lambda c: q.functional_dependency(c.invoice_facts),
    "dq_orphan_lines": lambda c: orphan_lines(c.spark, c.sf_dir),
    "dq_violations": lambda c: q.violations(c.raw, c.invoice_facts),
    "dq_quarantine": _quarantine,
    "dq_date_bounds": lambda c: q.date_bounds(c.lines),
    "dq_repair_summary": lambda c: q.repair_summary(c.invoice_facts, c.lines),
    "dq_duplicate_sensitivity": lambda c: q.duplicate_sensitivity(c.raw),
    "dq_multi_timestamp_invoices": lambda c: q.multi_timestamp_invoices(c.invoice_facts, c.lines),
    "dq_chronology_inversions": lambda c: q.chronology_inversions(c.invoice_facts),
    "dq_reconcile": lambda c: q.reconcile(c.lines, c.activity, c.invoice_facts),
    "table_fingerprint": _fingerprint,
    "assert_many_to_one": lambda c: key_counts(c.spark, c.sf_dir),
}
