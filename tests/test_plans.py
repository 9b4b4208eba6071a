"""Plan-shape guards for scale: checked on the physical plans of the
registered queries (sf0.001), not on their results."""

import re

import pytest

from conftest import SF001
from tillpoint.plans import registry

def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, small_trees):
    # The reference's own queries; tests/llm holds the training-data operators.
    return {k: _plan(fn(spark, SF001)) for k, fn in registry.queries().items()}


def test_no_cartesian_or_nested_loop_join(plans):
    bad = {k: p for k, p in plans.items()
           if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p}
    assert not bad, sorted(bad)


def test_no_python_on_executors(plans):
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonMapInArrow",
                    "FlatMapGroupsInPandas", "FlatMapCoGroupsInPandas", "AggregateInPandas",
                    "WindowInPandas")
    bad = [k for k, p in plans.items() if any(n in p for n in python_nodes)]
    assert not bad, bad


def _combines_below_exchange(plan: str) -> bool:
    return "partial_" in plan[plan.index("Exchange hashpartitioning"):]


def test_invoice_keyed_aggregates_combine_map_side(spark, plans):
    # A hot invoice or a group of exact copies shrinks to one row per task
    # before the exchange: the partial aggregate sits below it.
    from tillpoint.operators import grains
    from tillpoint.plans.context import Ctx
    assert _combines_below_exchange(_plan(grains.invoice_full(Ctx(spark, SF001).lines)))
    for key in ("dq_duplicate_sensitivity", "revenue_decomposition", "top_products"):
        assert _combines_below_exchange(plans[key]), key


def _scan_columns(plan: str) -> list[set]:
    return [{c.split("#")[0] for c in cols.split(",")}
            for cols in re.findall(r"FileScan parquet \S*\[([^\]]*)\]", plan)]


# Columns only the staged line extract has (the invoice grain has none).
LINE_ONLY = {"quantity", "invoice_month", "stock_code", "parsed_ts", "week_start", "unit_price"}


def test_marts_read_the_staged_invoice_grain(plans):
    # Invoice-level marts never re-aggregate the lines.
    for key in ("invoices", "monthly_summary", "cohort_retention", "country_share", "rfm_segments"):
        scans = _scan_columns(plans[key])
        assert scans and all(not (cols & LINE_ONLY) for cols in scans), (key, scans)


def test_scans_prune_columns_and_never_reparse_dates(plans):
    # The growth decomposition reads 4 of the 26 staged columns, all typed.
    assert sorted(map(sorted, _scan_columns(plans["revenue_decomposition"]))) == [
        ["customer_id", "invoice_month"], ["invoice_month", "invoice_no", "revenue_cents"]]
    # The quarantine judges texts, dates among them; all others read typed dates.
    bad = [k for k, p in plans.items() if ("gettimestamp" in p or "to_timestamp" in p) and k != "dq_quarantine"]
    assert not bad, bad


def test_duplicate_check_scans_and_shuffles_once(plans):
    plan = plans["dq_duplicate_sensitivity"]
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_quality_reads_the_staged_invoice_grain(plans):
    for key in ("dq_functional_dependency", "dq_chronology_inversions"):
        scans = _scan_columns(plans[key])
        assert scans and all(not (cols & LINE_ONLY) for cols in scans), (key, scans)


def test_week_filter_reaches_the_scan(spark):
    from tillpoint.operators import forecast as fc
    from tillpoint.plans import forecasting as pf
    from tillpoint.plans.context import Ctx
    c = Ctx(spark, SF001)
    for df in (fc.sku_popularity(c.series_lines, pf.cal(c)), fc.weekly_units(c.series_lines, pf.cal(c), pf.top(c))):
        assert "GreaterThanOrEqual(week_start," in _plan(df)


def test_staged_tables_are_reused_across_queries(spark):
    from tillpoint.plans import forecasting as pf
    from tillpoint.plans.context import Ctx
    a, b = Ctx(spark, SF001), Ctx(spark, SF001)
    assert a.extract.inputFiles() == b.extract.inputFiles()
    assert a.invoice_facts.inputFiles() == b.invoice_facts.inputFiles()
    assert pf.selection(a) is pf.selection(b)  # checkpointed once per input
    assert pf.cal(a) == pf.cal(b)
