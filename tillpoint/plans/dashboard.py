"""Registered dashboard queries."""

from __future__ import annotations

from tillpoint.operators import customers as cu
from tillpoint.operators import dashboard as db
from tillpoint.operators import products as pr
from tillpoint.operators import revenue as rv
from tillpoint.plans import forecasting as pf
from tillpoint.plans.context import Ctx


# The market modes: every market, all but the home market, and one country.
MARKETS = {"all": "all", "outside_home": "outside_home", "france": "FRANCE"}


def _months(c: Ctx, market: str = "all", period: str = "all"):
    return db.market_period(c.status, c.invoices, pr.home_country(c.invoices), market, period)


def _view(market: str, period: str):
    return lambda c: _months(c, MARKETS[market], period)


QUERIES = {
    "dash_market_period": _months,
    **{f"dash_market_period_{m}_{p}": _view(m, p) for m in MARKETS for p in db.PERIODS},
    "dash_market_kpis": lambda c: db.market_kpis(_months(c)),
    "dash_focus_compare": lambda c: rv.period_comparison(c.invoices, metrics=("orders", "aov")),
    "dash_top_markets": lambda c: db.top_markets(pr.country_share(c.invoices)),
    "dash_top_products": lambda c: pr.top_products_named(c.lines),
    "dash_segments": lambda c: db.segments_by_share(cu.rfm_segments(c.customers)),
    "dash_series_panel": lambda c: db.series_panel(pf.stat_weekly(c), pf._holdout_out(c)),
    "dash_cohort_table": lambda c: db.cohort_table(cu.cohort_retention(c.invoices)),
}
