"""Weekly unit series and the three statistical four-week forecasts.

Everything is long-form: (series, week_start, units).  Per-series windows
hold one row per calendar week (52 by default), so no window group grows
with the data; the "All products" series is built from per-SKU weekly sums,
so its one key never meets raw lines.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.functions.columns import dround, wape_expr

# Fixed values that must equal the reference.
ALL_SERIES = "All products"
ALL_PRODUCT_NAME = "All product units"
UNKNOWN_NAME = "Unknown"
METHODS = ("four_week_mean", "four_week_repeat", "eight_week_damped_trend")
HORIZON = 4
HISTORY = 8
DAMPING = 0.65
SLOPE_CAP = 0.18
WEEKS = 52
N_VALIDATION = 5
POOL_SIZE = 120
TOP_N = 5
MIN_ACTIVE_POOL = 12
MIN_ACTIVE_TOP = 17

# Cumulative damping factors sum_{i=1..h} 0.65^i, h = 1..4.
DAMPED_STEPS = [sum(DAMPING ** i for i in range(1, h + 1)) for h in range(1, HORIZON + 1)]
# Least-squares slope over x = 0..7 is sum((x - 3.5) * y) / 42; with
# lag k holding x = 8 - k the weight of lag k is (4.5 - k) / 42.
SLOPE_WEIGHTS = {k: (4.5 - k) for k in range(1, HISTORY + 1)}
SLOPE_DENOM = sum((x - 3.5) ** 2 for x in range(HISTORY))


@dataclass(frozen=True)
class Calendar:
    """Forecast calendar (all Mondays): first/last complete week of the
    history grid, the test origin and the validation origins (earliest
    first).  Six dates: the only values the forecasting jobs hold on the
    driver, so every date filter is a literal that Catalyst can push down."""

    first_week: datetime.date
    last_week: datetime.date
    test_origin: datetime.date
    validation: tuple

    @property
    def initial_end(self) -> datetime.date:
        return self.validation[0]

    def origin_rows(self):
        rows = [(d, "validation", i + 1) for i, d in enumerate(self.validation)]
        rows.append((self.test_origin, "test", len(self.validation) + 1))
        return rows


def calendar_from_last_week(last_week: datetime.date, weeks: int = WEEKS,
                            n_validation: int = N_VALIDATION) -> Calendar:
    """L = last complete week; first = L-(weeks-1)w; T = L-3w;
    validation origins T-(7+4i)w for i = n-1..0.  Every origin needs
    ``HISTORY`` weeks of the grid before it."""
    day = datetime.timedelta(days=1)
    test = last_week - 7 * (HORIZON - 1) * day
    validation = tuple(test - 7 * (7 + 4 * i) * day for i in range(n_validation - 1, -1, -1))
    first = last_week - 7 * (weeks - 1) * day
    if min((test, *validation)) < first + 7 * HISTORY * day:
        raise ValueError(f"Each origin needs {HISTORY} complete weeks of history; {weeks} weeks are too few")
    return Calendar(first, last_week, test, validation)


def last_complete_week(lines: DataFrame) -> DataFrame:
    """One row: Monday of the last week fully covered by the data."""
    last = F.date_sub(F.to_date(F.date_trunc("week", F.date_add(F.to_date(F.max("invoice_date")), 1))), 7)
    return lines.agg(last.alias("last_week"))


def calendar(dated: DataFrame, weeks: int = WEEKS, n_validation: int = N_VALIDATION) -> Calendar:
    """Derive the calendar from ``invoice_date`` (one global max, one row collected)."""
    last = last_complete_week(dated).first()["last_week"]
    if last is None:
        raise ValueError("no dated lines: cannot derive a forecast calendar")
    return calendar_from_last_week(last, weeks, n_validation)


def origins(spark, cal: Calendar) -> DataFrame:
    """(origin, kind, fold): validation folds 1..n, then the test origin."""
    return spark.createDataFrame(cal.origin_rows(), "origin date, kind string, fold int")


def _in_window(lines: DataFrame, lo: datetime.date, hi: datetime.date, hi_inclusive: bool) -> DataFrame:
    """Lines of the weeks ``lo`` to ``hi``.  The bounds on the month say nothing
    new about the rows; they leave out the folders of all other months."""
    last = hi + datetime.timedelta(days=6) if hi_inclusive else hi - datetime.timedelta(days=1)
    upper = F.col("week_start") <= F.lit(hi) if hi_inclusive else F.col("week_start") < F.lit(hi)
    window = (F.col("week_start") >= F.lit(lo)) & upper
    if "invoice_month" in lines.columns:
        window = F.col("invoice_month").between(F.lit(lo.replace(day=1)), F.lit(last.replace(day=1))) & window
    return lines.where(window)


def sku_popularity(lines: DataFrame, cal: Calendar) -> DataFrame:
    """Distinct invoices and active weeks per SKU in the initial period
    [first week, first validation origin).  Two single-distinct aggregates
    on pre-deduplicated keys, joined on their common partitioning."""
    initial = _in_window(lines, cal.first_week, cal.initial_end, hi_inclusive=False)
    orders = (initial.select("stock_code", "invoice_no").distinct()
              .groupBy("stock_code").agg(F.count(F.lit(1)).alias("orders")))
    weeks = (initial.select("stock_code", "week_start").distinct()
             .groupBy("stock_code").agg(F.count(F.lit(1)).alias("active_weeks")))
    return orders.join(weeks, "stock_code")


def _ranked(pop: DataFrame, min_active: int, n: int, name: str) -> DataFrame:
    top = (pop.where(F.col("active_weeks") >= min_active)
           .orderBy(F.desc("orders"), F.desc("active_weeks"), F.asc("stock_code")).limit(n))
    w = Window.orderBy(F.desc("orders"), F.desc("active_weeks"), F.asc("stock_code"))  # <= n rows
    return top.select("stock_code", F.row_number().over(w).cast("bigint").alias(name))


def select_series(pop: DataFrame, pool_size: int = POOL_SIZE, top_n: int = TOP_N,
                  min_pool: int = MIN_ACTIVE_POOL, min_top: int = MIN_ACTIVE_TOP) -> DataFrame:
    """Training pool (>= min_pool active weeks, top pool_size) and reported
    top SKUs (>= min_top, top top_n); ranks by orders, active weeks, code."""
    pool = _ranked(pop, min_pool, pool_size, "pool_rank")
    top = _ranked(pop, min_top, top_n, "top_rank")
    sel = pool.join(top, "stock_code", "full")
    # rank 0 = not selected (keeps the rank columns non-nullable integers)
    return sel.join(pop, "stock_code").select(
        "stock_code", "orders", "active_weeks",
        F.coalesce("pool_rank", F.lit(0)).cast("bigint").alias("pool_rank"),
        F.coalesce("top_rank", F.lit(0)).cast("bigint").alias("top_rank"))


def top_codes(selection: DataFrame) -> DataFrame:
    return selection.where(F.col("top_rank") > 0).select("stock_code", "top_rank")


def pool_codes(selection: DataFrame) -> DataFrame:
    return selection.where(F.col("pool_rank") > 0).select("stock_code", "pool_rank")


def week_axis(cal: Calendar) -> Column:
    """Generator of the dense week axis (fixed length, e.g. 52 Mondays)."""
    return F.explode(F.sequence(F.lit(cal.first_week), F.lit(cal.last_week),
                                F.expr("INTERVAL 7 DAYS"))).alias("week_start")


def week_grid(spark, cal: Calendar) -> DataFrame:
    """The dense week axis as a frame."""
    return spark.range(1).select(week_axis(cal))


def weekly_units(lines: DataFrame, cal: Calendar, codes: DataFrame | None = None) -> DataFrame:
    """Dense zero-filled weekly units: "All products" plus one series per code.

    ``codes`` (one column ``stock_code``) restricts the SKU series; by
    default every code in the extract gets a series.  Each code row
    generates its own fixed-length week axis (a projection, no join); the
    dense index then left-joins the sparse sums on (code, week).
    """
    in_range = _in_window(lines, cal.first_week, cal.last_week, hi_inclusive=True)
    sku = in_range.groupBy("stock_code", "week_start").agg(F.sum("quantity").cast("bigint").alias("units"))
    total = sku.groupBy("week_start").agg(F.sum("units").cast("bigint").alias("units"))
    grid = week_grid(lines.sparkSession, cal)
    if codes is None:
        codes = lines.select("stock_code").distinct()
    else:
        codes = codes.select("stock_code")
    sku_grid = (codes.select("stock_code", week_axis(cal)).join(sku, ["stock_code", "week_start"], "left")
                .select(F.col("stock_code").alias("series"), "week_start",
                        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"),
                        F.lit(False).alias("is_all")))
    all_grid = (grid.join(total, "week_start", "left")
                .select(F.lit(ALL_SERIES).alias("series"), "week_start",
                        F.coalesce("units", F.lit(0)).cast("bigint").alias("units"),
                        F.lit(True).alias("is_all")))
    return (all_grid.unionByName(sku_grid)
            .withColumn("week_idx", (F.datediff("week_start", F.lit(cal.first_week)) / 7).cast("int")))


def with_lags(weekly: DataFrame, n: int = HISTORY) -> DataFrame:
    """Add lag_1..lag_n of units within each series (frames of 52 rows)."""
    w = Window.partitionBy("series").orderBy("week_start")
    return weekly.select("*", *[F.lag("units", k).over(w).cast("double").alias(f"lag_{k}")
                                for k in range(1, n + 1)])


def lag_sum(ks) -> Column:
    out = None
    for k in ks:
        out = F.col(f"lag_{k}") if out is None else out + F.col(f"lag_{k}")
    return out


def method_columns(h: Column) -> dict[str, Column]:
    """Forecast of each method for horizon ``h`` from the lag columns."""
    mean4 = lag_sum([4, 3, 2, 1]) / F.lit(4.0)
    mean8 = lag_sum(range(8, 0, -1)) / F.lit(8.0)
    slope = None
    for k in range(HISTORY, 0, -1):
        term = F.lit(SLOPE_WEIGHTS[k]) * F.col(f"lag_{k}")
        slope = term if slope is None else slope + term
    slope = slope / F.lit(SLOPE_DENOM)
    cap = F.lit(SLOPE_CAP) * F.greatest(F.lit(1.0), mean8)
    slope = F.least(F.greatest(slope, -cap), cap)
    repeat = F.element_at(F.array(*[F.col(f"lag_{k}") for k in (4, 3, 2, 1)]), h)
    steps = F.element_at(F.array(*[F.lit(s) for s in DAMPED_STEPS]), h)
    return {
        "four_week_mean": F.greatest(mean4, F.lit(0.0)),
        "four_week_repeat": F.greatest(repeat, F.lit(0.0)),
        "eight_week_damped_trend": F.greatest(mean4 + slope * steps, F.lit(0.0)),
    }


def forecasts(weekly: DataFrame, origins_df: DataFrame, methods=METHODS) -> DataFrame:
    """(series, origin, kind, fold, horizon, week_start, method, forecast).

    Each origin row carries its own eight lags, so history never includes
    the origin week or later (leak-free by construction); an origin with
    fewer than eight grid weeks before it is refused.  Methods are
    stacked from one projection (the union of the three method branches
    without recomputing the lag window).
    """
    st = with_lags(weekly)
    at = st.join(F.broadcast(origins_df), st["week_start"] == origins_df["origin"])  # <= 6 origins
    enough = F.when(F.col("week_idx") >= HISTORY, F.col("lag_1")).otherwise(F.raise_error(F.concat(
        F.lit(f"Fewer than {HISTORY} complete weeks of history before "), F.col("origin").cast("string"))).cast("double"))
    at = at.withColumn("lag_1", enough)  # every method reads it
    at = at.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    mc = method_columns(F.col("horizon"))
    stack = ", ".join(f"'{m}', `_{m}`" for m in methods)
    wide = at.select("series", "origin", "kind", "fold", "horizon",
                     F.date_add("origin", (F.col("horizon") - 1) * 7).alias("week_start"),
                     *[mc[m].alias(f"_{m}") for m in methods])
    return wide.selectExpr("series", "origin", "kind", "fold", "horizon", "week_start",
                           f"stack({len(methods)}, {stack}) AS (method, forecast)")


def with_actuals(fc: DataFrame, weekly: DataFrame) -> DataFrame:
    act = weekly.select("series", "week_start", F.col("units").alias("actual"))
    return fc.join(act, ["series", "week_start"], "left")


def backtest_folds(fc_actual: DataFrame) -> DataFrame:
    """Per (series, origin, method): absolute error, actual total, WAPE.  A fold
    whose weeks are not all observed is refused."""
    v = fc_actual.where(F.col("kind") == "validation")
    g = v.groupBy("series", "origin", "method").agg(
        F.sum(F.abs(F.col("actual") - F.col("forecast"))).alias("absolute_error"),
        F.sum(F.abs(F.col("actual"))).cast("double").alias("actual_total"),
        F.count("actual").alias("n_actual"))
    whole = F.when(F.col("n_actual") == HORIZON, F.col("absolute_error")).otherwise(F.raise_error(F.concat(
        F.lit(f"Fold without its {HORIZON} actual weeks: "), F.col("series"), F.lit(" "),
        F.col("origin").cast("string"))).cast("double"))
    return (g.withColumn("absolute_error", whole)
            .withColumn("wape", wape_expr(F.col("absolute_error"), F.col("actual_total"))))


def method_priority(methods=METHODS) -> Column:
    expr = None
    for i, m in enumerate(methods):
        expr = F.when(F.col("method") == m, i) if expr is None else expr.when(F.col("method") == m, i)
    return expr


def pooled_scores(folds: DataFrame) -> DataFrame:
    g = folds.groupBy("series", "method").agg(F.sum("absolute_error").alias("absolute_error"),
                                              F.sum("actual_total").alias("actual_total"))
    return g.withColumn("validation_wape", wape_expr(F.col("absolute_error"), F.col("actual_total")))


def select_method(scores: DataFrame, methods=METHODS, round_digits: int | None = 8) -> DataFrame:
    """Lowest pooled validation WAPE per series; ties by method order.

    Groups are (series) over at most len(methods) rows.
    """
    key = dround("validation_wape", round_digits) if round_digits is not None else F.col("validation_wape")
    w = Window.partitionBy("series").orderBy(key.asc_nulls_last(), method_priority(methods))
    return (scores.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"))


def product_names(lines: DataFrame, cal: Calendar, codes: DataFrame) -> DataFrame:
    """Series label -> product name: modal description of the SKU in the
    initial period ("Unknown" when absent); "All product units" for the total."""
    initial = _in_window(lines, cal.first_week, cal.initial_end, hi_inclusive=False)
    counts = (initial.join(F.broadcast(codes.select("stock_code")), "stock_code", "left_semi")
              .where(F.col("description").isNotNull())
              .groupBy("stock_code", "description").agg(F.count(F.lit(1)).alias("n")))
    # Modal description (ties: smallest); a group holds one row per description.
    w = Window.partitionBy("stock_code").orderBy(F.desc("n"), F.asc("description"))
    names = (counts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
             .select("stock_code", F.col("description").alias("product")))
    sku = (codes.select("stock_code").join(names, "stock_code", "left")
           .select(F.col("stock_code").alias("series"),
                   F.coalesce("product", F.lit(UNKNOWN_NAME)).alias("product")))
    allrow = lines.sparkSession.createDataFrame([(ALL_SERIES, ALL_PRODUCT_NAME)], "series string, product string")
    return allrow.unionByName(sku)


def holdout_weeks(fc_actual: DataFrame, selected: DataFrame, names: DataFrame,
                  baseline: str = "four_week_mean") -> DataFrame:
    """Test-origin weeks: actual, selected-method forecast and baseline."""
    t = fc_actual.where(F.col("kind") == "test")
    sel = t.join(selected.select("series", "method"), ["series", "method"])
    base = t.where(F.col("method") == baseline).select(
        "series", "week_start", F.col("forecast").alias("baseline"))
    return (sel.join(base, ["series", "week_start"]).join(names, "series")
            .select("series", "product", "week_start", "method",
                    F.col("actual").cast("bigint").alias("actual_units"),
                    F.col("forecast").alias("forecast"), "baseline"))


def holdout_evaluation(weeks: DataFrame) -> DataFrame:
    g = weeks.groupBy("series", "product", "method").agg(
        F.sum(F.abs(F.col("actual_units") - F.col("forecast"))).alias("ae"),
        F.sum(F.abs(F.col("actual_units") - F.col("baseline"))).alias("bae"),
        F.sum(F.abs(F.col("actual_units"))).cast("double").alias("at"),
        F.sum("actual_units").cast("bigint").alias("actual_total"),
        F.sum("forecast").alias("ft"), F.sum("baseline").alias("bt"))
    return g.select("series", "product", F.col("method").alias("selected_method"),
                    dround(wape_expr(F.col("ae"), F.col("at")), 2).alias("holdout_wape"),
                    dround(wape_expr(F.col("bae"), F.col("at")), 2).alias("baseline_holdout_wape"),
                    "actual_total", dround("ft", 1).alias("forecast_total"),
                    dround("bt", 1).alias("baseline_forecast_total"))
