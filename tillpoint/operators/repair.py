"""Date repair and the repaired line view (12 output columns + cents)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.columns import TS_FORMAT, month_start, swap_day_month, week_start


def repair_dates(df: DataFrame, text_col: str = "invoice_date_text") -> DataFrame:
    """Strict parse of the timestamp text, then undo the day/month swap.

    A malformed value fails the job whatever the session's ANSI setting: the
    parse yields NULL without ANSI, and a NULL from a text raises.  Adds
    ``parsed_ts``, ``invoice_date`` and ``was_swapped``.
    """
    text = F.col(text_col)
    tried = F.to_timestamp_ntz(text, F.lit(TS_FORMAT))
    parsed = F.when(text.isNotNull() & tried.isNull(),
                    F.raise_error(F.concat(F.lit("Malformed invoice date: "), text))).otherwise(tried)
    return (df.withColumn("parsed_ts", parsed)
              .withColumn("invoice_date", swap_day_month("parsed_ts"))
              .withColumn("was_swapped", F.col("invoice_date") != F.col("parsed_ts")))


def _line_exprs() -> list:
    """Columns of the repaired line view, over ``repair_dates`` output."""
    price_cents = (F.col("unit_price") * 100).cast("bigint")
    return [
        F.col("invoice_no"), F.col("stock_code"), F.col("description"), F.col("quantity"),
        F.col("unit_price"), F.col("customer_id"), F.col("country"), F.col("invoice_date_text"),
        F.col("parsed_ts"), F.col("invoice_date"),
        month_start("invoice_date").alias("invoice_month"),
        (F.col("quantity") * F.col("unit_price")).cast("decimal(18,2)").alias("revenue"),
        (F.col("quantity").cast("bigint") * price_cents).alias("revenue_cents"),
        week_start("invoice_date").alias("week_start"),
        F.col("was_swapped"),
    ]


LINE_COLUMNS = ("invoice_no", "stock_code", "description", "quantity", "unit_price", "customer_id",
                "country", "invoice_date_text", "parsed_ts", "invoice_date", "invoice_month",
                "revenue", "revenue_cents", "week_start", "was_swapped")


def lines(raw: DataFrame) -> DataFrame:
    """Repaired invoice lines.

    ``revenue`` is exact DECIMAL(18,2); ``revenue_cents`` is the same value
    as BIGINT cents so that sums stay on the fast long-arithmetic path.
    """
    return repair_dates(raw).select(*_line_exprs())


def repaired_extract(raw: DataFrame) -> DataFrame:
    """The raw columns plus the repaired line columns, for staging: the
    text is parsed and repaired once at load (a malformed value fails the
    load), and no query re-parses it.  Selecting ``raw.columns`` or
    ``LINE_COLUMNS`` from it gives the raw extract or the line view."""
    extra = [e for e, name in zip(_line_exprs(), LINE_COLUMNS) if name not in raw.columns]
    return repair_dates(raw).select(*raw.columns, *extra)


def public_view(lines_df: DataFrame) -> DataFrame:
    """Public 12-column repaired view of the lines (money as double)."""
    return lines_df.select(
        "invoice_no", "stock_code", "description", "quantity",
        F.col("unit_price").cast("double").alias("unit_price"),
        "customer_id", "country", "invoice_date_text", "parsed_ts", "invoice_date",
        "invoice_month", F.col("revenue").cast("double").alias("revenue"))


def lines_repaired(raw: DataFrame) -> DataFrame:
    """Public 12-column repaired view of a raw extract."""
    return public_view(lines(raw))
