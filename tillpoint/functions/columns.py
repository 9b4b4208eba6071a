"""Column expressions shared by the operators.

All of these stay inside whole-stage codegen: no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results.
# Customer status labels of the invoice grain.
STATUS_FIRST = "First observed month"
STATUS_RETURNING = "Returning (later month)"
# RFM segment labels, in rule order.
SEG_CHAMPIONS = "Champions"
SEG_LOYAL = "Loyal active"
SEG_AT_RISK = "At risk (rule-based)"
SEG_DORMANT = "Dormant (rule-based)"
SEG_RECENT = "Recent buyers"
SEG_DEVELOPING = "Developing"
# Order-frequency bands (label, sort key).
BAND_1 = ("1 order", 1)
BAND_2_4 = ("2-4 orders", 2)
BAND_5_9 = ("5-9 orders", 3)
BAND_10 = ("10+ orders", 4)

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dround(c: str | Column, n: int) -> Column:
    """Round half-up on a decimal image of ``c`` and return a double.

    Rounding the binary double directly differs between engines at ties;
    going through DECIMAL(38,10) makes the result engine-independent.
    """
    return F.round(col(c).cast("decimal(38,10)"), n).cast("double")


def money(cents: str | Column) -> Column:
    """Exact integer cents -> currency units as the nearest double."""
    return col(cents).cast("double") / F.lit(100.0)


def safe_div(num: str | Column, den: str | Column) -> Column:
    """``num / NULLIF(den, 0)`` in double arithmetic (ANSI-safe)."""
    d = col(den).cast("double")
    return F.when(d != 0, col(num).cast("double") / d)


def swap_day_month(ts: str | Column) -> Column:
    """Swap day and month where both are <= 12 and differ.

    An involution on valid timestamps: applying it twice returns the input.
    """
    t = col(ts)
    swap = (F.dayofmonth(t) <= 12) & (F.month(t) <= 12) & (F.dayofmonth(t) != F.month(t))
    swapped = F.make_timestamp_ntz(F.year(t), F.dayofmonth(t), F.month(t),
                                   F.hour(t), F.minute(t), F.second(t))
    return F.when(swap, swapped).otherwise(t)


def month_start(ts: str | Column) -> Column:
    """DATE of the first day of the month."""
    return F.trunc(F.to_date(col(ts)), "MM")


def month_label(d: str | Column) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def week_start(ts: str | Column) -> Column:
    """Monday of the ISO week as a DATE."""
    return F.to_date(F.date_trunc("week", col(ts)))


def month_index(later: str | Column, earlier: str | Column) -> Column:
    """Whole calendar months between two month starts (integer arithmetic)."""
    a, b = col(later), col(earlier)
    return (F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))


def segment_expr(recency_days: str | Column, frequency: str | Column) -> Column:
    """Rule-based RFM segment; the rule order matters."""
    r, f = col(recency_days), col(frequency)
    return (F.when((r <= 30) & (f >= 5), SEG_CHAMPIONS)
            .when((r <= 90) & (f >= 5), SEG_LOYAL)
            .when((r > 90) & (f >= 3), SEG_AT_RISK)
            .when(r > 90, SEG_DORMANT)
            .when(r <= 30, SEG_RECENT)
            .otherwise(SEG_DEVELOPING))


def frequency_band(orders: str | Column) -> Column:
    o = col(orders)
    return (F.when(o == 1, BAND_1[0]).when(o.between(2, 4), BAND_2_4[0])
            .when(o.between(5, 9), BAND_5_9[0]).otherwise(BAND_10[0]))


def frequency_band_key(orders: str | Column) -> Column:
    o = col(orders)
    return (F.when(o == 1, BAND_1[1]).when(o <= 4, BAND_2_4[1])
            .when(o <= 9, BAND_5_9[1]).otherwise(BAND_10[1]))


def customer_status(month: str | Column, first_month: str | Column) -> Column:
    return F.when(col(month) == col(first_month), STATUS_FIRST).otherwise(STATUS_RETURNING)


def wape_expr(abs_error_sum: Column, actual_sum: Column) -> Column:
    """100 * sum|a-p| / sum|a|; NULL when the denominator is 0."""
    return F.when(actual_sum != 0, F.lit(100.0) * abs_error_sum / actual_sum)


def label_number(c: str | Column, start: int, length: int) -> Column:
    """The number in part of a label; ``start`` counts from 1, or from the end
    if negative.  Surrounding blanks do not count; no number there is NULL."""
    return F.substring(F.trim(col(c)), start, length).try_cast("int")


def plain_label(c: str | Column) -> Column:
    """A label for people: trimmed, with spaces for underscores."""
    return F.replace(F.trim(col(c)), F.lit("_"), F.lit(" "))


def relabelled(c: str | Column, labels: dict[str, str]) -> Column:
    """``labels`` of the values that have one, all other values as they are."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), col(c)), col(c))
