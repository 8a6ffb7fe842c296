"""Numbers and periods as Column -> Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_value(c: Column) -> Column:
    """Blank text is 0, junk is null."""
    return F.when(F.trim(c) == "", 0.0).otherwise(F.trim(c).try_cast("double"))


def line_number_value(c: Column) -> Column:
    x = F.trim(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))


def confidence(best: Column, second: Column) -> Column:
    return F.when(best == 0, 0.0).otherwise(F.least(F.lit(1.0), best / F.nullif(best + second, F.lit(0))))


def money(c: Column) -> Column:
    """Exact sums: decimals inside, a double outside."""
    return F.sum(c.cast("decimal(18,2)"))


def serial_to_date(serial: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (F.floor(serial) - 25569).cast("int"))


def period_columns(day: Column) -> list[Column]:
    return [day.alias("report_date"), F.year(day).alias("report_year"), F.month(day).alias("report_month"), F.date_format(day, "yyyy-MM").alias("period")]


def period_from_year_month(label: Column) -> Column:
    return F.to_date(F.concat(label, F.lit("-01")), "yyyy-MM-dd")
