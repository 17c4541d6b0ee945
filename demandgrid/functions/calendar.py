"""Calendar expressions over a DATE column."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from demandgrid.schema import BUSINESS, DATE, SEGMENT

# Fixed values of the data model.
WEEKEND_FROM = 5
MONTH_START_LAST_DAY = 7
MONTH_END_FIRST_DAY = 24
NEW_YEAR_LAST_DAY = 5
YEAR_END_FIRST_DAY = 30


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dow(d: Column | str) -> Column:
    """0 is Monday."""
    return F.weekday(_c(d))


def is_weekend(d: Column | str) -> Column:
    return (dow(d) >= WEEKEND_FROM).cast("int")


def day_of_week_f(d: Column | str) -> Column:
    """1 (Monday) to 5; NULL at the weekend."""
    return F.when(dow(d) < WEEKEND_FROM, dow(d) + 1)


def is_business_day_simple(d: Column | str) -> Column:
    """Complement of the weekend flag."""
    return F.lit(1) - is_weekend(d)


def is_business_day_f(df: DataFrame, holidays: DataFrame, date: str = DATE, out: str = "is_business_day_f") -> DataFrame:
    """0 at weekends, on listed holidays and around New Year, else 1.

    ``holidays`` has one DATE column ``holiday``. It is joined, not collected, so
    the planner broadcasts it only while it is below the size threshold.
    """
    listed = holidays.select(F.col("holiday").alias("_holiday")).distinct()
    month, day = F.month(date), F.dayofmonth(date)
    new_year = (month == 1) & (day <= NEW_YEAR_LAST_DAY)
    year_end = (month == 12) & (day >= YEAR_END_FIRST_DAY)
    closed = (dow(date) >= WEEKEND_FROM) | F.col("_holiday").isNotNull() | new_year | year_end
    return (
        df.join(listed, F.col(date) == F.col("_holiday"), "left")
        .withColumn(out, F.when(F.col(date).isNull(), None).when(closed, 0).otherwise(1))
        .drop("_holiday")
    )


def month_parts(d: Column | str) -> dict[str, Column]:
    d = _c(d)
    return {"month_f": F.month(d), "quarter_f": F.quarter(d), "year_f": F.year(d)}


def day_parts(d: Column | str) -> dict[str, Column]:
    """Day of month and ISO week."""
    d = _c(d)
    return {"day_of_month_f": F.dayofmonth(d), "week_of_year_f": F.weekofyear(d)}


def month_edges(d: Column | str) -> dict[str, Column]:
    d = _c(d)
    return {
        "is_month_start": (F.dayofmonth(d) <= MONTH_START_LAST_DAY).cast("int"),
        "is_month_end": (F.dayofmonth(d) >= MONTH_END_FIRST_DAY).cast("int"),
    }


def onehot_dow(d: Column | str) -> dict[str, Column]:
    return {f"day_of_week_{i}_f": (dow(d) == i).cast("int") for i in range(7)}


def container_f(segment: Column | str = SEGMENT) -> Column:
    """1 for business, 0 for every other segment."""
    return F.when(_c(segment) == BUSINESS, 1).otherwise(0)


def year_month(d: Column | str) -> Column:
    return F.date_format(_c(d), "yyyy-MM")


def test_bounds(train_end: Column | str, step: int | Column = 1) -> dict[str, Column]:
    """First and last day of the ``step`` months after ``train_end``."""
    end = _c(train_end)
    return {"test_start": F.date_add(end, 1), "test_end": F.add_months(end, step)}


def add_months(day: dt.date, months: int) -> dt.date:
    """Driver-side twin of ``F.add_months`` for plan parameters."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    first_next = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (first_next - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))


def to_day(day: str | dt.date) -> dt.date:
    return dt.date.fromisoformat(day) if isinstance(day, str) else day
