import datetime as dt

from demandgrid.functions import calendar as cal
from demandgrid.operators import keys as ks


def one(spark, day, cols):
    frame = spark.createDataFrame([(day,)], "file_date string")
    return frame.withColumn("file_date", frame.file_date.cast("date")).select(
        *[c.alias(n) for n, c in cols.items()]
    ).first().asDict()


def test_weekdays(spark):
    monday = one(spark, "2025-01-06", {"d": cal.dow("file_date"), "f": cal.day_of_week_f("file_date")})
    sunday = one(
        spark,
        "2025-01-05",
        {
            "d": cal.dow("file_date"),
            "f": cal.day_of_week_f("file_date"),
            "w": cal.is_weekend("file_date"),
            "b": cal.is_business_day_simple("file_date"),
        },
    )
    assert monday == {"d": 0, "f": 1}
    assert sunday == {"d": 6, "f": None, "w": 1, "b": 0}


def test_business_days(spark):
    days = ["2025-01-05", "2025-01-06", "2024-12-30", "2024-12-27", "2024-05-03", None]
    table = spark.createDataFrame([(d,) for d in days], "day string")
    table = table.withColumn("file_date", table.day.cast("date"))
    holidays = spark.createDataFrame([(dt.date(2024, 5, 3),), (dt.date(2024, 5, 3),)], "holiday date")
    got = {r.day: r.is_business_day_f for r in cal.is_business_day_f(table, holidays).collect()}
    assert got == {
        "2025-01-05": 0,
        "2025-01-06": 1,
        "2024-12-30": 0,
        "2024-12-27": 1,
        "2024-05-03": 0,
        None: None,
    }


def test_parts_and_edges(spark):
    got = one(
        spark,
        "2024-12-30",
        {**cal.month_parts("file_date"), **cal.day_parts("file_date"), **cal.month_edges("file_date")},
    )
    assert got == {
        "month_f": 12,
        "quarter_f": 4,
        "year_f": 2024,
        "day_of_month_f": 30,
        "week_of_year_f": 1,
        "is_month_start": 0,
        "is_month_end": 1,
    }
    hot = one(spark, "2024-12-30", cal.onehot_dow("file_date"))
    assert sum(hot.values()) == 1 and hot["day_of_week_0_f"] == 1


def test_month_arithmetic_agrees_with_the_column_form(spark):
    for day in ("2024-01-31", "2024-12-31", "2023-01-30", "2025-02-28"):
        for step in (1, 2, 6, 13):
            got = one(spark, day, cal.test_bounds("file_date", step))
            assert (got["test_start"], got["test_end"]) == ks.test_period(day, step)
