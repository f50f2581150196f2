"""Column functions on dates, campaigns and forecast labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted text formats of dates.
DATE_PATTERNS = (
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3}\. \d{4}$", "d MMM. yyyy"),
)

LOCAL_ZONE = "Europe/Madrid"

# Days before the first of each month in a 365-day year.
DAYS_BEFORE_MONTH = (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)


def parse_any_date(col: Column) -> Column:
    """Date from any accepted text format, null when none fits."""
    text = F.trim(col)
    tries = []
    for pattern, fmt in DATE_PATTERNS:
        body = F.regexp_extract(text, pattern, 0)
        value = F.replace(body, F.lit("."), F.lit("")) if "." in fmt else body
        clean = fmt.replace(".", "")
        tries.append(F.when(text.rlike(pattern), F.try_to_date(value, clean)))
    return F.coalesce(*tries)


def epoch_ms_local_date(col: Column, zone: str = LOCAL_ZONE) -> Column:
    """Calendar day in the local zone of an epoch-millisecond value, whatever the session zone."""
    seconds = (col.cast("long") / 1000).cast("decimal(18,6)")
    zero = F.lit(0)
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def campaign_year(col: Column) -> Column:
    """Year in which the campaign of a date ends: 1 September to 31 August."""
    return F.year(F.add_months(col, 4))


def campaign_name(year: Column) -> Column:
    return F.concat((year - 1).cast("string"), F.lit("/"), year.cast("string"))


def campaign_start(year: Column) -> Column:
    return F.make_date(year - 1, F.lit(9), F.lit(1))


def campaign_end(year: Column) -> Column:
    return F.make_date(year, F.lit(8), F.lit(31))


def campaign_day(col: Column, shared_new_year: bool = False) -> Column:
    """Day index from 1 September in a 365-day year.

    ``shared_new_year`` keeps the variant in which 31 December and 1 January share index 121.
    """
    before = F.element_at(F.array(*[F.lit(v) for v in DAYS_BEFORE_MONTH]), F.month(col))
    autumn = before - F.lit(243) + F.dayofmonth(col) - 1
    spring = before + F.dayofmonth(col) - 1 + F.lit(121 if shared_new_year else 122)
    return F.when(F.month(col) >= 9, autumn).otherwise(spring)


def campaign_day_to_date(day: Column, year: Column) -> Column:
    return F.when(day <= 121, F.date_add(campaign_start(year), day)).otherwise(
        F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day - 122)
    )


def forecast_label(run_date: Column, offset: Column) -> Column:
    """``dd/MM`` of the forecast day; offset 0 is the day after the run."""
    return F.date_format(F.date_add(run_date, offset + 1), "dd/MM")
