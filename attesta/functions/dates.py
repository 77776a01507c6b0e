"""Identity numbers and Jalali dates as Column builders (FN10-FN13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years that a document may bear.
FIRST_YEAR, LAST_YEAR = 1250, 1500


def valid_national_id(c: Column) -> Column:
    """Ten ASCII digits, not all one, whose last is the check digit of the others. Null gives false."""
    total = sum(F.substring(c, k + 1, 1).cast("int") * (10 - k) for k in range(9))
    rest, check = total % 11, F.substring(c, 10, 1).cast("int")
    ok = F.when(rest < 2, check == rest).otherwise(check == 11 - rest)
    return F.coalesce(F.when(c.rlike("^[0-9]{10}$") & ~c.rlike(r"^([0-9])\1{9}$"), ok), F.lit(False))


def jalali_days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a Jalali date."""
    z = y + 1595
    leaps = F.floor(z / 33) * 8 + F.floor((z % 33 + 3) / 4)
    months = F.when(m < 7, (m - 1) * 31).otherwise((m - 7) * 30 + 186)
    return (365 * z + leaps + months + d - 355668 - 719528).cast("int")


def jalali_to_date(y: Column, m: Column, d: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), jalali_days(y, m, d))


def jalali_leap(y: Column) -> Column:
    one = F.lit(1)
    return jalali_days(y + 1, one, one) - jalali_days(y, one, one) == 366


def days_in_month(y: Column, m: Column) -> Column:
    return F.when(m.between(1, 6), 31).when(m.between(7, 11), 30).when(m == 12, F.when(jalali_leap(y), 30).otherwise(29)).otherwise(0)


def parse_jalali(c: Column) -> Column:
    """YYYY/MM/DD -> struct y, m, d; null where there is no such day."""
    part = F.split(c, "/")
    y, m, d = (F.when(F.get(part, F.lit(k)).rlike("^[0-9]{1,4}$"), F.get(part, F.lit(k)).cast("int")) for k in range(3))
    ok = (F.size(part) == 3) & y.between(FIRST_YEAR, LAST_YEAR) & m.between(1, 12) & d.between(1, days_in_month(y, m))
    return F.when(ok, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def to_date(c: Column) -> Column:
    p = parse_jalali(c)
    return jalali_to_date(p["y"], p["m"], p["d"])


def age_on(c: Column, today: Column) -> Column:
    """Completed years."""
    born = to_date(c)
    before = (F.month(today) < F.month(born)) | ((F.month(today) == F.month(born)) & (F.day(today) < F.day(born)))
    return F.year(today) - F.year(born) - before.cast("int")


def is_expired(c: Column, today: Column) -> Column:
    return to_date(c) < today
