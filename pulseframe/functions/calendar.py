"""Days, Julian days and time scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days from 0001-01-01 to 1970-01-01 when that day counts as 1, and the Julian day of 1970-01-01.
EPOCH_ORDINAL, EPOCH_JD, J2000 = 719163, 2440587.5, 2451545.0


def epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date"))


def ordinal(ts: Column) -> Column:
    return epoch_day(ts) + EPOCH_ORDINAL


def julian_day(day: Column) -> Column:
    """Of midnight of an epoch day."""
    return day.cast("double") + EPOCH_JD


def centuries(jd: Column) -> Column:
    return (jd - J2000) / 36525.0


def doy_angle(date: Column) -> Column:
    """Day of the year as an angle in degrees over the year's own length."""
    year = F.year(date)
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return (F.dayofyear(date) - 1) * 360.0 / F.when(leap, 366.0).otherwise(365.0)


# Dynamical less universal time by polynomials. Before which year an era ends, the year that counts as 0, the
# years in a unit, and the coefficients from the constant on.
ERAS = [
    (-500, 1820, 100, [-20, 0, 32]),
    (500, 0, 100, [10583.6, -1014.41, 33.78311, -5.952053, -0.1798452, 0.022174192, 0.0090316521]),
    (1600, 1000, 100, [1574.2, -556.01, 71.23472, 0.319781, -0.8503463, -0.005050998, 0.0083572073]),
    (1700, 1600, 1, [120, -0.9808, -0.01532, 1 / 7129]),
    (1800, 1700, 1, [8.83, 0.1603, -0.0059285, 0.00013336, -1 / 1174000]),
    (1860, 1800, 1, [13.72, -0.332447, 0.0068612, 0.0041116, -0.00037436, 0.0000121272, -0.0000001699, 0.000000000875]),
    (1900, 1860, 1, [7.62, 0.5737, -0.251754, 0.01680668, -0.0004473624, 1 / 233174]),
    (1920, 1900, 1, [-2.79, 1.494119, -0.0598939, 0.0061966, -0.000197]),
    (1941, 1920, 1, [21.20, 0.84493, -0.076100, 0.0020936]),
    (1961, 1950, 1, [29.07, 0.407, -1 / 233, 1 / 2547]),
    (1986, 1975, 1, [45.45, 1.067, -1 / 260, -1 / 718]),
    (2005, 2000, 1, [63.86, 0.3345, -0.060374, 0.0017275, 0.000651814, 0.00002373599]),
    (2050, 2000, 1, [62.92, 0.32217, 0.005589]),
    (None, 1820, 100, [-20, 0, 32]),
]


def delta_t(year: Column) -> Column:
    """Dynamical less universal time in seconds at a year with its fraction, for all years."""

    def horner(zero: float, unit: float, coefficients: list[float]) -> Column:
        t, out = (year - float(zero)) / float(unit), F.lit(0.0)
        for c in reversed(coefficients):
            out = out * t + float(c)
        return out

    *first, last = [(end, horner(zero, unit, c)) for end, zero, unit, c in ERAS]
    return F.coalesce(*[F.when(year < float(end), value) for end, value in first], last[1])


def day_from_date(y: Column, m: Column, d: Column, julian: bool = False) -> Column:
    """The Julian day of a date, d with its fraction, in the Gregorian calendar run backwards, or in the Julian one."""
    early = m <= 2
    y, m = F.when(early, y - 1).otherwise(y), F.when(early, m + 12).otherwise(m)
    century = F.floor(y / 100)
    shift = F.lit(0) if julian else 2 - century + F.floor(century / 4)
    return F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + d + shift - 1524.5


def date_from_day(jd: Column) -> Column:
    """struct<year, month, day double> of a Julian day in the Gregorian calendar run backwards."""
    z = F.floor(jd + 0.5)
    alpha = F.floor((z - 1867216.25) / 36524.25)
    b = z + 1 + alpha - F.floor(alpha / 4) + 1524
    c = F.floor((b - 122.1) / 365.25)
    d = F.floor(365.25 * c)
    e = F.floor((b - d) / 30.6001)
    month = F.when(e < 14, e - 1).otherwise(e - 13)
    return F.struct(F.when(month > 2, c - 4716).otherwise(c - 4715).cast("int").alias("year"), month.cast("int").alias("month"), (b - d - F.floor(30.6001 * e) + (jd + 0.5 - z)).alias("day"))


def micros(ts: str) -> Column:
    """Microseconds from 1970 on the clock that the column shows, with or without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def slot(ts: str, hours: int) -> Column:
    return F.floor(micros(ts) / F.lit(hours * 3_600_000_000))
