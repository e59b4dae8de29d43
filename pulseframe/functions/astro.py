"""Low-precision positions of Sun, Moon and planets from published series, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import centuries
from .circular import separation, wrap

# Leading terms of the Moon's longitude (degrees) with multiples of D, M, M', F.
MOON_LONGITUDE = [
    (6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0), (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0),
    (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0), (-0.030383, 0, 1, 1, 0), (0.015327, 2, 0, 0, -2), (-0.012528, 0, 0, 1, 2), (0.010980, 0, 0, 1, -2),
]
# Leading terms of the Moon's latitude (degrees).
MOON_LATITUDE = [
    (5.128122, 0, 0, 0, 1), (0.280602, 0, 0, 1, 1), (0.277693, 0, 0, 1, -1), (0.173237, 2, 0, 0, -1),
    (0.055413, 2, 0, -1, 1), (0.046271, 2, 0, -1, -1), (0.032573, 2, 0, 0, 1), (0.017198, 0, 0, 2, 1),
]
# Leading terms of the Moon's distance (km).
MOON_DISTANCE = [
    (-20905.355, 0, 0, 1, 0), (-3699.111, 2, 0, -1, 0), (-2955.968, 2, 0, 0, 0), (-569.925, 0, 0, 2, 0), (48.888, 0, 1, 0, 0),
    (-3.149, 0, 0, 0, 2), (246.158, 2, 0, -2, 0), (-152.138, 2, -1, -1, 0), (-170.733, 2, 0, 1, 0), (-204.586, 2, -1, 0, 0),
]
# Mean elements at J2000 (a, e, longitude, perihelion) and change of longitude in a century.
PLANETS = {
    "mercury": (0.38709927, 0.20563593, 252.25032350, 77.45779628, 149472.67411175),
    "venus": (0.72333566, 0.00677672, 181.97909950, 131.60246718, 58517.81538729),
    "earth": (1.00000261, 0.01671123, 100.46457166, 102.93768193, 35999.37244981),
    "mars": (1.52371034, 0.09339410, -4.55343205, -23.94362959, 19140.30268499),
    "jupiter": (5.20288700, 0.04838624, 34.39644051, 14.72847983, 3034.74612775),
    "saturn": (9.53667594, 0.05386179, 49.95424423, 92.59887831, 1222.49362201),
}


def sun_longitude(jd: Column) -> Column:
    t = centuries(jd)
    m = F.radians(357.52911 + 35999.05029 * t)
    return wrap(280.46646 + 36000.76983 * t + 1.914602 * F.sin(m) + 0.019993 * F.sin(2 * m) + 0.000289 * F.sin(3 * m))


def sun_distance(jd: Column) -> Column:
    """Astronomical units."""
    t = centuries(jd)
    m = F.radians(357.52911 + 35999.05029 * t)
    e = 0.016708634 - 0.000042037 * t
    v = m + F.radians(1.914602 * F.sin(m) + 0.019993 * F.sin(2 * m) + 0.000289 * F.sin(3 * m))
    return 1.000001018 * (1 - e * e) / (1 + e * F.cos(v))


def _moon_arguments(t: Column) -> tuple[Column, ...]:
    return (297.8501921 + 445267.1114034 * t, 357.5291092 + 35999.0502909 * t, 134.9633964 + 477198.8675055 * t, 93.2720950 + 483202.0175233 * t)


def _series(terms: list, t: Column, fn) -> Column:
    args = _moon_arguments(t)
    out = F.lit(0.0)
    for c, *ks in terms:
        angle = F.lit(0.0)
        for k, a in zip(ks, args, strict=True):
            if k:
                angle = angle + k * a
        out = out + c * fn(F.radians(angle))
    return out


def moon_longitude(jd: Column) -> Column:
    t = centuries(jd)
    return wrap(218.3164477 + 481267.88123421 * t + _series(MOON_LONGITUDE, t, F.sin))


def moon_latitude(jd: Column) -> Column:
    return _series(MOON_LATITUDE, centuries(jd), F.sin)


def moon_distance(jd: Column) -> Column:
    return 385000.56 + _series(MOON_DISTANCE, centuries(jd), F.cos)


def lunar_phase(jd: Column) -> Column:
    """Elongation in longitude: 0 new, 180 full."""
    return wrap(moon_longitude(jd) - sun_longitude(jd))


def obliquity(jd: Column) -> Column:
    return 23.439291 - 0.0130042 * centuries(jd)


def equatorial(lon: Column, lat: Column, eps: Column) -> tuple[Column, Column]:
    """(right ascension, declination) in degrees."""
    l, b, e = F.radians(lon), F.radians(lat), F.radians(eps)
    ra = F.atan2(F.sin(l) * F.cos(e) - F.tan(b) * F.sin(e), F.cos(l))
    dec = F.asin(F.sin(b) * F.cos(e) + F.cos(b) * F.sin(e) * F.sin(l))
    return wrap(F.degrees(ra)), F.degrees(dec)


def gmst(jd: Column) -> Column:
    """Greenwich mean sidereal time in degrees."""
    t = centuries(jd)
    return wrap(280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t)


def kepler(mean: Column, e: float, rounds: int = 12) -> Column:
    """Eccentric anomaly in radians by Newton's method, as a fold."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), mean, lambda acc, _: acc - (acc - e * F.sin(acc) - mean) / (1 - e * F.cos(acc)))


def heliocentric(planet: str, jd: Column) -> tuple[Column, Column]:
    """(longitude in degrees, distance in AU) in the plane of the orbit."""
    a, e, lon, peri, rate = PLANETS[planet]
    mean = F.radians(F.pmod(lon + rate * centuries(jd) - peri, F.lit(360.0)))
    big = kepler(mean, e)
    x, y = a * (F.cos(big) - e), a * (1 - e * e) ** 0.5 * F.sin(big)
    return wrap(F.degrees(F.atan2(y, x)) + peri), F.sqrt(x * x + y * y)


def aspect_distance(a: Column, b: Column, aspect: float) -> Column:
    return F.abs(separation(a, b) - aspect)


def signed_phase(ra_moon: Column, dec_moon: Column, ra_sun: Column, dec_sun: Column) -> Column:
    """The arc between Moon and Sun from their equatorial places, 0 to 360: a waxing Moon counts as 360 less the arc."""
    a, b = F.radians(dec_moon), F.radians(dec_sun)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(ra_moon - ra_sun))
    arc = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    return F.when(F.pmod(ra_moon - ra_sun, F.lit(360.0)) >= 180, arc).otherwise(360 - arc)


def phase_time(target: float, guess: Column, rounds: int = 12) -> Column:
    """The Julian day near the guess at which the lunar phase is the target, by Newton's method with steps of two days at most, as a fold."""
    miss = lambda jd: F.pmod(lunar_phase(jd) - target + 180.0, F.lit(360.0)) - 180.0

    def better(jd: Column, _: Column) -> Column:
        slope = (miss(jd + 0.01) - miss(jd - 0.01)) / 0.02
        return jd - F.greatest(F.lit(-2.0), F.least(F.lit(2.0), miss(jd) / slope))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), guess, better)
