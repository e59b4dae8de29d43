"""Distances, magnitude windows, faults and tides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Kilometres east and north of a reference point."""
    return (lon - lon0) * 111.19 * F.cos(F.radians(F.lit(lat0))), (lat - lat0) * 111.19


def gk_km(mag: Column) -> Column:
    return F.pow(F.lit(10.0), 0.1238 * mag + 0.983)


def gk_days(mag: Column) -> Column:
    return F.when(mag >= 6.5, F.pow(F.lit(10.0), 0.032 * mag + 2.7389)).otherwise(F.pow(F.lit(10.0), 0.5409 * mag - 0.547))


def mechanism(rake: Column) -> Column:
    r = F.pmod(rake + 180.0, F.lit(360.0)) - 180.0
    return F.when((r >= 45) & (r <= 135), "thrust").when((r >= -135) & (r <= -45), "normal").otherwise("strike-slip")


def fault_vectors(strike: Column, dip: Column, rake: Column) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """(normal, slip) as north, east, down components."""
    s, d, r = F.radians(strike), F.radians(dip), F.radians(rake)
    normal = (-F.sin(d) * F.sin(s), F.sin(d) * F.cos(s), -F.cos(d))
    slip = (F.cos(r) * F.cos(s) + F.cos(d) * F.sin(r) * F.sin(s), F.cos(r) * F.sin(s) - F.cos(d) * F.sin(r) * F.cos(s), -F.sin(r) * F.sin(d))
    return normal, slip


def coulomb(stress: tuple[Column, ...], strike: Column, dip: Column, rake: Column, friction: float = 0.4) -> Column:
    """Shear plus friction times normal stress for a symmetric tensor (nn, ee, dd, ne, nd, ed)."""
    n, u = fault_vectors(strike, dip, rake)
    nn, ee, dd, ne, nd, ed = stress
    t = (nn * n[0] + ne * n[1] + nd * n[2], ne * n[0] + ee * n[1] + ed * n[2], nd * n[0] + ed * n[1] + dd * n[2])
    shear = t[0] * u[0] + t[1] * u[1] + t[2] * u[2]
    normal = t[0] * n[0] + t[1] * n[1] + t[2] * n[2]
    return shear + friction * normal


# Speeds of tidal constituents in degrees an hour.
TIDE_SPEEDS = {"m2": 28.9841042, "s2": 30.0, "n2": 28.4397295, "k2": 30.0821373, "k1": 15.0410686, "o1": 13.9430356, "p1": 14.9589314, "q1": 13.3986609}


def tide_argument(name: str, hours: Column) -> Column:
    return F.pmod(TIDE_SPEEDS[name] * hours, F.lit(360.0))


# Speeds of the first and of the damaging waves in km/s, seconds to detect and to process, and gravity.
FIRST_WAVE, STRONG_WAVE, DETECT, PROCESS, G = 6.5, 3.7, 3.0, 2.0, 9.81


def warning_seconds(km: Column, station_km: Column | float) -> Column:
    """From the alert to the strong waves at a place, if the nearest station is so far from the source."""
    return km / STRONG_WAVE - (station_km / FIRST_WAVE + (DETECT + PROCESS))


def blind_radius(station_km: Column) -> Column:
    """Within which the strong waves come before the alert."""
    return STRONG_WAVE * (station_km / FIRST_WAVE + (DETECT + PROCESS))


def tsunami_minutes(km: Column, depth_m: Column | float) -> Column:
    depth = depth_m if isinstance(depth_m, Column) else F.lit(float(depth_m))
    return km / (F.sqrt(G * depth) * 3.6) * 60


def magnitude_from_moment(m0: Column) -> Column:
    """Dyne-centimetres."""
    return (F.log10(m0) - 16.1) * 2.0 / 3.0


def space_kernel(km: Column, dm: Column, d: float, gamma: float, q: float) -> Column:
    """A density over the plane that falls with the distance, wider for larger events; its integral is 1."""
    w = d * d * F.pow(F.lit(10.0), gamma * dm)
    return (q - 1) / (F.pi() * w) * F.pow(1 + km * km / w, F.lit(-q))


def omori_integral(age0: Column, age1: Column, dm: Column, k: float, alpha: float, c: float, p: float) -> Column:
    """Events that an ancestor triggers between two ages."""
    part = lambda age: F.pow(age + c, F.lit(1 - p))
    return k * F.exp(alpha * dm) * (part(age1) - part(F.greatest(age0, F.lit(0.0)))) / (1 - p)


def block_id(lat: Column, lon: Column, size: float = 10.0) -> Column:
    return (F.floor((lat + 90) / size) * F.lit(int(360 / size)) + F.floor((lon + 180) / size)).cast("int")
