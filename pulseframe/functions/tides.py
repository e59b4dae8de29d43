"""Ocean tides and tidal stress as column expressions. Angles in degrees, heights in metres, stress in pascals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import centuries
from .circular import wrap
from .geo import coulomb

# Multiples of lunar time, of the mean longitudes of Moon and Sun and of the perigee, and a constant.
CONSTITUENTS = {
    "m2": ((2, 0, 0, 0), 0.0), "s2": ((2, 2, -2, 0), 0.0), "n2": ((2, -1, 0, 1), 0.0), "k2": ((2, 2, 0, 0), 0.0),
    "k1": ((1, 1, 0, 0), -90.0), "o1": ((1, -1, 0, 0), 90.0), "p1": ((1, 1, -2, 0), 90.0), "q1": ((1, -2, 0, 1), 90.0),
}
# Nodal factors f by cosines and corrections u by sines of 0, 1, 2, 3 times the node.
NODAL_F = {"m2": [1.0004, -0.0373, 0.0002], "o1": [1.0089, 0.1871, -0.0147, 0.0014], "k1": [1.0060, 0.1150, -0.0088, 0.0006], "k2": [1.0241, 0.2863, 0.0083, -0.0015], "s2": [1.0]}
NODAL_U = {"m2": [0, -2.14], "o1": [0, 10.80, -1.34, 0.19], "k1": [0, -8.86, 0.68, -0.07], "k2": [0, -17.74, 0.68, -0.04], "s2": [0]}
NODAL_OF = {"m2": "m2", "n2": "m2", "s2": "s2", "p1": "s2", "k2": "k2", "k1": "k1", "o1": "o1", "q1": "o1"}
# Sea water, gravity, the Earth's radius and elasticity, Love numbers, and the bodies' gravity.
WATER, GRAVITY, EARTH, SHEAR, POISSON, LOVE_H, LOVE_L = 1025.0, 9.80665, 6.371e6, 3.0e10, 0.25, 0.6078, 0.0847
GM = {"moon": 4.9028695e12, "sun": 1.32712440018e20}


def argument(name: str, jd: Column) -> Column:
    """The equilibrium argument of a constituent at a Julian day."""
    t = centuries(jd)
    s, h, p = 218.3164477 + 481267.88123421 * t, 280.46646 + 36000.76983 * t, 83.3532465 + 4069.0137287 * t
    tau = 360.0 * (jd + 0.5 - F.floor(jd + 0.5)) + h - s + 180.0
    (a, b, c, d), constant = CONSTITUENTS[name]
    return wrap(a * tau + b * s + c * h + d * p + constant)


def nodal(name: str, jd: Column) -> tuple[Column, Column]:
    """(f, u): what the Moon's node makes of a constituent's height, and of its argument."""
    node = F.radians(125.0445479 - 1934.1362891 * centuries(jd))
    f, u = NODAL_F[NODAL_OF[name]], NODAL_U[NODAL_OF[name]]
    total = lambda cs, fn: sum((c * fn(k * node) for k, c in enumerate(cs) if k and c), F.lit(float(cs[0])))
    return total(f, F.cos), total(u, F.sin)


def height(coefficients: dict[str, tuple[Column, Column]], jd: Column) -> Column:
    """The tide from (re, im) of each constituent at a place."""
    out = F.lit(0.0)
    for name, (re, im) in coefficients.items():
        f, u = nodal(name, jd)
        phase = F.radians(argument(name, jd) + u)
        out = out + f * (re * F.cos(phase) - im * F.sin(phase))
    return out


def load_stress(metres: Column) -> tuple[Column, Column, Column]:
    """(north, east, down) of a broad layer of water, tension positive."""
    p = WATER * GRAVITY * metres
    return -p * POISSON / (1 - POISSON), -p * POISSON / (1 - POISSON), -p


def potential(colat: Column, lon: Column, ra: Column, dec: Column, metres: Column, gmst: Column, gm: float) -> Column:
    """The tide-raising potential of degree two; colat and lon in radians."""
    hour = F.radians(gmst) + lon - F.radians(ra)
    c = F.cos(colat) * F.sin(F.radians(dec)) + F.sin(colat) * F.cos(F.radians(dec)) * F.cos(hour)
    return gm * EARTH**2 / (metres * metres * metres) * (3 * c * c - 1) / 2


def surface_stress(lat: Column, lon: Column, ra: Column, dec: Column, metres: Column, gmst: Column, gm: float) -> tuple[Column, Column, Column]:
    """(nn, ee, ne) at the free surface.

    The potential is a quadratic form of the direction to the body, so that its derivatives are written out: with c the
    cosine of the zenith angle and its derivatives ct, cp along colatitude and longitude, W = k (3 c c - 1) / 2.
    """
    t, p, d = F.radians(90.0 - lat), F.radians(lon), F.radians(dec)
    hour = F.radians(gmst) + p - F.radians(ra)
    k = gm * EARTH**2 / (metres * metres * metres)
    st, ct = F.sin(t), F.cos(t)
    c = ct * F.sin(d) + st * F.cos(d) * F.cos(hour)
    c_t = -st * F.sin(d) + ct * F.cos(d) * F.cos(hour)
    c_p, c_pp = -st * F.cos(d) * F.sin(hour), -st * F.cos(d) * F.cos(hour)
    c_tp = -ct * F.cos(d) * F.sin(hour)
    w = k * (3 * c * c - 1) / 2
    w_t, w_p = 3 * k * c * c_t, 3 * k * c * c_p
    w_tt, w_pp, w_tp = 3 * k * (c_t * c_t - c * c), 3 * k * (c_p * c_p + c * c_pp), 3 * k * (c_p * c_t + c * c_tp)
    e = 1 / (EARTH * GRAVITY)
    e_tt = e * (LOVE_L * w_tt + LOVE_H * w)
    e_pp = e * (LOVE_L * (w_pp / (st * st) + ct / st * w_t) + LOVE_H * w)
    e_tp = e * LOVE_L * (w_tp / st - w_p * ct / (st * st))
    m = 2 * SHEAR / (1 - POISSON)
    return m * (e_tt + POISSON * e_pp), m * (e_pp + POISSON * e_tt), -2 * SHEAR * e_tp


def fault_stress(lat: Column, lon: Column, strike: Column, dip: Column, rake: Column, bodies: dict[str, tuple[Column, Column, Column]], gmst: Column, metres: Column | None = None) -> Column:
    """Coulomb stress of the body tide, and of the water's load where its height is given, on a fault. bodies: (ra, dec, distance in metres)."""
    nn = ee = ne = dd = F.lit(0.0)
    for name, (ra, dec, far) in bodies.items():
        a, b, c = surface_stress(lat, lon, ra, dec, far, gmst, GM[name])
        nn, ee, ne = nn + a, ee + b, ne + c
    if metres is not None:
        n, e, d = load_stress(F.coalesce(metres, F.lit(0.0)))
        nn, ee, dd = nn + n, ee + e, dd + d
    return coulomb((nn, ee, dd, ne, F.lit(0.0), F.lit(0.0)), strike, dip, rake)
