"""Astronomy, tides and faults as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from pulseframe.functions import astro, calendar, geo
from pulseframe.functions.circular import cardinal_offset, harmonic, separation
from pulseframe.sources.testbed import catalog, daily

from .base import CAT, DAILY, query

DAYS = DAILY + ", d AS (SELECT dd, dd + 2440587.5::DOUBLE AS jd, (dd + 2440587.5::DOUBLE - 2451545.0::DOUBLE) / 36525.0::DOUBLE AS t FROM daily)"


def days(spark, sf):
    return daily(spark, sf).select("dd", calendar.julian_day(F.col("dd")).alias("jd"))


def n(x: float) -> str:
    return f"({x!r})::DOUBLE"


def wrap(x: str) -> str:
    return f"((({x}) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE)"


SUN_M = f"radians({n(357.52911)} + {n(35999.05029)} * t)"
SUN_LON = wrap(f"{n(280.46646)} + {n(36000.76983)} * t + {n(1.914602)} * sin({SUN_M}) + {n(0.019993)} * sin(2 * {SUN_M}) + {n(0.000289)} * sin(3 * {SUN_M})")
SUN_V = f"({SUN_M} + radians({n(1.914602)} * sin({SUN_M}) + {n(0.019993)} * sin(2 * {SUN_M}) + {n(0.000289)} * sin(3 * {SUN_M})))"
SUN_E = f"({n(0.016708634)} - {n(0.000042037)} * t)"
SUN_R = f"({n(1.000001018)} * (1 - {SUN_E} * {SUN_E}) / (1 + {SUN_E} * cos({SUN_V})))"
ARGS = [f"({n(297.8501921)} + {n(445267.1114034)} * t)", f"({n(357.5291092)} + {n(35999.0502909)} * t)", f"({n(134.9633964)} + {n(477198.8675055)} * t)", f"({n(93.2720950)} + {n(483202.0175233)} * t)"]


def series(terms, fn: str) -> str:
    return " + ".join(f"{n(c)} * {fn}(radians({' + '.join(f'{k} * {a}' for k, a in zip(ks, ARGS, strict=True) if k)}))" for c, *ks in terms)


MOON_LON = wrap(f"{n(218.3164477)} + {n(481267.88123421)} * t + {series(astro.MOON_LONGITUDE, 'sin')}")
MOON_LAT = f"({series(astro.MOON_LATITUDE, 'sin')})"
MOON_R = f"({n(385000.56)} + {series(astro.MOON_DISTANCE, 'cos')})"


@query(f"WITH {DAYS} SELECT dd, (dd + 719163)::INTEGER AS ordinal, jd FROM d")
def julian_day(spark, sf):
    return days(spark, sf).select("dd", (F.col("dd") + calendar.EPOCH_ORDINAL).alias("ordinal"), "jd")


@query(f"WITH {DAYS}, y AS (SELECT DISTINCT year(DATE '1970-01-01' + dd)::INTEGER AS year FROM d), u AS (SELECT year, year - 2000.0::DOUBLE AS u FROM y) SELECT year, round(CASE WHEN year < 2005 THEN 63.86 + 0.3345 * u - 0.060374 * u*u + 0.0017275 * u*u*u + 0.000651814 * u*u*u*u + 0.00002373599 * u*u*u*u*u ELSE 62.92 + 0.32217 * u + 0.005589 * u*u END, 6) AS delta_t FROM u")
def delta_t(spark, sf):
    y = days(spark, sf).select(F.year(F.date_from_unix_date("dd")).alias("year")).distinct()
    return y.select("year", F.round(calendar.delta_t(F.col("year").cast("double")), 6).alias("delta_t"))


@query(f"WITH {DAYS} SELECT dd, round({wrap('280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t')}, 6) AS gmst FROM d")
def gmst(spark, sf):
    return days(spark, sf).select("dd", F.round(astro.gmst(F.col("jd")), 6).alias("gmst"))


@query(f"WITH {DAYS} SELECT dd, round({SUN_LON}, 6) AS lon, round({SUN_R}, 9) AS au FROM d")
def sun_distance(spark, sf):
    return days(spark, sf).select("dd", F.round(astro.sun_longitude(F.col("jd")), 6).alias("lon"), F.round(astro.sun_distance(F.col("jd")), 9).alias("au"))


@query(f"WITH {DAYS} SELECT dd, round({MOON_LON}, 6) AS lon, round({MOON_LAT}, 6) AS lat, round({MOON_R}, 3) AS km FROM d")
def moon_ecliptic(spark, sf):
    jd = F.col("jd")
    return days(spark, sf).select("dd", F.round(astro.moon_longitude(jd), 6).alias("lon"), F.round(astro.moon_latitude(jd), 6).alias("lat"), F.round(astro.moon_distance(jd), 3).alias("km"))


@query(f"WITH {DAYS}, p AS (SELECT dd, {wrap(f'{MOON_LON} - {SUN_LON}')} AS phase FROM d) SELECT dd, round(phase, 6) AS phase, round(sin(radians(phase * 2)), 6) AS s2, round(cos(radians(phase * 2)), 6) AS c2, round(least(phase % 90, 90 - phase % 90), 6) AS off FROM p")
def lunar_phase_dates(spark, sf):
    p = days(spark, sf).withColumn("phase", astro.lunar_phase(F.col("jd")))
    s, c = harmonic(F.col("phase"), 2)
    return p.select("dd", F.round("phase", 6).alias("phase"), F.round(s, 6).alias("s2"), F.round(c, 6).alias("c2"), F.round(cardinal_offset(F.col("phase")), 6).alias("off"))


@query(f"""WITH {DAYS}, m AS (SELECT dd, radians({MOON_LON}) AS l, radians({MOON_LAT}) AS b, radians(23.439291 - 0.0130042 * t) AS e FROM d)
  SELECT dd, round({wrap('degrees(atan2(sin(l) * cos(e) - tan(b) * sin(e), cos(l)))')}, 6) AS ra, round(degrees(asin(sin(b) * cos(e) + cos(b) * sin(e) * sin(l))), 6) AS dec FROM m""")
def moon_equatorial(spark, sf):
    jd = F.col("jd")
    ra, dec = astro.equatorial(astro.moon_longitude(jd), astro.moon_latitude(jd), astro.obliquity(jd))
    return days(spark, sf).select("dd", F.round(ra, 6).alias("ra"), F.round(dec, 6).alias("dec"))


def planet_sql() -> str:
    parts = []
    for name, (a, e, lon, peri, rate) in astro.PLANETS.items():
        m = f"radians({wrap(f'{n(lon)} + {n(rate)} * t - {n(peri)}')})"
        parts.append(f"SELECT dd, '{name}' AS planet, list_reduce(list_prepend({m}, list_transform(range(12), lambda i: {m})), lambda acc, mm: acc - (acc - {n(e)} * sin(acc) - mm) / (1 - {n(e)} * cos(acc))) AS big, {n(a)} AS a, {n(e)} AS e, {n(peri)} AS peri FROM d")
    xy = "SELECT dd, planet, a * (cos(big) - e) AS x, a * sqrt(1 - e * e) * sin(big) AS y, peri FROM k"
    return f"k AS ({' UNION ALL '.join(parts)}), xy AS ({xy}), pl AS (SELECT dd, planet, {wrap('degrees(atan2(y, x)) + peri')} AS lon, sqrt(x * x + y * y) AS r FROM xy)"


def planets(spark, sf):
    d = days(spark, sf)
    rows = F.array(*[F.struct(F.lit(p).alias("planet"), lon.alias("lon"), r.alias("r")) for p in astro.PLANETS for lon, r in [astro.heliocentric(p, F.col("jd"))]])
    return d.select("dd", F.inline(rows))


@query(f"WITH {DAYS}, {planet_sql()} SELECT dd, planet, round(lon, 6) AS lon, round(r, 6) AS r FROM pl")
def kepler_positions(spark, sf):
    return planets(spark, sf).select("dd", "planet", F.round("lon", 6).alias("lon"), F.round("r", 6).alias("r"))


PAIRS = f"WITH {DAYS}, {planet_sql()}, pairs AS (SELECT a.dd, a.planet AS p, b.planet AS q, least({wrap('a.lon - b.lon')}, 360 - {wrap('a.lon - b.lon')}) AS arc FROM pl a JOIN pl b ON a.dd = b.dd AND a.planet < b.planet)"


def pairs(spark, sf):
    p = planets(spark, sf)
    a, b = p.select("dd", F.col("planet").alias("p"), F.col("lon").alias("l1")), p.select("dd", F.col("planet").alias("q"), F.col("lon").alias("l2"))
    return a.join(b, "dd").where("p < q").select("dd", "p", "q", separation(F.col("l1"), F.col("l2")).alias("arc"))


@query(PAIRS + " SELECT dd, p, q, round(arc, 6) AS arc FROM pairs")
def aspect_pairs(spark, sf):
    return pairs(spark, sf).select("dd", "p", "q", F.round("arc", 6).alias("arc"))


@query(PAIRS + " SELECT dd, sum((abs(arc - 0) <= 5 OR abs(arc - 90) <= 5 OR abs(arc - 180) <= 5)::INT)::BIGINT AS n, bool_or(arc <= 5) AS conjunction FROM pairs GROUP BY dd")
def aspect_count(spark, sf):
    active = reduce(lambda x, y: x | y, [F.abs(F.col("arc") - k) <= 5 for k in (0, 90, 180)])
    return pairs(spark, sf).groupBy("dd").agg(F.count_if(active).alias("n"), F.bool_or(F.col("arc") <= 5).alias("conjunction"))


@query(f"WITH {DAYS}, {planet_sql()} SELECT dd, round(sqrt(pow(sum(sin(radians(lon))), 2) + pow(sum(cos(radians(lon))), 2)) / count(*), 6) AS r FROM pl GROUP BY dd")
def alignment(spark, sf):
    s = lambda fn: F.pow(F.sum(fn(F.radians("lon"))), 2)
    return planets(spark, sf).groupBy("dd").agg(F.round(F.sqrt(s(F.sin) + s(F.cos)) / F.count("*"), 6).alias("r"))


FAULT = CAT + ", f AS (SELECT id, hour, (id * 37 % 360)::DOUBLE AS strike, (10 + id * 17 % 80)::DOUBLE AS dip, (id * 53 % 360 - 180)::DOUBLE AS rake FROM cat), r AS (SELECT *, radians(strike) AS s, radians(dip) AS d, radians(rake) AS k FROM f)"
FN = ["(-sin(d)*sin(s))", "(sin(d)*cos(s))", "(-cos(d))"]
FU = ["(cos(k)*cos(s)+cos(d)*sin(k)*sin(s))", "(cos(k)*sin(s)-cos(d)*sin(k)*cos(s))", "(-sin(k)*sin(d))"]


def faults(spark, sf):
    i = F.col("id")
    return catalog(spark, sf).select("id", "hour", (i * 37 % 360).cast("double").alias("strike"), (10 + i * 17 % 80).cast("double").alias("dip"), (i * 53 % 360 - 180).cast("double").alias("rake"))


@query(f"WITH {FAULT} SELECT id, round({FN[0]}, 6) AS nn, round({FN[1]}, 6) AS ne, round({FN[2]}, 6) AS nd, round({FU[0]}, 6) AS un, round({FU[1]}, 6) AS ue, round({FU[2]}, 6) AS ud FROM r")
def fault_vectors(spark, sf):
    a, b = geo.fault_vectors(F.col("strike"), F.col("dip"), F.col("rake"))
    return faults(spark, sf).select("id", *[F.round(c, 6).alias(k) for k, c in zip(("nn", "ne", "nd", "un", "ue", "ud"), (*a, *b), strict=True)])


@query(f"WITH {FAULT} SELECT id, CASE WHEN rake BETWEEN 45 AND 135 THEN 'thrust' WHEN rake BETWEEN -135 AND -45 THEN 'normal' ELSE 'strike-slip' END AS mechanism FROM f")
def mechanism_class(spark, sf):
    return faults(spark, sf).select("id", geo.mechanism(F.col("rake")).alias("mechanism"))


TN = f"(100*{FN[0]} + 10*{FN[1]} + 5*{FN[2]})"
TE = f"(10*{FN[0]} - 50*{FN[1]} + 2*{FN[2]})"
TD = f"(5*{FN[0]} + 2*{FN[1]} - 20*{FN[2]})"


@query(f"WITH {FAULT} SELECT id, round({TN}*{FU[0]} + {TE}*{FU[1]} + {TD}*{FU[2]} + 0.4*({TN}*{FN[0]} + {TE}*{FN[1]} + {TD}*{FN[2]}), 6) AS cfs FROM r")
def coulomb_stress(spark, sf):
    tensor = tuple(F.lit(float(x)) for x in (100, -50, -20, 10, 5, 2))
    return faults(spark, sf).select("id", F.round(geo.coulomb(tensor, F.col("strike"), F.col("dip"), F.col("rake")), 6).alias("cfs"))


@query(f"WITH {CAT}, h AS (SELECT DISTINCT hour FROM cat) SELECT hour, name, round(({' '.join('CASE name ' + ' '.join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in geo.TIDE_SPEEDS.items()) + ' END' for _ in [0])} * hour) % 360, 7) AS arg FROM h, (SELECT unnest([{', '.join(repr(k) for k in geo.TIDE_SPEEDS)}]) AS name)")
def tide_arguments(spark, sf):
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.round(geo.tide_argument(k, F.col("hour")), 7).alias("arg")) for k in geo.TIDE_SPEEDS])
    return catalog(spark, sf).select("hour").distinct().select("hour", F.inline(rows))


@query(f"WITH {CAT} SELECT id, round(pow(10, 0.1238 * mag + 0.983), 4) AS km, round(CASE WHEN mag >= 6.5 THEN pow(10, 0.032 * mag + 2.7389) ELSE pow(10, 0.5409 * mag - 0.547) END, 4) AS days FROM cat")
def gk_windows(spark, sf):
    return catalog(spark, sf).select("id", F.round(geo.gk_km(F.col("mag")), 4).alias("km"), F.round(geo.gk_days(F.col("mag")), 4).alias("days"))
