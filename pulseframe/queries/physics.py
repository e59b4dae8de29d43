"""Calendars, phases, tides, stress and warning times, and statistics that take a matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseframe.functions import astro, calendar, geo, tides
from pulseframe.operators import linear, stats
from pulseframe.sources.testbed import catalog, daily, large

from .base import CAT, DAILY, big, query
from .sky import DAYS, MOON_LAT, MOON_LON, MOON_R, SUN_LON, SUN_R, days, n, wrap

YEARS = "y AS (SELECT o_orderkey AS order_key, (o_orderkey * 7) % 3200 - 1000 + 0.3::DOUBLE AS year FROM orders)"


def _poly(zero: float, unit: float, cs: list[float]) -> str:
    t = f"((year - {n(float(zero))}) / {n(float(unit))})"
    return " + ".join(f"{n(float(c))} * pow({t}, {k})" for k, c in enumerate(cs))


ERA_CASE = "CASE " + " ".join(f"WHEN year < {end} THEN {_poly(z, u, cs)}" for end, z, u, cs in calendar.ERAS if end is not None) + f" ELSE {_poly(*calendar.ERAS[-1][1:])} END"


@query(f"WITH {YEARS} SELECT order_key, year, round({ERA_CASE}, 6) AS seconds FROM y")
def delta_t_eras(spark, sf):
    """Dynamical less universal time at years that orders spread over three thousand, through all eras."""
    y = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_key"), (F.col("o_orderkey") * 7 % 3200 - 1000 + 0.3).alias("year"))
    return y.select("order_key", "year", F.round(calendar.delta_t(F.col("year")), 6).alias("seconds"))


@query("WITH d AS (SELECT o_orderkey AS order_key, ((o_orderkey * 997) % 660000 - 600000)::INTEGER AS dd FROM orders) SELECT order_key, dd, year(DATE '1970-01-01' + dd)::INTEGER AS year, month(DATE '1970-01-01' + dd)::INTEGER AS month, day(DATE '1970-01-01' + dd)::INTEGER AS day, dd + 2440587.5::DOUBLE AS jd FROM d")
def calendar_round_trip(spark, sf):
    """Days to dates and back in the Gregorian calendar run backwards; orders are spread over eighteen centuries."""
    d = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("order_key"), (F.col("o_orderkey") * 997 % 660000 - 600000).cast("int").alias("dd"))
    d = d.withColumn("at", calendar.date_from_day(calendar.julian_day(F.col("dd"))))
    y, m, day = F.col("at.year"), F.col("at.month"), F.round("at.day", 6)
    return d.select("order_key", "dd", y.alias("year"), m.alias("month"), day.cast("int").alias("day"), calendar.day_from_date(y, m, day).alias("jd"))


@query("WITH d AS (SELECT o_orderkey AS order_key, ((o_orderkey * 13) % 6294 - 4712)::INTEGER AS year, (o_orderkey % 12 + 1)::INTEGER AS month, o_orderkey % 28 + 1 AS day, (o_orderkey % 4) / 4::DOUBLE AS part FROM orders) SELECT order_key, year, month, day + part AS day, 367 * year - (7 * (year + 5001 - (month <= 2)::INT)) // 4 + (275 * month) // 9 + day + 1729776.5::DOUBLE + part AS jd FROM d")
def julian_calendar(spark, sf):
    """Days of the Julian calendar from its first year on."""
    k = F.col("o_orderkey")
    d = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("order_key"), (k * 13 % 6294 - 4712).cast("int").alias("year"), (k % 12 + 1).cast("int").alias("month"), (k % 28 + 1 + k % 4 / 4.0).alias("day"))
    return d.withColumn("jd", F.round(calendar.day_from_date(F.col("year"), F.col("month"), F.col("day"), julian=True), 6))


@query(f"WITH {DAILY} SELECT dd, round((dayofyear(DATE '1970-01-01' + dd) - 1) * 360.0::DOUBLE / (CASE WHEN year(DATE '1970-01-01' + dd) % 4 = 0 THEN 366 ELSE 365 END), 9) AS angle FROM daily")
def day_of_year_angle(spark, sf):
    return daily(spark, sf).select("dd", F.round(calendar.doy_angle(F.date_from_unix_date("dd")), 9).alias("angle"))


EQ = lambda lon, lat: (wrap(f"degrees(atan2(sin(radians({lon})) * cos(e) - tan(radians({lat})) * sin(e), cos(radians({lon}))))"), f"degrees(asin(sin(radians({lat})) * cos(e) + cos(radians({lat})) * sin(e) * sin(radians({lon}))))")
PLACES = f"""{DAYS}, l AS (SELECT dd, jd, t, radians({n(23.439291)} - {n(0.0130042)} * t) AS e, {MOON_LON} AS ml, {MOON_LAT} AS mb, {MOON_R} AS mr, {SUN_LON} AS sl, {SUN_R} AS sr, {wrap('280.46061837 + 360.98564736629 * (jd - 2451545.0) + 0.000387933 * t * t')} AS gmst FROM d),
  q AS (SELECT dd, jd, gmst, mr, sr, {EQ('ml', 'mb')[0]} AS ram, {EQ('ml', 'mb')[1]} AS decm, {EQ('sl', '0')[0]} AS ras, {EQ('sl', '0')[1]} AS decs FROM l)"""


def places(spark, sf):
    d = days(spark, sf)
    jd = F.col("jd")
    eps = astro.obliquity(jd)
    moon, sun = astro.equatorial(astro.moon_longitude(jd), astro.moon_latitude(jd), eps), astro.equatorial(astro.sun_longitude(jd), F.lit(0.0), eps)
    return d.select("dd", "jd", astro.gmst(jd).alias("gmst"), moon[0].alias("ram"), moon[1].alias("decm"), astro.moon_distance(jd).alias("mr"), sun[0].alias("ras"), sun[1].alias("decs"), astro.sun_distance(jd).alias("sr"))


@query(f"WITH {PLACES}, a AS (SELECT *, degrees(acos(greatest(-1.0, least(1.0, sin(radians(decm)) * sin(radians(decs)) + cos(radians(decm)) * cos(radians(decs)) * cos(radians(ram - ras)))))) AS arc FROM q) SELECT dd, round(CASE WHEN {wrap('ram - ras')} >= 180 THEN arc ELSE 360 - arc END, 5) AS phase FROM a")
def signed_phase(spark, sf):
    """The Moon's phase from equatorial places."""
    p = places(spark, sf)
    return p.select("dd", F.round(astro.signed_phase(F.col("ram"), F.col("decm"), F.col("ras"), F.col("decs")), 5).alias("phase"))




@query()
def phase_times(spark, sf):
    """The full Moon nearest to each first day of a month, by Newton's method; a test holds that the phase there is 180."""
    d = daily(spark, sf).select(F.trunc(F.date_from_unix_date("dd"), "month").alias("m")).distinct().select(F.unix_date("m").alias("dd"))
    jd = calendar.julian_day(F.col("dd"))
    guess = jd + (180.0 - astro.lunar_phase(jd)) / 12.190749
    return d.select("dd", F.round(astro.phase_time(180.0, guess), 6).alias("jd"), F.round(astro.lunar_phase(astro.phase_time(180.0, guess)), 6).alias("phase"))


def _args_sql(jd: str, name: str) -> str:
    t = f"(({jd} - 2451545.0::DOUBLE) / 36525.0::DOUBLE)"
    s, h, p = f"({n(218.3164477)} + {n(481267.88123421)} * {t})", f"({n(280.46646)} + {n(36000.76983)} * {t})", f"({n(83.3532465)} + {n(4069.0137287)} * {t})"
    (a, b, c, d), k = tides.CONSTITUENTS[name]
    tau = f"(360.0::DOUBLE * ({jd} + 0.5 - floor({jd} + 0.5)) + {h} - {s} + 180.0::DOUBLE)"
    return wrap(f"{a} * {tau} + {b} * {s} + {c} * {h} + {d} * {p} + {n(k)}")


def _nodal_sql(jd: str, name: str) -> tuple[str, str]:
    node = f"radians({n(125.0445479)} - {n(1934.1362891)} * (({jd} - 2451545.0::DOUBLE) / 36525.0::DOUBLE))"
    of = tides.NODAL_OF[name]
    f = " + ".join(f"{n(float(c))} * cos({k} * {node})" for k, c in enumerate(tides.NODAL_F[of]))
    u = " + ".join(f"{n(float(c))} * sin({k} * {node})" for k, c in enumerate(tides.NODAL_U[of]))
    return f"({f})", f"({u})"


HOURS = f"{DAYS}, e AS (SELECT dd, jd + ((dd * 7) % 24) / 24.0::DOUBLE AS jd FROM d)"


def at_hours(spark, sf):
    return days(spark, sf).select("dd", (F.col("jd") + (F.col("dd") * 7) % 24 / 24.0).alias("jd"))


@query(f"WITH {HOURS} " + " UNION ALL ".join(f"SELECT dd, '{k}' AS name, round({_args_sql('jd', k)}, 4) % 360 AS argument, round({_nodal_sql('jd', k)[0]}, 9) AS f, round({_nodal_sql('jd', k)[1]}, 9) AS u FROM e" for k in tides.CONSTITUENTS))
def tide_nodal(spark, sf):
    """Equilibrium arguments of eight constituents, with the node's factors and corrections."""
    d = at_hours(spark, sf)
    row = lambda k: F.struct(F.lit(k).alias("name"), (F.round(tides.argument(k, F.col("jd")), 4) % 360).alias("argument"), F.round(tides.nodal(k, F.col("jd"))[0], 9).alias("f"), F.round(tides.nodal(k, F.col("jd"))[1], 9).alias("u"))
    return d.select("dd", F.inline(F.array(*map(row, tides.CONSTITUENTS))))


def _height_sql(jd: str) -> str:
    return " + ".join(f"{_nodal_sql(jd, k)[0]} * ({n(0.1 + i / 10)} * cos(radians({_args_sql(jd, k)} + {_nodal_sql(jd, k)[1]})) - {n(0.05 * i)} * sin(radians({_args_sql(jd, k)} + {_nodal_sql(jd, k)[1]})))" for i, k in enumerate(tides.CONSTITUENTS))




@query(f"WITH {HOURS} SELECT dd, round({_height_sql('jd')}, 6) AS metres FROM e")
def tide_height(spark, sf):
    c = {k: (F.lit(0.1 + i / 10), F.lit(0.05 * i)) for i, k in enumerate(tides.CONSTITUENTS)}
    return at_hours(spark, sf).select("dd", F.round(tides.height(c, F.col("jd")), 6).alias("metres"))


def _w(dt: str, dp: str, body: str) -> str:
    ra, dec, far, gm = {"moon": ("ram", "decm", "mr * 1000", tides.GM["moon"]), "sun": ("ras", "decs", "sr * 149597870700.0::DOUBLE", tides.GM["sun"])}[body]
    colat, lon = f"(radians(90 - lat) + {dt})", f"(radians(lon) + {dp})"
    c = f"(cos({colat}) * sin(radians({dec})) + sin({colat}) * cos(radians({dec})) * cos(radians(gmst) + {lon} - radians({ra})))"
    return f"({n(gm)} * {n(tides.EARTH)} * {n(tides.EARTH)} / pow({far}, 3) * (3 * pow({c}, 2) - 1) / 2)"


SITE = "((dd * 37) % 121 - 60.5)::DOUBLE AS lat, ((dd * 53) % 360 - 180)::DOUBLE AS lon"


@query(f"WITH {PLACES}, s AS (SELECT *, {SITE} FROM q) SELECT dd, round({_w('0', '0', 'moon')}, 6) AS moon, round({_w('0', '0', 'sun')}, 6) AS sun FROM s")
def tidal_potential(spark, sf):
    p = sites(places(spark, sf))
    w = lambda ra, dec, far, body: tides.potential(F.radians(90.0 - F.col("lat")), F.radians("lon"), F.col(ra), F.col(dec), far, F.col("gmst"), tides.GM[body])
    return p.select("dd", F.round(w("ram", "decm", F.col("mr") * 1000, "moon"), 6).alias("moon"), F.round(w("ras", "decs", F.col("sr") * 149597870700.0, "sun"), 6).alias("sun"))


def sites(p):
    return p.withColumns({"lat": (F.pmod(F.col("dd") * 37, F.lit(121)) - 60.5).cast("double"), "lon": (F.pmod(F.col("dd") * 53, F.lit(360)) - 180).cast("double")})


@query()
def tidal_stress(spark, sf):
    """Stress of the body tide at a site a day, and on a fault with the load of a metre of water; a test compares it with differences of the potential."""
    p = sites(places(spark, sf))
    bodies = {"moon": (F.col("ram"), F.col("decm"), F.col("mr") * 1000), "sun": (F.col("ras"), F.col("decs"), F.col("sr") * 149597870700.0)}
    one = [tides.surface_stress(F.col("lat"), F.col("lon"), *b, F.col("gmst"), tides.GM[k]) for k, b in bodies.items()]
    fault = tides.fault_stress(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(20.0), F.lit(90.0), bodies, F.col("gmst"), F.lit(1.0))
    return p.select("dd", *[F.round(one[0][i] + one[1][i], 3).alias(c) for i, c in enumerate(("nn", "ee", "ne"))], F.round(fault, 3).alias("fault"))


@query(f"WITH {CAT}, x AS (SELECT id, sqrt(pow((lon - 20) * 111.19::DOUBLE * cos(radians(10.0::DOUBLE)), 2) + pow((lat - 10) * 111.19::DOUBLE, 2)) AS km, (5 + id % 40)::DOUBLE AS station FROM cat) SELECT id, round(km, 4) AS km, round(km / 3.7::DOUBLE - (station / 6.5::DOUBLE + 5), 4) AS seconds, round(3.7::DOUBLE * (station / 6.5::DOUBLE + 5), 4) AS blind_km, round(km / (sqrt(9.81::DOUBLE * 4000) * 3.6::DOUBLE) * 60, 4) AS tsunami FROM x")
def early_warning(spark, sf):
    """Local distances to one place, seconds of warning there, the radius without warning, and minutes to a tsunami."""
    east, north = geo.local_xy(F.col("lat"), F.col("lon"), 10.0, 20.0)
    c = catalog(spark, sf).select("id", F.sqrt(east * east + north * north).alias("km"), (5 + F.col("id") % 40).cast("double").alias("station"))
    return c.select("id", F.round("km", 4).alias("km"), F.round(geo.warning_seconds(F.col("km"), F.col("station")), 4).alias("seconds"), F.round(geo.blind_radius(F.col("station")), 4).alias("blind_km"), F.round(geo.tsunami_minutes(F.col("km"), 4000.0), 4).alias("tsunami"))


@query(f"WITH {CAT}, {big(0.97)} SELECT id, round(0.02 * exp(1.4::DOUBLE * (mag - 5)) * (pow(t1 - hour + 0.05, -0.25::DOUBLE) - pow(greatest(t1 - 360 - hour, 0) + 0.05, -0.25::DOUBLE)) / -0.25::DOUBLE, 6) AS expected, round(0.6::DOUBLE / (pi() * 144 * pow(10, 0.5::DOUBLE * (mag - 5))) * pow(1 + 10000 / (144 * pow(10, 0.5::DOUBLE * (mag - 5))), -1.6::DOUBLE), 12) AS density FROM big, (SELECT max(hour) + 1 AS t1 FROM cat)")
def omori_expectation(spark, sf):
    """Events that each ancestor is expected to trigger in the last 360 hours of the catalogue, and the density of their places 100 km away."""
    b = large(spark, sf, 0.97).crossJoin(F.broadcast(catalog(spark, sf).agg((F.max("hour") + 1).alias("t1"))))  # one row
    dm = F.col("mag") - 5
    expected = geo.omori_integral(F.col("t1") - 360 - F.col("hour"), F.col("t1") - F.col("hour"), dm, 0.02, 1.4, 0.05, 1.25)
    return b.select("id", F.round(expected, 6).alias("expected"), F.round(geo.space_kernel(F.lit(100.0), dm, 12.0, 0.5, 1.6), 12).alias("density"))


LINES = "v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE AS a, l_extendedprice / 1000::DOUBLE AS b, l_discount::DOUBLE AS c FROM lineitem)"


def lines(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).cast("double").alias("b"), F.col("l_discount").cast("double").alias("c"))


_PAIRS = [("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")]
COV = LINES + ", s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, " + ", ".join(f"covar_samp({x}, {y}) * {'1' if x == y else '0.8::DOUBLE'} + {'1e-6' if x == y else '0'} AS {x}{y}" for x, y in _PAIRS) + " FROM v), i AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM s)"


@query(f"WITH {COV}, z AS (SELECT id, a - ma AS x, b - mb AS y, c - mc AS w, i.* FROM v, i) SELECT id, round((x * x * (bb * cc - bc * bc) + y * y * (aa * cc - ac * ac) + w * w * (aa * bb - ab * ab) + 2 * (x * y * (ac * bc - ab * cc) + x * w * (ab * bc - ac * bb) + y * w * (ab * ac - aa * bc))) / det, 6) AS distance FROM z")
def mahalanobis_full(spark, sf):
    """Squared distances under the whole covariance, shrunk by a fifth towards its diagonal, and inverted."""
    v = lines(spark, sf)
    _, means, cov = linear.moments(v, ["a", "b", "c"])
    return v.select("id", F.round(linear.mahalanobis(["a", "b", "c"], means, linear.shrunk_inverse(cov, 0.2)), 6).alias("distance"))


@query(f"WITH {LINES} SELECT round(regr_r2(b, a), 9) AS line, round(corr(a, b) * corr(a, b), 9) AS again FROM v")
def least_squares(spark, sf):
    """R2 by normal equations, for a line and for a basis that holds the same line twice."""
    v = lines(spark, sf)
    one = linear.least_squares_r2(v, [F.col("a")], F.col("b"))
    two = linear.least_squares_r2(v, [F.col("a"), F.col("a") * 2 + 1], F.col("b"))
    return spark.createDataFrame([(round(one, 9), round(two, 9))], "line double, again double")


@query("""WITH v AS (SELECT unnest([{'name': 'l_quantity', 'x': l_quantity::DOUBLE}, {'name': 'l_extendedprice', 'x': l_extendedprice::DOUBLE}, {'name': 'l_discount', 'x': l_discount::DOUBLE}, {'name': 'constant', 'x': 1::DOUBLE},
    {'name': 'mostly_missing', 'x': CASE WHEN l_linenumber > 5 THEN l_quantity::DOUBLE ELSE 'nan'::DOUBLE END}, {'name': 'mostly_known', 'x': CASE WHEN l_linenumber < 7 THEN l_quantity::DOUBLE END}], recursive := true) FROM lineitem)
  SELECT name FROM v GROUP BY name HAVING count(x) FILTER (isfinite(x)) > count(*) / 2 AND min(x) FILTER (isfinite(x)) < max(x) FILTER (isfinite(x))""")
def usable_columns(spark, sf):
    """Columns of which more than half is finite, and which vary: neither a constant nor one that is mostly missing."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "constant", "mostly_missing", "mostly_known"]
    v = spark.read.parquet(f"{sf}/lineitem.parquet").select(*[F.col(c).cast("double").alias(c) for c in names[:3]], F.lit(1.0).alias("constant"), F.when(F.col("l_linenumber") > 5, F.col("l_quantity").cast("double")).otherwise(F.lit(float("nan"))).alias("mostly_missing"), F.when(F.col("l_linenumber") < 7, F.col("l_quantity").cast("double")).alias("mostly_known"))
    return spark.createDataFrame([(c,) for c in linear.usable(v, names)], "name string")


QUARTILES = "p AS (SELECT id, mag, kind, (hour * 360.0::DOUBLE / 24.8) % 360 AS phase, (id * 11) % 360 - 180 AS rake, (id * 3) % 90 AS dip FROM cat), m AS (SELECT *, CASE WHEN rake BETWEEN 45 AND 135 THEN 'thrust' WHEN rake BETWEEN -135 AND -45 THEN 'normal' ELSE 'strike-slip' END AS mechanism FROM p), e AS (SELECT quantile_cont(mag, 0.25) AS a, quantile_cont(mag, 0.5) AS b, quantile_cont(mag, 0.75) AS c FROM m)"


@query(f"WITH {CAT}, {QUARTILES}, f AS (SELECT m.*, (mag >= a)::INTEGER + (mag >= b)::INTEGER + (mag >= c)::INTEGER + 1 AS quartile, dip < 30 AS shallow FROM m, e) SELECT mechanism, quartile, shallow, count(*) AS n, round(sqrt(pow(sum(sin(radians(phase))), 2) + pow(sum(cos(radians(phase))), 2)) / count(*), 6) AS resultant FROM f GROUP BY ALL")
def mechanism_families(spark, sf):
    """Subsets by mechanism, quartile of size and dip, with their phase statistics in one pass."""
    c = catalog(spark, sf).withColumns({"phase": F.pmod(F.col("hour") * 360.0 / 24.8, F.lit(360.0)), "rake": F.col("id") * 11 % 360 - 180, "dip": F.col("id") * 3 % 90})
    e = c.agg(F.percentile("mag", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("e"))
    f = c.crossJoin(F.broadcast(e))  # one row
    f = f.select("phase", geo.mechanism(F.col("rake")).alias("mechanism"), (F.size(F.filter("e", lambda x: x <= F.col("mag"))) + 1).alias("quartile"), (F.col("dip") < 30).alias("shallow"))
    return f.groupBy("mechanism", "quartile", "shallow").agg(F.count("*").alias("n"), F.round(stats.schuster(F.col("phase"))["resultant"], 6).alias("resultant"))
