"""The registry of queries, and the SQL that stands for the engine's inputs."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with SQL that gives the same rows."""

    def add(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql.strip()
        return fn

    return add


HAV = "2*6371.0*asin(sqrt(least(1.0, greatest(0.0, pow(sin((radians({b}.lat)-radians({a}.lat))/2),2) + cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin((radians({b}.lon)-radians({a}.lon))/2),2)))))"


def hav(a: str, b: str) -> str:
    return HAV.format(a=a, b=b)


CAT = """cat AS (SELECT event_id AS id, (epoch_us(ts) // 3600000000 - 473352)::INTEGER AS hour,
  ((user_id * 37) % 121 - 60)::DOUBLE AS lat, ((user_id * 53) % 360 - 180)::DOUBLE AS lon,
  4 + ln(1 + value) / ln(10) AS mag, event_type AS kind FROM events)"""


def big(q: float, name: str = "big") -> str:
    return f"{name} AS (SELECT * FROM cat WHERE mag >= (SELECT quantile_cont(mag, {q}) FROM cat))"


def xorshift(name: str, first: str, last: int) -> str:
    """SQL for streams of draws: `first` selects (s, x) of each stream's name and seed."""
    m = 4294967295
    return f"""{name} AS (SELECT s, -1 AS i, x FROM ({first}) UNION ALL SELECT s, i + 1, xor(b, (b << 5) & {m}) FROM (SELECT s, i, xor(a, a >> 17) AS b FROM (SELECT s, i, xor(x, (x << 13) & {m}) AS a FROM {name} WHERE i < {last})))"""


DAILY = """daily AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS dd, count(*) AS cnt, max(o_totalprice) AS mx FROM orders GROUP BY 1)"""
IND = DAILY + """, ind AS (SELECT dd, cnt, mx, (mx >= (SELECT quantile_cont(mx, 0.7) FROM daily))::INTEGER AS y FROM daily)"""
BANK = """wide AS (SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS dd, avg(l_extendedprice) AS price, avg(l_discount) AS discount, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
bank AS (SELECT dd, 'pricing' AS family, 'price' AS variable, round(price, 9) AS value FROM wide UNION ALL SELECT dd, 'pricing', 'discount', round(discount, 9) FROM wide
  UNION ALL SELECT dd, 'volume', 'quantity', round(quantity, 9) FROM wide UNION ALL SELECT dd, 'calendar', 'season', round(sin(radians(dd * 360 / 365.25::DOUBLE)), 9) FROM wide)"""
FIELD = """field AS (SELECT date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::INTEGER AS dd, (l_suppkey % 20)::INTEGER AS cell, round(avg(l_extendedprice), 6) AS value FROM lineitem GROUP BY 1, 2)"""
EDGES = "[0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]"
#: The bank on indicator days, with positions, the indicator and unique-edge deciles.
BINNED = IND + ", " + BANK + f""", joined AS (SELECT b.*, i.y FROM bank b JOIN ind i ON b.dd = i.dd),
edges AS (SELECT variable, list_sort(list_distinct(quantile_cont(value, {EDGES}))) AS e FROM joined GROUP BY variable),
binned AS (SELECT j.*, (row_number() OVER (PARTITION BY j.variable ORDER BY dd) - 1)::INTEGER AS pos, len(list_filter(e[2:len(e)-1], lambda x: x <= value))::INTEGER AS bin FROM joined j JOIN edges USING (variable)),
counted AS (SELECT family, variable, bin, count(*) AS n, sum(y)::BIGINT AS hits FROM binned GROUP BY ALL)"""
