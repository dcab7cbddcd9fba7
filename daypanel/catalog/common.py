"""Registry of named queries, the panels they read, and the SQL text both sides share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import rounded
from ..sources import panel as P
from ..sources import standins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

USER_KEYS = ["anchor", "user_id"]

# Anchors of the order panel: one with less than a year of history, one in the middle, one late.
ANCHORS = [date(1995, 10, 31), date(1998, 6, 30), date(2000, 6, 30)]
VALID_ANCHORS = [date(2000, 3, 2) + timedelta(days=30 * k) for k in range(5)]
GUARD_START = date(2000, 8, 1)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its oracle."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


class Days:
    """A stand-in panel in daily form with its calendar."""

    def __init__(self, raw: DataFrame, span: tuple[date, date], rows: int):
        self.raw, self.rows = raw, rows
        self.first, self.final = span
        self.n_days = (self.final - self.first).days + 1
        self.panel = P.daily(raw, self.first, self.rows)

    def index(self, dates: list[date]) -> list[int]:
        return [P.as_day(d, self.first) for d in dates]


_spans: dict[tuple[str, str, str], tuple[date, date]] = {}


def _days(spark: SparkSession, folder: str, kind: str) -> Days:
    rows = standins.most_rows(spark, folder, kind)
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _spans:
        _spans[key] = P.day_range(standins.FACTS[kind](spark, folder))  # a panel has the dates of its facts
    return Days(standins.panel_of(spark, folder, kind, rows), _spans[key], rows)


def order_days(spark: SparkSession, folder: str) -> Days:
    return _days(spark, folder, "order")


def event_days(spark: SparkSession, folder: str) -> Days:
    return _days(spark, folder, "event")


def out(df: DataFrame, keys: list[str] = USER_KEYS, digits: int = 6, **special: int) -> DataFrame:
    return rounded(df, list(keys), digits, special)


# -- SQL side ------------------------------------------------------------------------------------

def sql_result(body: str, keys: list[str] = USER_KEYS, digits: int = 6, ctes: str = "", **special: int) -> str:
    """The oracle's form of ``out``: keys as they are, other numbers rounded doubles."""
    shift = lambda d: 0.037 * 10.0**-d
    k = ", ".join(keys)
    lead = f"WITH {ctes}\n" if ctes else ""
    skip = ", ".join([*keys, *special])
    cols = [k] if k else []
    for name, d in special.items():
        cols.append(f"round(CAST({name} AS DOUBLE) + {shift(d)!r}, {d}) AS {name}")
    exclude = f" EXCLUDE ({skip})" if skip else ""
    cols.append(f"round(CAST(COLUMNS(*{exclude}) AS DOUBLE) + {shift(digits)!r}, {digits})")
    return f"{lead}SELECT {', '.join(cols)}\nFROM ({body})"


_CLOSE = """
SELECT user_id, event_date,
  round(sum(gs), 4) AS gmv_search, round(sum(gc), 4) AS gmv_cat, sum(sr) AS searches,
  max(se) AS search, max(ce) AS cat,
  sum(sc) AS search_to_cart, sum(so) AS search_to_ord, sum(cc) AS cat_to_cart, sum(co) AS cat_to_ord
FROM facts GROUP BY user_id, event_date"""

_RAW = f"""
sums AS ({_CLOSE}),
raw AS (
  SELECT *, round(gmv_search + gmv_cat, 4) AS gmv, search_to_ord + cat_to_ord AS to_ord,
    search_to_cart + cat_to_cart AS to_cart,
    CASE WHEN search_to_cart > 0 THEN 1 ELSE 0 END AS has_search_to_cart,
    CASE WHEN search_to_ord > 0 THEN 1 ELSE 0 END AS has_search_to_ord,
    CASE WHEN cat_to_cart > 0 THEN 1 ELSE 0 END AS has_cat_to_cart,
    CASE WHEN cat_to_ord > 0 THEN 1 ELSE 0 END AS has_cat_to_ord
  FROM sums),
cal AS (SELECT min(event_date) AS dmin, CAST(max(event_date) - min(event_date) AS INT) + 1 AS n_days FROM raw)"""

ORDER_RAW = f"""
facts AS (
  SELECT o_custkey AS user_id, CAST(l_shipdate AS DATE) AS event_date,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS gs,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN l_extendedprice * (1 - l_discount) ELSE 0 END AS gc,
    CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS sr,
    CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS se, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS ce,
    CASE WHEN l_linestatus = 'O' AND l_returnflag IN ('N', 'R') THEN 1 ELSE 0 END AS sc,
    CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN 1 ELSE 0 END AS so,
    CASE WHEN l_linestatus = 'F' AND l_returnflag IN ('N', 'R') THEN 1 ELSE 0 END AS cc,
    CASE WHEN l_linestatus = 'F' AND l_returnflag = 'N' THEN 1 ELSE 0 END AS co
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_custkey, CAST(o_orderdate AS DATE), 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM orders),
{_RAW}"""

EVENT_RAW = f"""
evs AS (SELECT *, CAST(props->>'$.k' AS BIGINT) % 2 AS odd FROM events),
facts AS (
  SELECT user_id, CAST(ts AS DATE) AS event_date,
    CASE WHEN odd = 0 AND event_type = 'purchase' THEN value ELSE 0 END AS gs,
    CASE WHEN odd = 1 AND event_type = 'purchase' THEN value ELSE 0 END AS gc,
    CASE WHEN odd = 0 AND event_type = 'view' THEN 1 ELSE 0 END AS sr,
    CASE WHEN odd = 0 AND event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS se,
    CASE WHEN odd = 1 AND event_type IN ('view', 'click', 'purchase') THEN 1 ELSE 0 END AS ce,
    CASE WHEN odd = 0 AND event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS sc,
    CASE WHEN odd = 0 AND event_type = 'purchase' THEN 1 ELSE 0 END AS so,
    CASE WHEN odd = 1 AND event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS cc,
    CASE WHEN odd = 1 AND event_type = 'purchase' THEN 1 ELSE 0 END AS co
  FROM evs),
{_RAW}"""

_P = """
p AS (
  SELECT user_id, CAST(event_date - (SELECT dmin FROM cal) AS BIGINT) AS day,
    gmv, gmv_search AS gmvs, gmv_cat AS gmvc, to_ord AS ord, to_cart AS cart, searches AS srch,
    search AS sev, cat AS cev, search_to_cart AS s2c, search_to_ord AS s2o, cat_to_cart AS c2c, cat_to_ord AS c2o,
    has_search_to_cart AS hs2c, has_search_to_ord AS hs2o, has_cat_to_cart AS hc2c, has_cat_to_ord AS hc2o,
    CASE WHEN gmv > 0 THEN 1 ELSE 0 END AS buy,
    CASE WHEN searches = 0 AND to_cart = 0 AND to_ord = 0 AND search = 0 AND cat = 0 THEN 1 ELSE 0 END AS empty
  FROM raw)"""

ORDER_P = f"{ORDER_RAW},{_P}"
EVENT_P = f"{EVENT_RAW},{_P}"


def anchor_cte(dates: list[date]) -> str:
    rows = ", ".join(f"(DATE '{d}')" for d in dates)
    return f"a AS (SELECT CAST(d - (SELECT dmin FROM cal) AS BIGINT) AS anchor, d AS anchor_date FROM (VALUES {rows}) v(d))"


def s(col: str, young: int, old: int) -> str:
    """Sum over ages young..old before the anchor."""
    return f"sum(CASE WHEN anchor - day BETWEEN {young} AND {old} THEN {col} ELSE 0 END)"


def life(col: str) -> str:
    return f"sum(CASE WHEN day <= anchor THEN {col} ELSE 0 END)"


IN_POPULATION = "max(CASE WHEN day <= anchor THEN day END) >= anchor - 29"


def features_sql(cols: dict[str, str], dates: list[date] = ANCHORS, panel: str = ORDER_P, ahead: int = 0,
                 digits: int = 6, **special: int) -> str:
    """Oracle for features: one grouped pass over anchors x panel rows."""
    listed = ",\n  ".join(f"{e} AS {n}" for n, e in cols.items())
    body = f"""SELECT anchor, user_id, {listed}
FROM a JOIN p ON p.day <= a.anchor + {ahead}, cal
GROUP BY anchor, user_id, n_days HAVING {IN_POPULATION}"""
    return sql_result(body, ctes=f"{panel}, {anchor_cte(dates)}", digits=digits, **special)
