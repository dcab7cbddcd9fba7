"""Per-day channels as queries, on the whole event panel."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..functions.text import named
from ..operators import channels as C
from ..sources import panel as S
from ..sources.panel import COLUMNS, FLAGS
from .common import ORDER_P, ORDER_RAW, event_days, order_days, out, query, sql_result
from .data import DAY, GRID
from .folds import _B

# The event panel covers 30 days, so the trailing windows are shorter than the defaults.
WIN = (3, 7, 14, 21)


def dense_events(spark, folder):
    d = event_days(spark, folder)
    return S.dense(S.binary_flags(d.panel), d.n_days), d


def channel_query(name: str, body: str, make, ctes: str = GRID, **digits):
    def run(spark, folder):
        rows, d = dense_events(spark, folder)
        return out(make(rows, d), DAY, **digits)

    query(name, sql_result(body, DAY, ctes=ctes, **digits))(run)


def cols(parts: dict[str, str], source: str) -> str:
    frames = ", ".join(f"w{w} AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
                       for w in sorted({*WIN, *C.WINDOWS, *C.DERIVED_WINDOWS}))
    listed = ",\n  ".join(f"{e} AS {n}" for n, e in parts.items())
    return f"""SELECT user_id, day, {listed} FROM {source}
WINDOW so_far AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING), {frames}"""


def rm(c: str, w: int) -> str:
    return f"avg({c}) OVER w{w}"


def rs(c: str, w: int) -> str:
    return f"sqrt(greatest(avg({c} * {c}) OVER w{w} - (avg({c}) OVER w{w}) * (avg({c}) OVER w{w}), 0))"


def lg(e: str) -> str:
    return f"ln(1 + greatest({e}, 0))"


def clip(e: str, hi: float) -> str:
    return f"least(greatest({e}, 0), {hi})"


def since(flag: str) -> str:
    return f"coalesce(day - max(CASE WHEN {flag} THEN day END) OVER so_far, n_days)"


_G = f"{GRID}, gc AS (SELECT * FROM g, cal)"
_BLOCK = [f"coalesce(sum(gmv) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {30 * k + 29} PRECEDING AND {30 * k} PRECEDING), 0)"
          for k in range(3)]
_GEO = "(" + " + ".join(f"ln(1 + {b})" for b in _BLOCK) + ") / 3.0"

channel_query("c1_base_channels", cols(_B, "g"), lambda rows, d: C.base_channels(rows))



def derived_sql(windows) -> dict[str, str]:
    c = {f"{n}_{w}": f"ln(1 + sum({e}) OVER w{w})" for n, e in
         {"gmv": "gmv", "ord": "ord", "cart": "cart", "srch": "srch", "days": "active", "buydays": "buy"}.items() for w in windows}
    return c | {"recency": f"ln(1 + {since('active > 0')})", "recency_ord": f"ln(1 + {since('gmv > 0')})", "geo3": _GEO}


channel_query("c2_derived_channels", cols(derived_sql(WIN), "gc"), lambda rows, d: C.derived_channels(rows, d.n_days, WIN), ctes=_G)


def _since_cols(rows, d):
    flags = {"dsa": "active > 0", "dso": "ord > 0", "dsc": "cart > 0"}
    return rows.selectExpr(*DAY, *named({n: C.days_since(f, d.n_days) for n, f in flags.items()}))


channel_query("c3_days_since", cols({"dsa": since("active > 0"), "dso": since("ord > 0"), "dsc": since("cart > 0")}, "gc"),
              _since_cols, ctes=_G)

_RANK_SRC = {"rk_gmv30": "round(sum(gmv) OVER w30, 6)", "rk_ord30": "sum(ord) OVER w30", "rk_days30": "sum(active) OVER w30",
             "rk_recency": f"-({since('active > 0')})", "rk_geo3": f"round({_GEO}, 6)"}
_RANKED = ", ".join(f"(rank() OVER (PARTITION BY day ORDER BY {n}) - 1) / CAST(count(*) OVER (PARTITION BY day) AS DOUBLE) AS {n}"
                    for n in _RANK_SRC)
channel_query("c4_rank_channels", f"SELECT user_id, day, {_RANKED} FROM ({cols(_RANK_SRC, 'gc')})",
              lambda rows, d: C.rank_channels(rows, d.n_days, digits=6), ctes=_G)


@query("c5_population_index", sql_result(
    "SELECT day, avg(level) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS pop_gmv_30 "
    "FROM (SELECT day, avg(ln(1 + gmv)) AS level FROM g GROUP BY day)", ["day"], ctes=GRID))
def c5_population_index(spark, folder):
    rows, d = dense_events(spark, folder)
    return out(C.population_index(rows), ["day"])


_SQUARED = {"gmv": "gmv", "ord": "ord", "gmv2": "gmv * gmv", "ord2": "ord * ord"}


def _rolled(windows) -> dict[str, str]:
    return {f"{n}_{t}{w}": f(n, w) for n in ("gmv", "ord") for w in windows for t, f in (("rm", C.mean_of), ("rs", C.sd_of))}


def _rolling(rows, d):
    return C.trailing_sums(rows, _SQUARED, WIN, money={"gmv", "gmv2"}).selectExpr(*DAY, *named(_rolled(WIN)))


def rolling_sql(windows) -> dict[str, str]:
    return {f"{n}_{t}{w}": f(n, w) for n in ("gmv", "ord") for w in windows for t, f in (("rm", rm), ("rs", rs))}


channel_query("c6_rolling_mean_std", cols(rolling_sql(WIN), "g"), _rolling, digits=4)

channel_query("c7_gmv_only", cols({"gmv": lg("gmv"), "gmv_rm7": lg(rm("gmv", 7)), "gmv_rm30": lg(rm("gmv", 30)), "active": "active"}, "g"),
              lambda rows, d: C.channels(rows, "gmv_only", d.n_days, d.first))


@cache
def full_sql() -> dict[str, str]:
    c = {f"raw_{n}": COLUMNS[n] for n in FLAGS} | {f"raw_{n}": lg(COLUMNS[n]) for n in C.COUNTS}
    c |= {f"{n}_rm{w}": lg(rm(COLUMNS[n], w)) for n in C.COUNTS for w in WIN}
    c |= {f"{n}_rate{w}": rm(COLUMNS[n], w) for n in FLAGS for w in WIN}
    return c | {"active": "active"} | {f"active_rm{w}": rm("active", w) for w in WIN}


def variant_query(name: str, variant: str, parts: dict[str, str], source: str = "gc", ctes: str = _G, **digits):
    channel_query(name, cols(parts, source), lambda rows, d: C.channels(rows, variant, d.n_days, d.first, WIN), ctes=ctes, **digits)


_GAP = "greatest(cart - ord, 0)"
variant_query("c8_full", "full", full_sql())
variant_query("c9_full_dso", "full_dso", full_sql() | {"dso": lg(since("ord > 0"))})
variant_query("c9_full_backlog", "full_backlog", full_sql() | {"cart_backlog": lg(f"sum({_GAP}) OVER so_far")})
_POP = f"""{_G}, pop AS (SELECT day, avg(level) OVER (ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS pop_gmv_30
  FROM (SELECT day, avg(ln(1 + gmv)) AS level FROM g GROUP BY day)), gp AS (SELECT * FROM gc JOIN pop USING (day))"""
variant_query("c9_full_popidx", "full_popidx", full_sql() | {"pop_gmv_30": "pop_gmv_30"}, "gp", _POP)

_Q = f"""{_G}, run AS (SELECT *, sum(cart) OVER so_far AS cc, sum(ord) OVER so_far AS co FROM gc
  WINDOW so_far AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
qa AS (SELECT r.* EXCLUDE (cc, co), greatest(r.day - coalesce((SELECT min(j.day) FROM run j WHERE j.user_id = r.user_id AND j.cc >= r.co),
    r.n_days), 0) AS qage FROM run r)"""
_DS = {"dsa": lg(since("active > 0")), "dso": lg(since("ord > 0")), "dsc": lg(since("cart > 0"))}


def per(a: str, b: str, w: int) -> str:
    return f"({rm(a, w)}) / ({rm(b, w)} + 1e-6)"


def behav_sql(windows=WIN) -> dict[str, str]:
    c = {"cart_minus_ord_d": lg(_GAP), "queue_age": lg("qage"), "cart_backlog": lg(f"sum({_GAP}) OVER so_far")}
    for w in windows:
        c |= {
            f"cart_minus_ord_{w}": lg(rm(_GAP, w)), f"conv_{w}": clip(per("ord", "cart", w), 1.5),
            f"aov_{w}": lg(clip(per("gmv", "ord", w), 5e4)), f"basket_{w}": clip(per("ord", "buy", w), 100),
            f"gmv_per_buyday_{w}": lg(clip(per("gmv", "buy", w), 5e4)),
            f"cart_no_ord_days_{w}": rm("(CASE WHEN cart > 0 AND ord = 0 THEN 1 ELSE 0 END)", w),
            f"queue_age_mean_{w}": lg(rm("qage", w)), f"cart_per_srch_{w}": clip(per("cart", "srch", w), 20),
            f"srch_per_cart_{w}": clip(per("srch", "cart", w), 200),
        }
    return c


variant_query("c10_behav", "behav", full_sql() | _DS | behav_sql(), "qa", _Q, digits=4)
channel_query("c14_queue_age", "SELECT user_id, day, qage AS queue_age FROM qa",
              lambda rows, d: C.queue_age(rows).select(*DAY, "queue_age"), ctes=_Q)

_DATED = f"""{_G}, gd AS (SELECT *, dmin + CAST(day AS INT) AS dt, {since('active > 0')} AS dsa_days FROM gc
  WINDOW so_far AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING))"""
_TENURE = "greatest(coalesce(day - min(CASE WHEN active > 0 THEN day END) OVER so_far, 0), 0)"


def extra_sql(windows=WIN) -> dict[str, str]:
    c = {f"gmv_rs{w}": lg(rs("gmv", w)) for w in windows} | {f"active_rs{w}": rs("active", w) for w in windows}
    c |= {f"dsa_rs{w}": lg(rs("dsa_days", w)) for w in windows}
    c |= {f"{n}_cv{w}": clip(f"({rs(n, w)}) / ({rm(n, w)} + 1e-6)", 20) for n in ("gmv", "ord") for w in windows}
    c |= {f"{n}_{w}": clip(per(a, b, w), 20) for n, a, b in C.RATIOS for w in windows}
    a, b, e = windows[0], windows[1], windows[3]
    c |= {f"trend_{a}_{b}": clip(f"({rm('gmv', a)}) / ({rm('gmv', b)} + 1e-6)", 20),
          f"trend_{b}_{e}": clip(f"({rm('gmv', b)}) / ({rm('gmv', e)} + 1e-6)", 20)}
    return c | {"tenure": lg(_TENURE), "cum_active": lg("sum(active) OVER so_far"),
                "exp_mean_gmv": lg("sum(gmv) OVER so_far / (day + 1)"), "exp_max_gmv": lg("max(gmv) OVER so_far")}


_DOW = "(isodow(dt) - 1) * 2 * pi() / 7"
_DOY = "dayofyear(dt) * 2 * pi() / 365.25"
CALENDAR = {"dow_sin": f"sin({_DOW})", "dow_cos": f"cos({_DOW})", "dom": "day(dt) / 31.0",
            "moy_sin": f"sin({_DOY})", "moy_cos": f"cos({_DOY})"}
variant_query("c11_extra", "extra", full_sql() | _DS | extra_sql() | CALENDAR, "gd", _DATED, digits=4)
variant_query("c13_extra_nocal", "extra_nocal", full_sql() | _DS | extra_sql(), "gd", _DATED, digits=4)
variant_query("c13_extra_nodoy", "extra_nodoy",
              full_sql() | _DS | extra_sql() | {n: CALENDAR[n] for n in ("dow_sin", "dow_cos", "dom")}, "gd", _DATED, digits=4)


@query("c12_calendar", sql_result(
    f"SELECT user_id, CAST(day AS BIGINT) AS day, {', '.join(f'{e} AS {n}' for n, e in CALENDAR.items())} "
    "FROM (SELECT user_id, event_date - dmin AS day, event_date AS dt FROM raw, cal)", DAY, ctes=ORDER_RAW))
def c12_calendar(spark, folder):

    d = order_days(spark, folder)
    return out(d.panel.selectExpr(*DAY, *named(C.calendar(d.first))), DAY)


channel_query("c15_tenure", cols({"tenure": _TENURE, "first_seen": "coalesce(min(CASE WHEN active > 0 THEN day END) OVER so_far, -1)"}, "g"),
              lambda rows, d: rows.withColumn("first", F.min(F.when(F.col("active") > 0, F.col("day"))).over(C.so_far()))
              .select(*DAY, F.coalesce(F.col("day") - F.col("first"), F.lit(0)).alias("tenure"),
                      F.coalesce("first", F.lit(-1)).alias("first_seen")))
channel_query("c16_subset", cols({n: _B[n] for n in ("gmv", "buy", "cart")}, "g"),
              lambda rows, d: C.subset(C.base_channels(rows), ["gmv", "buy", "cart"]))
channel_query("c17_crop", "SELECT user_id, day, gmv, ord FROM g WHERE day BETWEEN 16 AND 25",
              lambda rows, d: C.subset(C.crop(rows, 25, 10), ["gmv", "ord"]))


# The default windows need a long history: the whole order panel, every user on every day, as user means.
_ORDER_GRID = f"""{ORDER_P}, g AS (
  SELECT u.user_id, d.day, CASE WHEN p.day IS NULL THEN 0 ELSE 1 END AS active,
    {', '.join(f'CAST(coalesce(p.{c}, 0) AS DOUBLE) AS {c}' for c in [*COLUMNS.values(), 'buy'])}
  FROM (SELECT DISTINCT user_id FROM p) u CROSS JOIN (SELECT unnest(range(n_days)) AS day FROM cal) d
  LEFT JOIN p ON p.user_id = u.user_id AND p.day = d.day)"""
_LONG = {f"{n}_rm{w}": lg(rm(COLUMNS[n], w)) for n in ("gmv", "to_ord", "searches", "to_cart") for w in C.WINDOWS}
_LONG |= {f"{n}_rate{w}": rm(COLUMNS[n], w) for n in FLAGS for w in C.WINDOWS} | {f"active_rm{w}": rm("active", w) for w in C.WINDOWS}


def order_query(name: str, parts: dict[str, str], make, source: str = "gc", ctes: str = "", **digits):
    def run(spark, folder):
        d = order_days(spark, folder)
        return out(make(S.binary_flags(d.panel), d).select("user_id", *parts), ["user_id"], **digits)

    means = f"SELECT user_id, {', '.join(f'avg({n}) AS {n}' for n in parts)} FROM ({cols(parts, source)}) GROUP BY user_id"
    query(name, sql_result(means, ["user_id"], ctes=f"{_ORDER_GRID}, gc AS (SELECT * FROM g, cal){ctes}", **digits))(run)


def order_variant(name: str, variant: str, parts: dict[str, str], source: str = "gc", ctes: str = "", **digits):
    order_query(name, parts, lambda panel, d: C.panel_channels(panel, variant, d.n_days, d.first, means=list(parts)), source, ctes, **digits)


order_variant("c8_full_orders", "full", _LONG)
order_query("c2_derived_orders", derived_sql(C.DERIVED_WINDOWS),
            lambda panel, d: C.panel_derived_channels(panel, d.n_days, means=list(derived_sql(C.DERIVED_WINDOWS))))
order_query("c6_rolling_orders", rolling_sql(C.WINDOWS), lambda panel, d: C.spread_sums(panel, d.n_days, _rolled(C.WINDOWS), _SQUARED, C.WINDOWS, {"gmv", "gmv2"}, means=list(_rolled(C.WINDOWS))), digits=3)
# The oldest cart addition that the orders so far leave open, found by nearest match on the running counts.
_QUEUE = """, run AS (SELECT *, sum(cart) OVER so_far AS cc, sum(ord) OVER so_far AS co FROM gc
  WINDOW so_far AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
reached AS (SELECT user_id, cc, min(day) AS at FROM run GROUP BY user_id, cc),
qa AS (SELECT r.* EXCLUDE (cc, co), greatest(r.day - coalesce(j.at, r.n_days), 0) AS qage
  FROM run r ASOF LEFT JOIN reached j ON r.user_id = j.user_id AND r.co <= j.cc)"""
order_variant("c10_behav_orders", "behav", behav_sql(C.WINDOWS), "qa", _QUEUE, digits=3)
_DAYS_SINCE = f""", gd AS (SELECT *, {since('active > 0')} AS dsa_days FROM gc
  WINDOW so_far AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING))"""
order_variant("c11_extra_orders", "extra", extra_sql(C.WINDOWS), "gd", _DAYS_SINCE, digits=3)
