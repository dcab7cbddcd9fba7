"""Window primitives and feature blocks as queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators.windows import Plan, ahead, before, block, features, last
from .common import (ANCHORS, IN_POPULATION, ORDER_P, anchor_cte, features_sql, life, order_days, out, query, s,
                     sql_result)

W7 = (7, 14, 30, 60, 90, 180, 365)


def windows_query(name: str, spark_cols, sql_cols: dict[str, str], look_ahead: int = 0, floor_days=None, **digits):
    """A query that projects a few window aggregates at the common anchors."""

    def run(spark, folder):
        d = order_days(spark, folder)
        plan = Plan(d.n_days, floor_days)
        return out(features(d.panel, d.index(ANCHORS), plan, spark_cols(plan)), **digits)

    query(name, features_sql(sql_cols, ahead=look_ahead, **digits))(run)


def block_query(name: str, blocks: list[str], sql_cols: dict[str, str], **digits):
    def run(spark, folder):
        d = order_days(spark, folder)
        return out(B.build(d.panel, d.index(ANCHORS), d.n_days, blocks), **digits)

    query(name, features_sql(sql_cols, **digits))(run)


def ratio(a: str, b: str, eps: float = 1.0) -> str:
    return f"({a}) / greatest(CAST({b} AS DOUBLE), {eps})"


def com_sql(v: str, w: int) -> str:
    mass = s(v, 0, w - 1)
    return f"CASE WHEN {mass} > 0 THEN anchor - {s(f'{v} * day', 0, w - 1)} / {mass} ELSE -1 END"


def date_sd_sql(v: str, w: int) -> str:
    n, m, m2 = s(v, 0, w - 1), s(f"{v} * day", 0, w - 1), s(f"{v} * day * day", 0, w - 1)
    var = f"greatest(({m2}) / CAST({n} AS DOUBLE) - pow(({m}) / CAST({n} AS DOUBLE), 2), 0)"
    return f"CASE WHEN {n} >= 2 THEN sqrt({var}) ELSE -1 END"


def ewm_sql(col: str, hl: int) -> str:
    return life(f"{col} * pow(0.5, (anchor - day) / {hl}.0)")


def blk(col: str, k: int) -> str:
    return s(col, 30 * k, 30 * k + 29)


def change_sql(a: str, b: str) -> str:
    return f"ln(1 + {a}) - ln(1 + {b})"


GEO3 = "exp((" + " + ".join(f"ln(1 + {blk('gmv', k)})" for k in range(3)) + ") / 3.0) - 1"
RECENCY = "anchor - max(CASE WHEN day <= anchor THEN day END)"
RECENCY_ORD = "coalesce(anchor - max(CASE WHEN day <= anchor AND ord > 0 THEN day END), n_days)"
FIRST = "min(day)"
TENURE = f"anchor - {FIRST}"

# -- W: primitives ---------------------------------------------------------------------------------

windows_query(
    "w1_window_sum",
    lambda p: {f"{c}_{w}": p.total(c, last(w)) for c in ("gmv", "ord", "cart", "srch", "s2o") for w in W7},
    {f"{c}_{w}": s(c, 0, w - 1) for c in ("gmv", "ord", "cart", "srch", "s2o") for w in W7},
)
windows_query("w2_active_days", lambda p: {f"days_{w}": p.days(last(w)) for w in W7},
              {f"days_{w}": s("1", 0, w - 1) for w in W7})
windows_query("w3_buy_days", lambda p: {f"buy_{w}": p.buys(last(w)) for w in W7},
              {f"buy_{w}": s("buy", 0, w - 1) for w in W7})
windows_query("w4_empty_days", lambda p: {f"empty_{w}": p.empties(last(w)) for w in W7},
              {f"empty_{w}": s("empty", 0, w - 1) for w in W7})
windows_query("w5_window_squares", lambda p: {f"{c}_sq_{w}": p.squares(c, last(w)) for c in ("gmv", "ord") for w in W7},
              {f"{c}_sq_{w}": s(f"{c} * {c}", 0, w - 1) for c in ("gmv", "ord") for w in W7}, digits=0)
windows_query("w6_date_sd", lambda p: {f"sd_{n}_{w}": p.date_sd(n, last(w)) for n in ("days", "buy") for w in W7},
              {f"sd_{n}_{w}": date_sd_sql("1" if n == "days" else "buy", w) for n in ("days", "buy") for w in W7}, digits=4)
windows_query("w7_centre_of_mass", lambda p: {f"com_{n}_{w}": p.mass_age(n, last(w)) for n in ("days", "gmv") for w in W7},
              {f"com_{n}_{w}": com_sql("1" if n == "days" else "gmv", w) for n in ("days", "gmv") for w in W7})
windows_query("w8_active_in", lambda p: {f"active_{w}": f"{p.days(last(w))} > 0" for w in (3, 7, 14, 30)}
              | {f"active_prev_{w}": f"{p.days(before(w))} > 0" for w in (7, 30)},
              {f"active_{w}": f"({s('1', 0, w - 1)} > 0)" for w in (3, 7, 14, 30)}
              | {f"active_prev_{w}": f"({s('1', w, 2 * w - 1)} > 0)" for w in (7, 30)})
windows_query("w9_target", lambda p: {"target_30": p.total("gmv", ahead(30)), "target_7": p.total("gmv", ahead(7))},
              {"target_30": s("gmv", -30, -1), "target_7": s("gmv", -7, -1)}, look_ahead=30)
windows_query("w10_recency", lambda p: {"recency": p.recency()}, {"recency": RECENCY})
windows_query("w11_recency_order", lambda p: {"recency_order": p.recency_order()}, {"recency_order": RECENCY_ORD})
windows_query("w12_tenure", lambda p: {"tenure": p.tenure()}, {"tenure": TENURE})
windows_query("w13_ewm", lambda p: {f"{c}_hl{h}": p.decay(c, h) for c in ("gmv", "ord") for h in (7, 30, 90)},
              {f"{c}_hl{h}": ewm_sql(c, h) for c in ("gmv", "ord") for h in (7, 30, 90)}, digits=4)

FLOOR = 120


def floored(col: str) -> str:
    return s(col, 0, FLOOR - 1)


windows_query("w14_ewm_floor", lambda p: {f"{c}_hl{h}": p.decay(c, h) for c in ("gmv", "ord") for h in (7, 30, 90)},
              {f"{c}_hl{h}": floored(f"{c} * pow(0.5, (anchor - day) / {h}.0)") for c in ("gmv", "ord") for h in (7, 30, 90)},
              floor_days=FLOOR, digits=4)


def _cap(e: str) -> str:
    return f"CASE WHEN anchor - {FLOOR} + 1 > 0 THEN least({e}, {FLOOR}) ELSE {e} END"


windows_query(
    "w15_floor",
    lambda p: {f"gmv_{w}": p.total("gmv", last(w)) for w in W7}
    | {"days_365": p.days(last(365)), "gmv_total": p.life_total("gmv"), "days_total": p.life_days(),
       "recency": p.recency(), "recency_order": p.recency_order(), "tenure": p.tenure(),
       "com_gmv_365": p.mass_age("gmv", last(365))},
    {f"gmv_{w}": s("gmv", 0, min(w, FLOOR) - 1) for w in W7}
    | {"days_365": floored("1"), "gmv_total": floored("gmv"), "days_total": floored("1"),
       "recency": _cap(f"({RECENCY})"), "recency_order": _cap(RECENCY_ORD), "tenure": _cap(f"({TENURE})"),
       "com_gmv_365": com_sql("gmv", FLOOR)},
    floor_days=FLOOR,
)
windows_query("w16_lag_blocks", lambda p: {f"{c}_blk{k}": p.total(c, block(k)) for c in ("gmv", "ord") for k in range(12)},
              {f"{c}_blk{k}": blk(c, k) for c in ("gmv", "ord") for k in range(12)})
windows_query("w17_geo3", lambda p: {"geo3": p.geo3()}, {"geo3": GEO3})

# -- F: blocks -------------------------------------------------------------------------------------


def base_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in W7:
        c |= {f"{n}_sum_{w}": s(n, 0, w - 1) for n in ("gmv", "ord", "cart", "srch")} | {f"days_{w}": s("1", 0, w - 1)}
    for w in (30, 90, 365):
        c |= {f"gmv_search_{w}": s("gmvs", 0, w - 1), f"gmv_cat_{w}": s("gmvc", 0, w - 1)}
    for k in range(3):
        c |= {f"gmv_blk{k}": blk("gmv", k), f"ord_blk{k}": blk("ord", k)}
    g, o, ca, sr, d = (s(x, 0, 89) for x in ("gmv", "ord", "cart", "srch", "1"))
    return c | {
        "geo3": GEO3, "gmv_trend_blk01": change_sql(blk("gmv", 0), blk("gmv", 1)),
        "recency_days": RECENCY, "recency_order_days": RECENCY_ORD, "tenure_days": TENURE,
        "active_days_total": life("1"), "gmv_total": life("gmv"), "ord_total": life("ord"),
        "aov_90": ratio(g, o), "gmv_per_active_day_90": ratio(g, d), "ord_per_active_day_90": ratio(o, d),
        "cart_to_ord_rate_90": ratio(o, ca), "srch_to_ord_rate_90": ratio(o, sr),
        "gmv_ratio_30_90": ratio(s("gmv", 0, 29), f"{g} + 1"), "active_day_rate_90": f"{d} / 90.0",
    }


def counts_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in W7:
        b = s("buy", 0, w - 1)
        c |= {f"buy_days_{w}": b, f"buy_day_rate_{w}": ratio(b, s("1", 0, w - 1)),
              f"ord_per_buy_day_{w}": ratio(s("ord", 0, w - 1), b), f"gmv_per_buy_day_{w}": ratio(s("gmv", 0, w - 1), b)}
    for w in (3, 21, 45, 120, 270):
        c |= {f"ord_sum_{w}": s("ord", 0, w - 1), f"gmv_sum_{w}": s("gmv", 0, w - 1), f"days_{w}": s("1", 0, w - 1)}
    b = life("buy")
    return c | {"buy_days_total": b, "buy_day_rate_total": ratio(b, life("1")),
                "ord_per_tenure_day": ratio(life("ord"), TENURE), "buy_day_per_tenure_day": ratio(b, TENURE)}


def ewm_block_sql() -> dict[str, str]:
    c = {f"ewm_{n}_hl{h}": ewm_sql(n, h) for n in ("gmv", "ord") for h in (7, 30, 90)}
    return c | {f"ewm_{n}_ratio_7_90": ratio(ewm_sql(n, 7), ewm_sql(n, 90), 1e-3) for n in ("gmv", "ord")}


def com_block_sql() -> dict[str, str]:
    return {f"com_{n}_{w}": com_sql(v, w) for w in (30, 90, 365) for n, v in (("days", "1"), ("gmv", "gmv"))}


def trend_sql() -> dict[str, str]:
    c = ewm_block_sql() | com_block_sql()
    for w in (30, 90):
        for n, v in (("gmv", "gmv"), ("ord", "ord"), ("days", "1")):
            c[f"{n}_logratio_{w}_prev{w}"] = change_sql(s(v, 0, w - 1), s(v, w, 2 * w - 1))
    return c


def funnel_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in W7:
        v = {n: s(n, 0, w - 1) for n in ("sev", "cev", "s2c", "s2o", "c2c", "c2o", "hs2c", "hs2o", "hc2c", "hc2o", "ord")}
        act = s("1", 0, w - 1)
        c |= {f"fn_{n}_{w}": v[n] for n in ("sev", "cev", "s2c", "s2o", "c2c", "c2o")}
        c |= {f"fn_days_{n}_{w}": v[n] for n in ("hs2c", "hs2o", "hc2c", "hc2o")}
        c |= {
            f"fn_ordshare_search_{w}": ratio(v["s2o"], f"{v['s2o']} + {v['c2o']}"),
            f"fn_cartshare_search_{w}": ratio(v["s2c"], f"{v['s2c']} + {v['c2c']}"),
            f"fn_attributed_ord_rate_{w}": ratio(f"{v['s2o']} + {v['c2o']}", v["ord"]),
            f"fn_conv_search_ord_{w}": ratio(v["s2o"], v["sev"]), f"fn_conv_cat_ord_{w}": ratio(v["c2o"], v["cev"]),
            f"fn_conv_search_cart_{w}": ratio(v["s2c"], v["sev"]), f"fn_conv_cat_cart_{w}": ratio(v["c2c"], v["cev"]),
            f"fn_cart2ord_search_{w}": ratio(v["s2o"], v["s2c"]), f"fn_cart2ord_cat_{w}": ratio(v["c2o"], v["c2c"]),
            f"fn_cart2ord_all_{w}": ratio(f"{v['s2o']} + {v['c2o']}", f"{v['s2c']} + {v['c2c']}"),
            f"fn_sev_per_day_{w}": ratio(v["sev"], act), f"fn_cev_per_day_{w}": ratio(v["cev"], act),
        }
    return c


def visit_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in (7, 30, 90, 365):
        e, d = s("empty", 0, w - 1), s("1", 0, w - 1)
        c |= {f"empty_days_{w}": e, f"real_days_{w}": f"{d} - {e}", f"empty_day_rate_{w}": ratio(e, d)}
    return c | {"empty_days_total": life("empty"), "empty_day_rate_total": ratio(life("empty"), life("1"))}


def channel_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in (7, 14, 60, 180):
        c |= {f"gmv_search_{w}": s("gmvs", 0, w - 1), f"gmv_cat_{w}": s("gmvc", 0, w - 1)}
    for w in (30, 90, 365):
        gs, gc = s("gmvs", 0, w - 1), s("gmvc", 0, w - 1)
        c[f"cat_gmv_share_{w}"] = ratio(gc, f"{gs} + {gc}")
        c[f"cart_per_search_{w}"] = ratio(s("cart", 0, w - 1), s("srch", 0, w - 1))
    return c


def diff_sql() -> dict[str, str]:
    src = {"gmv": "gmv", "ord": "ord", "days": "1"}
    lg = {n: [f"ln(1 + {blk(v, k)})" for k in range(7)] for n, v in src.items()}
    c = {f"{n}_blk{k}": blk(n, k) for k in range(3, 7) for n in ("gmv", "ord")}
    c |= {f"days_blk{k}": blk("1", k) for k in range(7)}
    c |= {f"d1_{n}_{k}": f"{lg[n][k]} - {lg[n][k + 1]}" for k in range(6) for n in src}
    c |= {f"d2_{n}_{k}": f"{lg[n][k]} - 2 * {lg[n][k + 1]} + {lg[n][k + 2]}" for k in range(5) for n in ("gmv", "ord")}
    for w in (60, 90, 180):
        c |= {f"d1_{n}_w{w}": change_sql(s(n, 0, w - 1), s(n, w, 2 * w - 1)) for n in ("gmv", "ord")}
    for n in ("gmv", "ord"):
        c[f"blk_{n}_logstd"] = f"list_stddev_pop([{', '.join(lg[n])}])"
    return c


def cumshare_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in (7, 30, 90, 180):
        for n, v in (("gmv", "gmv"), ("ord", "ord"), ("days", "1")):
            c[f"{n}_share_life_{w}"] = ratio(s(v, 0, w - 1), life(v))
    g, ten = life("gmv"), f"greatest({TENURE}, 1)"
    c |= {"gmv_per_tenure_day": f"{g} / {ten}", "gmv_per_active_day_life": ratio(g, life("1")),
          "ord_per_active_day_life": ratio(life("ord"), life("1"))}
    for w in (30, 90):
        c[f"gmv_{w}_vs_expanding"] = change_sql(s("gmv", 0, w - 1), f"{g} / {ten} * {w}")
    return c


def dispersion_sql() -> dict[str, str]:
    c: dict[str, str] = {}
    for w in (30, 90, 365):
        wl = f"least({w}.0, anchor + 1.0)"
        for n in ("ord", "gmv"):
            m = f"({s(n, 0, w - 1)} / {wl})"
            var = f"greatest({s(f'{n} * {n}', 0, w - 1)} / {wl} - {m} * {m}, 0)"
            c[f"fano_{n}_{w}"] = f"CASE WHEN {m} > 0 THEN {var} / greatest({m}, 1e-9) ELSE -1 END"
            c[f"cv_{n}_{w}"] = f"CASE WHEN {m} > 0 THEN sqrt({var}) / greatest({m}, 1e-9) ELSE -1 END"
        for v, tag in (("1", "act"), ("buy", "buy")):
            n, sd = s(v, 0, w - 1), f"({date_sd_sql(v, w)})"
            gap = f"({wl} / greatest({n}, 1.0))"
            c[f"date_sd_{tag}_{w}"] = sd
            c[f"date_regularity_{tag}_{w}"] = f"CASE WHEN {sd} >= 0 THEN {sd} / ({wl} / sqrt(12.0)) ELSE -1 END"
            c[f"mean_gap_{tag}_{w}"] = f"CASE WHEN {n} >= 2 THEN {gap} ELSE -1 END"
            c[f"burstiness_{tag}_{w}"] = f"CASE WHEN {n} >= 2 THEN ({sd} - {gap}) / greatest({sd} + {gap}, 1e-9) ELSE -2 END"
    for w in (30, 90):
        for n in ("gmv", "ord"):
            t = s(n, 0, w - 1)
            c[f"{n}_hhi_{w}"] = f"CASE WHEN {t} > 0 THEN {s(f'{n} * {n}', 0, w - 1)} / greatest({t} * {t}, 1e-9) ELSE -1 END"
    return c


block_query("f1_base", ["base"], base_sql())
block_query("f2_counts", ["counts"], counts_sql())
block_query("f3_trend", ["trend"], trend_sql(), digits=4)
block_query("f5_funnel", ["funnel"], funnel_sql())
block_query("f6_visit", ["visit"], visit_sql())
block_query("f7_channel", ["channel"], channel_sql())
block_query("f8_diff", ["diff"], diff_sql())
block_query("f10_ewm", ["ewm"], ewm_block_sql(), digits=4)
block_query("f10_com", ["com"], com_block_sql())
# Spread around a mean of squared dates or values: four decimals are what cancellation leaves exact.
block_query("f11_dispersion", ["dispersion"], dispersion_sql(), digits=3)
block_query("f13_cartbacklog", ["cartbacklog"], {"cart_backlog_7": f"greatest({s('cart', 0, 6)} - {s('ord', 0, 6)}, 0)"})

_SEEN = f"""{ORDER_P}, {anchor_cte(ANCHORS)},
seen AS (SELECT anchor, p.*, min(day) OVER (PARTITION BY anchor, user_id) AS first_day,
  max(day) OVER (PARTITION BY anchor, user_id) AS last_day,
  sum(gmv) OVER (PARTITION BY anchor, user_id ORDER BY day) AS run
  FROM a JOIN p ON p.day <= a.anchor),
pop AS (SELECT * FROM seen WHERE last_day >= anchor - 29)"""

_CROSS = """crossed AS (SELECT *, max(run) OVER (PARTITION BY anchor, user_id) AS tot FROM pop),
cx AS (SELECT anchor, user_id,
  CASE WHEN max(tot) > 0 THEN anchor - min(CASE WHEN run >= 0.5 * tot THEN day END) ELSE -1 END AS days_since_half_of_life_gmv,
  CASE WHEN max(tot) > 0 THEN anchor - min(CASE WHEN run >= 0.9 * tot THEN day END) ELSE -1 END AS days_since_p90_of_life_gmv
  FROM crossed GROUP BY anchor, user_id)"""

_CUM = ", ".join(f"{e} AS {n}" for n, e in cumshare_sql().items())


@query("f9_cumshare", sql_result(
    f"""SELECT * FROM (SELECT anchor, user_id, {_CUM} FROM a JOIN p ON p.day <= a.anchor
GROUP BY anchor, user_id HAVING {IN_POPULATION}) JOIN cx USING (anchor, user_id)""",
    ctes=f"{_SEEN}, {_CROSS}"))
def f9_cumshare(spark, folder):
    d = order_days(spark, folder)
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, ["cumshare"]))


@query("f12_agebucket", sql_result(
    """SELECT anchor, user_id, sum(CASE WHEN day - first_day BETWEEN 90 AND 119 THEN gmv ELSE 0 END)
  / greatest(sum(gmv), 1e-3) AS age_bucket_gmv_share_3 FROM pop GROUP BY anchor, user_id""", ctes=_SEEN))
def f12_agebucket(spark, folder):
    d = order_days(spark, folder)
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, ["agebucket"]))


_RANKED = {"gmv_30": s("gmv", 0, 29), "gmv_90": s("gmv", 0, 89), "gmv_365": s("gmv", 0, 364), "ord_90": s("ord", 0, 89),
           "ord_180": s("ord", 0, 179), "days_90": s("1", 0, 89), "recency": f"-({RECENCY})", "recency_ord": f"-({RECENCY_ORD})"}
_RANK_COLS = ", ".join(f"round({e}, 6) AS {n}" for n, e in _RANKED.items())
_RANK_POS = ", ".join(
    f"(row_number() OVER (PARTITION BY anchor ORDER BY {n}, user_id) - 0.5) / count(*) OVER (PARTITION BY anchor) AS pct_{n}"
    for n in _RANKED)


@query("f4_rank", sql_result(
    f"""SELECT anchor, user_id, {_RANK_POS} FROM (SELECT anchor, user_id, {_RANK_COLS}
FROM a JOIN p ON p.day <= a.anchor, cal GROUP BY anchor, user_id, n_days HAVING {IN_POPULATION})""",
    ctes=f"{ORDER_P}, {anchor_cte(ANCHORS)}"))
def f4_rank(spark, folder):
    d = order_days(spark, folder)
    return out(B.rank(d.panel, d.index(ANCHORS), d.n_days, digits=6))


@query("f14_cohortrel", sql_result(
    f"""SELECT anchor, user_id, rate - median(rate) OVER (PARTITION BY anchor, cohort) AS cohort_rel_buy_rate90
FROM (SELECT anchor, user_id, {ratio(s('buy', 0, 89), s('1', 0, 89))} AS rate, min(day) // 14 AS cohort
FROM a JOIN p ON p.day <= a.anchor GROUP BY anchor, user_id HAVING {IN_POPULATION})""",
    ctes=f"{ORDER_P}, {anchor_cte(ANCHORS)}"))
def f14_cohortrel(spark, folder):
    d = order_days(spark, folder)
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, ["cohortrel"]))


_UNIFORM = [f"((CAST('0x' || substr(md5(concat_ws(':', {k}, anchor, user_id)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE)" for k in (1, 2)]


@query("f15_noisectl", features_sql({"noise_ctl": f"sqrt(-2 * ln({_UNIFORM[0]})) * cos(2 * pi() * {_UNIFORM[1]})"}))
def f15_noisectl(spark, folder):
    d = order_days(spark, folder)
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, ["noisectl"]))


block_query("f16_build", ["base", "counts", "visit", "channel", "dispersion"],
            base_sql() | counts_sql() | visit_sql() | channel_sql() | dispersion_sql(), digits=3)

_ALL = base_sql() | counts_sql() | trend_sql()


# What sees at most 60 days, written out.
_SHORT_SIGHTED = [
    *[f"{n}_{w}" for w in (7, 14, 30, 60) for n in ("gmv_sum", "ord_sum", "cart_sum", "srch_sum", "days", "buy_days",
                                                    "buy_day_rate", "ord_per_buy_day", "gmv_per_buy_day")],
    *[f"{n}_{w}" for w in (3, 21, 45) for n in ("ord_sum", "gmv_sum", "days")],
    "gmv_search_30", "gmv_cat_30", "gmv_blk0", "ord_blk0", "gmv_blk1", "ord_blk1", "gmv_trend_blk01", "recency_days",
    "ewm_gmv_hl7", "ewm_ord_hl7", "com_days_30", "com_gmv_30",
    "gmv_logratio_30_prev30", "ord_logratio_30_prev30", "days_logratio_30_prev30",
]


@query("f17_max_window", features_sql({n: _ALL[n] for n in _SHORT_SIGHTED}, digits=4))
def f17_max_window(spark, folder):
    d = order_days(spark, folder)
    blocks = ["base", "counts", "trend"]
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, blocks, keep=B.within_lookback(60, blocks, d.n_days)), digits=4)


# Every block of the shipped matrix within 90 days. The names, written out: windows up to 90 days, blocks that end
# within them, shares and ranks of such windows, and the statistics of all series of up to 90 days.
_SHIPPED_90 = """
SELECT n || '_sum_' || w AS feature FROM (VALUES ('gmv'), ('ord'), ('cart'), ('srch')) a(n), (VALUES (7), (14), (30), (60), (90)) b(w)
UNION ALL SELECT n || '_sum_' || w FROM (VALUES ('gmv'), ('ord')) a(n), (VALUES (3), (21), (45)) b(w)
UNION ALL SELECT 'days_' || w FROM (VALUES (3), (7), (14), (21), (30), (45), (60), (90)) b(w)
UNION ALL SELECT 'gmv_' || n || '_' || w FROM (VALUES ('search'), ('cat')) a(n), (VALUES (7), (14), (30), (60), (90)) b(w)
UNION ALL SELECT n || '_blk' || k FROM (VALUES ('gmv'), ('ord')) a(n), (VALUES (0), (1), (2)) b(k)
UNION ALL SELECT n || '_' || w FROM (VALUES ('buy_days'), ('buy_day_rate'), ('ord_per_buy_day'), ('gmv_per_buy_day')) a(n), (VALUES (7), (14), (30), (60), (90)) b(w)
UNION ALL SELECT n || '_' || w FROM (VALUES ('empty_days'), ('real_days'), ('empty_day_rate')) a(n), (VALUES (7), (30), (90)) b(w)
UNION ALL SELECT n || '_' || w FROM (VALUES ('cat_gmv_share'), ('cart_per_search')) a(n), (VALUES (30), (90)) b(w)
UNION ALL SELECT n || '_' || t || '_' || w FROM (VALUES ('fano'), ('cv')) a(n), (VALUES ('ord'), ('gmv')) c(t), (VALUES (30), (90)) b(w)
UNION ALL SELECT n || '_' || t || '_' || w FROM (VALUES ('date_sd'), ('date_regularity'), ('mean_gap'), ('burstiness')) a(n),
  (VALUES ('act'), ('buy')) c(t), (VALUES (30), (90)) b(w)
UNION ALL SELECT n || '_hhi_' || w FROM (VALUES ('gmv'), ('ord')) a(n), (VALUES (30), (90)) b(w)
UNION ALL SELECT n FROM (VALUES ('geo3'), ('gmv_trend_blk01'), ('recency_days'), ('aov_90'), ('gmv_per_active_day_90'), ('ord_per_active_day_90'),
  ('cart_to_ord_rate_90'), ('srch_to_ord_rate_90'), ('gmv_ratio_30_90'), ('active_day_rate_90'),
  ('pct_gmv_30'), ('pct_gmv_90'), ('pct_ord_90'), ('pct_days_90'), ('pct_recency')) a(n)
UNION ALL SELECT 'sbc_' || n || '_' || t || '_' || w FROM (VALUES ('gmv'), ('ord')) c(t), (VALUES (14), (30), (60), (90)) b(w), (VALUES
  ('trendchangerate'), ('numtrendchanges'), ('zigzagfreq'), ('fracup'), ('fracdown'), ('maxrunlength'), ('meanrunlength'), ('zerocross'), ('meanlast'),
  ('q10'), ('q25'), ('median'), ('q75'), ('q90'), ('q99'), ('q19'), ('iqr'), ('interdecile'), ('max'), ('range'), ('trimmedmean'), ('trimmedstd'),
  ('winsorizedmean'), ('biweightmidvar'), ('gini'), ('shapirofrancia'), ('andersondarling'), ('spectralentropy'), ('spectralflatness'), ('fftmaxfreq'),
  ('domfreqpower'), ('spectralrolloff'), ('trendslope'), ('firsthalfmean'), ('secondhalfmean'), ('hurstexp'), ('autocorr1'), ('autocorr5'), ('autocorr7'),
  ('histentropy')) a(n)"""
SHIPPED = ["base", "counts", "rank", "visit", "channel", "dispersion", "sbcnomoment"]


@query("f17_shipped_max_window", sql_result(
    f"SELECT feature, count(DISTINCT user_id) AS n FROM ({_SHIPPED_90}), a JOIN p ON day BETWEEN anchor - 29 AND anchor GROUP BY feature",
    ["feature"], ctes=f"{ORDER_P}, {anchor_cte(ANCHORS[2:])}"))
def f17_shipped_max_window(spark, folder):
    d = order_days(spark, folder)
    rows = B.build(d.panel, d.index(ANCHORS[2:]), d.n_days, SHIPPED, keep=B.within_lookback(90, SHIPPED, d.n_days))
    names = [c for c in rows.columns if c not in ("anchor", "user_id")]
    counted = rows.agg(*[F.count(n).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("n")) for n in names])
    return out(counted.select(F.inline(cells)), ["feature"])


_ONLY = ["gmv_sum_90", "ord_sum_365", "geo3", "buy_days_180", "tenure_days", "gmv_total", "days_30", "aov_90"]


@query("f18_select_columns", features_sql(
    {n: e for n, e in (base_sql() | counts_sql()).items() if n in _ONLY and n not in ("tenure_days", "gmv_total")}))
def f18_select_columns(spark, folder):
    d = order_days(spark, folder)
    keep = B.selected(exclude=["_total$", "^tenure"], only=_ONLY)
    return out(B.build(d.panel, d.index(ANCHORS), d.n_days, ["base", "counts"], keep=keep))
