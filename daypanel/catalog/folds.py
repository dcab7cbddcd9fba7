"""Populations, folds, masks, splits and training tables as queries."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..operators import channels as C
from ..operators import folds as P
from ..operators.windows import Plan, features
from ..sources import panel as S
from .common import (ANCHORS, GUARD_START, IN_POPULATION, ORDER_P, VALID_ANCHORS, anchor_cte, event_days, features_sql,
                     order_days, out, query, s, sql_result)
from .data import DAY, FOLDS, GRID, TRAIN_GRID, fold_rows, train_grid
from .features import GEO3, SHIPPED, base_sql

FOLD = ["fold_id", "anchor_date", "user_id"]

query("p1_population", features_sql({"member": "1"}))(
    lambda spark, folder: (lambda d: out(
        P.population(d.panel, d.index(ANCHORS), d.n_days).withColumn("member", F.lit(1))))(order_days(spark, folder)))


@query("p2_training_grid", sql_result(
    """SELECT fold_id, valid_anchor, train_anchor, count(*) AS n_users FROM (
  SELECT DISTINCT fold_id, valid_anchor, train_anchor, user_id FROM tg, cal, p
  WHERE p.day BETWEEN (train_anchor - dmin) - 29 AND (train_anchor - dmin)) GROUP BY ALL""",
    ["fold_id", "valid_anchor", "train_anchor"], ctes=TRAIN_GRID))
def p2_training_grid(spark, folder):
    d = order_days(spark, folder)
    grid = train_grid(spark, folder)
    sizes = P.population(d.panel, P.anchor_days(grid, d.first), d.n_days).groupBy("anchor").agg(F.count(F.lit(1)).alias("n_users"))
    sizes = sizes.select(S.date_of(F.col("anchor"), d.first).alias("train_anchor"), "n_users")
    return out(sizes.join(F.broadcast(grid), "train_anchor"), ["fold_id", "valid_anchor", "train_anchor"])


query("p3_folds", sql_result("SELECT fold_id, anchor_date, user_id, target FROM folds", FOLD, ctes=FOLDS))(
    lambda spark, folder: out(fold_rows(spark, folder), FOLD))


@query("p3_fold_spec", sql_result(
    """SELECT f.fold_id, f.valid_anchor, n_users, zero_share, n_train, first_train, last_train
FROM (SELECT fold_id, anchor_date AS valid_anchor, count(*) AS n_users, avg(CASE WHEN target <= 0 THEN 1.0 ELSE 0 END) AS zero_share
  FROM folds GROUP BY ALL) f
JOIN (SELECT fold_id, count(*) AS n_train, min(train_anchor) AS first_train, max(train_anchor) AS last_train
  FROM tg GROUP BY fold_id) t ON t.fold_id = f.fold_id""",
    ["fold_id", "valid_anchor", "first_train", "last_train"], ctes=TRAIN_GRID))
def p3_fold_spec(spark, folder):
    spec = P.fold_spec(fold_rows(spark, folder), train_grid(spark, folder))
    return out(spec.select("fold_id", "valid_anchor", "n_users", "zero_share", F.size("train_anchors").alias("n_train"),
                           F.array_min("train_anchors").alias("first_train"), F.array_max("train_anchors").alias("last_train")),
               ["fold_id", "valid_anchor", "first_train", "last_train"])


@query("p4_guard_checks", sql_result(
    f"""SELECT fold_id, anchor_date, count(*) AS n_rows,
  sum(CASE WHEN anchor_date + INTERVAL 30 DAY >= DATE '{VALID_ANCHORS[-1] + timedelta(days=20)}' THEN 1 ELSE 0 END) AS touches_guard,
  sum(CASE WHEN anchor < 89 THEN 1 ELSE 0 END) AS lacks_history FROM folds GROUP BY fold_id, anchor_date""",
    ["fold_id", "anchor_date"], ctes=FOLDS))
def p4_guard_checks(spark, folder):
    d = order_days(spark, folder)
    # The guard is placed so that the last fold breaks the rule.
    return out(P.guard_violations(fold_rows(spark, folder), VALID_ANCHORS[-1] + timedelta(days=20), d.first), ["fold_id", "anchor_date"])


@query("p5_embargo_roles", sql_result(
    """SELECT fold_id, role, count(*) AS n_anchors, sum(n_users) AS n_rows FROM (
  SELECT fold_id, train_anchor, CASE WHEN age = 0 THEN 'tune' WHEN age >= 30 THEN 'fit' ELSE 'embargoed' END AS role, n_users
  FROM (SELECT fold_id, train_anchor, max(train_anchor) OVER (PARTITION BY fold_id) - train_anchor AS age,
    (SELECT count(DISTINCT user_id) FROM p, cal WHERE day BETWEEN (train_anchor - dmin) - 29 AND (train_anchor - dmin)) AS n_users FROM tg))
GROUP BY fold_id, role""", ["fold_id", "role"], ctes=TRAIN_GRID))
def p5_embargo_roles(spark, folder):
    d = order_days(spark, folder)
    roles = P.anchor_roles(train_grid(spark, folder))
    sizes = P.population(d.panel, P.anchor_days(roles, d.first), d.n_days).groupBy("anchor").agg(F.count(F.lit(1)).alias("n_users"))
    sizes = sizes.select(S.date_of(F.col("anchor"), d.first).alias("train_anchor"), "n_users")
    rows = sizes.join(F.broadcast(roles), "train_anchor").groupBy("fold_id", "role").agg(
        F.count(F.lit(1)).alias("n_anchors"), F.sum("n_users").alias("n_rows"))
    return out(rows, ["fold_id", "role"])


_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY train_anchor DESC) AS rn FROM tg) WHERE rn <= 6)"


@query("p6_newest_anchors", sql_result(
    """SELECT fold_id, train_anchor, user_id, sum(gmv) AS gmv_30 FROM newest, cal, p
WHERE p.day BETWEEN (train_anchor - dmin) - 29 AND (train_anchor - dmin) GROUP BY ALL""",
    ["fold_id", "train_anchor", "user_id"], ctes=f"{TRAIN_GRID}, {_NEWEST}"))
def p6_newest_anchors(spark, folder):
    from ..operators.windows import last

    d = order_days(spark, folder)
    grid = P.newest(train_grid(spark, folder), 6)
    plan = Plan(d.n_days)
    rows = features(d.panel, P.anchor_days(grid, d.first), plan, {"gmv_30": plan.total("gmv", last(30))})
    rows = rows.withColumn("train_anchor", S.date_of(F.col("anchor"), d.first))
    return out(rows.join(F.broadcast(grid), "train_anchor").select("fold_id", "train_anchor", "user_id", "gmv_30"),
               ["fold_id", "train_anchor", "user_id"])


# Every training anchor of the last fold: each week back from 30 days before it, as far as 90 days of history
# reach. The order panel begins on the same date at every size.
PANEL_START = date(1995, 1, 1)
TRAIN_DATES = [VALID_ANCHORS[-1] - timedelta(days=30 + 7 * k) for k in range(271)]
TRAIN_DATES = [t for t in TRAIN_DATES if t >= PANEL_START + timedelta(days=89)]
_Y = s("gmv", -30, -1)


def train_days(spark, d) -> list[int]:
    grid = P.training_anchors(P.fold_calendar(spark, VALID_ANCHORS[-1:]), d.first)
    return P.anchor_days(grid, d.first)


def per_anchor(rows, names: list[str], *by: str):
    """Rows and means of every column per anchor, so that a comparison covers each column of a large table."""
    return rows.groupBy("anchor", *by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])


def _means(body: str, names: list[str], *by: str) -> str:
    keys = ", ".join(["anchor", *by])
    return f"SELECT {keys}, count(*) AS n, {', '.join(f'avg({n}) AS {n}' for n in names)} FROM ({body}) GROUP BY {keys}"


_TRAIN_COLS = base_sql()
_TRAIN_SQL = f"""SELECT *, ln(1 + y) AS y_log FROM (SELECT anchor, user_id, {", ".join(f"{e} AS {n}" for n, e in _TRAIN_COLS.items())}, {_Y} AS y
FROM a JOIN p ON p.day <= a.anchor + 30, cal GROUP BY anchor, user_id, n_days HAVING {IN_POPULATION})"""


@query("p7_training_table", sql_result(
    _means(_TRAIN_SQL, [*_TRAIN_COLS, "y", "y_log"]), ["anchor"], digits=4, ctes=f"{ORDER_P}, {anchor_cte(TRAIN_DATES)}"))
def p7_training_table(spark, folder):
    d = order_days(spark, folder)
    rows = P.stacked(d.panel, train_days(spark, d), d.n_days, ["base"])
    return out(per_anchor(rows, [*_TRAIN_COLS, "y", "y_log"]), ["anchor"], digits=4)


_H = ", ".join(f"sum(CASE WHEN day > anchor AND day <= anchor + {h} THEN gmv ELSE 0 END) AS y{h}" for h in (7, 14, 30))
_AUX_SQL = f"""SELECT t.*, h AS horizon, [y7, y14, y30][k] AS y, ln(1 + [y7, y14, y30][k]) AS y_log FROM (
SELECT anchor, user_id, {", ".join(f"{e} AS {n}" for n, e in _TRAIN_COLS.items())}, {_H}
FROM a JOIN p ON p.day <= a.anchor + 30, cal GROUP BY anchor, user_id, n_days HAVING {IN_POPULATION}) t, (VALUES (1, 7), (2, 14), (3, 30)) v(k, h)"""


@query("p8_aux_horizons", sql_result(
    _means(_AUX_SQL, [*_TRAIN_COLS, "y", "y_log"], "horizon"), ["anchor", "horizon"], digits=4, ctes=f"{ORDER_P}, {anchor_cte(TRAIN_DATES)}").replace(
        "SELECT anchor, horizon,", "SELECT anchor, CAST(horizon AS BIGINT) AS horizon,", 1))
def p8_aux_horizons(spark, folder):
    d = order_days(spark, folder)
    rows = P.stacked(d.panel, train_days(spark, d), d.n_days, ["base"], horizons=(7, 14, 30))
    return out(per_anchor(rows, [*_TRAIN_COLS, "y", "y_log"], "horizon"), ["anchor", "horizon"], digits=4)


# All 665 columns and the target on every training anchor. Its series written out day by day would be billions of
# rows for the oracle; single anchors of the same blocks have one, and a test compares the two.
@query("p7_shipped_training")
def p7_shipped_training(spark, folder):
    d = order_days(spark, folder)
    rows = P.stacked(d.panel, train_days(spark, d), d.n_days, SHIPPED)
    return out(per_anchor(rows, [c for c in rows.columns if c not in ("anchor", "user_id")]), ["anchor"], digits=4)


@query("p9_sample_weights", sql_result(
    f"""SELECT anchor, user_id, CASE WHEN y > 0 THEN 2.5 ELSE 1 END AS buyer_weight,
  pow(0.5, (max(anchor) OVER () - anchor) / 60.0) AS decay_weight
FROM (SELECT anchor, user_id, {_Y} AS y FROM a JOIN p ON p.day BETWEEN a.anchor - 29 AND a.anchor + 30 GROUP BY anchor, user_id HAVING {IN_POPULATION})""",
    ctes=f"{ORDER_P}, {anchor_cte(TRAIN_DATES)}"))
def p9_sample_weights(spark, folder):
    d = order_days(spark, folder)
    anchors = train_days(spark, d)
    rows = P.stacked(d.panel, anchors, d.n_days, [])
    return out(rows.select("anchor", "user_id", P.buyer_weight(F.col("y"), 2.5).alias("buyer_weight"),
                           P.decay_weight(max(anchors) - F.col("anchor"), 60).alias("decay_weight")))


@query("p10_exact_sample", sql_result(
    """SELECT anchor, user_id, 1 AS drawn FROM (SELECT anchor, user_id, row_number() OVER (ORDER BY
  CAST('0x' || substr(md5('7:' || anchor || ':' || user_id), 1, 8) AS BIGINT), anchor, user_id) AS rn, count(*) OVER () AS n
  FROM (SELECT DISTINCT anchor, user_id FROM a JOIN p ON p.day BETWEEN anchor - 29 AND anchor))
WHERE rn <= 1000""", ctes=f"{ORDER_P}, {anchor_cte(TRAIN_DATES)}"))
def p10_exact_sample(spark, folder):
    d = order_days(spark, folder)
    rows = P.population(d.panel, train_days(spark, d), d.n_days)
    return out(P.exact_sample(rows, 1000, ["anchor", "user_id"], seed="7").withColumn("drawn", F.lit(1)))


_MD5 = "CAST('0x' || substr(md5('gmv-v1:' || user_id), 1, 8) AS BIGINT)"


@query("p11_user_folds", sql_result(
    f"""SELECT user_id, least(CAST(floor({_MD5} / 4294967295.0::DOUBLE * 5) AS BIGINT), 4) AS fold, count(*) AS n_days
FROM p GROUP BY user_id""", ["user_id", "fold"], ctes=ORDER_P))
def p11_user_folds(spark, folder):
    d = order_days(spark, folder)
    rows = d.panel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_days"))
    return out(rows.withColumn("fold", P.user_fold()), ["user_id", "fold"])


# -- day level, on the event panel: 30 days, so horizon and burn-in are short ---------------------------
H, BURN, POP = 7, 3, 2

_YDAY = f"""(CASE WHEN day <= n_days - {H} - 1 THEN ln(1 + sum(gmv) OVER (PARTITION BY user_id ORDER BY day
  ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING)) ELSE 0 END)"""
MASKED = f"""{GRID}, masked AS (SELECT *, day <= n_days - {H} - 1 AND day >= first_seen + {BURN} AS supervised FROM (
  SELECT g.*, n_days, {_YDAY} AS y_log,
    min(CASE WHEN active > 0 THEN day END) OVER (PARTITION BY user_id) AS first_seen,
    sum(active) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN {POP - 1} PRECEDING AND CURRENT ROW) > 0 AS in_pop
  FROM g, cal))"""


def day_table(spark, folder):
    """Dense event panel with targets and masks, and its calendar."""
    d = event_days(spark, folder)
    rows = S.dense(S.binary_flags(d.panel), d.n_days)
    rows = P.day_targets(rows, d.n_days, H)
    return P.day_masks(rows, P.max_anchor(d.n_days, H), BURN, pop_days=POP), d


def day_query(name: str, body: str, make, keys=DAY, ctes: str = MASKED, **digits):
    def run(spark, folder):
        rows, d = day_table(spark, folder)
        return out(make(rows, d), keys, **digits)

    query(name, sql_result(body, keys, ctes=ctes, **digits))(run)


def _mean_target(rows, d):
    mean = P.day_targets(rows.drop("y_log"), d.n_days, H, agg="mean").withColumnRenamed("y_log", "y_log_mean")
    return P.day_targets(mean, d.n_days, H).select(*DAY, "y_log", "y_log_mean")


day_query("p12_day_targets",
          f"SELECT user_id, day, y_log, CASE WHEN y_log > 0 THEN ln(1 + (exp(y_log) - 1) / {H}) ELSE 0 END AS y_log_mean FROM masked",
          _mean_target)
day_query("p13_max_anchor",
          "SELECT day, count(*) AS n, sum(CASE WHEN y_log > 0 THEN 1 ELSE 0 END) AS buyers, "
          f"day <= (SELECT n_days FROM cal) - {H} - 1 AS whole FROM masked GROUP BY day",
          lambda rows, d: rows.groupBy("day").agg(
              F.count(F.lit(1)).alias("n"), F.sum((F.col("y_log") > 0).cast("long")).alias("buyers"),
              F.first(F.col("day") <= P.max_anchor(d.n_days, H)).alias("whole")), ["day"])
day_query("p14_supervised",
          f"SELECT user_id, day, supervised, day <= n_days - {H} - 1 AND day >= {BURN} AS from_start FROM masked",
          lambda rows, d: P.day_masks(rows.withColumnRenamed("supervised", "s").drop("in_pop"), P.max_anchor(d.n_days, H), BURN, False)
          .select(*DAY, F.col("s").alias("supervised"), F.col("supervised").alias("from_start")))
day_query("p15_daily_population", "SELECT user_id, day, in_pop FROM masked", lambda rows, d: rows.select(*DAY, "in_pop"))

CUT, CLEAN = 10, 20
_ROLE = f"""CASE WHEN NOT supervised THEN 'none' WHEN day <= {CUT} THEN 'in_calendar' WHEN day < {CUT + H} THEN 'embargo'
  WHEN day <= {CLEAN} THEN 'forward_clean' ELSE 'forward' END"""
day_query("p16_calendar_split", f"SELECT user_id, day, {_ROLE} AS role, y_log FROM masked",
          lambda rows, d: rows.select(*DAY, P.calendar_role(CUT, CLEAN, H).alias("role"), "y_log"), ["user_id", "day", "role"])
day_query("p17_train_cap", f"SELECT user_id, day, supervised AND day <= 21 AS train, supervised AND day <= {CLEAN} AS score FROM masked",
          lambda rows, d: rows.select(*DAY, *[c.alias(n) for n, c in P.capped_masks(21, CLEAN).items()]))
day_query("p18_stride", "SELECT user_id, day, supervised AND day IN (22, 15, 8, 1) AS kept FROM masked",
          lambda rows, d: rows.select(*DAY, (F.col("supervised") & P.strided(P.max_anchor(d.n_days, H), 7)).alias("kept")))
day_query("p19_day_weight",
          f"SELECT day, count(*) AS cells, pow(0.5, ((SELECT n_days FROM cal) - {H} - 1 - day) / 10.0) AS weight, "
          f"pow(0.5, ((SELECT n_days FROM cal) - {H} - 1 - day) / 10.0) * count(*) AS mass FROM masked WHERE supervised GROUP BY day",
          lambda rows, d: rows.filter("supervised").groupBy("day").agg(
              F.count(F.lit(1)).alias("cells"), F.max(P.day_weight(P.max_anchor(d.n_days, H), 10)).alias("weight"),
              F.sum(P.day_weight(P.max_anchor(d.n_days, H), 10)).alias("mass")), ["day"])

EPOCHS, START = 6, 0.3
_CUM = f"""{MASKED}, cells AS (SELECT day, count(*) FILTER (supervised) AS n FROM masked, cal WHERE day <= cal.n_days - {H} - 1 GROUP BY day),
cum AS (SELECT day, n, sum(n) OVER (ORDER BY day) AS upto, sum(n) OVER (ORDER BY day) - n AS before,
  sum(n) OVER () AS total, max(day) OVER () AS last_day FROM cells),
ep AS (SELECT CAST(e AS BIGINT) AS epoch, least(1.0::DOUBLE, e / {EPOCHS - 1}.0::DOUBLE) AS f FROM range({EPOCHS}) r(e))"""
_EXPAND = f"""SELECT epoch, 0 AS lo, least(greatest(min(CASE WHEN upto >= total * {START}::DOUBLE + f * (total - total * {START}::DOUBLE) THEN day END), 0), max(last_day)) AS hi
FROM cum, ep GROUP BY epoch"""
_SLIDE = f"""SELECT epoch, lo, CASE WHEN f >= 1 THEN (SELECT max(day) FROM cum) ELSE greatest(lo, coalesce((SELECT min(day) FROM cum
    WHERE upto >= (SELECT before FROM cum c2 WHERE c2.day = lo) + total * {START}::DOUBLE), (SELECT max(day) FROM cum))) END AS hi
FROM (SELECT epoch, f, least(coalesce((SELECT min(day) FROM cum WHERE before >= f * (SELECT before FROM cum c3 WHERE c3.day = lo_max)), lo_max), lo_max) AS lo
  FROM ep, (SELECT coalesce(min(day), (SELECT max(day) FROM cum)) AS lo_max FROM cum WHERE before >= total - total * {START}::DOUBLE))"""


def _cells(rows, d):
    return rows.groupBy("day").agg(F.sum(F.col("supervised").cast("long")).alias("n"))


day_query("p20_mass_windows_expand", _EXPAND,
          lambda rows, d: P.mass_windows(_cells(rows, d), P.max_anchor(d.n_days, H), EPOCHS, START, "expand"), ["epoch"], ctes=_CUM)
day_query("p20_mass_windows_slide", _SLIDE,
          lambda rows, d: P.mass_windows(_cells(rows, d), P.max_anchor(d.n_days, H), EPOCHS, START, "slide"), ["epoch"], ctes=_CUM)
day_query("p20_mass_windows_shuffled",
          f"""SELECT epoch, lo, hi, row_number() OVER (ORDER BY CAST('0x' || substr(md5('12345:' || epoch), 1, 8) AS BIGINT), epoch) - 1 AS turn
FROM ({_EXPAND})""",
          lambda rows, d: P.shuffled_epochs(P.mass_windows(_cells(rows, d), P.max_anchor(d.n_days, H), EPOCHS, START, "expand"), "12345"),
          ["epoch"], ctes=_CUM)
day_query("p21_thinned_cells",
          """SELECT user_id, day, y_log FROM masked WHERE supervised
  AND CAST('0x' || substr(md5('3:' || user_id || ':' || day), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.25""",
          lambda rows, d: P.thinned(rows.filter("supervised"), 0.25, DAY, "3").select(*DAY, "y_log"))

BASE_CH = ["presence", "buy", "searches", "cat", "s2c", "c2c", "s2o", "c2o", "gmvs", "gmvc", "cart", "ord", "gmv"]
_B = {"presence": "active", "buy": "CASE WHEN gmv > 0 THEN 1 ELSE 0 END", "searches": "ln(1 + srch)", "cat": "cev",
      "s2c": "ln(1 + s2c)", "c2c": "ln(1 + c2c)", "s2o": "ln(1 + s2o)", "c2o": "ln(1 + c2o)", "gmvs": "ln(1 + gmvs)",
      "gmvc": "ln(1 + gmvc)", "cart": "ln(1 + cart)", "ord": "ln(1 + ord)", "gmv": "ln(1 + gmv)"}
_BASE_CTE = f"{MASKED}, b AS (SELECT user_id, day, {', '.join(f'{e} AS {n}' for n, e in _B.items())} FROM masked)"
_FLAGS = ("presence", "buy", "cat")


def _scaler_sql(where: str) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{n}' AS channel, " + ("0 AS mu, 1 AS sd" if n in _FLAGS else f"avg({n}) AS mu, greatest(stddev_pop({n}), 1e-3) AS sd")
        + f" FROM b WHERE {where}" + (" HAVING count(*) > 0" if n in _FLAGS else "") for n in BASE_CH)


_TRAIN_USERS = f"least(CAST(floor({_MD5} / 4294967295.0::DOUBLE * 5) AS BIGINT), 4) <> 2 AND day <= 20"


@query("p22_scaler", sql_result(_scaler_sql(_TRAIN_USERS), ["channel"], ctes=_BASE_CTE))
def p22_scaler(spark, folder):
    rows, d = day_table(spark, folder)
    train = C.base_channels(rows).filter((P.user_fold() != 2) & (F.col("day") <= 20))
    return out(C.scaler(train, BASE_CH), ["channel"])


@query("p22_scaler_systematic", sql_result(
    _scaler_sql("user_id IN (SELECT user_id FROM (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i "
                "FROM (SELECT DISTINCT user_id FROM b)) WHERE i % 7 = 0)"), ["channel"], ctes=_BASE_CTE))
def p22_scaler_systematic(spark, folder):
    rows, d = day_table(spark, folder)
    return out(C.scaler(C.every_kth_user(C.base_channels(rows), 7), BASE_CH), ["channel"])


_TS = ["searches", "gmv", "ord", "presence"]
_TS_SQL = "\nUNION ALL ".join(
    f"SELECT day, '{n}' AS channel, " + ("0 AS mu, 1 AS sd FROM mom" if n in _FLAGS else
    f"""avg(m_{n}) OVER w AS mu, least(greatest(sqrt(greatest(avg(q_{n}) OVER w - pow(avg(m_{n}) OVER w, 2), 0)), 1e-3),
  100 * greatest(sqrt(greatest(avg(q_{n}) OVER () - pow(avg(m_{n}) OVER (), 2), 0)), 1e-3)) AS sd
FROM mom WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""") for n in _TS)


@query("p23_trailing_scaler", sql_result(_TS_SQL, ["day", "channel"], ctes=_BASE_CTE + ", mom AS (SELECT day, "
       + ", ".join(f"avg({n}) AS m_{n}, avg({n} * {n}) AS q_{n}" for n in _TS) + " FROM b GROUP BY day)"))
def p23_trailing_scaler(spark, folder):
    rows, d = day_table(spark, folder)
    return out(C.trailing_scaler(C.base_channels(rows), _TS, days=7), ["day", "channel"])


@query("p24_population_drift", sql_result(
    f"""SELECT anchor_date, sum(CASE WHEN f AND t THEN 1 ELSE 0 END) AS in_both,
  sum(CASE WHEN f AND NOT t THEN 1 ELSE 0 END) AS only_in_folds, sum(CASE WHEN t AND NOT f THEN 1 ELSE 0 END) AS only_in_table
FROM (SELECT va.anchor_date, user_id, bool_or(day BETWEEN anchor - 29 AND anchor) AS f, bool_or(day BETWEEN anchor - 44 AND anchor - 15) AS t
  FROM va JOIN p ON day BETWEEN anchor - 44 AND anchor GROUP BY va.anchor_date, user_id) WHERE f OR t GROUP BY anchor_date""",
    ["anchor_date"], ctes=FOLDS))
def p24_population_drift(spark, folder):
    d = order_days(spark, folder)
    # The feature table is built half a month early, so that the check has something to find.
    early = P.population(d.panel, [a - 15 for a in d.index(VALID_ANCHORS)], d.n_days)
    table = early.select(S.date_of(F.col("anchor") + 15, d.first).alias("anchor_date"), "user_id")
    return out(P.population_drift(fold_rows(spark, folder), table), ["anchor_date"])


@query("p24_population_aligned", sql_result(
    "SELECT anchor_date, count(*) AS in_both, 0 AS only_in_folds, 0 AS only_in_table FROM folds GROUP BY anchor_date",
    ["anchor_date"], ctes=FOLDS))
def p24_population_aligned(spark, folder):
    d = order_days(spark, folder)
    pop = P.population(d.panel, d.index(VALID_ANCHORS), d.n_days)
    table = pop.select(S.date_of(F.col("anchor"), d.first).alias("anchor_date"), "user_id")
    return out(P.population_drift(fold_rows(spark, folder), table), ["anchor_date"])


day_query("p25_day_range", f"SELECT user_id, day, y_log FROM masked WHERE in_pop AND day BETWEEN 5 AND 25 - {H}",
          lambda rows, d: rows.filter(F.col("in_pop") & F.col("day").between(5, 25 - H)).select(*DAY, "y_log"))


@query("p26_residual_target", sql_result(
    f"""SELECT anchor, user_id, ln(1 + y) - ln(1 + geo3) AS resid, ln(1 + y) AS restored
FROM (SELECT anchor, user_id, {GEO3} AS geo3, {_Y} AS y FROM a JOIN p ON p.day <= a.anchor + 30
  GROUP BY anchor, user_id HAVING {IN_POPULATION})""", ctes=f"{ORDER_P}, {anchor_cte(ANCHORS)}"))
def p26_residual_target(spark, folder):
    from ..operators.windows import ahead

    d = order_days(spark, folder)
    plan = Plan(d.n_days)
    rows = features(d.panel, d.index(ANCHORS), plan, {"geo3": plan.geo3(), "y": plan.total("gmv", ahead(30))})
    rows = rows.withColumn("resid", P.residual(F.log1p("y"), F.col("geo3")))
    return out(rows.select("anchor", "user_id", "resid", P.with_baseline(F.col("resid"), F.col("geo3")).alias("restored")))


FINAL_LAST = GUARD_START - timedelta(days=31)


@query("p27_final_fit", sql_result(
    f"""SELECT train_anchor, count(DISTINCT user_id) AS n_users, (SELECT count(*) FROM (SELECT user_id FROM p GROUP BY user_id
    HAVING max(day) < (SELECT n_days FROM cal) - 30)) AS scored_outside_population
FROM (SELECT CAST(unnest(range(DATE '{FINAL_LAST}', dmin + INTERVAL 88 DAY, INTERVAL (-7) DAY)) AS DATE) AS train_anchor FROM cal), cal, p
WHERE p.day BETWEEN (train_anchor - dmin) - 29 AND (train_anchor - dmin) GROUP BY train_anchor""",
    ["train_anchor"], ctes=ORDER_P))
def p27_final_fit(spark, folder):
    d = order_days(spark, folder)
    grid = P.training_anchors(P.fold_calendar(spark, [GUARD_START - timedelta(days=1)]), d.first, gap=30)
    sizes = P.population(d.panel, P.anchor_days(grid, d.first), d.n_days).groupBy("anchor").agg(F.count(F.lit(1)).alias("n_users"))
    late = d.panel.groupBy("user_id").agg(F.max("day").alias("seen")).agg(
        F.sum((F.col("seen") < d.n_days - 30).cast("long")).alias("scored_outside_population"))
    rows = sizes.join(F.broadcast(late)).select(
        S.date_of(F.col("anchor"), d.first).alias("train_anchor"), "n_users", "scored_outside_population")
    return out(rows, ["train_anchor"])


# The set itself: features and targets on every clean anchor, and the rows to score on the last day.
_FINAL_DATES = [FINAL_LAST - timedelta(days=7 * k) for k in range(300) if FINAL_LAST - timedelta(days=7 * k) >= PANEL_START + timedelta(days=89)]
_FINAL_ROWS = f"""SELECT anchor, anchor = (SELECT n_days - 1 FROM cal) AS scored, {", ".join(_TRAIN_COLS)},
  CASE WHEN anchor = (SELECT n_days - 1 FROM cal) THEN 0 ELSE ln(1 + y) END AS y_log FROM (
SELECT anchor, user_id, {", ".join(f"{e} AS {n}" for n, e in _TRAIN_COLS.items())}, {_Y} AS y
FROM (SELECT anchor FROM a UNION ALL SELECT n_days - 1 FROM cal) a JOIN p ON p.day <= a.anchor + 30, cal GROUP BY anchor, user_id, n_days HAVING {IN_POPULATION})"""


@query("p27_final_fit_set", sql_result(
    f"SELECT anchor, scored, count(*) AS n, {', '.join(f'avg({n}) AS {n}' for n in [*_TRAIN_COLS, 'y_log'])} FROM ({_FINAL_ROWS}) GROUP BY anchor, scored",
    ["anchor", "scored"], digits=4, ctes=f"{ORDER_P}, {anchor_cte(_FINAL_DATES)}"))
def p27_final_fit_set(spark, folder):
    d = order_days(spark, folder)
    grid = P.training_anchors(P.fold_calendar(spark, [GUARD_START - timedelta(days=1)]), d.first, gap=30)
    rows = P.final_set(d.panel, P.anchor_days(grid, d.first), d.n_days, ["base"])
    return out(per_anchor(rows, [*_TRAIN_COLS, "y_log"], "scored"), ["anchor", "scored"], digits=4)
